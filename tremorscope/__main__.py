"""python -m tremorscope --train T --cases C --feature X --output DIR: an audit from the command line.

Tables are Parquet paths. DIR gets the summary and a one-line JSON of it, the
case statistics, and a frontier over ridge penalties of the first feature.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.audit import bootstrap_predictions, summarised
from .operators.frontier import stability_frontier
from .operators.procedures import Ols
from .sources.tables import write_json, write_parquet


def main(argv: Sequence[str] | None = None) -> dict:
    """Runs the audit and the frontier, writes their tables, and returns (and prints) the summary."""
    parser = argparse.ArgumentParser(prog="tremorscope", description=__doc__)
    for name in ("--train", "--cases", "--output"):
        parser.add_argument(name, required=True)
    parser.add_argument("--key", default="rid")
    parser.add_argument("--target", default="y")
    parser.add_argument("--feature", required=True, help="the number that least squares uses")
    parser.add_argument("--penalties", default="0,1,10,100", help="ridge penalties of the frontier")
    parser.add_argument("--n-bootstrap", type=int, default=20)
    parser.add_argument("--seed", type=int, default=0)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    train, cases = spark.read.parquet(given.train), spark.read.parquet(given.cases)
    options = {"key": given.key, "target": given.target, "n_bootstrap": given.n_bootstrap, "seed": given.seed}
    audit = bootstrap_predictions(train, cases, Ols(given.feature), **options)
    summary = summarised(audit)
    write_parquet(audit.case_stats, f"{given.output}/case_stats")
    write_json(summary, f"{given.output}/summary")
    grid = {"penalty": [float(x) for x in given.penalties.split(",")]}
    frontier = stability_frontier(lambda penalty: Ols(given.feature, penalty), grid, train, cases=cases, **options)
    write_json(frontier.points.withColumn("on_frontier", F.col("config_id").isin([r.config_id for r in frontier.frontier.collect()])), f"{given.output}/frontier")
    audit.release()
    shown = spark.read.json(f"{given.output}/summary").first().asDict() | {"frontier": frontier.metadata()}
    print(json.dumps(shown, sort_keys=True))
    return shown


if __name__ == "__main__":
    main()
