"""Score against instability over a parameter grid."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import RANGE_ROWS, in_ranges, score_by
from ..sources.shared import dropped
from ..sources.tables import require_columns, require_scalar
from .audit import TASKS, audited_all, columns_of, demand, prepare, require_probabilities, summarised
from .sampling import holdout_split, param_grid


METRICS = ("pairwise", "mape")
SUPPLIED, HELD_OUT = "user_supplied_validation_data", "internal_validation_split"


def _skyline(score: np.ndarray, instability: np.ndarray) -> np.ndarray:
    """Places of the points that no other one beats, equal ones all."""
    if not len(score):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((instability, -score))
    s, i = score[order], instability[order]
    new = np.append(True, s[1:] != s[:-1])
    least = i[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the least of the same score
    higher = np.append(np.inf, np.minimum.accumulate(i)[:-1])[np.flatnonzero(new)[np.cumsum(new) - 1]]  # and of all higher scores
    return order[(i == least) & ((i < higher) | (s == s[0]))]


def undominated(points: DataFrame, instability_key: str = "instability", rows: int = RANGE_ROWS) -> DataFrame:
    """Rows that no other row beats: at least its score and at most its instability, one of them strictly.

    A NaN or null neither beats nor is beaten. Each task keeps the pairs of
    numbers that none of its own beats. What is left is dealt into ranges by
    falling score; a range's least instability is passed on to the ranges
    behind it, and inside each a running least decides. So no two points are
    compared one by one, and no range holds more than its share however many
    points are undominated.
    """
    score, i = F.col("score").cast("double"), F.col(instability_key).cast("double")
    known = score.isNotNull() & i.isNotNull() & ~F.isnan(score) & ~F.isnan(i)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, waiting, size = np.zeros((2, 0)), [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting.append(np.stack([c.to_numpy() for c in batch.columns]))
                size += batch.num_rows
            if batch is None or size > max(1 << 16, left.shape[1]):
                left = np.hstack([left, *waiting])
                left, waiting, size = np.unique(left[:, _skyline(*left)], axis=1), [], 0
        if left.size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in left], names=["s_", "i_"])

    pairs = points.where(known).select(score.alias("s_"), i.alias("i_")).mapInArrow(local, "s_ double, i_ double").groupBy("s_").agg(F.min("i_").alias("i_"))
    placed = in_ranges(pairs, F.desc("s_"), rows=rows)
    least = placed.groupBy("part_").agg(F.min("i_").alias("least_"))  # a row a range
    before = least.select(F.col("part_").alias("of_"), F.min("least_").over(Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)).alias("before_"))
    inside = F.min("i_").over(Window.partitionBy("part_").orderBy(F.desc("s_")).rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.withColumn("inside_", inside).join(F.broadcast(before), F.col("part_") == F.col("of_"))
    higher = F.least("inside_", "before_")  # null where nothing scores more
    best = joined.where(higher.isNull() | (F.col("i_") < higher)).select("s_", "i_")
    return points.where(known).join(best, (score == F.col("s_")) & (i == F.col("i_")), "left_semi").unionByName(points.where(~F.coalesce(known, F.lit(False))))


def pareto_front(points: DataFrame, instability_key: str = "instability", order: str = "config_id") -> DataFrame:
    """The undominated rows, one of those equal to 12 decimals, by falling score; ``order`` decides among equals."""
    require_columns(points, "score", instability_key, order)
    same = Window.partitionBy(F.bround("score", 12), F.bround(instability_key, 12)).orderBy(F.desc("score"), order)
    front = undominated(points, instability_key).withColumn("n_", F.row_number().over(same)).where("n_ = 1").drop("n_")
    return front.orderBy(F.desc("score"), order)


POINTS = "config_id int, params map<string,string>, score double, instability double, instability_standard_error double, pairwise double, pairwise_standard_error double, mape double, mape_standard_error double, n_resample_attempts long, n_rejected_resamples long"


@dataclass
class Frontier:
    points: DataFrame
    frontier: DataFrame
    n_fits: int
    seconds: float
    task: str
    score_name: str
    instability_metric: str
    prediction_method: str
    evaluation_source: str

    def metadata(self) -> dict:
        return {k: getattr(self, k) for k in ("n_fits", "seconds", "task", "score_name", "instability_metric", "prediction_method", "evaluation_source")}


def stability_frontier(procedure_factory: Callable, grid, data: DataFrame, task: str = "continuous", *, cases: DataFrame | None = None, key: str = "rid", target: str = "y", n_bootstrap: int = 20, test_size: float = 0.3, seed: int = 0, prediction_method: str = "predict", instability_metric: str = "pairwise") -> Frontier:
    """One point a configuration: score of the original fit, and how far refits move.

    Without ``cases`` (case_id, y, features), a share of ``data`` is held out,
    by class for labels. All configurations share split and resamples.
    """
    demand((task in TASKS, f"no such task: {task!r}"), (n_bootstrap > 1, f"a spread needs two refits, not {n_bootstrap}"), (instability_metric in METRICS, f"no such instability metric: {instability_metric!r}"))
    require_columns(data, key, target)
    require_scalar(data, target)
    began, source = time.perf_counter(), SUPPLIED
    train = data
    if cases is None:
        split = holdout_split(data, key, test_size, f"{seed}|split", target if task == "categorical" else None)
        train, cases, source = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test").withColumnRenamed(key, "case_id"), HELD_OUT
    else:
        require_columns(cases, "case_id", target)
    truth = cases.select("case_id", F.col(target).cast("double" if task == "continuous" else "string").alias("y"))
    configs = param_grid(grid)
    demand((bool(configs), "a grid without configurations"))
    procedures = {i: procedure_factory(**params) for i, params in enumerate(configs)}
    if prediction_method == "predict_proba":
        for p in procedures.values():
            require_probabilities(p)
    finite = sorted({c for p in procedures.values() for c in getattr(p, "finite", ())})
    told = cases.withColumn("truth_", F.col(target).cast("double" if task == "continuous" else "string"))
    prepared = prepare(train, told, key=key, target=target, task=task, n_bootstrap=n_bootstrap, prediction_method=prediction_method, seed=seed, finite=finite, columns=columns_of(list(procedures.values())))
    audit = audited_all(prepared, procedures, prediction_method, also=["truth_"] if prediction_method == "predict" else [])
    if audit.own_ids and audit.kind != "vector":
        # each case has its truth beside its predictions: scores come with the sums
        mean = prepared.cases.agg(F.sum("truth_") / F.count("*")).first()[0] if audit.kind == "numeric" else None
        error, spread = F.col("score_error"), F.col("score_spread")
        r2 = F.when(spread == 0, F.when(error == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(error, spread))
        scored = summarised(audit, {"truth": "truth_", "mean": mean}).withColumn("score", r2 if audit.kind == "numeric" else F.try_divide(error, spread))
    else:
        scored = summarised(audit).join(score_by(audit.original_labels.withColumnRenamed("pred0", "pred").join(truth, "case_id"), ["config_id"], task), "config_id")
    rows = []
    for r in scored.orderBy("config_id").collect():  # a row a configuration
        instability, error = (r.pairwise_mean, r.pairwise_standard_error) if instability_metric == "pairwise" else (r.mape, r.mape_standard_error)
        rows.append((r.config_id, {k: str(v) for k, v in configs[r.config_id].items()}, r.score, instability, error, r.pairwise_mean, r.pairwise_standard_error, r.mape, r.mape_standard_error, r.n_resample_attempts, r.n_rejected_resamples))
    audit.release()
    if source != SUPPLIED:
        dropped(split)
    points = data.sparkSession.createDataFrame(rows, POINTS)
    return Frontier(points, pareto_front(points), len(configs) * (n_bootstrap + 1), time.perf_counter() - began, task, "accuracy" if task == "categorical" else "r2", instability_metric, prediction_method, source)


def within_of_best(points: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Rows whose score is within ``tolerance`` of the best."""
    best = points.agg(F.max("score").alias("best_"))
    return points.crossJoin(F.broadcast(best)).where(F.col("score") >= F.col("best_") - tolerance).drop("best_")


def most_stable(points: DataFrame, instability_key: str = "instability") -> DataFrame:
    """The row of least instability, ties to the higher score, then the smaller config_id."""
    return points.orderBy(instability_key, F.desc("score"), "config_id").limit(1)
