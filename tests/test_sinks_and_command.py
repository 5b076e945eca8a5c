"""Sinks, the command line, and small results that no query shows."""

import json

import pytest

import tremorscope as ts
from tremorscope.__main__ import main
from tremorscope.operators.frontier import most_stable, within_of_best
from tremorscope.operators.plotdata import class_codes, opacity
from tremorscope.operators.procedures import Ols
from tremorscope.operators.trees import RegressionTree
from tremorscope.sources.shared import dropped, stored
from tremorscope.sources.tables import write_json, write_parquet

from .test_audit import table


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", 0.5), (1, None, float("nan"))], "z int, a string, m double")
    write_json(rows, f"{tmp_path}/j")
    lines = sorted(line for f in (tmp_path / "j").glob("*.json") for line in f.read_text().splitlines())
    assert lines[0].startswith('{"a":"b","m":0.5,"z":2}') and list(json.loads(lines[0])) == ["a", "m", "z"]
    write_parquet(rows, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    kept = stored(rows, "test")
    assert kept.count() == 2
    dropped(kept)
    dropped(rows)
    with pytest.raises(Exception):
        spark.read.parquet(kept.stored_at)


def test_command(spark, tmp_path, capsys):
    train, cases = table(spark)
    train.write.parquet(f"{tmp_path}/train")
    cases.write.parquet(f"{tmp_path}/cases")
    shown = main(["--train", f"{tmp_path}/train", "--cases", f"{tmp_path}/cases", "--feature", "x", "--output", f"{tmp_path}/out", "--n-bootstrap", "4", "--penalties", "0,50", "--seed", "3"])
    want = ts.bootstrap_instability(train, cases, Ols("x"), n_bootstrap=4, seed=3).first()
    assert shown["pairwise_mean"] == pytest.approx(want.pairwise_mean) and shown["frontier"]["n_fits"] == 10
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["n_fit_attempts"] == 5
    assert spark.read.parquet(f"{tmp_path}/out/case_stats").count() == 20 and spark.read.json(f"{tmp_path}/out/frontier").count() == 2


def test_choices_and_codes(spark):
    points = spark.createDataFrame([(0, 0.90, 3.0), (1, 0.89, 1.0), (2, 0.885, 1.0), (3, 0.5, 0.1)], "config_id int, score double, instability double")
    near = within_of_best(points)
    assert {r.config_id for r in near.collect()} == {0, 1, 2} and most_stable(near).first().config_id == 1
    assert class_codes(spark.createDataFrame([("b",), ("a",)], "class string")) == {"a": 0, "b": 1}
    assert [opacity(n) for n in (0, 10_000, 60_000, 10**7)] == [0.35, 0.3, 0.05, 0.02]


def test_tree_procedure(spark):
    train, cases = table(spark)
    tree = RegressionTree(["x"], {"x": [-0.5, 0.0, 0.5]}, depth=2)
    audit = ts.bootstrap_predictions(train, cases, tree, n_bootstrap=3)
    assert audit.predictions.count() == 60 and audit.case_stats.where("per_point >= 0").count() == 20
    shown = ts.plot_prediction_instability(audit)
    assert shown["style"].first().opacity == 0.35 and shown["scatter"].count() == 60
