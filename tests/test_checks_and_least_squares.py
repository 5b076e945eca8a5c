"""What audits refuse, and least squares on one feature and several against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tremorscope as ts
from tremorscope.operators.procedures import ClassShares, GroupMean, Mean, Ols
from tremorscope.sources.tables import checked

NAN, INF = float("nan"), float("inf")


def rows(spark, *changed, n=40):
    """A clean table, with (column, row, value) changed."""
    cells = [{"rid": i, "y": float(i % 7), "x": float(i), "g": "ab"[i % 2]} for i in range(n)]
    for name, i, value in changed:
        cells[i][name] = value
    return spark.createDataFrame([(c["rid"], c["y"], c["x"], c["g"]) for c in cells], "rid long, y double, x double, g string")


def cases(spark, *changed):
    return rows(spark, *changed, n=10).withColumnRenamed("rid", "case_id")


@pytest.mark.parametrize("change, words", [(("y", 3, None), "y is null in 1"), (("y", 3, NAN), "y is NaN"), (("y", 3, -INF), "y is infinite"), (("x", 5, None), "x is null"), (("x", 5, NAN), "x is NaN"), (("x", 5, INF), "x is infinite"), (("rid", 0, None), "rid is null")])
def test_audits_refuse_training_rows(spark, change, words):
    with pytest.raises(ValueError, match=words):
        ts.bootstrap_predictions(rows(spark, change), cases(spark), Ols("x"), n_bootstrap=2)


@pytest.mark.parametrize("change", [("x", 2, None), ("x", 2, NAN), ("rid", 2, None)])
def test_audits_refuse_cases(spark, change):
    with pytest.raises(ValueError, match="cases"):
        ts.bootstrap_predictions(rows(spark), cases(spark, change), Ols("x"), n_bootstrap=2)


def test_audits_refuse_types_and_labels(spark):
    good, held = rows(spark), cases(spark)
    for bad in (good.withColumn("x", F.lit("one")), good.withColumn("y", F.lit("one")), good.withColumn("x", F.array("x"))):
        with pytest.raises(ValueError, match="not numbers|one value"):
            ts.bootstrap_predictions(bad, held, Ols("x"), n_bootstrap=2)
    for bad in (good.withColumn("y", F.when(F.col("rid") > 0, F.col("g"))), good.withColumn("y", F.when(F.col("rid") > 0, F.col("y")).otherwise(NAN))):
        with pytest.raises(ValueError, match="y is null in 1 of 40"):
            ts.bootstrap_predictions(bad, held, ClassShares("g"), task="categorical", n_bootstrap=2)
    with pytest.raises(ValueError, match="no rows"):
        checked(good.limit(0), "these", ["x"])
    # a group that isn't known takes the mean of all, so a missing one is no error
    ts.bootstrap_predictions(rows(spark, ("g", 1, None)), cases(spark, ("g", 1, None)), GroupMean("g"), n_bootstrap=2).release()


def test_selector_and_frontier_refuse(spark):
    for change in (("y", 3, None), ("y", 3, NAN), ("x", 3, NAN)):
        with pytest.raises(ValueError, match="rows: "):
            ts.RepresentativeEstimator(Ols("x"), "regression", 3).fit(rows(spark, change))
        with pytest.raises(ValueError, match="training rows: "):
            ts.stability_frontier(lambda penalty: Ols("x", penalty), {"penalty": [0.0]}, rows(spark, change), cases=cases(spark), n_bootstrap=2)


def fitted(spark, procedure, table, at):
    weighted = table.withColumn("draw", F.lit(1))
    held = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(at)], "case_id long, " + ", ".join(f"{c} double" for c in procedure.finite))
    return [r.pred for r in procedure.predict(procedure.fit(weighted), held).orderBy("case_id").collect()]


def test_rows_without_a_value_do_not_count(spark):
    some = spark.createDataFrame([(1, float(i), float(i)) for i in range(70)] + [(2, 5.0, None)] * 10 + [(2, None, 3.0)] * 5 + [(2, 1.0, NAN)], "w long, y double, x double")
    assert fitted(spark, Ols("x"), some, [[6.0]]) == pytest.approx([6.0])
    gaps = spark.createDataFrame([(1, 3.0, "a")] * 70 + [(1, None, "a")] * 30, "w long, y double, g string").withColumn("draw", F.lit(1))
    assert Mean().fit(gaps).first().pred == pytest.approx(3.0) and GroupMean("g").fit(gaps).first().value == pytest.approx(3.0)


@pytest.mark.parametrize("penalty", [0.0, 25.0])
def test_several_features_as_by_numpy(spark, penalty):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.01, 3] + [0, 1e3, 5, -2]
    y = x @ [1.0, -2.0, 30.0, 0.5] + rng.normal(size=300)
    w = rng.integers(1, 4, 300)
    table = spark.createDataFrame([(int(a), float(b), *map(float, c)) for a, b, c in zip(w, y, x, strict=True)], "w long, y double, a double, b double, c double, d double").repartition(7)
    centre, level = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    z = x - centre
    slope = np.linalg.solve((z * w[:, None]).T @ z + penalty * np.eye(4), (z * w[:, None]).T @ (y - level))
    assert fitted(spark, Ols(["a", "b", "c", "d"], penalty), table, x[:5]) == pytest.approx((level + z[:5] @ slope).tolist(), rel=1e-9)


def test_large_offsets_and_flat_columns(spark):
    at = 1e9
    table = spark.createDataFrame([(1, 1000 + 2.0 * i, at + i, 5.0) for i in range(-50, 50)], "w long, y double, x double, flat double").repartition(5)
    assert fitted(spark, Ols("x"), table, [[at + 6]]) == pytest.approx([1012.0], abs=1e-5)
    assert fitted(spark, Ols(["x", "flat"]), table, [[at + 6, 5.0]]) == pytest.approx([1012.0], abs=1e-5)
    assert fitted(spark, Ols("flat"), table, [[5.0]]) == pytest.approx([999.0])
    twice = table.withColumn("again", F.col("x"))
    assert fitted(spark, Ols(["x", "again"]), twice, [[at + 6, at + 6]]) == pytest.approx([1012.0], abs=1e-4)
    one = spark.createDataFrame([(3, 7.0, 2.0)], "w long, y double, x double")
    assert fitted(spark, Ols("x"), one, [[9.0]]) == pytest.approx([7.0])
