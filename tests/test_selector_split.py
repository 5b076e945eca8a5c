"""Splits by class order one bucket, and the selector's labels stay by row."""

from pyspark.sql import functions as F

import tremorscope as ts
from tremorscope.operators import audit as au
from tremorscope.operators import representative, sampling
from tremorscope.operators.procedures import ClassShares


def test_a_split_by_class_orders_one_bucket_of_each(spark):
    rows = spark.range(3000).select(F.col("id").alias("rid"), F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("g"))
    found = sampling.holdout_split(rows, "rid", 0.3, "s", "g")
    placed = sampling.numbered(rows, "rid", "s", "g").join(rows.groupBy(F.col("g").alias("k")).count(), F.col("g").eqNullSafe(F.col("k")))
    want = {(r.rid, r.g, r.t) for r in placed.select("rid", "g", (F.col("idx") < F.ceil(F.col("count") * F.lit(0.3))).alias("t")).collect()}
    assert {(r.rid, r.g, r.is_test) for r in found.collect()} == want and found.columns == ["rid", "g", "is_test"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    again = sampling.holdout_split(rows.withColumn("rid", F.lit(5)), "rid", 0.3, "s", "g")  # a common key fills one bucket
    assert {(r.g, r["count"]) for r in again.where("is_test").groupBy("g").count().collect()} == {(r.g, -(-3 * r["count"] // 10)) for r in rows.groupBy("g").count().collect()}


def test_own_ids_spare_the_selector_its_exchange(spark, monkeypatch):
    data = spark.range(900).select(F.col("id").alias("rid"), (F.col("id") % 11).cast("string").alias("g"), F.concat(F.lit("c"), F.pmod(F.hash("id"), F.lit(3))).alias("y"))
    rows = lambda table: sorted(map(tuple, table.select(*sorted(table.columns)).collect()))
    fit = lambda: ts.RepresentativeEstimator(ClassShares("g"), "classification", 5, "disagreement", 0.3, seed=3).fit(data)
    before = fit()
    monkeypatch.setattr(au, "MANY_CASES", 1)
    monkeypatch.setattr(representative, "proximity_scores", None)
    after = fit()
    for name in ("candidate_scores_", "ensemble_predictions_", "validation_predictions_", "validation_probabilities_", "candidate_performance_scores_"):
        assert rows(getattr(after, name)) == rows(getattr(before, name)), name
    assert after.selected_index_ == before.selected_index_ and len(rows(after.candidate_scores_)) == 5
    after.release()


def test_ties_go_to_the_smallest_label(spark):
    cells = spark.createDataFrame([(1, [(1, "b"), (2, "a"), (3, "c")]), (2, [(1, "b"), (2, "b"), (3, "a")])], "case_id long, cells array<struct<draw:int,pred:string>>")
    assert {r.draw: r.score for r in representative.cell_disagreement(cells).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
