import numpy as np
import pytest
from pyspark.sql import functions as F

import tremorscope as ts
from tremorscope.operators import audit as au
from tremorscope.operators import representative, sampling
from tremorscope.operators.procedures import ClassShares, GroupMean, Merging, Ols, StepMeans


def tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.random() * 9), "abc"[int(rng.integers(3))], "pqr"[int(rng.integers(3))]) for i in range(300)]
    whole = spark.createDataFrame(rows, "rid long, y double, x double, g string, label string")
    return whole.where("rid < 200"), whole.where("rid >= 200").withColumnRenamed("rid", "case_id")


KINDS = [
    (lambda: Ols("x"), {}),
    (lambda: GroupMean("g", 2.0), {}),
    (lambda: Merging(StepMeans(3.0), ["x"]), {}),
    (lambda: ClassShares("g"), {"task": "categorical", "target": "label"}),
    (lambda: ClassShares("g"), {"task": "categorical", "target": "label", "prediction_method": "predict_proba"}),
]


@pytest.mark.parametrize("make, options", KINDS)
def test_own_ids_spare_the_exchange_of_predictions(spark, monkeypatch, make, options):
    train, cases = tables(spark)
    cases = cases.withColumn("g", F.when(F.col("case_id") == 299, "unseen").otherwise(F.col("g")))
    before = ts.bootstrap_predictions(train, cases, make(), n_bootstrap=5, seed=2, **options)
    monkeypatch.setattr(au, "MANY_CASES", 1)
    after = ts.bootstrap_predictions(train, cases, make(), n_bootstrap=5, seed=2, **options)
    assert after.own_ids and not before.own_ids
    one, other = au.summarised(before), au.summarised(after)
    assert one.columns == other.columns
    np.testing.assert_allclose(tuple(other.first()), tuple(one.first()), rtol=1e-9, atol=1e-12)
    for ask in (au.Audit.mape_standard_error, au.Audit.pairwise_standard_error):
        assert ask(after).first()[0] == pytest.approx(ask(before).first()[0])
    assert sorted(after.predictions.select(*sorted(before.predictions.columns)).collect()) == sorted(before.predictions.select(*sorted(before.predictions.columns)).collect())
    np.testing.assert_allclose(sorted(map(tuple, after.case_stats.collect())), sorted(map(tuple, before.case_stats.collect())), rtol=1e-9, atol=1e-12)
    assert "case_id" not in "".join(x for x in au.added_up(after.sums())._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
    before.release()
    after.release()


def test_shared_ids_are_one_case(spark, monkeypatch):
    train, cases = tables(spark)
    cases = cases.withColumn("case_id", F.least("case_id", F.lit(298)))
    before = au.summarised(ts.bootstrap_predictions(train, cases, Ols("x"), n_bootstrap=4)).first()
    monkeypatch.setattr(au, "MANY_CASES", 1)
    audit = ts.bootstrap_predictions(train, cases, Ols("x"), n_bootstrap=4)
    assert not audit.own_ids and au.summarised(audit).first() == before


@pytest.mark.parametrize("factory, grid, options", [(lambda **p: Ols("x", p["penalty"]) if "penalty" in p else GroupMean("g", p["strength"]), [{"penalty": [0.0, 9.0]}, {"strength": [0.0, 5.0]}], {}), (ClassShares, {"column": ["g", None]}, {"task": "categorical", "target": "label"})])
def test_frontier_adds_up_once_for_all_configurations(spark, monkeypatch, factory, grid, options):
    train, cases = tables(spark)
    before = ts.stability_frontier(factory, grid, train, cases=cases, n_bootstrap=4, **options).points.collect()
    monkeypatch.setattr(au, "MANY_CASES", 1)
    seen = []
    for kind in (Ols, GroupMean):
        monkeypatch.setattr(kind, "states", lambda self, rows, known=kind.states, kind=kind: (seen.append(kind), known(self, rows))[1])
    after = ts.stability_frontier(factory, grid, train, cases=cases, n_bootstrap=4, **options).points.collect()
    assert len(seen) == len(set(seen))
    for a, b in zip(sorted(after), sorted(before), strict=True):
        assert a.params == b.params
        np.testing.assert_allclose(tuple(a)[2:], tuple(b)[2:], rtol=1e-8, atol=1e-12)


def test_fits_take_rows_with_all_their_draws(spark):
    train, cases = tables(spark)
    prepared = au.prepare(train, cases, n_bootstrap=4, seed=5)
    for procedure in (Ols(["x"], 2.0), GroupMean("g"), Merging(StepMeans(3.0), ["x"])):
        one, other = (sorted(procedure.predict(procedure.fit(rows), cases.where("case_id < 205")).select("draw", "case_id", "pred").collect()) for rows in (prepared.weighted, prepared.rows))
        np.testing.assert_allclose(one, other, rtol=1e-9)
        assert len(one) == 25


def test_probability_distances_follow_from_sums(spark, monkeypatch):
    train, cases = tables(spark)
    monkeypatch.setattr(au, "MANY_CASES", 1)
    audit = ts.bootstrap_predictions(train, cases, ClassShares("g"), task="categorical", target="label", n_bootstrap=5, prediction_method="predict_proba")
    one, other = (dict(map(tuple, x.collect())) for x in (representative.audit_scores(audit, "probability_mse"), representative.proximity_scores(audit.predictions, "probability_mse")))
    assert one == pytest.approx(other)


def test_a_split_orders_its_last_bucket_only(spark):
    rows = spark.range(20000).select(F.col("id").alias("rid"), (F.col("id") % 7).alias("v"))
    found = sampling.holdout_split(rows, "rid", 0.3, "s")
    assert len(found.stored_at) == 2 and spark.read.parquet(found.stored_at[1]).count() < 50
    order = [r.rid for r in rows.orderBy(sampling.hashed("s", "rid"), "rid").collect()]
    assert {r.rid for r in found.where("is_test").collect()} == set(order[:6000]) and found.count() == 20000
    again = sampling.holdout_split(rows.withColumn("rid", F.lit(5)), "rid", 0.3, "s")
    assert again.where("is_test").count() == 6000 and again.count() == 20000
