"""The audit's statistics against all-pairs and NumPy brute force, and its guards."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import tremorscope as ts
from tremorscope.functions.stats import exact_quantile, quantiles_by, r2_by, ranked
from tremorscope.operators import audit as au
from tremorscope.operators import sampling
from tremorscope.operators.procedures import ClassShares, Constant, Fitted, GroupMean, Mean, Ols


def table(spark, seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, rng.gauss(0, 1), float(rng.randint(0, 5)), rng.choice("abc")) for i in range(n)]
    rows = [(i, 3 * x + z + rng.gauss(0, 1), x, z, g) for i, x, z, g in rows]
    data = spark.createDataFrame(rows, "rid long, y double, x double, z double, g string")
    return data.where(f"rid < {n - 20}"), data.where(f"rid >= {n - 20}").withColumnRenamed("rid", "case_id")


def jackknife(cube, distance):
    b = len(cube)
    pairs = {(i, j): distance(cube[i], cube[j]) for i in range(b) for j in range(i)}
    loo = [np.mean([d for k, d in pairs.items() if out not in k]) for out in range(b)]
    return math.sqrt((b - 1) / b * np.sum((np.array(loo) - np.mean(loo)) ** 2))


def test_jackknife_matches_all_pairs(spark):
    rng = np.random.default_rng(4)
    cube = rng.normal(size=(7, 5)) + 1e9
    rows = [(d, c, float(cube[d, c])) for d in range(7) for c in range(5)]
    got = au.pairwise_standard_error(spark.createDataFrame(rows, "draw int, case_id long, pred double"), "numeric").first()[0]
    assert got == pytest.approx(jackknife(cube, lambda a, b: np.mean((a - b) ** 2)), rel=1e-6)
    names = rng.choice(list("abc"), size=(5, 4))
    rows = [(d, c, str(names[d, c])) for d in range(5) for c in range(4)]
    got = au.pairwise_standard_error(spark.createDataFrame(rows, "draw int, case_id long, pred string"), "label").first()[0]
    assert got == pytest.approx(jackknife(names, lambda a, b: np.mean(a != b)))
    probs = rng.random((6, 4, 3))
    rows = [(d, c, "xyz"[k], float(probs[d, c, k])) for d in range(6) for c in range(4) for k in range(3)]
    got = au.pairwise_standard_error(spark.createDataFrame(rows, "draw int, case_id long, class string, p double"), "vector").first()[0]
    assert got == pytest.approx(jackknife(probs, lambda a, b: np.sum((a - b) ** 2) / 4))
    two = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0)], "draw int, case_id long, pred double")
    assert math.isnan(au.pairwise_standard_error(two, "numeric").first()[0])


def test_audit_matches_numpy(spark):
    train, cases = table(spark)
    audit = ts.bootstrap_predictions(train, cases, Ols("x"), n_bootstrap=6, seed=3)
    rows = sampling.numbered(train, "rid", "3|rows").collect()
    by_idx = {r.idx: r for r in rows}
    assert sorted(by_idx) == list(range(40))
    weights = {}
    for r in sampling.bootstrap_weights(spark, 40, 6, 3).collect():
        weights.setdefault(r.draw, []).append((r.idx, r.w))
    assert all(sum(w for _, w in x) == 40 for x in weights.values())
    evals = {r.case_id: r.x for r in cases.collect()}
    cube = {}
    for draw, items in {0: [(i, 1) for i in range(40)], **weights}.items():
        x = np.repeat([by_idx[i].x for i, _ in items], [w for _, w in items])
        y = np.repeat([by_idx[i].y for i, _ in items], [w for _, w in items])
        slope, intercept = np.polyfit(x, y, 1)
        cube[draw] = {c: intercept + slope * v for c, v in evals.items()}
    for r in audit.case_stats.collect():
        p = np.array([cube[d][r.case_id] for d in range(1, 7)])
        assert r.per_point == pytest.approx(p.var(ddof=1)) and r.pairwise == pytest.approx(2 * p.var(ddof=1))
        assert r.mape == pytest.approx(np.abs(p - cube[0][r.case_id]).mean())
    one = au.summarised(audit).first()
    per = [r.per_point for r in audit.case_stats.collect()]
    assert one.instability_p90 == pytest.approx(np.percentile(per, 90)) and one.n_fit_attempts == 7
    again = ts.bootstrap_instability(train.repartition(3), cases, Ols("x"), n_bootstrap=6, seed=3).first()
    assert again.pairwise_mean == pytest.approx(one.pairwise_mean)
    still = ts.bootstrap_instability(train, cases, Constant(2.0), n_bootstrap=4).first()
    assert still.instability_max == still.mape == still.pairwise_standard_error == 0.0
    audit.release()


def test_labels_and_missing_classes(spark):
    rows = [(i, "common", "g") for i in range(20)] + [(20, "rare", "g"), (21, "rarer", "g")]
    train, cases = spark.createDataFrame(rows, "rid long, y string, g string"), spark.createDataFrame([(0, "g"), (1, "g")], "case_id long, g string")
    audit = ts.bootstrap_predictions(train, cases, ClassShares("g"), task="categorical", n_bootstrap=8, prediction_method="predict_proba", seed=1)
    sums = audit.predictions.groupBy("draw", "case_id").agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 16 and all(r.s == pytest.approx(1.0) and r.n == 3 for r in sums)
    assert audit.predictions.where("p = 0").count() > 0
    named = ts.bootstrap_predictions(train, cases, ClassShares("g"), task="categorical", n_bootstrap=8, seed=1)
    assert named.case_stats.agg(F.max("per_point")).first()[0] == 0.0
    near = spark.createDataFrame([(i, str(int(i == 0))) for i in range(20)], "rid long, y string")
    counted = ts.bootstrap_predictions(near, cases, ClassShares(), task="categorical", n_bootstrap=20, seed=2)
    assert counted.n_rejected_resamples > 0 and counted.n_resample_attempts == 20 + counted.n_rejected_resamples
    with pytest.raises(ValueError):
        ts.bootstrap_predictions(near.withColumn("y", F.lit("a")), cases, ClassShares(), task="categorical", n_bootstrap=3)
    unknown = spark.createDataFrame([(1, 0, "nobody", 1.0)], "draw int, case_id long, class string, p double")
    with pytest.raises(ValueError):
        au.aligned(unknown, unknown.select("draw"), cases, train.select(F.col("y").alias("class")).distinct())


def test_bad_arguments(spark):
    train, cases = table(spark)
    for options in ({"task": "other"}, {"n_bootstrap": 1}, {"prediction_method": "decide"}, {"prediction_method": "predict_proba"}, {"target": "absent"}):
        with pytest.raises(ValueError):
            ts.bootstrap_predictions(train, cases, Mean(), **options)
    with pytest.raises(ValueError):
        ts.bootstrap_predictions(train.limit(0), cases, Mean())
    with pytest.raises(ValueError):
        ts.bootstrap_predictions(train, cases.limit(0), Mean())
    with pytest.raises(ValueError):
        ts.bootstrap_predictions(train.withColumn("y", F.array("y")), cases, Mean())


class MeanObject:
    def fit(self, X, y):
        self.m = y.mean()
        return self

    def predict(self, X):
        return [self.m] * len(X)


def test_python_objects_match_the_relational_form(spark):
    train, cases = table(spark)
    a = ts.bootstrap_instability(train, cases, Fitted(MeanObject, ["x"]), n_bootstrap=4, seed=5).first()
    b = ts.bootstrap_instability(train, cases, Mean(), n_bootstrap=4, seed=5).first()
    assert a.pairwise_mean == pytest.approx(b.pairwise_mean) and a.mape == pytest.approx(b.mape)


def test_splits_and_draws(spark):
    train, _ = table(spark, n=120)
    split = sampling.holdout_split(train, "rid", 0.25, 1, "g").groupBy("g", "is_test").count().collect()
    sizes = {(r.g, r.is_test): r["count"] for r in split}
    for g in "abc":
        assert sizes[g, True] == math.ceil((sizes[g, True] + sizes[g, False]) * 0.25)
    counts = {"a": 5, "b": 9}
    drawn = sampling.stratified_weights(spark, counts, 3, 1).groupBy("draw", "stratum").agg(F.sum("w").alias("n"), F.max("idx").alias("m")).collect()
    assert len(drawn) == 6 and all(r.n == counts[r.stratum] and r.m < counts[r.stratum] for r in drawn)
    assert sampling.param_grid({}) == [{}] and len(sampling.param_grid([{"a": [1, 2]}, {"b": [3]}])) == 3


def test_quantiles_ranks_and_scores(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=3000).round(2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "case_id long, v double")
    for q in (0.0, 0.37, 0.9, 1.0):
        assert exact_quantile(df, "v", q, small=100) == pytest.approx(np.percentile(values, 100 * q))
    assert math.isnan(exact_quantile(df.limit(0), "v", 0.5))
    got = [r.case_id for r in ranked(df, "v", "case_id", rows=90).orderBy("rank").collect()]
    assert got == [int(i) for i in np.lexsort((np.arange(3000), values))]
    flat = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 0.0), (2, 1.0, 1.0)], "k int, y double, pred double")
    assert {r.k: r.score for r in r2_by(flat, ["k"]).collect()} == {1: 1.0, 2: 0.0}


def test_frontier(spark):
    data, cases = table(spark, n=80)
    got = ts.stability_frontier(lambda strength: GroupMean("g", strength), {"strength": [0.0, 10.0]}, data, cases=cases, n_bootstrap=4)
    points = got.points.collect()
    assert got.n_fits == 10 and [p.config_id for p in points] == [0, 1] and got.evaluation_source == "user_supplied_validation_data"
    assert points[1].instability < points[0].instability
    with pytest.raises(ValueError):
        ts.stability_frontier(lambda: Mean(), {}, data, instability_metric="rmse")


def test_quantiles_by_group_and_ranks_of_common_values(spark):
    rng = np.random.default_rng(8)
    groups = {0: rng.normal(size=60_000), 1: rng.integers(0, 5, 30_000).astype(float), 2: np.array([3.0]), 3: rng.normal(size=11), 4: np.full(20_000, 2.0)}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g int, v double").repartition(5)
    for r in quantiles_by(rows, "g", "v", {"a": 0.05, "b": 0.5, "c": 0.95}).collect():
        assert [r.a, r.b, r.c] == pytest.approx(np.percentile(groups[r.g], [5, 50, 95]).tolist(), abs=1e-12)
    values = [float(x) for x in rng.choice([1.0, 1.0, 1.0, 2.0, 5.0, *range(10, 30)], 3000)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(4)
    got = {r.id: r["rank"] for r in ranked(table, "v", "id", rows=100).collect()}
    assert [got[i] for i in sorted(got, key=lambda i: (values[i], i))] == list(range(3000))
    assert ranked(table.limit(0), "v", "id").count() == 0


def exchanges(df):
    """Shuffles of the plan as it was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return [line for line in final.splitlines() if " Exchange " in line or "- Exchange" in line], final


def test_summary_moves_predictions_once_and_makes_no_grid(spark):
    train, cases = table(spark)
    for procedure, options in ((Ols("x"), {}), (ClassShares("g"), {"task": "categorical", "prediction_method": "predict_proba", "target": "g"})):
        audit = ts.bootstrap_predictions(train, cases, procedure, n_bootstrap=4, seed=1, **options)
        found, plan = exchanges(au.summarised(audit))
        assert len(found) == 2 or len(found) == 3 and "SinglePartition" in plan, found  # by case, by draw (and the one row)
        assert sum("case_id" in line for line in found) == 1 and "Join" not in plan and "CartesianProduct" not in plan
        audit.release()


def test_probabilities_by_hand(spark):
    rng = np.random.default_rng(6)
    cube = rng.random((6, 5, 4)) * (rng.random((6, 5, 4)) < 0.6)  # draw 0 is the original; no row is a 0
    cube[:, 4] = 0.0  # a case of which nothing is known
    rows = [(d, c, "wxyz"[k], float(cube[d, c, k])) for d in range(6) for c in range(5) for k in range(4) if cube[d, c, k]] + [(-1, c, "w", 0.0) for c in range(5)]
    full = spark.createDataFrame(rows, "draw int, case_id long, class string, p double").repartition(3)
    found = au.case_rows(full, "vector", (), 5, 4)
    refits, first = cube[1:], cube[0]
    for r in au.case_stats(found).collect():
        assert r.per_point == pytest.approx(refits[:, r.case_id].var(axis=0, ddof=1).sum(), abs=1e-12)
        assert r.mape == pytest.approx(np.abs(refits[:, r.case_id] - first[r.case_id]).mean(), abs=1e-12)
    draws = {r.draw: r for r in au.draw_rows(found).collect()}
    for d in range(5):
        assert draws[d + 1].m == pytest.approx(np.abs(refits[d] - first).mean())
        assert draws[d + 1].r == pytest.approx(np.mean([sum(((refits[d, c] - refits[e, c]) ** 2).sum() for e in range(5)) for c in range(5)]))


class Twice:
    """Gives one class two times, and has no classes_ of its own kind."""

    classes_ = ("a", "a")

    def fit(self, X, y):
        return self

    def predict(self, X):
        return ["a"] * len(X)

    def predict_proba(self, X):
        return [[0.5, 0.5]] * len(X)


class Nothing:
    def fit(self, X, y):
        return self

    def predict(self, X):
        return ["a"] * len(X)


class Unnamed(Nothing):
    def predict_proba(self, X):
        return [[1.0]] * len(X)


def test_objects_without_proper_probabilities(spark):
    train, cases = table(spark)
    options = {"task": "categorical", "prediction_method": "predict_proba", "target": "g", "n_bootstrap": 2}
    for kind, words in ((Twice, "more than once: a, a"), (Nothing, "no class probabilities"), (Unnamed, "classes_")):
        with pytest.raises(ValueError, match=words):
            ts.bootstrap_predictions(train, cases, Fitted(kind, ["x"]), **options)
    with pytest.raises(ValueError, match="no class probabilities"):
        ts.bootstrap_predictions(train, cases, Mean(), **options)
    given = spark.createDataFrame([(1, 0, "a", 0.5), (1, 0, "a", 0.5)], "draw int, case_id long, class string, p double")
    with pytest.raises(ValueError, match="2 times"):
        au.aligned(given, given.select("draw").distinct(), cases, given.select("class").distinct())


def test_release_leaves_nothing(spark):
    import os

    from tremorscope.sources.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    train, cases = table(spark)
    ts.bootstrap_predictions(train, cases, Ols("x"), n_bootstrap=2).release()
    ts.bootstrap_instability(train, cases, Mean(), n_bootstrap=2).collect()
    ts.stability_frontier(lambda penalty: Ols("x", penalty), {"penalty": [0.0, 1.0]}, train, n_bootstrap=2)
    assert set(os.listdir(folder)) <= before


def test_resamples_are_exact_and_drawn_beside_the_rows(spark):
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("rid"), (F.col("id") % 3).cast("string").alias("y"), F.array("id").alias("more"), F.col("id").alias("idx")).repartition(5)
    assert sampling.bucket_rows(n) == 47 and sampling.bucket_rows(10**9) == sampling.BUCKET_ROWS and sampling.bucket_rows(3) == 1
    weights = {(r.draw, r.idx): r.w for r in sampling.bootstrap_weights(spark, n, 4, 9).collect()}
    drawn = sampling.resampled(rows, {None: n}, range(1, 5), 9)
    assert {(r.draw, r.idx): r.w for r in drawn.collect()} == weights
    assert all(r.more == [r.rid] and r.rid == r.idx for r in drawn.limit(50).collect())
    for draw in range(1, 5):
        w = np.zeros(n)
        for (d, i), x in weights.items():
            w[i] += x * (d == draw)
        assert w.sum() == n and abs((w == 0).mean() - math.exp(-1)) < 0.03 and w.max() < 10
        halves = w.reshape(2, -1).sum(axis=1)
        assert abs(halves[0] - n / 2) < 4 * math.sqrt(n) / 2
    # attempts may be any; a draw is its attempt's, under a new number
    other = {(r.draw, r.idx): r.w for r in sampling.resampled(rows, {None: n}, [2, 4], 9).collect()}
    assert other == {({2: 1, 4: 2}[d], i): w for (d, i), w in weights.items() if d in (2, 4)}
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("FlatMapCoGroups", "")
    strata = sampling.numbered(rows.drop("idx"), "rid", 1, "y")
    sizes = {"0": 1000, "1": 1000, "2": 1000}
    by_stratum = {(r.draw, r.stratum, r.idx): r.w for r in sampling.stratified_weights(spark, sizes, 2, 3).collect()}
    assert {(r.draw, r.y, r.idx): r.w for r in sampling.resampled(strata, sizes, range(1, 3), 3, "y").collect()} == by_stratum
    assert {(d, s): sum(w for (e, t, _), w in by_stratum.items() if (d, s) == (e, t)) for d in (1, 2) for s in sizes} == {(d, s): 1000 for d in (1, 2) for s in sizes}


def test_slots_are_dealt_in_tasks_of_bounded_size(spark):
    n, draws = 160_000, 8
    tables = sampling.bootstrap_weights(spark, n, draws, 5), sampling.stratified_weights(spark, {"a": n // 4, "b": n - n // 4}, draws, 5)
    for weights in tables:
        slots = [r.n for r in weights.groupBy(F.spark_partition_id()).agg(F.sum("w").alias("n")).collect()]
        assert sum(slots) == n * draws and len(slots) > 1
        assert max(slots) < 1.5 * sampling.TASK_SLOTS


def test_rows_are_read_once_and_numbers_move_by_case(spark):
    train, cases = table(spark)
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = train.mapInArrow(watched, train.schema)
    assert sorted(r.idx for r in sampling.numbered(rows, "rid", 1).collect()) == list(range(40)) and seen.value == 40
    split = sampling.holdout_split(rows, "rid", 0.3, 1)
    assert split.where("is_test").count() == 12 and split.count() == 40 and seen.value == 80
    audit = ts.bootstrap_predictions(train, cases, Ols("x"), n_bootstrap=4)
    assert sorted((r.case_id, len(r.cells)) for r in audit.cells.collect()) == [(i, 5) for i in range(40, 60)]
    by_rows = au.case_stats(au.case_rows(audit.kept, "numeric"))
    np.testing.assert_allclose(sorted(map(tuple, audit.case_stats.collect())), sorted(map(tuple, by_rows.collect())), rtol=1e-9)
    audit.release()
    prepared = au.prepare(train, cases, n_bootstrap=4, columns=["x"])
    assert sorted(prepared.weighted.columns) == ["draw", "idx", "w", "x", "y"]


def test_null_predictions_leave_the_variance_of_the_others(spark):
    rows = [(0, 1, 1.0), (1, 1, 2.0), (2, 1, 4.0), (3, 1, None), (0, 2, None), (1, 2, 1.0), (2, 2, 3.0), (0, 3, 1.0), (1, 3, 5.0)]
    got = {r.case_id: r for r in au.case_rows(spark.createDataFrame(rows, "draw int, case_id long, pred double"), "numeric").collect()}
    assert [got[i].per_point for i in (1, 2, 3)] == [2.0, 2.0, None]
    assert [got[i].mape for i in (1, 2, 3)] == [None, None, 4.0]
    assert sorted((e.draw, e.move) for e in got[1].each if e.move is not None) == [(1, 1.0), (2, 3.0)]
