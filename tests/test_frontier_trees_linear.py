"""Pareto sets, trees, closed forms, the selector and the plot tables against plain Python and NumPy."""

import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import tremorscope as ts
from tremorscope.functions.stats import equal_bins
from tremorscope.operators import linear, representative, trees
from tremorscope.operators.plotdata import mape_bins
from tremorscope.operators.procedures import ClassShares, Ols

NAN = float("nan")


def points(spark, pairs):
    return spark.createDataFrame([(i, float(s), float(v)) for i, (s, v) in enumerate(pairs)], "config_id int, score double, instability double")


def test_pareto(spark):
    rng = random.Random(3)
    for _ in range(6):
        pairs = [(rng.choice((0, 1, 2, 3, NAN)), rng.choice((0, 1, 2, 3, NAN))) for _ in range(12)]
        front = [(s, v, i) for i, (s, v) in enumerate(pairs) if not any(a >= s and b <= v and (a > s or b < v) for a, b in pairs)]
        want, seen = [], set()
        for s, v, i in sorted((f for f in front if f[0] == f[0] and f[1] == f[1]), key=lambda f: (-f[0], f[2])):
            if (s, v) not in seen:
                seen.add((s, v))
                want.append(i)
        got = [r.config_id for r in ts.pareto_front(points(spark, pairs)).collect() if r.score == r.score and r.instability == r.instability]
        assert got == want
    shown = ts.plot_stability_frontier({"f": points(spark, [(1, 1), (0, 2)])}).collect()
    assert [r.is_frontier for r in shown] == [True, False]


def test_trees(spark):
    rng = random.Random(5)
    rows = [(1, 1, 2.0 * (x > 3) + (z > 2) + rng.random() / 9, x, z) for _ in range(200) for x, z in [(float(rng.randint(0, 6)), float(rng.randint(0, 4)))]]
    weighted = spark.createDataFrame(rows, "draw int, w long, y double, x double, z double")
    nodes = trees.grow_trees(weighted, ["x", "z"], {"x": [1.0, 3.0, 5.0], "z": [2.0]}, 2)
    found = {r.node_id: (r.feature, r.threshold) for r in nodes.collect() if r.feature >= 0}
    assert found == {0: (0, 3.0), 1: (1, 2.0), 2: (1, 2.0)}
    assert {(r.feature, r.n) for r in ts.split_features(nodes).collect()} == {(0, 1), (1, 2)}
    assert {(r.feature, r.n) for r in ts.split_features(nodes, 0).collect()} == {(0, 1)}
    cases = spark.createDataFrame([(0, 1.0, 1.0), (1, NAN, 1.0)], "case_id long, x double, z double")
    assert {r.case_id: r.path for r in ts.split_feature_paths(nodes, cases, ["x", "z"]).collect()} == {0: [0, 1], 1: [0, 1]}
    made = "fit_id int, node_id int, left int, right int, feature int, threshold double, value double"
    stump = lambda fit, f: [(fit, 0, 1, 2, f, 0.0, 0.0), (fit, 1, -1, -1, -1, None, 0.0), (fit, 2, -1, -1, -1, None, 1.0)]
    leaf = [(3, 0, -1, -1, -1, None, 0.0)]
    three = spark.createDataFrame(stump(1, 0) + stump(2, 1) + leaf, made)
    one = ts.explanation_instability(three).first()
    assert one.jaccard_mean == one.jaccard_max == one.distinct_structures == 1.0
    assert ts.root_agreement(three).first()[0] == pytest.approx(1 / 3)
    same = spark.createDataFrame(stump(1, 0) + stump(2, 0), made)
    assert ts.explanation_instability(same).first().jaccard_max == 0.0 and ts.path_agreement(same, cases, ["x", "z"]).first()[0] == 1.0
    nested = spark.createDataFrame(stump(1, 0) + [(2, 0, 1, 2, 0, 0.0, 0.0), (2, 1, 3, 4, 0, -1.0, 0.0)] + [(2, n, -1, -1, -1, None, 0.0) for n in (2, 3, 4)], made)
    assert ts.explanation_instability(nested).first().jaccard_mean == 0.5
    with pytest.raises(ValueError):
        ts.explanation_instability(spark.createDataFrame(leaf, made))


def frame(spark, x, y):
    names = [f"f{j}" for j in range(x.shape[1])]
    return spark.createDataFrame([(*map(float, row), float(t)) for row, t in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in [*names, "y"])).repartition(3), names


def test_linear(spark):
    rng = np.random.default_rng(0)
    x, beta = rng.normal(size=(150, 4)), np.array([1.0, -2.0, 0.5, 0.0])
    y = x @ beta + 2 * rng.normal(size=150)
    design, names = frame(spark, x, y)
    cases = design.limit(40).withColumn("case_id", F.monotonically_increasing_id())
    inverse = np.linalg.inv(x.T @ x)
    for r in ts.linear_instability(design, cases, names, sigma=2.0).collect():
        v = np.array([r[n] for n in names])
        assert r.variance == pytest.approx(4 * v @ inverse @ v) and r.s2 == pytest.approx(2 * r.variance) and r.s1 == pytest.approx(math.sqrt(2) * r.centered_mad)
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    meat = (x * ((y - x @ coef) ** 2)[:, None]).T @ x
    for r in ts.linear_instability(design, cases, names, y="y", robust=True).collect():
        v = np.array([r[n] for n in names])
        assert r.variance == pytest.approx(v @ inverse @ meat @ inverse @ v)
    assert ts.shrinkage_coefficients(design, names, "y", 0.0) == pytest.approx(coef)
    assert np.linalg.norm(ts.shrinkage_coefficients(design, names, "y", 5.0)) < np.linalg.norm(coef)
    rows = ts.linear_frontier(design, names, "y", n_points=12, signal="per_direction").collect()
    best, grid = [r for r in rows if r.risk_optimal][0], [r for r in rows if not r.risk_optimal]
    assert best.mu == 1.0 and all(best.risk <= r.risk + 1e-12 for r in grid)
    assert all(a.variance >= b.variance - 1e-12 and a.bias2 <= b.bias2 + 1e-12 for a, b in zip(grid, grid[1:], strict=False))
    u = x @ np.linalg.inv(linear.r_factor(design, names))
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-9)
    null = ts.linear_frontier(*frame(spark, np.diag([4.0, 3.0, 2.0, 1.0]), np.ones(4)), "y", n_points=2, beta=[1, 0, 0, 0], sigma=1.0).collect()
    assert sorted(null[0].shrinkage) == [0.0, 0.0, 0.0, 1.0]


def test_linear_guards(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    close, names = frame(spark, np.c_[x, x[:, 0] + 1e-9 * rng.normal(size=80)], np.zeros(80))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        ts.linear_instability(close, close, names, sigma=1.0)
    assert any(issubclass(w.category, RuntimeWarning) for w in seen)
    twice, names = frame(spark, np.c_[x, x[:, 0]], np.zeros(80))
    bad, _ = frame(spark, np.full((5, 2), np.nan), np.zeros(5))
    square, two = frame(spark, np.eye(2), np.ones(2))
    for call in (
        lambda: ts.linear_instability(twice, twice, names, sigma=1.0), lambda: ts.linear_instability(bad, bad, ["f0", "f1"], sigma=1.0), lambda: ts.linear_instability(square, square, two),
        lambda: ts.linear_instability(square, square, two, sigma=-1.0), lambda: ts.linear_instability(square, square, two, y="y", robust=True), lambda: ts.shrinkage_coefficients(square, two, "y", 1.0),
        lambda: ts.linear_frontier(square, two, "y", n_points=1, sigma=1.0), lambda: ts.linear_frontier(square, two, "y", mu_max=0.0, sigma=1.0), lambda: ts.shrinkage_coefficients(square, two, "y", -1.0),
    ):
        with pytest.raises(ValueError):
            call()
    assert ts.shrinkage_coefficients(square, two, "y", 0.0) == pytest.approx([1.0, 1.0])


def test_representative(spark):
    rng = np.random.default_rng(7)
    cube = rng.normal(size=(6, 9))
    table = spark.createDataFrame([(d + 1, c, float(cube[d, c])) for d in range(6) for c in range(9)], "draw int, case_id long, pred double")
    centre = cube.mean(axis=0)
    want = {"rmse": np.sqrt(((cube - centre) ** 2).mean(axis=1)), "mae": np.abs(cube - centre).mean(axis=1), "correlation": [1 - np.corrcoef(r, centre)[0, 1] for r in cube]}
    for metric, scores in want.items():
        got = {r.draw: r.score for r in representative.proximity_scores(table, metric).collect()}
        assert [got[d + 1] for d in range(6)] == pytest.approx(list(scores))
    medoid = {r.draw: r.score for r in representative.medoid_distances(table).collect()}
    assert min(medoid, key=medoid.get) == int(np.argmin(want["rmse"])) + 1
    flat = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0), (2, 1, 1.0)], "draw int, case_id long, pred double")
    assert {r.score for r in representative.proximity_scores(flat, "correlation").collect()} == {0.0}
    assert representative.nearest(representative.proximity_scores(flat, "rmse")).first().draw == 1
    rows = [(i, float(i % 7) + rng.normal(), float(i % 7), "ab"[i % 2], "pq"[int(i % 7 > 3)]) for i in range(120)]
    data = spark.createDataFrame(rows, "rid long, y double, x double, g string, label string")
    model = ts.RepresentativeEstimator(Ols("x"), task="regression", n_candidates=5).fit(data.select("rid", "y", "x"))
    scores = sorted((r.score, r.draw) for r in model.candidate_scores_.collect())
    assert model.selected_index_ == scores[0][1] - 1 and model.proximity_metric_ == "rmse" and model.n_validation_samples_ == 24
    cases = data.withColumnRenamed("rid", "case_id")
    assert model.predict(cases).count() == 120 and 0 < model.score(cases) <= 1
    labels = ts.RepresentativeEstimator(ClassShares("g"), n_candidates=4).fit(data.select("rid", "g", "label"), target="label")
    assert labels.proximity_metric_ == "probability_mse" and labels.classes_ == ["p", "q"]
    assert labels.predict_proba(cases).groupBy("case_id").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    for bad in ({"task": "x"}, {"n_candidates": 0}, {"n_candidates": True}, {"validation_fraction": 1.0}, {"proximity_metric": "rmse"}, {"bootstrap_candidates": 1}):
        with pytest.raises(ValueError):
            ts.RepresentativeEstimator(ClassShares("g"), **bad).fit(data)
    with pytest.raises(ValueError):
        ts.RepresentativeEstimator(Ols("x"), task="regression").predict(cases)


def test_plot_tables(spark):
    sizes = [r.c for r in spark.range(23).select(equal_bins(F.col("id"), 23, 5).alias("b")).groupBy("b").agg(F.count("*").alias("c")).orderBy("b").collect()]
    assert sizes == [len(x) for x in np.array_split(np.arange(23), 5)]
    data = spark.createDataFrame([(i, float(i % 3), float(i)) for i in range(30)], "case_id long, x double, mape double")
    few = mape_bins(data.select("case_id", "x"), data.select("case_id", "mape"), 20).collect()
    assert sorted(r.centre for r in few) == [0.0, 1.0, 2.0]
    rows = [(i, float(i % 11), float(i % 13)) for i in range(60)]
    frame = spark.createDataFrame(rows, "rid long, y double, x double")
    audit = ts.bootstrap_predictions(frame, frame.withColumnRenamed("rid", "case_id"), Ols("x"), n_bootstrap=3)
    shown = ts.plot_prediction_instability(audit, max_points=10, n_bins=5)
    assert shown["scatter"].count() == 30 and shown["band"].count() == 5
    with pytest.raises(ValueError):
        ts.plot_prediction_instability(audit, class_label="a")


def test_paths_on_any_node_numbers(spark):
    """A right chain and a left chain numbered in preorder, and one whose numbers are arbitrary."""
    made = "fit_id int, node_id int, left int, right int, feature int, threshold double, value double"
    rows = []
    for fit, ids in ((1, [0, 2, 4, 6]), (2, [0, 1000, 7, 50])):
        leaves = [i + 1 for i in ids]
        for k in range(3):
            rows += [(fit, ids[k], leaves[k], ids[k + 1], 0, float(k), -1.0), (fit, leaves[k], -1, -1, -1, None, float(k))]
        rows.append((fit, ids[3], -1, -1, -1, None, 9.0))
    nodes = spark.createDataFrame(rows, made)
    cases = spark.createDataFrame([(i, x) for i, x in enumerate((-1.0, 0.5, 1.5, 5.0, NAN, None))], "case_id long, x double")
    got = {(r.fit_id, r.case_id): (r.path, r.value) for r in trees.routed(nodes, cases, ["x"]).collect()}
    want = {0: ([0], 0.0), 1: ([0, 0], 1.0), 2: ([0, 0, 0], 2.0), 3: ([0, 0, 0], 9.0), 4: ([0, 0, 0], 9.0), 5: ([0, 0, 0], 9.0)}
    assert got == {(f, c): x for f in (1, 2) for c, x in want.items()} and trees.depth_of(nodes) == 3
    loop = spark.createDataFrame([(1, 0, 0, 0, 0, 0.0, 0.0)], made)
    with pytest.raises(ValueError):
        trees.depth_of(loop, most=5)


class Nearest:
    """Labels by the nearest class mean of x; a free random_state, as such objects have."""

    def __init__(self):
        self.random_state = None

    def fit(self, x, y):
        self.means_ = x["x"].groupby(y).mean().sort_index()
        self.classes_ = list(self.means_.index)
        return self

    def predict(self, x):
        return [min(self.classes_, key=lambda c: abs(v - self.means_[c])) for v in x["x"]]


class WithShares(Nearest):
    def predict_proba(self, x):
        return [[1.0 if c == p else 0.0 for c in self.classes_] for p in self.predict(x)]


def labelled(spark):
    rng = random.Random(6)
    rows = [(i, "low" if i % 2 else "high", rng.gauss(0 if i % 2 else 2, 1)) for i in range(120)]
    return spark.createDataFrame(rows, "rid long, y string, x double")


def test_label_objects_and_metric_fallback(spark):
    from tremorscope.operators.procedures import Fitted

    data = labelled(spark)
    cases = data.where("rid >= 80").withColumnRenamed("rid", "case_id")
    one = ts.bootstrap_instability(data.where("rid < 80"), cases, Fitted(Nearest, ["x"]), task="categorical", n_bootstrap=4).first()
    assert 0 <= one.pairwise_mean < 0.5
    for made, metric in ((Nearest, "disagreement"), (WithShares, "probability_mse")):
        found = ts.RepresentativeEstimator(Fitted(made, ["x"]), n_candidates=3).fit(data)
        assert found.proximity_metric_ == metric and found.score(cases) > 0.6
        assert (found.validation_probabilities_ is None) == (made is Nearest)
        assert {r.pred for r in found.predict(cases).collect()} == {"low", "high"}
        found.release()
    with pytest.raises(ValueError):
        ts.RepresentativeEstimator(Fitted(Nearest, ["x"]), n_candidates=2, proximity_metric="probability_mse").fit(data)


def test_nested_random_states_follow_seed_and_draw(spark):
    from tremorscope.operators.procedures import seeded

    class Outer:
        def __init__(self):
            self.params = {"random_state": None, "inner__random_state": None, "fixed__random_state": 3, "other": None}

        def get_params(self, deep=True):
            return dict(self.params)

        def set_params(self, **new):
            self.params |= new

    a, b, c = (seeded(Outer(), s).params for s in (5, 5, 6))
    assert a == b != c and a["fixed__random_state"] == 3 and a["other"] is None
    assert None not in (a["random_state"], a["inner__random_state"]) and a["random_state"] != a["inner__random_state"]
    assert seeded(Nearest(), 4).random_state == 4


def test_default_tree_probabilities_and_its_nodes(spark):
    data = labelled(spark)
    found = ts.RepresentativeEstimator(n_candidates=2, seed=1).fit(data)
    cases = data.withColumnRenamed("rid", "case_id")
    assert found.proximity_metric_ == "probability_mse" and found.score(cases) > 0.7
    sums = [r.p for r in found.predict_proba(cases).groupBy("case_id").agg(F.sum("p").alias("p")).collect()]
    assert len(sums) == 120 and all(p == pytest.approx(1) for p in sums)
    nodes = trees.nodes_of(found, 4, spark)
    assert {r.fit_id for r in nodes.collect()} == {4} and nodes.where("feature = 0").count() > 0
    values = trees.routed(nodes, cases, ["x"]).join(found.predict(cases), "case_id").select("value", "pred").distinct().collect()
    assert {(r.value, r.pred) for r in values} == {(0.0, "high"), (1.0, "low")}
    with pytest.raises(TypeError):
        trees.nodes_of(Ols("x"), 0, spark)
    price = ts.RepresentativeEstimator(task="regression", n_candidates=2).fit(data.select("rid", F.col("x").alias("y"), F.length("y").cast("double").alias("k")))
    assert price.proximity_metric_ == "rmse" and price.candidate_scores_.count() == 2


def test_routing_joins_no_cases_and_refuses_broken_trees(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    x = rng.normal(size=(300, 3))
    x[rng.random((300, 3)) < 0.1] = np.nan
    for fit in range(12):  # random trees on free numbers
        numbers, todo, made = iter(rng.permutation(10_000)[1:] + 1), [(0, 0)], {}
        while todo:
            node, depth = todo.pop()
            if depth < 5 and rng.random() < 0.8:
                a, b = int(next(numbers)), int(next(numbers))
                made[node] = (a, b, int(rng.integers(3)), float(rng.normal()), 0.0)
                todo += [(a, depth + 1), (b, depth + 1)]
            else:
                made[node] = (-1, -1, -1, None, float(rng.normal()))
        rows += [(fit, n, *v) for n, v in made.items()]
        for case in range(300):
            node, path = 0, []
            while made[node][2] >= 0:
                a, b, f, t, _ = made[node]
                path.append(f)
                node = a if x[case, f] <= t else b
            want[fit, f"c{case}"] = (path, made[node][4])
    nodes = spark.createDataFrame(rows, trees.NODES)
    cases = spark.createDataFrame([(f"c{i}", *map(float, r)) for i, r in enumerate(x)], "case_id string, a double, b double, c double").repartition(4)
    for limit in (10**6, 40):
        monkeypatch.setattr(trees, "FOREST_NODES", limit)
        found = trees.routed(nodes, cases, ["a", "b", "c"])
        assert {(r.fit_id, r.case_id): (r.path, r.value) for r in found.collect()} == want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert trees.routed(nodes.limit(0), cases, ["a", "b", "c"]).count() == 0
    twice, lost, rootless = [*rows, rows[0]], [r for r in rows if r[:2] != (0, rows[0][2])], [r for r in rows if r[:2] != (3, 0)]
    for broken in (twice, lost, rootless):
        with pytest.raises(ValueError):
            trees.routed(spark.createDataFrame(broken, trees.NODES), cases, ["a", "b", "c"])


def test_default_tree_takes_text_columns(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), rng.random()) for i in range(120)]
    data = spark.createDataFrame([(i, k, v, {"a": 0.0, "b": 10.0, "c": -10.0}[k] + v) for i, k, v in rows], "rid long, kind string, value double, y double")
    found = ts.RepresentativeEstimator(None, "regression", 3, seed=1).fit(data)
    assert found.features_ == ["kind", "value"]
    asked = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.5), (2, "c", 0.5), (3, "never", 0.5), (4, None, 0.5)], "case_id long, kind string, value double")
    got = {r.case_id: r.pred for r in found.predict(asked).collect()}
    assert abs(got[0]) < 2 and abs(got[1] - 10) < 2 and abs(got[2] + 10) < 2 and {3, 4} <= set(got)
    # the candidates' predictions are a table that several uses read
    assert "Exchange" not in found.validation_predictions_._jdf.queryExecution().executedPlan().toString() and found.validation_predictions_.count() == 3 * found.n_validation_samples_
    found.release()


def test_axis_texts(spark):
    rows = [(i, "ab"[i % 2], float(i % 5)) for i in range(40)]
    train, cases = spark.createDataFrame(rows, "rid long, y string, x double"), spark.createDataFrame(rows[:10], "case_id long, y string, x double")
    from tremorscope.operators.plotdata import frontier_axes
    from tremorscope.operators.procedures import ClassShares

    labels = ts.bootstrap_predictions(train, cases, ClassShares(), task="categorical", n_bootstrap=2)
    chances = ts.bootstrap_predictions(train, cases, ClassShares(), task="categorical", prediction_method="predict_proba", n_bootstrap=2)
    style = ts.plot_mape_by_prediction(labels)["style"].first()
    assert style.x_label == "predicted label, original fit" and "another label" in style.y_label
    assert ts.plot_mape_by_prediction(chances, class_label="a")["style"].first().x_label == "probability of a, original fit"
    assert "mean absolute move" in frontier_axes("mape")["x_label"] and "accuracy" in frontier_axes("pairwise", "accuracy")["y_label"]
    with pytest.raises(ValueError):
        frontier_axes("rmse")
    labels.release()
    chances.release()
