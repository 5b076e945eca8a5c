"""The registered queries, each an operator over whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import accuracy_by, r2_by
from ..operators import linear, plotdata, representative, sampling, trees
from ..operators.audit import aligned, bootstrap_predictions, summarised
from ..operators.frontier import most_stable, stability_frontier, within_of_best
from ..operators.procedures import ClassShares, Constant, GroupMean, Merging, Ols, StepMeans
from ..sources.shared import stored
from ..sources.tables import line_cases, order_cases, table
from .oracles import DRAWS, LABEL_COLUMNS, ORACLES, PENALTIES, SEED, STRENGTHS, TEST, THRESHOLDS

FEATURES = ["x", "z"]
POINT = ("score", "instability", "instability_standard_error", "pairwise", "pairwise_standard_error", "mape", "mape_standard_error")


def _round(df: DataFrame, names, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _sides(spark: SparkSession, folder: str, target: str = "y", source: Callable = order_cases) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out cases of the orders, with ``y`` the price or the status."""
    split = sampling.holdout_split(source(spark, folder), "rid", TEST, f"{SEED}|split", "label" if target == "label" else None)
    if target == "label":
        split = split.drop("y").withColumnRenamed("label", "y")
    return split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test").withColumnRenamed("rid", "case_id")


def _audit(spark, folder, procedure, target="y", method="predict"):
    train, cases = _sides(spark, folder, target)
    return bootstrap_predictions(train, cases, procedure, task="categorical" if target == "label" else "continuous", n_bootstrap=DRAWS, prediction_method=method, seed=SEED)


def _ols(spark, folder):
    return _audit(spark, folder, Ols("x"))


def _means(spark, folder):
    return _audit(spark, folder, GroupMean("g"))


def _labels(spark, folder, method="predict"):
    return _audit(spark, folder, ClassShares("g"), "label", method)


def _weighted(spark, folder, target="y"):
    train, _ = _sides(spark, folder, target)
    rows = sampling.numbered(train, "rid", f"{SEED}|rows").drop("rid")
    return sampling.drawn_rows(stored(sampling.dealt(rows, {None: rows.count()}, range(1, DRAWS + 1), SEED), "rows"), True)


def _summary(audit, places=6):
    row = summarised(audit)
    return _round(row, [c for c in row.columns if not c.startswith("n_")], places)


def pairs_bootstrap_weights(spark, folder):
    train, _ = _sides(spark, folder)
    return sampling.bootstrap_weights(spark, train.count(), DRAWS, SEED)


def stratified_bootstrap_weights(spark, folder):
    sizes = {r.label: r["count"] for r in order_cases(spark, folder).groupBy("label").count().collect()}
    return sampling.stratified_weights(spark, sizes, DRAWS, SEED)


def holdout_split(spark, folder):
    return sampling.holdout_split(order_cases(spark, folder), "rid", TEST, f"{SEED}|split").select("rid", "is_test")


def stratified_holdout_split(spark, folder):
    return sampling.holdout_split(order_cases(spark, folder), "rid", TEST, f"{SEED}|split", "label").select("rid", "label", "is_test")


def distinct_classes(spark, folder):
    return order_cases(spark, folder).select(F.col("label").alias("class")).distinct()


def original_fit_ols(spark, folder):
    return _round(_ols(spark, folder).original, ["pred0"])


def bootstrap_predictions_ols(spark, folder):
    return _round(_ols(spark, folder).predictions, ["pred"])


def _stat(make: Callable, column: str, places: int = 6) -> Callable:
    return lambda spark, folder: _round(make(spark, folder).case_stats.select("case_id", column), [column], places)


def bootstrap_instability_ols(spark, folder):
    return _summary(_ols(spark, folder))


def bootstrap_instability_constant(spark, folder):
    return _summary(_audit(spark, folder, Constant(3.0)))


def bootstrap_instability_group_mean(spark, folder):
    return _summary(_audit(spark, folder, GroupMean("g")))


def bootstrap_instability_labels(spark, folder):
    return _summary(_labels(spark, folder))


def bootstrap_instability_probabilities(spark, folder):
    return _summary(_labels(spark, folder, "predict_proba"), 9)


def bootstrap_instability_lines(spark, folder):
    """The audit of a fit on three features."""
    train, cases = _sides(spark, folder, source=line_cases)
    return _summary(bootstrap_predictions(train, cases, Ols(["x", "z", "g"]), n_bootstrap=DRAWS, seed=SEED), 8)


def bootstrap_instability_merged(spark, folder):
    """The audit of a Python model that merges: mean prices by steps of ten in quantity."""
    train, cases = _sides(spark, folder, source=line_cases)
    return _summary(bootstrap_predictions(train, cases, Merging(StepMeans(10.0), ["x"], ["x"]), n_bootstrap=DRAWS, seed=SEED), 8)


def mape_standard_error(spark, folder):
    return _round(_ols(spark, folder).mape_standard_error(), ["standard_error"])


def pairwise_jackknife_numeric(spark, folder):
    return _round(_ols(spark, folder).pairwise_standard_error(), ["standard_error"])


def pairwise_jackknife_labels(spark, folder):
    return _round(_labels(spark, folder).pairwise_standard_error(), ["standard_error"])


def pairwise_jackknife_vector(spark, folder):
    return _round(_labels(spark, folder, "predict_proba").pairwise_standard_error(), ["standard_error"], 9)


def _regions(spark, folder):
    rows = table(spark, folder, "region").select(F.col("r_regionkey").alias("rid"), F.when(F.col("r_regionkey") == 0, "1").otherwise("0").alias("y"), (F.col("r_regionkey") % 3).cast("string").alias("k"))
    rows = sampling.numbered(rows, "rid", f"{SEED}|rows")
    return rows, sampling.bootstrap_weights(spark, rows.count(), DRAWS + 10, SEED)


def one_class_rejections(spark, folder):
    rows, weights = _regions(spark, folder)
    return sampling.classes_per_draw(weights.join(rows, "idx")).withColumnRenamed("draw", "attempt")


def redraw_accounting(spark, folder):
    rows, weights = _regions(spark, folder)
    return sampling.usable_draws(weights, rows, "y", DRAWS)


def class_alignment(spark, folder):
    rows, weights = _regions(spark, folder)
    procedure, cases = ClassShares(), table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("case_id"))
    model = procedure.fit(weights.join(rows.drop("y").withColumnRenamed("k", "y"), "idx"))
    draws = weights.select("draw").distinct()
    return _round(aligned(procedure.predict_proba(model, cases), draws, cases, rows.select(F.col("k").alias("class")).distinct()), ["p"])


def param_grid(spark, folder):
    """All regions with all market segments, as a grid would try them."""
    values = lambda name, column: [r[0] for r in table(spark, folder, name).select(column).distinct().orderBy(column).collect()]
    grid = sampling.param_grid({"segment": values("customer", "c_mktsegment"), "region": values("region", "r_name")})
    return spark.createDataFrame([(i, x["region"], x["segment"]) for i, x in enumerate(grid)], "config_id int, region string, segment string")


def frontier_points_labels(spark, folder):
    """A frontier of label procedures, by accuracy."""
    train, cases = _sides(spark, folder, "label")
    found = stability_frontier(ClassShares, {"column": list(LABEL_COLUMNS)}, train, "categorical", cases=cases, n_bootstrap=DRAWS, seed=SEED)
    return _shown(found.points)


def _frontier(spark, folder, metric="pairwise"):
    train, cases = _sides(spark, folder)
    return stability_frontier(lambda penalty: Ols("x", penalty), {"penalty": list(PENALTIES)}, train, cases=cases, n_bootstrap=DRAWS, seed=SEED, instability_metric=metric)


def _shown(points: DataFrame) -> DataFrame:
    return _round(points.select("config_id", *POINT), POINT)


def frontier_points_ridge(spark, folder):
    return _shown(_frontier(spark, folder).points)


def pareto_front_query(spark, folder):
    return _shown(_frontier(spark, folder).frontier)


def pareto_front_mape(spark, folder):
    return _shown(_frontier(spark, folder, "mape").frontier)


def frontier_two_families(spark, folder):
    """Both families in one frontier: they share split, resamples and predictions."""
    train, cases = _sides(spark, folder)
    factory = lambda **p: Ols("x", p["penalty"]) if "penalty" in p else GroupMean("g", p["strength"])
    return _shown(stability_frontier(factory, [{"penalty": list(PENALTIES)}, {"strength": list(STRENGTHS)}], train, cases=cases, n_bootstrap=DRAWS, seed=SEED).frontier)


def constrained_choice(spark, folder):
    return _shown(most_stable(within_of_best(_frontier(spark, folder).points)))


def plot_frontier(spark, folder):
    return _round(plotdata.plot_stability_frontier({"ridge": _frontier(spark, folder).points}, "mape"), ["score", "value"])


def _scored(spark, folder, procedure, target):
    _, cases = _sides(spark, folder, target)
    return procedure.predict(procedure.fit(_weighted(spark, folder, target)), cases).join(cases.select("case_id", "y", (F.col("z") + 1).alias("k")), "case_id")


def r2_score(spark, folder):
    return _round(r2_by(_scored(spark, folder, Ols("x"), "y"), ["draw"]), ["score"])


def weighted_r2(spark, folder):
    return _round(r2_by(_scored(spark, folder, Ols("x"), "y"), ["draw"], "k"), ["score"])


def accuracy_score(spark, folder):
    return _round(accuracy_by(_scored(spark, folder, ClassShares("g"), "label"), ["draw"]), ["score"])


def weighted_accuracy(spark, folder):
    return _round(accuracy_by(_scored(spark, folder, ClassShares("g"), "label"), ["draw"], "k"), ["score"])


def centroid_numeric(spark, folder):
    return _round(representative.numeric_centroid(_ols(spark, folder).predictions), ["centre"])


def centroid_labels(spark, folder):
    return representative.label_centroid(_labels(spark, folder).predictions)


def _proximity(make: Callable, metric: str, places: int = 6) -> Callable:
    return lambda spark, folder: _round(representative.audit_scores(make(spark, folder), metric), ["score"], places)


def medoid_distances(spark, folder):
    return _round(representative.medoid_distances(_ols(spark, folder).predictions), ["score"])


def representative_index(spark, folder):
    return _round(representative.nearest(representative.proximity_scores(_ols(spark, folder).predictions, "rmse")), ["score"])


def _trees(spark, folder, depth=2):
    return trees.grow_trees(_weighted(spark, folder), FEATURES, {k: list(v) for k, v in THRESHOLDS.items()}, depth)


def _node_rows(nodes: DataFrame) -> DataFrame:
    return _round(nodes.withColumnsRenamed({"left": "l", "right": "r"}), ["value"])


def stump_nodes(spark, folder):
    return _node_rows(_trees(spark, folder, 1))


def tree_nodes(spark, folder):
    return _node_rows(_trees(spark, folder))


def split_features(spark, folder):
    return trees.split_features(_trees(spark, folder))


def explanation_instability(spark, folder):
    return _round(trees.explanation_instability(_trees(spark, folder)), ["jaccard_mean", "jaccard_max", "distinct_structures"])


def root_agreement(spark, folder):
    return _round(trees.root_agreement(_trees(spark, folder)), ["root_agreement"])


def feature_paths(spark, folder):
    _, cases = _sides(spark, folder)
    paths = trees.split_feature_paths(_trees(spark, folder), cases, FEATURES)
    return paths.select("fit_id", "case_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def feature_paths_preorder(spark, folder):
    """Paths on the same trees with nodes numbered in preorder: numbers must not matter."""
    _, cases = _sides(spark, folder)
    anew = lambda c: F.when(F.col(c) < 0, F.col(c)).otherwise(F.get(F.array(*[F.lit(i) for i in (0, 1, 4, 2, 3, 5, 6)]), F.col(c))).cast("int").alias(c)
    nodes = _trees(spark, folder).select("fit_id", anew("node_id"), anew("left"), anew("right"), "feature", "threshold", "value")
    paths = trees.split_feature_paths(nodes, cases, FEATURES)
    return paths.select("fit_id", "case_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def representative_estimator_fit(spark, folder):
    """The selector itself: each candidate's distance to the centroid on the held-out rows, and which one it keeps."""
    found = representative.RepresentativeEstimator(Ols("x"), "regression", DRAWS, "rmse", TEST, seed=SEED).fit(order_cases(spark, folder).select("rid", "y", "x"))
    return _round(found.candidate_scores_.withColumn("selected", F.col("draw") == found.selected_index_ + 1), ["score"])


def representative_estimator_labels(spark, folder):
    """The selector on labels: split and draws by class, distance to the commonest label of each held-out row."""
    found = representative.RepresentativeEstimator(ClassShares("g"), "classification", DRAWS, "disagreement", TEST, seed=SEED).fit(order_cases(spark, folder).select("rid", F.col("label").alias("y"), "g"))
    return _round(found.candidate_scores_.withColumn("selected", F.col("draw") == found.selected_index_ + 1), ["score"])


def frontier_points_holdout(spark, folder):
    """A frontier that holds out its own cases."""
    found = stability_frontier(lambda penalty: Ols("x", penalty), {"penalty": list(PENALTIES)}, order_cases(spark, folder).drop("label"), n_bootstrap=DRAWS, test_size=TEST, seed=SEED)
    return _shown(found.points)


def linear_summary(spark, folder):
    design, cases = _design(spark, folder)
    means = linear.linear_summary(linear.linear_instability(design, cases, ["one", "x"], sigma=2.0))
    return _round(means, means.columns, 8)


def shrinkage_two_columns(spark, folder):
    """Coefficients of two columns at right angles, under each way to tell the signal."""
    design, _ = _design(spark, folder)
    middle = design.agg(F.avg("x")).first()[0]
    design = stored(design.select("one", (F.col("x") - middle).alias("c"), "y"), "design")
    rows = []
    for signal, options in (("pooled", {}), ("per_direction", {"signal": "per_direction"}), ("beta", {"beta": [1.0, 2.0]})):
        rows += [(signal, i, float(c)) for i, c in enumerate(linear.shrinkage_coefficients(design, ["one", "c"], "y", mu=500.0, **options))]
    return spark.createDataFrame(rows, "signal string, i int, coefficient double").select("signal", "i", F.round("coefficient", 6).alias("coefficient"))


def path_agreement(spark, folder):
    _, cases = _sides(spark, folder)
    return _round(trees.path_agreement(_trees(spark, folder), cases, FEATURES), ["path_agreement"])


def _design(spark, folder):
    train, cases = _sides(spark, folder)
    return train.select(F.lit(1.0).alias("one"), "x", "y"), cases.select("case_id", F.lit(1.0).alias("one"), "x")


def gram_matrix(spark, folder):
    return _round(linear.gram(_design(spark, folder)[0], ["one", "x"]), ["value"], 3)


def _linear(spark, folder, **options):
    design, cases = _design(spark, folder)
    found = linear.linear_instability(design, cases, ["one", "x"], **options)
    return _round(found.select("case_id", "variance", "s2", "s1", "centered_mad"), ["variance", "s2", "s1", "centered_mad"], 8)


def linear_instability(spark, folder):
    return _linear(spark, folder, sigma=2.0)


def linear_instability_hc0(spark, folder):
    return _linear(spark, folder, y="y", robust=True)


def shrinkage_coefficients(spark, folder):
    coef = linear.shrinkage_coefficients(_design(spark, folder)[0], ["x"], "y", mu=5.0)
    return spark.createDataFrame([(float(c),) for c in coef], "coefficient double").select(F.round("coefficient", 6).alias("coefficient"))


def linear_frontier(spark, folder):
    found = linear.linear_frontier(_design(spark, folder)[0], ["x"], "y", n_points=6, mu_max=100.0)
    return _round(_round(found.select("mu", "risk_optimal", "bias2", "variance", "risk", "s2", "s1", "sigma"), ["bias2", "variance", "risk", "s2", "s1", "sigma"]), ["mu"], 8)


def linear_frontier_two_columns(spark, folder):
    """A frontier of two columns that aren't at right angles."""
    found = linear.linear_frontier(_design(spark, folder)[0], ["one", "x"], "y", n_points=6, mu_max=100.0)
    return _round(_round(found.select("mu", "risk_optimal", "bias2", "variance", "risk", "s2", "s1", "sigma"), ["bias2", "variance", "risk", "s2", "s1", "sigma"]), ["mu"], 8)


def linear_frontier_embeddings(spark, folder):
    """A frontier of 63 columns: how the first component of a vector follows from the others."""
    vectors = table(spark, folder, "embeddings").select("embedding").where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    names = [f"e{i}" for i in range(64)]
    design = stored(vectors.where(F.size("embedding") == len(names)).select(*[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), "vectors")
    found = linear.linear_frontier(design, names[1:], names[0])
    return _round(found.select("mu", "risk_optimal", "bias2", "variance", "risk", "s2", "s1", "sigma"), ["mu", "bias2", "variance", "risk", "s2", "s1", "sigma"], 8)


def _plot(spark, folder):
    audit = _ols(spark, folder)
    original, predictions, _ = plotdata.displayed(audit)
    return audit, original, predictions


def plot_scatter(spark, folder):
    _, original, predictions = _plot(spark, folder)
    return _round(plotdata.scatter(original, predictions), ["x", "y"])


def plot_limits(spark, folder):
    _, original, predictions = _plot(spark, folder)
    return _round(plotdata.limits(original, predictions), ["low", "high"])


def plot_band(spark, folder):
    _, original, predictions = _plot(spark, folder)
    return _round(plotdata.band(original, predictions), ["centre", "lower", "upper"])


def plot_mape_bins(spark, folder):
    audit, original, _ = _plot(spark, folder)
    return _round(plotdata.mape_bins(original, audit.case_stats), ["centre", "mean", "p90"])


def plot_mape_overall(spark, folder):
    return _round(plotdata.plot_mape_by_prediction(_ols(spark, folder))["overall"], ["mean"])


def _vectors(spark, folder):
    return _labels(spark, folder, "predict_proba")


_FUNCTIONS = [
    pairs_bootstrap_weights, stratified_bootstrap_weights, holdout_split, stratified_holdout_split, distinct_classes, original_fit_ols, bootstrap_predictions_ols,
    bootstrap_instability_ols, bootstrap_instability_constant, bootstrap_instability_group_mean, bootstrap_instability_labels, bootstrap_instability_probabilities, bootstrap_instability_lines, bootstrap_instability_merged,
    mape_standard_error, pairwise_jackknife_numeric, pairwise_jackknife_labels, pairwise_jackknife_vector, one_class_rejections, redraw_accounting, class_alignment,
    param_grid, frontier_points_labels, frontier_points_ridge, pareto_front_mape, frontier_two_families, constrained_choice, plot_frontier, r2_score, weighted_r2, accuracy_score, weighted_accuracy,
    centroid_numeric, centroid_labels, medoid_distances, representative_index, stump_nodes, tree_nodes, split_features, explanation_instability, root_agreement,
    feature_paths, path_agreement, gram_matrix, linear_instability, linear_instability_hc0, shrinkage_coefficients, linear_frontier, plot_scatter, plot_limits, plot_band, plot_mape_bins,
    feature_paths_preorder, representative_estimator_fit, representative_estimator_labels, frontier_points_holdout, linear_summary, shrinkage_two_columns, plot_mape_overall, linear_frontier_two_columns, linear_frontier_embeddings,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FUNCTIONS} | {
    "pareto_front": pareto_front_query,
    "case_variance": _stat(_ols, "per_point"),
    "case_pairwise": _stat(_ols, "pairwise"),
    "case_mape": _stat(_ols, "mape"),
    "label_modal_disagreement": _stat(_labels, "per_point"),
    "label_pairwise": _stat(_labels, "pairwise"),
    "label_mape": _stat(_labels, "mape"),
    "vector_variance": _stat(_vectors, "per_point", 9),
    "vector_mape": _stat(_vectors, "mape", 9),
    "proximity_rmse": _proximity(_ols, "rmse"),
    "proximity_mae": _proximity(_ols, "mae"),
    "proximity_correlation": _proximity(_means, "correlation"),
    "proximity_disagreement": _proximity(_labels, "disagreement"),
    "proximity_probability_mse": _proximity(_vectors, "probability_mse", 9),
}

__all__ = ["ORACLES", "QUERIES"]
