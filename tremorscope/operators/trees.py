"""Trees as tables, grown level by level for all draws at once, and how alike they are.

A node table has rows (fit_id, node_id, left, right, feature, threshold,
value). Node 0 is the root; all other numbers are free, each fit's own; feature
is -1 at a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = "fit_id int, node_id int, left int, right int, feature int, threshold double, value double"
MOST_DEPTH = 200


def grow_trees(weighted: DataFrame, features: list[str], thresholds: dict[str, list[float]], depth: int) -> DataFrame:
    """Least-squares trees on rows (draw, w, y, features): one node table for all draws.

    A level is one aggregation by (draw, node) of the sums left of every
    threshold, with map-side combining; rows are then routed by the level's
    few splits. Only node tables, 2^level rows a draw, reach the driver. The largest reduction of squared error wins, ties to the
    smaller feature, then threshold. A node without a reduction is a leaf.
    """
    splits = [(f, t) for f, name in enumerate(features) for t in sorted(thresholds[name])]
    spark, kept, out = weighted.sparkSession, weighted.persist(), []
    rows = kept.withColumn("node_", F.lit(0))
    for level in range(depth + 1):
        sums = [F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s")]
        if level < depth:
            for i, (f, t) in enumerate(splits):
                left = F.col(features[f]) <= t
                sums += [F.sum(F.when(left, F.col("w")).otherwise(0)).alias(f"n{i}"), F.sum(F.when(left, F.col("w") * F.col("y")).otherwise(0.0)).alias(f"s{i}")]
        found = rows.groupBy("draw", "node_").agg(*sums)
        n, s = F.col("n"), F.col("s")
        if level == depth:
            nodes = found.withColumn("best", F.lit(None).cast("struct<gain:double,f:int,t:double>"))
        else:
            options = []
            for i, (f, t) in enumerate(splits):
                a, b = F.col(f"n{i}"), F.col(f"s{i}")
                gain = F.when((a > 0) & (a < n), F.try_divide(b * b, a) + F.try_divide((s - b) * (s - b), n - a) - s * s / n).otherwise(0.0)
                options.append(F.struct(F.round(gain, 9).alias("gain"), F.lit(-f).alias("f"), F.lit(-t).alias("t")))
            best = F.array_max(F.array(*options))
            nodes = found.withColumn("best", F.when(best["gain"] > 0, F.struct(best["gain"].alias("gain"), (-best["f"]).alias("f"), (-best["t"]).alias("t"))))
        split = F.col("best").isNotNull()
        table = nodes.select(
            F.col("draw").alias("fit_id"), F.col("node_").alias("node_id"),
            F.when(split, 2 * F.col("node_") + 1).otherwise(-1).alias("left"), F.when(split, 2 * F.col("node_") + 2).otherwise(-1).alias("right"),
            F.when(split, F.col("best.f")).otherwise(-1).alias("feature"), F.col("best.t").alias("threshold"), (s / n).alias("value"),
        )
        found_nodes = [tuple(r) for r in table.collect()]  # draws times nodes of one level
        out += found_nodes
        if level < depth:
            chosen = spark.createDataFrame(found_nodes, NODES).where("feature >= 0").select(F.col("fit_id").alias("d_"), F.col("node_id").alias("p_"), "feature", "threshold")
            joined = rows.join(F.broadcast(chosen), (F.col("draw") == F.col("d_")) & (F.col("node_") == F.col("p_")))
            goes_left = F.element_at(F.array(*[F.col(f) for f in features]), F.col("feature") + 1) <= F.col("threshold")
            rows = joined.withColumn("node_", F.when(goes_left, 2 * F.col("node_") + 1).otherwise(2 * F.col("node_") + 2)).drop("d_", "p_", "feature", "threshold")
    kept.unpersist()
    return spark.createDataFrame(out, NODES)


class RegressionTree:
    """A procedure for ``bootstrap_predictions``: trees on fixed thresholds."""

    def __init__(self, features: list[str], thresholds: dict[str, list[float]], depth: int = 2):
        self.features, self.thresholds, self.depth = features, thresholds, depth

    def fit(self, weighted: DataFrame) -> DataFrame:
        return grow_trees(weighted, self.features, self.thresholds, self.depth).withColumnRenamed("fit_id", "draw")

    def predict(self, model: DataFrame, cases: DataFrame) -> DataFrame:
        return routed(model.withColumnRenamed("draw", "fit_id"), cases, self.features).select(F.col("fit_id").alias("draw"), "case_id", F.col("value").alias("pred"))


def nodes_of(model, fit_id: int, spark) -> DataFrame:
    """The node table of a fitted pyspark.ml tree model, or of the one a ``RepresentativeEstimator`` selected; NaN goes right as in that library.

    Nodes are numbered as a walk, left before right, meets them. Anything that
    has no tree raises TypeError.
    """
    if hasattr(model, "get_selected_estimator"):
        chosen = model.get_selected_estimator()
        if isinstance(chosen, DataFrame) and {"node_id", "left", "right", "feature"} <= set(chosen.columns):
            return chosen.select(F.lit(fit_id).alias("fit_id"), *[x.split()[0] for x in NODES.split(", ")[1:]])
        model = next(iter(chosen.values())) if isinstance(chosen, dict) else chosen
    model = model.stages[-1] if hasattr(model, "stages") else model
    if not hasattr(model, "_call_java") or not hasattr(model, "toDebugString") or hasattr(model, "trees"):
        raise TypeError(f"a {type(model).__name__} is not a single tree")
    rows: list[list] = []

    def walk(node) -> int:
        at, inner = len(rows), node.subtreeDepth() > 0
        rows.append([fit_id, at, -1, -1, -1, None, float(node.prediction())])
        if inner:
            rows[at][4:6] = [node.split().featureIndex(), float(node.split().threshold())]
            rows[at][2] = walk(node.leftChild())
            rows[at][3] = walk(node.rightChild())
        return at

    walk(model._call_java("rootNode"))
    return spark.createDataFrame([tuple(r) for r in rows], NODES)


def _fits(nodes: DataFrame) -> DataFrame:
    return nodes.select("fit_id").distinct()


def splits(nodes: DataFrame, max_depth: int = 3) -> DataFrame:
    """(fit_id, depth, feature) of the inner nodes reached from the root, down to ``max_depth``."""
    level = nodes.where("node_id = 0 AND feature >= 0").select("fit_id", "node_id", "left", "right", "feature", F.lit(0).alias("depth"))
    out = level
    for depth in range(1, max_depth + 1):
        children = level.select("fit_id", F.explode(F.array("left", "right")).alias("node_id"))
        level = children.join(nodes.where("feature >= 0"), ["fit_id", "node_id"]).select("fit_id", "node_id", "left", "right", "feature", F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    return out.select("fit_id", "depth", "feature")


def split_features(nodes: DataFrame, max_depth: int = 3) -> DataFrame:
    """(fit_id, feature, n): how many inner nodes test each feature."""
    return splits(nodes, max_depth).groupBy("fit_id", "feature").agg(F.count("*").alias("n"))


@dataclass
class Forest:
    """Fits as arrays: of each node its children's places (its own at a leaf), feature (-1 at a leaf), threshold, value and the features tested on the way to it."""

    fits: np.ndarray
    roots: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    paths: pa.Array
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(cases x fits): the leaf of each case in each fit. A missing value goes right."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[at]
            goes_left = x[rows, np.maximum(feature, 0)] <= self.threshold[at]  # false for NaN
            at = np.where(goes_left, self.left[at], self.right[at])
        return at


def forest(nodes: pd.DataFrame, most: int = MOST_DEPTH) -> Forest:
    """The arrays of a node table. A fit without a root, a node given twice, a child that isn't there, or a way of over ``most`` splits (a loop, maybe) raises ValueError."""
    nodes = nodes.sort_values(["fit_id", "node_id"], kind="stable").reset_index(drop=True)
    fit, feature = nodes["fit_id"].to_numpy(), nodes["feature"].to_numpy(dtype=np.int64)
    places = pd.MultiIndex.from_arrays([fit, nodes["node_id"].to_numpy()])
    if places.has_duplicates:
        raise ValueError("a fit has two nodes of one number")
    place = lambda fits, ids: places.get_indexer(pd.MultiIndex.from_arrays([fits, ids]))
    fits, inner = np.unique(fit), feature >= 0
    roots = place(fits, np.zeros(len(fits), dtype=np.int64))
    sides = []
    for side in ("left", "right"):
        to = np.arange(len(nodes))
        to[inner] = place(fit[inner], nodes[side].to_numpy()[inner])
        sides.append(to)
    if (roots < 0).any() or any((to < 0).any() for to in sides):
        raise ValueError("a fit lacks its root, or a node its child")
    paths: list[list[int]] = [[] for _ in range(len(nodes))]
    level, depth = roots[inner[roots]], 0
    while len(level):
        depth += 1
        if depth > most:
            raise ValueError(f"a tree is over {most} splits deep")
        for n in level.tolist():
            for to in sides:
                paths[to[n]] = [*paths[n], int(feature[n])]
        below = np.concatenate([to[level] for to in sides])
        level = below[inner[below]]
    numbers = [nodes[c].to_numpy(dtype=float, na_value=np.nan) for c in ("threshold", "value")]
    return Forest(fits, roots, *sides, feature, *numbers, pa.array(paths, pa.list_(pa.int32())), depth)


def depth_of(nodes: DataFrame, most: int = MOST_DEPTH) -> int:
    """How many splits the longest way from a root passes; a way of over ``most`` raises ValueError."""
    return max((forest(nodes.where(F.col("fit_id").isin(fits)).toPandas(), most).depth for fits in _groups(nodes) if fits), default=0)


#: Nodes that are compiled, and go to the tasks, at once.
FOREST_NODES = 1_000_000


def _groups(nodes: DataFrame) -> list[list[int]]:
    """Fits in groups of about FOREST_NODES nodes; the driver sees a row a fit."""
    out, size = [[]], 0
    for fit, n in sorted(tuple(r) for r in nodes.groupBy("fit_id").count().collect()):
        if out[-1] and size + n > FOREST_NODES:
            out.append([])
            size = 0
        out[-1].append(fit)
        size += n
    return out


def routed(nodes: DataFrame, cases: DataFrame, features: list[str]) -> DataFrame:
    """(fit_id, case_id, path, value): the features tested on each case's way to its leaf, however nodes are numbered.

    Fits are compiled to arrays, and each batch of cases walks down all of them
    at once, where it is: no case row is joined or shuffled. Paths belong to
    leaves and are looked up there. Very many nodes are taken in groups of
    fits, a scan of the cases each. A missing value goes right.
    """
    names = ["fit_id", "case_id", "path", "value"]
    schema = T.StructType([T.StructField("fit_id", T.IntegerType()), T.StructField("case_id", cases.schema["case_id"].dataType), T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("value", T.DoubleType())])
    rows = cases.select("case_id", *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(features)])
    out = None
    for fits in _groups(nodes):
        chosen = nodes.where(F.col("fit_id").isin(fits)) if fits else nodes
        held = cases.sparkSession.sparkContext.broadcast(forest(chosen.select("fit_id", "node_id", "left", "right", "feature", "threshold", "value").toPandas()))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            trees = held.value
            step = max(1, (1 << 18) // max(1, len(trees.fits)))
            for whole in batches:
                for low in range(0, whole.num_rows, step):
                    batch = whole.slice(low, step)
                    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                    at = trees.leaves(x).reshape(-1)
                    case = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), len(trees.fits))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(trees.fits, len(x)), pa.int32()), case, trees.paths.take(pa.array(at)), pa.array(trees.value[at], from_pandas=True)], names=names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def split_feature_paths(nodes: DataFrame, cases: DataFrame, features: list[str]) -> DataFrame:
    return routed(nodes, cases, features).select("fit_id", "case_id", "path")


def jaccard_pairs(nodes: DataFrame, max_depth: int = 3) -> DataFrame:
    """(fit_a, fit_b, distance) of all pairs of fits: one less the shared over the joint feature multiset; two empty ones are alike.

    A fit is one row, its multiset a short map; there are as many as draws.
    """
    counted = split_features(nodes, max_depth).groupBy("fit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "n")))).alias("bag"))
    fits = _fits(nodes).join(counted, "fit_id", "left").select("fit_id", F.coalesce("bag", F.create_map().cast("map<int,bigint>")).alias("bag"))
    a, b = fits.select(F.col("fit_id").alias("fit_a"), F.col("bag").alias("a")), fits.select(F.col("fit_id").alias("fit_b"), F.col("bag").alias("b"))
    both = F.map_zip_with("a", "b", lambda k, x, y: F.struct(F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("lo"), F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("hi")))
    total = lambda part: F.aggregate(F.map_values(both), F.lit(0).cast("long"), lambda s, v: s + v[part])
    pairs = a.join(F.broadcast(b), F.col("fit_a") < F.col("fit_b"))
    return pairs.select("fit_a", "fit_b", F.coalesce(1 - F.try_divide(total("lo"), total("hi")), F.lit(0.0)).alias("distance"))


def explanation_instability(nodes: DataFrame, max_depth: int = 3) -> DataFrame:
    """One row: jaccard_mean, jaccard_max, distinct_structures. Needs two fits."""
    n = _fits(nodes).count()
    if n < 2:
        raise ValueError("explanation instability needs two fits or more")
    bags = split_features(nodes, max_depth).groupBy("fit_id").agg(F.array_sort(F.collect_list(F.struct("feature", "n"))).alias("bag"))
    kinds = _fits(nodes).join(bags, "fit_id", "left").agg((F.count_distinct(F.coalesce(F.to_json("bag"), F.lit("[]"))) / n).alias("distinct_structures"))
    return jaccard_pairs(nodes, max_depth).agg(F.avg("distance").alias("jaccard_mean"), F.max("distance").alias("jaccard_max")).crossJoin(F.broadcast(kinds))


def root_agreement(nodes: DataFrame) -> DataFrame:
    """One row: the share of fits with the commonest root feature; an unsplit root counts as a feature of its own."""
    if not nodes.limit(1).collect():
        raise ValueError("root agreement needs a fit")
    roots = nodes.where("node_id = 0").groupBy("feature").agg(F.count("*").alias("n"))
    return roots.agg((F.max("n") / F.sum("n")).alias("root_agreement"))


def path_agreement(nodes: DataFrame, cases: DataFrame, features: list[str]) -> DataFrame:
    """One row: the share of fits on a case's commonest path, averaged over cases."""
    if _fits(nodes).count() < 2:
        raise ValueError("path agreement needs two fits or more")
    counts = split_feature_paths(nodes, cases, features).groupBy("case_id", "path").agg(F.count("*").alias("n"))
    each = counts.groupBy("case_id").agg((F.max("n") / F.sum("n")).alias("share"))
    return each.agg(F.avg("share").alias("path_agreement"))

