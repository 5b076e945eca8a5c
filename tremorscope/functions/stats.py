"""Scores, quantiles and ranks as DataFrame expressions."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored

#: Mean absolute difference of two Gaussian draws, and of one from its mean, in standard deviations.
PAIRWISE, CENTERED_MAD = 2 / sqrt(pi), sqrt(2 / pi)
NAN = float("nan")


def weighted_r2(y: Column, pred: Column, w: Column | None = None, mean: Column | None = None) -> Column:
    """R2 as an aggregate over rows that carry the (weighted) mean of y; a constant target gives 1 if it is met exactly, else 0."""
    w = F.lit(1.0) if w is None else w
    sse, sst = F.sum(w * F.pow(y - pred, F.lit(2))), F.sum(w * F.pow(y - mean, F.lit(2)))
    return F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst))


def r2_by(df: DataFrame, keys: list[str], w: str | None = None) -> DataFrame:
    """(keys, score): R2 of ``pred`` for ``y`` in each group; the mean comes from a first aggregate."""
    weight = F.lit(1.0) if w is None else F.col(w)
    means = df.groupBy(*keys).agg((F.sum(weight * F.col("y")) / F.sum(weight)).alias("mean_"))
    joined = df.join(means, keys) if keys else df.crossJoin(F.broadcast(means))
    return joined.groupBy(*keys).agg(weighted_r2(F.col("y"), F.col("pred"), weight, F.col("mean_")).alias("score"))


def accuracy_by(df: DataFrame, keys: list[str], w: str | None = None) -> DataFrame:
    weight = F.lit(1.0) if w is None else F.col(w)
    right = F.when(F.col("pred") == F.col("y"), 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg((F.sum(weight * right) / F.sum(weight)).alias("score"))


def score_by(df: DataFrame, keys: list[str], task: str, w: str | None = None) -> DataFrame:
    return accuracy_by(df, keys, w) if task == "categorical" else r2_by(df, keys, w)


def pick(index: Column, values: list) -> Column:
    """values[index] of a short driver-side list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def exact_quantile(df: DataFrame, column: str, q: float, small: int = 100_000) -> float:
    """The linearly interpolated quantile, exact, with no full sort in one task.

    Approximate quantiles bracket the wanted ranks; counting below the bracket
    and repeating inside it leaves at most ``small`` rows for the last,
    exact step. Nulls don't count; no rows give NaN.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return NAN
    at = (n - 1) * q
    first, last, below, inside = floor(at), ceil(at), 0, n
    while inside > small and low < high:
        a, b = rows.where(F.col("v").between(low, high)).approxQuantile("v", [max(0.0, (first - below) / inside - 0.01), min(1.0, (last - below + 1) / inside + 0.01)], 0.002)
        under, within = rows.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
        if not under <= first <= last < under + within or within >= inside:
            break
        low, high, below, inside = a, b, under, within
    if low == high:
        return float(low)
    span = max(inside - 1, 1)
    part = rows.where(F.col("v").between(low, high)).agg(F.percentile("v", F.lit((first - below) / span)).alias("a"), F.percentile("v", F.lit((last - below) / span)).alias("b")).first()
    return part.a + (part.b - part.a) * (at - first)


#: Rows that a range should hold.
RANGE_ROWS = 200_000


def in_ranges(df: DataFrame, *order: Column, rows: int = RANGE_ROWS, part: str = "part_") -> DataFrame:
    """``df`` dealt into ranges of ``order``, about ``rows`` each, and written so; ``part`` numbers the ranges in that order.

    Rows that are equal in ``order`` share a range. The edges are Spark's own
    sample; the plan doesn't grow with the data. What fits one range isn't
    written: there are no edges to hold on to.
    """
    parts = 1 + df.count() // rows
    if parts == 1:
        return df.repartition(1).withColumn(part, F.spark_partition_id())
    return stored(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, column: str, tie: str, name: str = "rank", rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the 0-based global rank by (column, tie) without sorting everything in one task.

    A row's rank is the number of rows in earlier ranges plus its place in its
    own; a common value is spread over ranges by the tie. The counts, a row a
    range, are what is broadcast.
    """
    placed = in_ranges(df, F.col(column).asc(), F.col(tie).asc(), rows=rows)
    counts = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(F.lit(0)).orderBy("part_")) - F.col("n_")
    offsets = counts.select(F.col("part_").alias("of_"), before.alias("before_"))
    local = F.row_number().over(Window.partitionBy("part_").orderBy(column, tie)) - 1
    return placed.withColumn("local_", local).join(F.broadcast(offsets), F.col("part_") == F.col("of_")).select(*df.columns, (F.col("before_") + F.col("local_")).alias(name))


def quantiles_by(df: DataFrame, key: str, column: str, wanted: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(key, a column for each of ``wanted``): linearly interpolated quantiles of a few groups, however large, exact.

    Mergeable approximate quantiles bracket each wanted rank. Values under the
    bracket are only counted; those inside, about one in ``accuracy`` / 4 of a
    group's, are counted by value, so a common one is a single row, and put in
    order with running counts. Nulls don't count.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(key).alias("k_"), F.col(column).cast("double").alias("v_"))
    slack, shares = 2.0 / accuracy, list(wanted.values())
    ends = [F.percentile_approx("v_", [max(0.0, q - slack), min(1.0, q + slack)], accuracy).alias(f"e{i}") for i, q in enumerate(shares)]
    brackets = rows.groupBy("k_").agg(F.count("*").alias("n_"), *ends).withColumnRenamed("k_", "b_")  # a row a group
    joined = rows.join(F.broadcast(brackets), F.col("k_") == F.col("b_"))
    few = F.col("n_") * slack < 2  # then the bracket is opened to all values
    cells = []
    for i in range(len(shares)):
        low, high = (F.when(few, F.lit(edge)).otherwise(F.get(f"e{i}", F.lit(j))) for j, edge in ((0, float("-inf")), (1, float("inf"))))
        cells.append(F.when(F.col("v_") <= high, F.struct(F.lit(i).alias("i"), F.when(F.col("v_") >= low, F.col("v_")).alias("v"))))
    each = joined.select("k_", "n_", F.explode(F.array_compact(F.array(*cells))).alias("x"))
    pairs = each.groupBy("k_", "n_", F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k_", "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("n_") - 1) * F.element_at(F.array(*[F.lit(q) for q in shares]), F.col("i") + 1)
    holds = lambda rank: F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("v")))
    spots = pairs.withColumns({"upto": upto, "at": at}).groupBy("k_", "i").agg(holds(F.floor("at")).alias("a"), holds(F.floor("at") + 1).alias("b"), F.max(F.col("at") - F.floor("at")).alias("share"))
    value = F.col("a") + (F.coalesce("b", "a") - F.col("a")) * F.col("share")
    return spots.groupBy(F.col("k_").alias(key)).agg(*[F.max(F.when(F.col("i") == i, value)).alias(name) for i, name in enumerate(wanted)])


def equal_bins(rank: Column, n: int, k: int) -> Column:
    """The bin of a 0-based rank when n rows fill k bins of equal count, the first n mod k one larger."""
    k = max(1, min(k, n))
    size, extra = divmod(n, k)
    edge = extra * (size + 1)
    return F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(extra + F.floor((rank - edge) / max(size, 1))).cast("int")


def dot(x: Column, row: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def squared_norm(x: Column, matrix: list[list[float]]) -> Column:
    """|matrix x|^2 of an array column."""
    return reduce(lambda a, b: a + b, [F.pow(dot(x, row), F.lit(2)) for row in matrix], F.lit(0.0))
