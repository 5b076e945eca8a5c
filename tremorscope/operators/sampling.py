"""Resampling as tables: numbered rows, hash draws, weights, splits.

Nothing here keeps state: a draw is a function of (seed, draw, slot), so any
executor, and any other SQL engine, gets the same one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import product
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.shared import stored

BUCKET_DIGITS = 3
#: Strata up to which the offsets of all buckets are broadcast.
FEW_STRATA = 100


def hashed(seed: int | str, *parts) -> Column:
    """md5 of the parts joined by '|', as hex."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def hash_number(seed: int | str, *parts) -> Column:
    """The first 52 bits of the hash as a number."""
    return F.conv(F.substring(hashed(seed, *parts), 1, 13), 16, 10).cast("long")


def _placed(rows: DataFrame, key: str, seed: int | str, by: str | None, name: str) -> DataFrame:
    """``rows`` with ``name`` as in ``numbered``, and total_, the number of rows (within ``by``)."""
    keys = [by] if by else []
    tagged = rows.withColumn("h_", hashed(seed, key)).withColumn("p_", F.substring("h_", 1, BUCKET_DIGITS))
    local = F.row_number().over(Window.partitionBy(*keys, "p_").orderBy("h_", key)) - 1
    kept = stored(tagged.withColumn("local_", local).drop("h_"), "numbered")
    counts, whole = kept.groupBy(*keys, "p_").agg(F.count("*").alias("n_")), Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("n_").over(whole.orderBy("p_")) - F.col("n_")
    offsets = counts.select(*[F.col(k).alias("s_") for k in keys], F.col("p_").alias("q_"), before.alias("before_"), F.sum("n_").over(whole).alias("total_"))
    same = F.col("p_") == F.col("q_")
    if by:
        same = same & F.col(by).eqNullSafe(F.col("s_"))
    if not by or kept.select(by).distinct().limit(FEW_STRATA + 1).count() <= FEW_STRATA:
        offsets = F.broadcast(offsets)  # a row a bucket (and stratum)
    out = kept.join(offsets, same).select(*rows.columns, (F.col("before_") + F.col("local_")).alias(name), "total_")
    out.stored_at = kept.stored_at
    return out


def _shown(placed: DataFrame, *columns) -> DataFrame:
    out = placed.select(*columns)
    out.stored_at = placed.stored_at
    return out


def numbered(rows: DataFrame, key: str, seed: int | str, by: str | None = None, name: str = "idx") -> DataFrame:
    """Adds ``name``: 0, 1, ... (within ``by``) in the order of (hash of key, key).

    Hashes spread evenly, so rows are numbered inside buckets of the first
    digits, and buckets are offset by the counts of those before: two small
    windows in place of one over everything. Rows are read once and written to
    the shared folder with their place in the bucket; ``dropped`` on the result
    deletes them.
    """
    return _shown(_placed(rows, key, seed, by, name), *rows.columns, name)


def holdout_split(rows: DataFrame, key: str, test_size: float, seed: int | str, strata: str | None = None) -> DataFrame:
    """Adds boolean ``is_test``: the ceil(test_size n) rows (of each stratum) with the smallest hashes.

    Rows are read once and written to the shared folder; ``dropped`` on the
    result deletes them. Only the bucket of hashes in which the test rows (of a
    stratum) end is put in order: no other row moves.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be strictly between 0 and 1")
    kept = stored(rows.withColumn("p_", F.substring(hashed(seed, key), 1, BUCKET_DIGITS)), "split")
    if strata:
        return _stratified_split(kept, rows.columns, key, test_size, seed, strata)
    counts = sorted(tuple(r) for r in kept.groupBy("p_").count().collect())  # a row a bucket
    left, last = ceil(sum(n for _, n in counts) * float(test_size)), ""
    for last, n in counts:
        if left <= n:
            break
        left -= n
    place = F.row_number().over(Window.partitionBy("p_").orderBy(hashed(seed, key), key))
    ends = stored(kept.where(F.col("p_") == last).select(*rows.columns, (place <= left).alias("is_test")), "split-end")
    out = kept.where(F.col("p_") != last).select(*rows.columns, (F.col("p_") < last).alias("is_test")).unionByName(ends)
    out.stored_at = [kept.stored_at, ends.stored_at]
    return out


def _stratified_split(kept: DataFrame, names: list[str], key: str, test_size: float, seed: int | str, strata: str) -> DataFrame:
    counts, stratum = kept.groupBy(F.col(strata).alias("s_"), F.col("p_").alias("last_")).agg(F.count("*").alias("n_")), Window.partitionBy("s_")  # a row a bucket and stratum
    left = F.ceil(F.sum("n_").over(stratum) * F.lit(float(test_size))) - (F.sum("n_").over(stratum.orderBy("last_")) - F.col("n_"))
    edges = stored(counts.withColumn("left_", left).where("left_ > 0 and left_ <= n_").drop("n_"), "split-edges")  # a row a stratum
    near = F.broadcast(edges) if edges.limit(FEW_STRATA + 1).count() <= FEW_STRATA else edges
    met = kept.join(near, F.col(strata).eqNullSafe(F.col("s_")))
    place = F.row_number().over(Window.partitionBy("s_").orderBy(hashed(seed, key), key))
    ends = stored(met.where("p_ = last_").select(*names, (place <= F.col("left_")).alias("is_test")), "split-end")
    out = met.where("p_ != last_").select(*names, (F.col("p_") < F.col("last_")).alias("is_test")).unionByName(ends)
    out.stored_at = [kept.stored_at, edges.stored_at, ends.stored_at]
    return out


#: Rows of a bucket at most; a table has 64 buckets or more, if it has so many rows.
BUCKET_ROWS, LEAST_BUCKETS = 2000, 64


def bucket_rows(n: int) -> int:
    return max(1, min(BUCKET_ROWS, -(-n // LEAST_BUCKETS)))


def _bucket_counts(spark: SparkSession, sizes: dict[str | None, int], attempts: Sequence[int], seed: int | str) -> DataFrame:
    """(draw, attempt, stratum, bucket, c, size): how many of a draw's slots fall on each bucket of rows, and the bucket's rows. The stratum None is the table as a whole.

    Slots come from a range, already in even partitions, and are counted where
    they are: what is shuffled is a number a draw and bucket.
    """
    names, starts, total = sorted(sizes, key=str), [], 0
    for s in names:
        starts.append(total)
        total += sizes[s]
    slots = spark.range(total * len(attempts)).select((F.floor(F.col("id") / total) + 1).cast("int").alias("draw"), F.pmod("id", F.lit(total)).alias("at"))
    slots = slots.withColumn("attempt", F.element_at(F.array(*[F.lit(int(a)) for a in attempts]), F.col("draw")))
    which = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("at"))) if len(names) > 1 else F.lit(1)
    table = F.array(*[F.struct(F.lit(s).cast("string").alias("stratum"), F.lit(a).cast("long").alias("start"), F.lit(sizes[s]).cast("long").alias("n"), F.lit(bucket_rows(sizes[s])).cast("long").alias("m")) for s, a in zip(names, starts, strict=True)])
    placed = slots.withColumn("k", F.element_at(table, which)).select("draw", "attempt", "k.stratum", "k.n", "k.m", (F.col("at") - F.col("k.start")).alias("slot"))
    parts = ["attempt", "stratum", "slot"] if names != [None] else ["attempt", "slot"]
    bucket = F.floor(F.pmod(hash_number(seed, *parts), F.col("n")) / F.col("m")).cast("long")
    return placed.groupBy("draw", "attempt", "stratum", bucket.alias("bucket"), F.least("m", F.col("n") - bucket * F.col("m")).alias("size"), "m").agg(F.count("*").alias("c"))


#: Slots that a task deals over rows; counts of slots are so small that Spark alone would put all buckets into one task.
TASK_SLOTS = 1 << 19


def _weights(counts: DataFrame, seed: int | str, slots: int, stratified: bool) -> DataFrame:
    """(draw, stratum, idx, w): a bucket's slots are dealt over its rows where the bucket is, in tasks of about TASK_SLOTS of all ``slots``."""
    keys = [*(["stratum"] if stratified else []), "bucket", "draw"]
    dealt = counts.repartition(1 + slots // TASK_SLOTS, *keys).select("*", F.explode(F.sequence(F.lit(0), F.col("c").cast("int") - 1)).alias("j"))
    parts = ["attempt", *keys[:-1], "j"]
    idx = F.col("bucket") * F.col("m") + F.pmod(hash_number(seed, *parts), F.col("size"))
    stratum = F.col("stratum") if stratified else F.lit(None).cast("string").alias("stratum")
    return dealt.groupBy(*keys, idx.alias("idx")).agg(F.count("*").alias("w")).select("draw", stratum, "idx", "w")


def bootstrap_weights(spark: SparkSession, n: int, n_draws: int, seed: int | str) -> DataFrame:
    """(draw, idx, w): how often each of n numbered rows is drawn in n draws with replacement, draw by draw.

    A draw's n slots fall on buckets of rows on end, and a bucket's slots on its
    rows, each by a hash: an exact n of n.
    """
    return _weights(_bucket_counts(spark, {None: n}, range(1, n_draws + 1), seed), seed, n * n_draws, False).select("draw", "idx", "w")


def stratified_weights(spark: SparkSession, sizes: dict[str, int], n_draws: int, seed: int | str) -> DataFrame:
    """(draw, stratum, idx, w): each stratum redrawn to its own size; idx numbers rows within the stratum."""
    return _weights(_bucket_counts(spark, sizes, range(1, n_draws + 1), seed), seed, sum(sizes.values()) * n_draws, True)


def dealt(rows: DataFrame, sizes: dict[str | None, int], attempts: Sequence[int], seed: int | str, strata: str | None = None) -> DataFrame:
    """``rows`` with array<int> ``times_``: how often each of ``attempts`` draws the row, as by ``bootstrap_weights``.

    ``rows`` carry ``idx`` (within ``strata``). A bucket's rows meet the
    bucket's counts, a number a draw, and are drawn there: no slot and no row
    number is shuffled, and rows move once for all draws. A task holds a bucket
    of some thousand rows and its draws at a time. Python gives each row back
    once, whatever the number of draws.
    """
    stratified, n_draws = strata is not None, len(attempts)
    m = {s: bucket_rows(n) for s, n in sizes.items()}
    if stratified:
        per = F.element_at(F.map_from_arrays(F.array(*[F.lit(s) for s in m]), F.array(*[F.lit(x) for x in m.values()])), F.col(strata))
    else:
        per = F.lit(m[None])
    placed = rows.select("*", (F.col(strata) if stratified else F.lit(None).cast("string")).alias("stratum_"), F.floor(F.col("idx") / per).cast("long").alias("bucket_"))
    counts = _bucket_counts(rows.sparkSession, sizes, attempts, seed).select("draw", "attempt", "stratum", "bucket", "c", "size", "m")
    names, text = rows.columns, str(seed)

    def drawn(table: pa.Table, counts: pa.Table) -> pa.Table:
        n = table.num_rows
        times = np.zeros((n, n_draws), dtype=np.int32)
        place = np.argsort(table.column("idx").to_numpy()) if n else np.zeros(0, dtype=np.int64)
        ends = [str(j).encode() for j in range(max(counts.column("c").to_pylist(), default=0))]
        for c in counts.to_pylist() if n else ():
            head = "|".join([text, str(c["attempt"]), *([c["stratum"]] if stratified else []), str(c["bucket"]), ""]).encode()
            hashes = b"".join([hashlib.md5(head + end).digest() for end in ends[: c["c"]]])
            hits = (np.frombuffer(hashes, dtype=">u8")[::2] >> np.uint64(12)) % np.uint64(c["size"])  # the first 52 bits
            times[place, c["draw"] - 1] = np.bincount(hits.astype(np.int64), minlength=n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_draws + 1, n_draws, dtype=np.int32)), pa.array(times.reshape(-1)))
        return pa.Table.from_arrays([*table.select(names).columns, lists], names=[*names, "times_"])

    schema = T.StructType([*rows.schema.fields, T.StructField("times_", T.ArrayType(T.IntegerType()))])
    return placed.groupBy("stratum_", "bucket_").cogroup(counts.groupBy("stratum", "bucket")).applyInArrow(drawn, schema)


def drawn_rows(rows: DataFrame, original: bool = False) -> DataFrame:
    """(draw, w, other columns) of what ``dealt`` gives: the rows that each draw holds, with their multiplicity. With ``original`` draw 0 is each row once."""
    times = F.concat(F.array(F.lit(1)), "times_") if original else F.col("times_")
    names = [c for c in rows.columns if c != "times_"]
    each = rows.select(*names, F.posexplode(times).alias("at_", "w")).where("w > 0")
    return each.select((F.col("at_") + (0 if original else 1)).cast("int").alias("draw"), F.col("w").cast("long").alias("w"), *names)


def resampled(rows: DataFrame, sizes: dict[str | None, int], attempts: Sequence[int], seed: int | str, strata: str | None = None) -> DataFrame:
    """(draw, w, columns of rows): the drawn rows of each of ``attempts``, which become draws 1, 2, ..., with their multiplicity, as dealt by ``dealt``."""
    return drawn_rows(dealt(rows, sizes, attempts, seed, strata))


def classes_per_draw(weighted: DataFrame, target: str = "y") -> DataFrame:
    """(draw, n_classes): how many distinct labels each draw holds."""
    return weighted.groupBy("draw").agg(F.count_distinct(target).alias("n_classes"))


def usable_draws(weights: DataFrame, train: DataFrame, target: str, n_draws: int) -> DataFrame:
    """(draw, attempt): the first ``n_draws`` attempts with two labels or more, numbered from 1.

    ``weights`` holds attempts under ``draw``. There is one row an attempt, and
    attempts are capped, so the window is small whatever the data.
    """
    return first_usable(weights.join(train.select("idx", target), "idx"), target, n_draws)


def first_usable(drawn: DataFrame, target: str, n_draws: int) -> DataFrame:
    """The same from drawn rows (draw, target)."""
    held = drawn.groupBy("draw").agg((F.min(target) < F.max(target)).alias("several"))
    good = held.where("several").select(F.col("draw").alias("attempt"))
    return good.select(F.row_number().over(Window.orderBy("attempt")).alias("draw"), "attempt").where(F.col("draw") <= n_draws)


def param_grid(grid) -> list[dict]:
    """All combinations of a dict of lists, or of each dict in a list; an empty dict is one configuration. Names in sorted order vary last first."""
    out = []
    for one in [grid] if isinstance(grid, dict) else list(grid):
        names = sorted(one)
        out.extend(dict(zip(names, values, strict=True)) for values in product(*[one[n] for n in names]))
    return out


def display_sample(cases: DataFrame, key: str, max_points: int, seed: int = 0) -> DataFrame:
    """At most ``max_points`` rows, those with the smallest hashes of their key."""
    return cases.orderBy(hashed(seed, key), key).limit(max_points)
