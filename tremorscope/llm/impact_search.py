"""Exact top-k inner products from an impact-ordered index, read score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE, TOP = 256, 5
#: Rows a block of the index, value bits that quantised impacts drop, and the factor from one round's least impact to the next's.
BLOCK, SHIFT, FALL = 32768, 2, 0.4


def quantised_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, data): floor(256 x) of each component as 64-bit integers; rows that take no part are left out.

    Components so large that the bounds of an inner product with a like vector,
    up to four times the product, might not fit 64 bits raise ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                values = np.asarray(x.values).astype(np.float64)
                if np.isfinite(values).all():
                    if len(values) and len(values) * (SCALE * np.abs(values).max() + 1) ** 2 >= 2.0**60:
                        raise ValueError(f"vector {i}: components too large for 64-bit scores")
                    out.append((i, len(values), np.floor(SCALE * values).astype("<i8").tobytes()))
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=["vec_id", "dim", "data"])

    return rows.select(F.col(vec_id).cast("long"), F.col(vector)).mapInArrow(run, "vec_id long, dim int, data binary")


class ImpactIndex:
    """Of each dimension, the rows in order of quantised value, as segments of equal value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, shift: int = SHIFT):
        self.ids, self.vectors, self.shift = ids, vectors, shift
        levels = vectors >> shift
        self.low, self.high = levels.min(axis=0), levels.max(axis=0)
        up = np.argsort(levels, axis=0, kind="stable")
        sorted_levels = np.take_along_axis(levels, up, axis=0)
        # two postings lists a dimension, by falling gain over the worst value: for weights above and below 0
        self.posts = [(np.ascontiguousarray(up[::-1, d].astype(np.int32)), np.ascontiguousarray(up[:, d].astype(np.int32))) for d in range(vectors.shape[1])]
        self.gains = [(np.ascontiguousarray(sorted_levels[::-1, d] - self.low[d]), np.ascontiguousarray(self.high[d] - sorted_levels[:, d])) for d in range(vectors.shape[1])]
        self.falling = [(-g, -h) for g, h in self.gains]  # as searchsorted wants them

    def search(self, query_id: int, query: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the query's own, ties to smaller ids.

        Segments are read by falling impact, the weight times the quantised
        gain. A row's score is at least ``least`` plus a constant and at most
        that plus ``slack``: what any row can still gain from the segments not
        read, and from what the quantised values leave open. Rows whose upper
        bound is below the k-th lower bound can't be among the best; reading
        ends when few are left or nothing is left to read, and all rows left
        are scored exactly.
        """
        n = len(self.ids)
        own = self.ids == query_id
        least = np.zeros(n, dtype=np.int64)
        dims = [d for d in range(len(query)) if query[d]]
        weight = {d: abs(int(query[d])) for d in dims}
        side = {d: int(query[d] < 0) for d in dims}
        span = {d: int(self.high[d] - self.low[d]) for d in dims}
        read = dict.fromkeys(dims, 0)
        bound = max((weight[d] * span[d] << self.shift for d in dims), default=0)
        few, left = max(4 * k, n // 64), ~own
        while True:
            bound = int(bound * FALL)
            slack = 0
            for d in dims:
                gain = max(1, -(-bound // (weight[d] << self.shift)))  # the least that is read in this round
                end = int(np.searchsorted(self.falling[d][side[d]], -gain, side="right"))
                start, read[d] = read[d], max(end, read[d])
                if end > start:
                    least[self.posts[d][side[d]][start:end]] += self.gains[d][side[d]][start:end] * (weight[d] << self.shift)
                slack += weight[d] * ((min(gain - 1, span[d]) << self.shift) + (1 << self.shift) - 1)
            if (~own).sum() > k:
                kth = np.partition(np.where(own, np.iinfo(np.int64).min, least), n - k)[n - k]
                left = ~own & (least + slack >= kth)
            if bound <= 1 or left.sum() <= few:
                break
        rows = np.flatnonzero(left)
        scores = self.vectors[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def search(rows: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by integer inner product; all, if fewer.

    ``rows`` and ``queries`` hold (vec_id, embedding). A query's own vec_id is
    no candidate; ties go to the smaller vec_id. Vectors that are null, or hold
    null or non-finite components, and null ids take no part. Only vectors of
    the query's length are candidates. Repeated candidates each count; of
    repeated queries of one id the smallest vector is asked. A query without
    candidates has no rows.

    Rows are dealt into blocks by a hash of their id, so that no vector however
    common fills a block, and go to their block once; queries go to every
    block. A task builds a block's index from its rows, which come first, and
    then answers the queries as they stream by. The k best a query and block are
    merged by rank.
    """
    data = quantised_vectors(rows)
    asked = quantised_vectors(queries).groupBy("vec_id", "dim").agg(F.min("data").alias("data"))
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("dim", "data")).alias("x")).select("vec_id", "x.dim", "x.data")
    blocks = max(1, -(-rows.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    dealt = data.select(block.alias("b"), "dim", F.lit(False).alias("asks"), "vec_id", "data")
    dealt = dealt.union(asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "dim", F.lit(True), "vec_id", "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for b, dim, asks, vec_id, vector in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if (b, dim) != at:
                    at, held, index = (b, dim), [], None
                if not asks:
                    held.append((vec_id, vector))
                elif held:
                    if index is None:
                        ids, vectors = zip(*held, strict=True)
                        index = ImpactIndex(np.array(ids), np.frombuffer(b"".join(vectors), dtype="<i8").reshape(len(ids), dim))
                    found, scores = index.search(vec_id, np.frombuffer(vector, dtype="<i8"), k)
                    out.extend((vec_id, int(i), int(s)) for i, s in zip(found, scores, strict=True))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = dealt.repartition("b").sortWithinPartitions("b", "dim", "asks").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where("vec_id % 50 = 0"))


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM kept q JOIN kept c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM ranked QUALIFY rank <= {TOP}
"""
