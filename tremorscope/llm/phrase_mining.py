"""Phrase collocation mining over persisted occurrence relations, length by length."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, block_reads, block_writes, dropped, stored

LONGEST, LEAST, KEPT, COVER = 4, 30, 2000, 80
UNKNOWN = "und"
#: Bytes of text whose occurrences make a block.
BLOCK_BYTES = 4 << 20
#: Groups that a task gathers before it adds up those of several blocks, and sums it holds at most; occurrences that are worth a task, as many as a split of 128 MB has, and a bucket of groups.
COMBINED_ROWS, MOST_ROWS, TASK_WORDS, BUCKET_WORDS = 1 << 18, 1 << 20, 20_000_000, 1_000_000
#: Parts in which a task adds up its groups, one after the other.
PARTS = 16
#: A filter of frequent groups has 16 bits a group, but never more than these (16 MB); what it lets through besides is counted and found rare.
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 27
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_S = np.uint64(32)

# Byte kinds: 0 in a word, 1 between words, 2 between pieces.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def occurrences(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each occurrence's word, its position) in a text in UTF-8; from one piece to the next positions skip one."""
    raw = np.frombuffer(data.translate(_LOWER), dtype=np.uint8)
    kinds = _KINDS[raw]
    inside = kinds == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    piece = np.searchsorted(np.flatnonzero(kinds == 2), starts)
    # pieces without words don't matter: a step of one or more between words is one
    at = np.arange(len(starts), dtype=np.int64) + np.cumsum(np.append(0, np.minimum(np.diff(piece), 1))) if len(starts) else np.zeros(0, dtype=np.int64)
    letters = pa.py_buffer(raw[inside].tobytes())
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int64).tobytes()), letters])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), at


_WORDS = {"lang": pa.string(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "codes": pa.binary(), "gaps": pa.binary()}


def word_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The occurrence relation (piece, position, word) of each language, sorted, in blocks of whole texts: distinct words with their counts, words as numbers, positions as steps."""

    def packed(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        words, codes, at = occurrences(b"\n".join(texts))
        counts = np.bincount(codes, minlength=len(words))
        cells = ([lang], [words.cast(pa.large_string()).to_pylist()], [counts], [codes.astype("<i4").tobytes()], [np.diff(at, prepend=0).astype(np.uint8).tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, _WORDS.values(), strict=True)], names=list(_WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed blocks back
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        total = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if text := text.as_py():
                    waiting.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
                    total += len(text)
                while total >= 2 * block_bytes or size.get(lang, 0) >= block_bytes:
                    most = max(size, key=size.__getitem__)
                    total -= size.pop(most)
                    yield packed(most, waiting.pop(most))
        for lang, texts in waiting.items():
            yield packed(lang, texts)

    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(run, "lang string, words array<string>, counts array<long>, codes binary, gaps binary")


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each group of words, from the hashes of its words."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for i, column in enumerate(columns):
        out = (out ^ column.view(np.uint64)) * _ODD[i]
        out ^= out >> _S
    return out


def _bits(hashed: np.ndarray, bits: int) -> list[np.ndarray]:
    low = np.uint64(bits - 1)
    return [(hashed * odd >> np.uint64(20)) & low for odd in _ODD[:3]]


def group_filter(groups: DataFrame, n: int, length: int) -> np.ndarray:
    """Bits of a Bloom filter of the ``n`` groups (h0, h1, ...): bits are set by 64 at a time in tasks; only the filter, of bounded size, reaches the driver."""
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _bits(_mixed([batch.column(i).to_numpy() for i in range(length)]), bits):
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["slot", "bit"])

    slots = groups.select(*[f"h{i}" for i in range(length)]).mapInArrow(run, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    return out


def _passes(words: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    passed = np.ones(len(hashed), dtype=bool)
    for at in _bits(hashed, len(words) * 64):
        passed &= (words[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) != 0
    return passed


def _extended(codes: np.ndarray, at: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Where a group of the next length starts: the merge join of the sorted relation of live groups with itself, one position on."""
    start = np.flatnonzero(live[:-1] & live[1:])
    return start[at[start + 1] == at[start] + 1]


_NEXT = {"hashes": pa.list_(pa.int64()), "codes": pa.binary(), "gaps": pa.binary(), "live": pa.binary()}


def frequent_occurrences(blocks: DataFrame, words: np.ndarray, length: int) -> DataFrame:
    """Semi-join of the groups of ``length`` words with the frequent ones: the relation keeps the words that some frequent group holds, and marks where those groups start."""
    spark_words = blocks.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            for hashes, codes, at, live in _relations(batch):
                if length == 1:
                    start = np.flatnonzero(_passes(spark_words.value, _mixed([hashes]))[codes])
                else:
                    start = _extended(codes, at, live)
                    start = start[_passes(spark_words.value, _mixed([hashes[codes[start + i]] for i in range(length)]))]
                if not len(start):
                    continue
                held = np.zeros(len(codes), dtype=bool)
                for i in range(length):
                    held[start + i] = True
                marks = np.zeros(len(codes), dtype=bool)
                marks[start] = True
                left, again = np.unique(codes[held], return_inverse=True)
                steps = np.minimum(np.diff(at[held], prepend=-1), 2)  # two or more is no neighbour
                cells = ([hashes[left]], [again.astype("<i4").tobytes()], [steps.astype(np.uint8).tobytes()], [marks[held].tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, _NEXT.values(), strict=True)], names=list(_NEXT))

    return blocks.mapInArrow(run, "hashes array<long>, codes binary, gaps binary, live binary")


def _relations(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    for row in range(batch.num_rows):
        hashes = batch.column(0)[row].values.to_numpy(zero_copy_only=False)
        codes, gaps = (np.frombuffer(batch.column(i)[row].as_py(), dtype=k) for i, k in ((1, "<i4"), (2, np.uint8)))
        yield hashes, codes, np.cumsum(gaps, dtype=np.int64), np.frombuffer(batch.column(3)[row].as_py(), dtype=bool) if batch.num_columns > 3 else None


def _added(table: pa.Table) -> pa.Table:
    """The groups of all columns but the last, once each, with the sum of the last, c."""
    names = table.column_names[:-1]
    return table.group_by(names, use_threads=False).aggregate([("c", "sum")]).select([*names, "c_sum"]).rename_columns([*names, "c"])


class GroupSums:
    """Counts of groups that a task gathers: by part of the buckets, so that adding up and packing take room beside the counts for one part only."""

    def __init__(self, length: int, buckets: int):
        self.names, self.buckets = [*[f"h{i}" for i in range(length)], "c"], buckets
        self.waiting: list[list[pa.Table]] = [[] for _ in range(min(PARTS, buckets))]
        self.size, self.enough = 0, COMBINED_ROWS

    def put(self, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take distinct groups with their counts; gives packed sums, if groups don't come again or are too many to hold."""
        part = (self._bucket(columns) * len(self.waiting)) // self.buckets
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=len(self.waiting)))
        columns = [*columns, counts.astype(np.int64)]
        for tables, low, high in zip(self.waiting, np.append(0, ends[:-1]), ends, strict=True):
            if low < high:
                tables.append(pa.Table.from_arrays([pa.array(c[order[low:high]]) for c in columns], names=self.names))
        self.size += len(counts)
        if self.size < self.enough:
            return
        before = self.size
        self._add()
        if 2 * self.size <= before and self.size <= MOST_ROWS:  # groups come again: go on adding up
            self.enough = max(COMBINED_ROWS, 2 * self.size)
        else:
            yield from self.flushed()

    def flushed(self) -> Iterator[pa.RecordBatch]:
        self._add()
        for tables in self.waiting:
            if tables:
                yield from self._packed(tables.pop())
        self.size, self.enough = 0, COMBINED_ROWS

    def _bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        return (_mixed(columns) % np.uint64(self.buckets)).astype(np.int64)

    def _add(self) -> None:
        for tables in self.waiting:
            if len(tables) > 1:
                tables[:] = [_added(pa.concat_tables(tables))]
        self.size = sum(t.num_rows for tables in self.waiting for t in tables)

    def _packed(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [table.column(n).to_numpy() for n in self.names]
        bucket = self._bucket(columns[:-1])
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        heads = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = pa.array(np.append(heads, len(bucket)).astype(np.int32))
        made = pa.RecordBatch.from_arrays([pa.array(bucket[heads]), *[pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns]], names=["bucket", *self.names])
        step = max(1, len(heads) * BATCH_BYTES // made.nbytes)  # the JVM holds a batch outside its heap
        for i in range(0, len(heads), step):
            yield made.slice(i, step)


def group_counts(relation: DataFrame, length: int, least: int, words: int) -> DataFrame:
    """(h0, h1, ..., n): the groups of ``length`` words that occur ``least`` times, counted in each block, over a task's blocks, and over all.

    What a task counted travels in columns, a row for each bucket of groups; a
    bucket stands for some million of the relation's ``words``.
    """
    names, buckets = [f"h{i}" for i in range(length)], 1 + words // BUCKET_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        sums = GroupSums(length, buckets)
        for batch in batches:
            for hashes, codes, at, live in _relations(batch):
                start = _extended(codes, at, live)
                # words are numbered anew for each step, so that any number of them fits 64 bits
                key = codes[start].astype(np.int64)
                for i in range(1, length):
                    if i > 1:
                        key = np.unique(key, return_inverse=True)[1].reshape(-1)
                    key = key << 32 | codes[start + i]
                _, first, counts = np.unique(key, return_index=True, return_counts=True)
                yield from sums.put([hashes[codes[start[first] + i]] for i in range(length)], counts)
        yield from sums.flushed()

    def frequent(bucket: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        table = _added(pa.Table.from_arrays([pa.concat_arrays([x.flatten() for x in bucket.column(n).chunks]) for n in [*names, "c"]], names=[*names, "c"]))
        return table.filter(pc.greater_equal(table.column("c"), least)).rename_columns([*names, "n"])

    rows = relation.mapInArrow(run, "bucket long, " + ", ".join(f"{n} array<long>" for n in [*names, "c"]))
    return rows.groupBy("bucket").applyInArrow(frequent, ", ".join(f"{n} long" for n in [*names, "n"]))


def distinct_words(blocks: DataFrame, salt: int) -> DataFrame:
    """(lang, word, n, h0) of all distinct words."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    return each.groupBy("lang", "word").agg(F.sum("c").alias("n")).withColumn("h0", word_hash(salt, "lang", "word"))


def word_hash(salt: int, lang, word):
    return F.xxhash64(F.lit(salt), lang, word)


def scored(groups: dict[int, DataFrame], cover: int = COVER) -> dict[int, DataFrame]:
    """By length, (h0, ..., a, l, r, score) of the candidates that no longer one covers. ``groups`` holds frequent groups by length, words under 1."""
    names = lambda i, j: [f"h{k}" for k in range(i, j)]
    found, covered = {}, {}
    for length in range(2, max(groups) + 1):
        rows = groups[length].withColumnRenamed("n", "a")
        for cut in range(1, length):
            for side, low, high in (("l", 0, cut), ("r", cut, length)):
                part = groups[high - low].select(*[F.col(f"h{k - low}").alias(f"h{k}") for k in range(low, high)], F.col("n").alias(f"{side}{cut}"))
                rows = rows.join(part, names(low, high))
        cuts = [F.struct(F.expr(f"(cast(a as decimal(20,0)) * 2000000) div (cast(l{k} as decimal(20,0)) + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, length)]
        best = F.array_min(F.array(*cuts))
        found[length] = rows.withColumn("cut", best).select(*names(0, length), "a", "cut.l", "cut.r", "cut.score")
        for low in range(length):
            for high in range(low + 2, length + 1):
                if high - low < length:
                    part = groups[length].select(*[F.col(f"h{k}").alias(f"h{k - low}") for k in range(low, high)], F.col("n").alias("longer"))
                    covered.setdefault(high - low, []).append(part)
    out = {}
    for length, rows in found.items():
        if length in covered:
            most = reduce(DataFrame.unionByName, covered[length]).groupBy(*names(0, length)).agg(F.max("longer").alias("longer"))
            rows = rows.join(most, names(0, length), "left").where(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {cover}").drop("longer")
        out[length] = rows
    return out


def mine_phrases(docs: DataFrame, least: int = LEAST, kept: int = KEPT, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    Null languages are one, ``und``. Null and empty texts hold no words; rows
    that share a doc_id all count; other columns take no part. No words give no
    rows. Ties in score go by count, then by the phrase's bytes, so a rank is
    one phrase's.

    The occurrences of all words are written once, sorted by piece and
    position, in blocks of whole texts. For each length the relation of the
    groups so far is merge-joined with itself one position on, groups are
    counted in each block and then by a shuffle of counts, and the relation is
    semi-joined with the frequent ones before it grows. The semi-join asks a
    Bloom filter of bounded size; what passes it wrongly is counted like the
    rest and fails the exact count, so the result doesn't depend on the
    filter. Groups travel as the 64-bit hashes of their words; if any frequent
    word shares its hash with another word, all words are hashed anew with
    another salt. A common pair is a count a block, never a row an
    occurrence. Ranks are limited by partition before they meet.
    """
    if not 2 <= longest <= len(_ODD):
        raise ValueError(f"longest must be from 2 to {len(_ODD)}")
    spark = docs.sparkSession
    with block_writes(spark):
        first = stored(word_blocks(docs, block_bytes), "words")
        salt = 0
        while True:
            with block_reads(spark):
                words = stored(distinct_words(first, salt), "distinct-words")
            alike = words.groupBy("h0").agg(F.count("*").alias("k"), F.max("n").alias("most")).where(f"k > 1 and most >= {least}")
            if alike.isEmpty():
                break
            dropped(words)
            salt += 1
        groups = {1: words.where(F.col("n") >= least)}
        relation = first.select(F.transform("words", lambda w: word_hash(salt, F.col("lang"), w)).alias("hashes"), "codes", "gaps")
        held = first
        for length in range(2, longest + 1):
            known = groups[length - 1]
            bits = group_filter(known, known.count(), length - 1)
            with block_reads(spark):
                before, relation = held, stored(frequent_occurrences(relation, bits, length - 1), f"groups-{length - 1}")
                dropped(before)
                held = relation
                left = relation.agg(F.coalesce(F.sum(F.length("gaps")), F.lit(0))).first()[0]
                if length > 2:  # what is left may be little, and its groups recur in many blocks: tasks of the usual size add up more of them
                    relation = relation.coalesce(1 + left // TASK_WORDS)
                groups[length] = stored(group_counts(relation, length, least, left), f"frequent-{length}")
        dropped(held)
    parts = []
    for length, rows in scored(groups).items():
        for i in range(length):
            own = groups[1].select(F.col("h0").alias(f"h{i}"), F.col("word").alias(f"w{i}"), *(["lang"] if i == 0 else []))
            rows = rows.join(own, f"h{i}")
        parts.append(rows.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(length)]).alias("phrase"), "a", "l", "r", "score"))
    candidates = reduce(DataFrame.unionByName, parts)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    return mine_phrases(docs)


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), occurring AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded CROSS JOIN (VALUES (1), (2), (3), (4)) AS s(k)
), grams AS (
  SELECT lang, k, phrase, count(*) AS f FROM occurring GROUP BY ALL HAVING f >= 30
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2
), parts AS (
  SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail
  FROM candidates JOIN (VALUES (1), (2), (3)) AS s(j) ON j < k
), cuts AS (
  SELECT p.lang, p.phrase, p.k, p.a, x.f AS l, y.f AS r, (2000000::HUGEINT * p.a) // (x.f + y.f) AS score
  FROM parts p JOIN grams x ON x.lang = p.lang AND x.phrase = p.head JOIN grams y ON y.lang = p.lang AND y.phrase = p.tail
  QUALIFY row_number() OVER (PARTITION BY p.lang, p.phrase ORDER BY score, j) = 1
), inner_phrases AS (
  SELECT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, max(c.a) AS longer
  FROM candidates c JOIN (VALUES (2), (3)) AS s(m) ON m < c.k JOIN (VALUES (1), (2), (3)) AS t(i) ON i <= c.k - m + 1
  GROUP BY ALL
), kept AS (
  SELECT cuts.* FROM cuts LEFT JOIN inner_phrases USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
