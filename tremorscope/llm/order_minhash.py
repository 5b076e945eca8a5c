"""Order MinHash fingerprints: signatures that follow edit distance, not only shared content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes a k-mer, k-mers a tuple, tuples a signature.
K, PICKED, SKETCHES = 8, 2, 16
LOWEST = -(2**63)
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S31, _S27, _S32 = np.uint64(31), np.uint64(27), np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S31)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S32)


_SEEDS = _mixed(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * _STEP)
_XOR, _ODD = _SEEDS[:SKETCHES, None], _SEEDS[SKETCHES:, None] | np.uint64(1)


def numbered_kmers(data: bytes) -> np.ndarray:
    """A 64-bit hash of each (k-mer, its how-manieth occurrence), in text order.

    A text shorter than K bytes is one k-mer.
    """
    if len(data) < K:
        data = data.ljust(K, b"\0")
    n = len(data) - K + 1
    windows = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))
    hashed = _mixed(windows)
    low = np.uint64((1 << max(20, n.bit_length())) - 1)
    ranked = np.sort((hashed & ~low) | np.arange(n, dtype=np.uint64))  # equal k-mers stand together, in text order
    at, group = (ranked & low).astype(np.int64), ranked & ~low
    again = np.zeros(n, dtype=bool)
    np.equal(group[1:], group[:-1], out=again[1:])
    if again.any():
        place = np.arange(n)
        occurrence = place - np.maximum.accumulate(np.where(again, 0, place))
        rows = np.flatnonzero(again)
        hashed[at[rows]] = _mixed(hashed[at[rows]] + occurrence[rows].astype(np.uint64) * _STEP)
    return hashed


def fingerprint(data: bytes) -> str:
    """SKETCHES tuples of PICKED k-mers as 8 hex digits each; of the empty text all zeros.

    For each of SKETCHES hash orders the PICKED smallest numbered k-mers are
    taken, put back into text order and hashed as one tuple.
    """
    if not data:
        return "0" * (8 * SKETCHES)
    hashed = numbered_kmers(data)
    rows = np.arange(SKETCHES)
    block = 1 << 15
    firsts: list[np.ndarray] = []
    for start in range(0, len(hashed), block):  # bounded scratch, however long the text
        part = (hashed[None, start : start + block] ^ _XOR) * _ODD
        for _ in range(min(PICKED, part.shape[1])):
            least = part.argmin(axis=1)
            firsts.append(np.stack([part[rows, least], (least + start).astype(np.uint64)]))
            part[rows, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    values, places = np.stack([x[0] for x in firsts]), np.stack([x[1] for x in firsts]).astype(np.int64)
    best = np.argsort(values, axis=0, kind="stable")[:PICKED]
    chosen = np.sort(np.take_along_axis(places, best, axis=0), axis=0)  # text order
    joined = np.zeros(SKETCHES, dtype=np.uint64)
    for row in chosen:
        joined = _mixed(joined * _MIX2 + hashed[row] + _STEP)
    return "".join(f"{x:08x}" for x in (joined >> _S32).tolist())


def likeness(a: str, b: str) -> float:
    """The share of equal tuples."""
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 8 * SKETCHES, 8)) / SKETCHES


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; null counts as empty."""
    schema = "doc_id long, n_chars long, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t.encode()) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


FOLDED = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("edge", T.BooleanType()),
        T.StructField("key", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("coded", T.BinaryType()),
    ]
)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter (rounded down) gives way to as many code points from the start of ``following``, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    The next document is the next larger doc_id; after the last comes the
    first. A null doc_id counts as the smallest; rows that share an id follow
    each other by fingerprint, length and coded text. A lone row is its own
    next. Null text is empty. An empty table gives an empty result.

    Ids are cut into as many ranges as there are shuffle partitions. Each row
    moves once, its text coded, to the task of its range; the first row of a
    range goes to the task before as well, so that each task has the row after
    its last. Tasks read their sorted rows one by one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("key"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(np.array(ids.selectExpr("cast(key as double) as key").approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [], dtype=np.float64))
    cuts = cuts.astype(np.int64)  # at most one for each partition
    where = F.array(*[F.lit(int(c)) for c in cuts]) if len(cuts) else F.array().cast("array<long>")
    block = F.size(F.filter(where, lambda c: c <= F.col("key")))
    firsts = sorted((r.b, r.least) for r in ids.groupBy(block.alias("b")).agg(F.min("key").alias("least")).collect())
    before = {least: firsts[i - 1][0] for i, (_, least) in enumerate(firsts)}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                key = LOWEST if doc_id is None else doc_id
                row = (key, doc_id, len(text or ""), fingerprint(data), coder.compress(data))
                out.append((int(np.searchsorted(cuts, key, side="right")), False, *row))
                if key in before:
                    out.append((before[key], True, *row))
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), _TYPES, strict=True)] if out else [pa.array([], f) for f in _TYPES], names=FOLDED.names)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = zstandard.ZstdDecompressor()
        last = None  # block, edge, doc_id, n_chars, fingerprint, text
        for batch in batches:
            out = []
            for block, edge, doc_id, n_chars, mark, coded in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)], strict=True):
                if last and last[1] and last[0] == block:
                    continue  # only the first row after the end counts
                text = decoder.decompress(coded).decode()
                if last and not last[1] and last[0] == block:
                    changed = edited(last[5], text).encode()
                    edit = fingerprint(changed)
                    out.append((last[2], last[3], hashlib.sha256(changed).hexdigest(), last[4], edit, likeness(last[4], edit), likeness(last[4], mark)))
                last = (block, edge, doc_id, n_chars, mark, text)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], f) for f in kinds], names=[x.split()[0] for x in RESULT.split(", ")])

    dealt = rows.mapInArrow(fold, FOLDED).repartitionById(n, F.col("block"))
    return dealt.sortWithinPartitions("block", "edge", "key", "fingerprint", "n_chars", "coded").mapInArrow(unfold, RESULT)


_TYPES = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())


def digest(docs: DataFrame) -> DataFrame:
    return against_next(docs)
