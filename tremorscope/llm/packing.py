"""Packing documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

CAPACITY, END_ID = 1024, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kept binary, lane int, ordinal long"


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer's own file, and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of whole texts by a byte-level BPE, as the tokenizer's file defines them.

    The ranks file holds the same merges; on texts below U+0240 without the
    special token, where both libraries split alike, its coder gives the same
    ids some times faster. All other texts go to the tokenizer itself.
    """

    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(paths[0])
        with open(paths[1], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if np.frombuffer(text.encode(), dtype=np.uint8).max() < 0xC9 and not any(t in text for t in self.special):
            return np.array(self.ranked.encode_ordinary(text), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut_pieces(docs: DataFrame, lanes: int, paths: tuple[str, str], capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and its end id as pieces of ``capacity`` and one rest.

    Rows hold doc_id, start, length, checksum, the document's ids in all, the
    ids of a rest (16 bits each; rests may be cut again), a lane (a hash of
    document and start modulo ``lanes``) and an ordinal that tells repeated
    rows of one document apart within a task.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ordinal = Encoder(paths), 0
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(mine), capacity):
                    piece = mine[start : start + capacity]
                    kept = piece.astype("<u4" if piece.max() >> 16 else "<u2").tobytes() if len(piece) < capacity else None
                    mixed = (((doc_id or 0) * 0x9E3779B97F4A7C15 + start * 0xBF58476D1CE4E5B9) & (2**64 - 1)) >> 33
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(mine), kept, mixed % lanes, ordinal))
                ordinal += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _slack(total: int, capacity: int) -> int:
    """Padding of a window that holds ``total`` ids: none at a power of two."""
    return 0 if total & (total - 1) == 0 else capacity - total


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill one window closest to ``capacity``, the largest length among them.

    Bitset subset-sum: bit s of a row is set if the lengths so far can sum to
    s; multiplicities are split into powers of two. The used counts are found
    by walking the rows backwards.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    top, room = lengths[0], capacity - lengths[0]
    full = (1 << (room + 1)) - 1
    rows, reach = [], 1
    for n in lengths:
        left = min(counts[n] - (n == top), room // n)
        step = 1
        while left > 0:
            k = min(step, left)
            rows.append((n, k, reach))
            reach |= (reach << (n * k)) & full
            left, step = left - k, step * 2
        if reach >> room & 1:
            break
    total = min((s for s in range(room + 1) if reach >> s & 1), key=lambda s: (_slack(s + top, capacity), -s))
    used = {top: 1}
    for n, k, before in reversed(rows):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + k
            total -= n * k
    return used


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], list[tuple], int, int]:
    """How the rests of each length fill windows: (segments, stream, windows, ids in the stream).

    A rest of length n with rank r, 0 to counts[n] - 1, follows the segment
    (n, first rank, after last rank, a window's share, first window, offset of
    the share) that holds r: with j = r - first rank it sits in window
    first window + j // share, at offset + (j % share) * n. A window's
    multiset repeats as often as the counts allow, so the work depends on how
    many lengths there are, not how many rests.

    Where even the closest sum with the largest length would need padding, the
    rests of that length go to the stream: (n, first rank, first place). There
    they stand end to end, to be cut where a window ends.
    """
    left = {n: c for n, c in counts.items() if c}
    given = dict.fromkeys(left, 0)
    segments, stream, windows, place = [], [], 0, 0
    while left:
        used = fullest(left, capacity)
        if _slack(sum(n * k for n, k in used.items()), capacity):
            top = max(left)
            stream.append((top, given[top], place))
            place += top * left.pop(top)
            continue
        times, offset = min(left[n] // k for n, k in used.items()), 0
        for n in sorted(used, reverse=True):
            k = used[n]
            segments.append((n, given[n], given[n] + k * times, k, windows, offset))
            given[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
            offset += n * k
        windows += times
    return segments, stream, windows, place


def window_starts(total: int, capacity: int) -> list[int]:
    """Where the windows of a stream's last, unfilled stretch start, and its end: powers of two, which need no padding."""
    at = total - total % capacity
    starts = [at]
    for b in reversed(range(capacity.bit_length())):
        if (total % capacity) >> b & 1:
            at += 1 << b
            starts.append(at)
    return starts


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, each with its window and its place there.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null and empty texts are their end id alone. Rows that share a doc_id are
    documents of their own. No documents give no rows. Extra columns take no
    part.

    Full pieces are windows of their own. The rests are counted by length and
    lane over all documents; the counts by length (``capacity`` numbers at
    most) are all that reaches the driver, where ``patterns`` plans windows for
    lengths. Ranks within a length come from the lanes' running counts and a
    row number inside (length, lane), so no task sees all rests of a common
    length. Each rest is then placed on its own, with its ids at hand if it is
    to be cut.
    """
    spark = docs.sparkSession
    lanes = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)  # a third of all rests in one length then splits into tasks of the usual size
    pieces = stored(cut_pieces(docs, lanes, paths or tokenizer_paths(), capacity), "pieces")
    by_lane = pieces.groupBy("length", "lane").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(by_lane.select("length", "lane", "n", F.coalesce(before, F.lit(0)).alias("first")), "lanes")
    counts = {r.length: r.n for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = counts.pop(capacity, 0)
    segments, stream, windows, streamed = patterns(counts, capacity)
    by_length: dict[int, list[tuple]] = {}
    for segment in segments:
        by_length.setdefault(segment[0], []).append(segment)
    firsts = {n: np.array([x[1] for x in rows]) for n, rows in by_length.items()}
    flowing = {n: (first, at) for n, first, at in stream}
    ends = np.array(window_starts(streamed, capacity))

    def cuts(at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(window of the stream, offset there, ids) of what stands at ``at``."""
        while length:
            if at < ends[0]:
                window, start, end = at // capacity, at - at % capacity, at - at % capacity + capacity
            else:
                k = int(np.searchsorted(ends, at, side="right"))
                window, start, end = int(ends[0]) // capacity + k - 1, int(ends[k - 1]), int(ends[k])
            take = min(length, end - at)
            yield window, at - start, take
            at, length = at + take, length - take

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, start, length, crc, total, kept, rank in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if length == capacity:
                    out.append((doc_id, start, length, crc, total, rank, 0))
                elif length in flowing and rank >= flowing[length][0]:
                    first, at = flowing[length]
                    ids, done = np.frombuffer(kept, dtype="<u2" if len(kept) == 2 * length else "<u4").astype("<u4"), 0
                    for window, offset, take in cuts(at + (rank - first) * length, length):
                        out.append((doc_id, start + done, take, zlib.crc32(ids[done : done + take].tobytes()), total, whole + windows + window, offset))
                        done += take
                else:
                    n, first, _, share, window, offset = by_length[length][int(np.searchsorted(firsts[length], rank, side="right")) - 1]
                    j = rank - first
                    out.append((doc_id, start, length, crc, total, whole + window + j // share, offset + (j % share) * n))
            kinds = [pa.int64()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    order = Window.partitionBy("length", "lane").orderBy("doc_id", "start", "ordinal", "ids_crc32")
    local = pieces.withColumn("r", F.row_number().over(order) - 1)
    ranked = local.join(offsets.select("length", "lane", "first"), ["length", "lane"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kept", (F.col("r") + F.col("first")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs)
