"""Language-model scores from an n-gram trie in Elias-Fano levels, sharded by context."""

from __future__ import annotations

import pickle
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: Text bytes a batch, after which it closes; code points of text to a word shard; occurrences to a context shard.
BATCH_BYTES, WORD_SHARD_CHARS, SHARD_TOKENS = 12_000_000, 24_000_000, 1_500_000
#: Training occurrences of a last context word to each piece that its occurrences are dealt in.
PIECE_TOKENS = 500_000
DISCOUNT, STEP = 0.75, 2.0**-11
END_WORD = b"\n"
#: Ids beside the known words' (0 and up): unknown words, the place before a text, the one before that.
UNKNOWN_ID, START_ID, NONE_ID = -1, -2, -3
HELD_MODULUS, HELD_VALUE = 7, 2
#: A batch's documents and its words for the word shards; the words' counts; the batch with them; followers of split words; the batch's base scores; occurrences; sums.
BATCH, WORDS, COUNTS, RESOLVED, FOLLOWERS, BASE, OCCURRENCES, SUMS = range(8)
ROWS = "kind int, batch long, shard long, train_tokens long, known long, blob binary"
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one coded blob; bytes of equal weight stand together, which codes better."""
    parts = [(a.dtype.str, a.shape, np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts))


def unpacked(blob: bytes) -> list[np.ndarray]:
    parts = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return [np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(shape) for kind, shape, raw in parts]


def small(a: np.ndarray) -> np.ndarray:
    """Unsigned values in the narrowest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def spread_bits(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_ONES = np.array([x.bit_count() for x in range(256)], dtype=np.int64)
#: Where a byte's k-th set bit is; of the complement, its k-th clear one.
_PLACE = np.array([[next((i for i in range(8) if x >> i & 1 and (x & ((1 << i) - 1)).bit_count() == k), 8) for k in range(8)] for x in range(256)], dtype=np.int64)


class EliasFano:
    """A monotone sequence, asked in its coded form: low bits packed, high bits in unary, in one byte string that may be a mapped file.

    Beside the bytes there is only a directory of how many bits are set up to
    each byte of the high part.
    """

    def __init__(self, n: int, low_bits: int, data: np.ndarray):
        self.n, self.low_bits = n, low_bits
        cut = (n * low_bits + 7) // 8 + 8
        self.low, self.high = data[:cut], data[cut:]
        self.ones = np.cumsum(_ONES[self.high])
        self.zeros = 8 * np.arange(1, len(self.high) + 1) - self.ones

    @staticmethod
    def coded(values: np.ndarray) -> tuple[int, int, bytes]:
        """(n, low bits, bytes) of a sorted array of values of at least 0."""
        n = len(values)
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        planes = np.empty((n, low_bits), dtype=np.uint8)
        for j in range(low_bits):
            planes[:, j] = (values >> j) & 1
        high = np.zeros((int(values[-1] >> low_bits) if n else 0) + n + 1, dtype=np.uint8)  # each run of equal high parts ends with a clear bit
        high[(values >> low_bits) + np.arange(n)] = 1
        return n, low_bits, np.packbits(planes.reshape(-1), bitorder="little").tobytes() + bytes(8) + np.packbits(high, bitorder="little").tobytes()

    def _select(self, k: np.ndarray, upto: np.ndarray, flip: int) -> np.ndarray:
        """The position of the k-th set (or clear) bit of the high part."""
        at = np.searchsorted(upto, k, side="right")
        bits = self.high[at] ^ np.uint8(flip)
        return 8 * at + _PLACE[bits, k - (upto[at] - _ONES[bits])]

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low_bits
        at, shift = bit >> 3, (bit & 7).astype(np.uint64)
        word = np.zeros(len(i), dtype=np.uint64)
        for j in range((self.low_bits + 14) // 8):
            word |= self.low[at + j].astype(np.uint64) << np.uint64(8 * j)
        return ((word >> shift) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return ((self._select(i, self.ones, 0) - i) << self.low_bits) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each x between ``first`` and ``end``, -1 where it isn't: the successor there is x or x is missing.

        The high bits give the few places that may hold x; low bits are
        compared among these by bisection.
        """
        high, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        some = (first < end) & (high < (self.zeros[-1] if len(self.zeros) else 0))
        rows = np.flatnonzero(some)
        h = high[rows]
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, 255) - h + 1, 0)
        hi = self._select(h, self.zeros, 255) - h
        lo, hi, end = np.maximum(lo, first[rows]), np.minimum(hi, end[rows]), np.minimum(hi, end[rows])
        asked = low[rows]
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            under = self._low(mid) < asked[active]
            lo[active[under]] = mid[under] + 1
            hi[active[~under]] = mid[~under]
            active = active[lo[active] < hi[active]]
        out = np.full(len(x), -1, dtype=np.int64)
        inside = np.flatnonzero(lo < end)
        hit = inside[self._low(lo[inside]) == asked[inside]]
        out[rows[hit]] = lo[hit]
        return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    fresh = np.zeros(len(columns[0]), dtype=bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


class Trie:
    """Levels in one mapped file: last context words, their followers, the words before them, and the followers of these pairs.

    Each level holds, for all parents in turn, the children's ids as offsets
    from their parent's stretch (parent rank * ids + child), which is monotone,
    and monotone pointers to where each parent's children start; and 16-bit
    quantised log10 probabilities or back-off weights. Training rows make the
    levels; any rows may ask.
    """

    def __init__(self, n_ids: int):
        self.n_ids, self.file, self.at, self.parts = n_ids, tempfile.TemporaryFile(), 0, {}

    def _put(self, name: str, n: int, bits: int, data: bytes) -> None:
        data += bytes(-len(data) % 8 or 8)
        self.file.write(data)
        self.parts[name] = (n, bits, self.at, len(data))
        self.at += len(data)

    def level(self, name: str, parents: int, parent: np.ndarray, child: np.ndarray, weights: np.ndarray) -> None:
        """Rows sorted by (parent rank, child)."""
        self._put(name, *EliasFano.coded(parent.astype(np.int64) * self.n_ids + child))
        self._put(name + ".pointers", *EliasFano.coded(np.searchsorted(parent, np.arange(parents + 1))))
        self._put(name + ".weights", len(weights), 16, quantised(weights).tobytes())

    def mapped(self) -> None:
        self.file.flush()
        self.map = np.memmap(self.file, dtype=np.uint8, mode="r", shape=(max(self.at, 1),))
        self.open = {k: EliasFano(n, bits, self._data(k)) for k, (n, bits, _, _) in self.parts.items() if not k.endswith("weights")}

    def _data(self, name: str) -> np.ndarray:
        _, _, at, size = self.parts[name]
        return self.map[at : at + size]

    def find(self, name: str, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The row of each (parent rank, child), -1 where there is none or the parent is -1: the child's successor between its parent's pointers."""
        out = np.full(len(parent), -1, dtype=np.int64)
        rows = np.flatnonzero((parent >= 0) & (child >= 0))
        if len(rows):
            above, pointers = parent[rows].astype(np.int64), self.open[name + ".pointers"]
            starts = _starts(above)  # equal parents stand together
            sizes = np.diff(np.append(starts, len(above)))
            out[rows] = self.open[name].find(above * self.n_ids + child[rows], np.repeat(pointers.get(above[starts]), sizes), np.repeat(pointers.get(above[starts] + 1), sizes))
        return out

    def weights(self, name: str, rows: np.ndarray) -> np.ndarray:
        """The log10 weights of rows, 0 where the row is -1."""
        n, _, at, _ = self.parts[name + ".weights"]
        out = np.zeros(len(rows))
        has = np.flatnonzero(rows >= 0)
        out[has] = self.map[at : at + 2 * n].view(np.uint16)[rows[has]] * -STEP
        return out

    def close(self) -> None:
        self.open = self.map = None
        self.file.close()


def quantised(logs: np.ndarray) -> np.ndarray:
    """Negative log10 values in steps, rounded away from 0, so that probabilities never sum to more than 1."""
    return np.minimum(np.ceil(-logs / STEP - 1e-9), 65535).astype(np.uint16)


def is_held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_MODULUS == HELD_VALUE


def tokenised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tokens a text, word hashes): ids point into the hashes, which are sorted; each text ends with the end token."""
    lowered = pc.ascii_lower(pa.array([x or "" for x in texts], pa.large_string()))
    lists = pc.ascii_split_whitespace(lowered)
    flat, ends = lists.flatten(), np.asarray(lists.offsets)
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(full)])
    words = flat.filter(pa.array(full)).dictionary_encode()
    sizes = np.diff(before[ends - ends[0]])
    hashes = np.array([xxhash.xxh3_64_intdigest(END_WORD), *map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist())], dtype=np.uint64)
    stream = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int32)
    is_end = np.zeros(len(stream), dtype=bool)
    is_end[np.cumsum(sizes + 1) - 1] = True
    stream[~is_end] = np.asarray(words.indices) + 1
    hashes, place = np.unique(hashes, return_inverse=True)
    return place[stream].astype(np.int32), sizes + 1, hashes


def batch_rows(batch: int, ids: list, texts: list, word_shards: int) -> list[tuple]:
    """A batch of documents as rows, see ``batches_of``."""
    stream, sizes, hashes = tokenised(texts)
    held = np.array([is_held(x) for x in ids])
    taught = np.bincount(stream[np.repeat(~held, sizes)], minlength=len(hashes))
    known = np.array([x is not None for x in ids])
    head = packed(np.array([x or 0 for x in ids], dtype=np.int64), known, held, small(sizes), small(stream))
    out = [(BATCH, batch, -1, int(taught.sum()), int((~held).sum()), head)]
    shard = (hashes >> np.uint64(32)) * np.uint64(word_shards) >> np.uint64(32)
    for s, a, b in _runs(shard):
        out.append((WORDS, batch, s, 0, 0, packed(np.diff(hashes[a:b], prepend=np.uint64(0)), small(taught[a:b]))))
    return out


def batches_of(docs: DataFrame, word_shards: int) -> DataFrame:
    """Rows of kind BATCH, documents as ids into the batch's own words, and of kind WORDS, these with their training counts, a row for each word shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, ids, texts, size, made = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal ids, texts, size, made
            found = batch_rows(first + made, ids, texts, word_shards)
            ids, texts, size, made = [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _KINDS, strict=True)], names=_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py())
                size += len(texts[-1] or "") + 16
                if size >= BATCH_BYTES:
                    yield closed()
        if ids:
            yield closed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS)


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    starts = np.flatnonzero(np.diff(sorted_values, prepend=sorted_values[:1] + 1))
    for a, b in zip(starts, [*starts[1:], len(sorted_values)][: len(starts)], strict=True):
        yield int(sorted_values[a]), int(a), int(b)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES)


def counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A word shard: each batch's words with their counts over all training rows and their rank among the known words of the shard."""
    asked = [unpacked(x) for x in pdf.blob]
    hashes = [np.cumsum(x[0], dtype=np.uint64) for x in asked]
    every, place = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.zeros(len(every), dtype=np.int64)
    np.add.at(counts, place, np.concatenate([x[1] for x in asked]).astype(np.int64))
    rank = np.where(counts > 0, np.cumsum(counts > 0), 0)
    out, at = [], 0
    for batch, shard, mine in zip(pdf.batch, pdf.shard, hashes, strict=True):
        here = place[at : at + len(mine)]
        at += len(mine)
        out.append((COUNTS, batch, shard, 0, int((counts > 0).sum()), packed(small(counts[here]), small(rank[here]))))
    return _frame(out)


@dataclass(frozen=True)
class Totals:
    """What is known of the training rows as a whole, and into how many shards they go."""

    tokens: int
    words: int
    texts: int
    shards: int
    piece_tokens: int
    #: By word shard, how many known words the shards before hold.
    before: dict[int, int]

    def pieces(self, count: np.ndarray) -> np.ndarray:
        """In how many pieces the occurrences after a word are dealt."""
        return (1 + count // self.piece_tokens).astype(np.uint64)

    def shard(self, mixed: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (spread_bits(mixed + piece) % np.uint64(self.shards)).astype(np.int64)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.words + 1)


def resolved(pdf: pd.DataFrame, totals: Totals) -> pd.DataFrame:
    """A batch with its words' global ids and counts, and the counted training followers of its split words, in slices of pairs.

    The place before a text always counts as split: all first words follow it.
    """
    doc_ids, known, held, sizes, stream = unpacked(pdf.blob[pdf.kind == BATCH].iloc[0])
    batch = int(pdf.batch.iloc[0])
    answers = pdf[pdf.kind == COUNTS].sort_values("shard")
    got = [unpacked(x) for x in answers.blob]
    count = np.concatenate([x[0] for x in got]).astype(np.int64)
    gid = np.concatenate([np.where(x[1] > 0, totals.before[s] + x[1].astype(np.int64) - 1, UNKNOWN_ID) for s, x in zip(answers.shard, got, strict=True)])
    out = [(RESOLVED, batch, -1, 0, 0, packed(doc_ids, known, held, sizes, stream, small(count), small(gid - UNKNOWN_ID)))]
    sizes, n = sizes.astype(np.int64), len(count)
    before = np.concatenate([[n], stream[:-1]]).astype(np.int64)
    before[np.cumsum(sizes) - sizes] = n
    split = np.append(totals.pieces(count) > 1, True)
    rows = np.flatnonzero(split[before] & np.repeat(~held, sizes))
    pairs, times = np.unique(before[rows] * (n + 1) + stream[rows], return_counts=True)
    v, w = pairs // (n + 1), pairs % (n + 1)
    pieces, vid, wid = totals.pieces(np.append(count, totals.texts))[v], np.append(gid, START_ID)[v], gid[w]
    shard = (spread_bits(spread_bits(vid) + wid.astype(np.uint64)) % np.uint64(totals.shards)).astype(np.int64)
    order = np.lexsort((wid, vid, shard))
    for s, a, b in _runs(shard[order]):
        mine = order[a:b]
        out.append((FOLLOWERS, batch, s, 0, 0, packed(vid[mine], wid[mine], small(times[mine]), small(pieces[mine]))))
    return _frame(out)


def followed(pdf: pd.DataFrame, totals: Totals) -> pd.DataFrame:
    """A slice of the split words' followers, summed over all batches, for each context shard that holds a piece of theirs."""
    v, w, n, pieces = (np.concatenate(x) for x in zip(*map(unpacked, pdf.blob), strict=True))
    order = np.lexsort((w, v))
    v, w, n, pieces = v[order], w[order], n[order].astype(np.int64), pieces[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    n, v, w, pieces = np.add.reduceat(n, starts), v[starts], w[starts], pieces[starts]
    heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    ends = np.append(heads[1:], len(v))
    wanted: dict[int, list] = {}
    for a, b in zip(heads, ends, strict=True):
        targets = totals.shard(np.repeat(spread_bits(v[a : a + 1]), pieces[a]), np.arange(pieces[a], dtype=np.uint64))
        for t in set(targets.tolist()):
            wanted.setdefault(t, []).append((a, b))
    out = []
    for t, spans in wanted.items():
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        out.append((FOLLOWERS, int(pdf["shard"].iloc[0]), t, 0, 0, packed(v[at], w[at], small(n[at]))))
    return _frame(out)


def dealt(row: tuple, totals: Totals) -> list[tuple]:
    """A resolved batch: its base scores, and the occurrences of word triples, dealt by context.

    Occurrences after a split word are dealt in pieces by a hash of the word
    before it, and first words by a hash of their own.
    """
    batch, blob = row
    doc_ids, known, held, sizes, stream, count, gid = unpacked(blob)
    gid, n = gid.astype(np.int64) + UNKNOWN_ID, len(count)
    stream, sizes, count = stream.astype(np.int64), sizes.astype(np.int64), np.append(count.astype(np.int64), [totals.texts, 0])
    gid = np.append(gid, [START_ID, NONE_ID])
    first = np.cumsum(sizes) - sizes
    base = np.log10(totals.unigram(count[:n]))
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    n_known = np.add.reduceat((count > 0).astype(np.int64)[stream], first)
    base_sum = np.add.reduceat(base[stream], first)
    v = np.concatenate([[n], stream[:-1]])
    v[first] = n
    u = np.concatenate([[n + 1], v[:-1]])
    u[first] = n + 1
    lost = count[v] == 0
    alone = np.bincount(doc[lost], base[stream[lost]], len(sizes)).astype(np.float64)
    out = [(BASE, batch, -1 - batch % totals.shards, 0, 0, packed(doc_ids, known, held, sizes, n_known, base_sum, alone))]
    unknown = np.flatnonzero(gid == UNKNOWN_ID)
    one = np.arange(len(gid))
    one[unknown] = unknown[0] if len(unknown) else 0  # one stands for all of them
    rows = np.flatnonzero(~lost)
    u, v, w, doc = one[u[rows]].astype(np.int32), v[rows].astype(np.int32), one[stream[rows]].astype(np.int32), doc[rows]
    mixed = spread_bits(gid)
    shard = totals.shard(mixed[v], mixed[np.where(v == n, w, u)] % totals.pieces(count)[v])
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    used, lut = np.zeros(len(gid), dtype=bool), np.zeros(len(gid), dtype=np.int64)
    for s, a, b in _runs(shard):
        mine = order[a:b]
        used[:] = False
        used[u[mine]] = used[v[mine]] = used[w[mine]] = True
        ids = np.flatnonzero(used)
        ids = ids[np.argsort(gid[ids], kind="stable")]
        lut[ids[np.argsort(-count[ids], kind="stable")]] = np.arange(len(ids))  # common words get small numbers, which code well
        x, y, z = lut[v[mine]], lut[u[mine]], lut[w[mine]]
        o = np.lexsort((z, y, x))
        x, y, z, d = x[o], y[o], z[o], doc[mine[o]]
        out.append((OCCURRENCES, batch, s, 0, 0, packed(small(np.diff(gid[ids], prepend=NONE_ID)), small(count[ids]), *_steps(x, y, z), small(d), held)))
    return out


def _steps(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
    """Sorted triples as steps: of x; of y among equal x; of z among equal (x, y)."""
    dx, dy = np.diff(x, prepend=0), np.diff(y, prepend=0)
    new_x = dx > 0
    new_x[:1] = True
    new_y = new_x | (dy != 0)
    return [small(dx), small(np.where(new_x, y, dy)), small(np.where(new_y, z, np.diff(z, prepend=0)))]


def _unstepped(dx: np.ndarray, dy: np.ndarray, dz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def summed(steps: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        sums, starts = np.cumsum(steps, dtype=np.int64), np.flatnonzero(fresh)
        return sums - np.repeat((sums - steps)[starts], np.diff(np.append(starts, len(steps))))

    new_x = dx > 0
    new_x[:1] = True
    y = summed(dy, new_x)
    new_y = new_x | (np.diff(y, prepend=-1) != 0)
    return np.cumsum(dx, dtype=np.int64), y, summed(dz, new_y)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and each key's rank among them, with little scratch."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(len(keys), dtype=np.int32)
    rank[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return ordered[fresh], rank


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is there."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys)))


def built(u: np.ndarray, v: np.ndarray, w: np.ndarray, none: int, followers: tuple, unigram: np.ndarray) -> Trie:
    """The trie of a shard's training occurrences.

    ``followers`` (v, w, n, totals, kinds) holds the counts of words that are
    split over shards, as rows v, w, n and, by v, the sums over all their
    followers; all others are counted here. Words after ``none`` have no
    context level.
    """
    n_ids = len(unigram)
    split_v, split_w, split_n, total, kinds = followers
    pairs, c_pair = _counts((v.astype(np.int64) * n_ids + w)[total[v] == 0])
    c_root = total + np.bincount(pairs // n_ids, c_pair, n_ids).astype(np.int64)
    t_root = kinds + np.bincount(pairs // n_ids, minlength=n_ids)
    pairs, c_pair = np.concatenate([pairs, split_v * n_ids + split_w]), np.concatenate([c_pair, split_n])
    order = np.argsort(pairs)
    pairs, c_pair = pairs[order], c_pair[order]
    inner = u != none
    contexts, context = _ranks((v.astype(np.int64) * n_ids + u)[inner])
    triples, c_triple = _counts(context.astype(np.int64) * n_ids + w[inner])
    context_of, word_of = triples // n_ids, triples % n_ids
    root_of, root_of_pair = contexts // n_ids, pairs // n_ids
    c_context, t_context = np.bincount(context_of, c_triple, len(contexts)), np.bincount(context_of, minlength=len(contexts))
    has = c_root > 0
    rank = np.where(has, np.cumsum(has) - 1, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        b_root, b_context = DISCOUNT * t_root / c_root, DISCOUNT * t_context / c_context
    p_pair = (c_pair - DISCOUNT) / c_root[root_of_pair] + b_root[root_of_pair] * unigram[pairs % n_ids]
    lower = p_pair[np.searchsorted(pairs, root_of[context_of] * n_ids + word_of)]
    p_triple = (c_triple - DISCOUNT) / c_context[context_of] + b_context[context_of] * lower
    trie = Trie(n_ids)
    trie.level("root", 1, np.zeros(has.sum(), dtype=np.int64), np.flatnonzero(has), np.log10(b_root[has]))
    trie.level("pair", int(has.sum()), rank[root_of_pair], pairs % n_ids, np.log10(p_pair))
    trie.level("context", int(has.sum()), rank[root_of], contexts % n_ids, np.log10(b_context))
    trie.level("triple", len(contexts), context_of, word_of, np.log10(p_triple))
    trie.mapped()
    return trie


def asked(trie: Trie, u: np.ndarray, v: np.ndarray, w: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The model's log10 probability of each w after u, v, sorted by (v, u, w): the triple's, or back-off weights and the pair's or the word's, which ``floor`` holds."""
    roots, contexts = _starts(v), _starts(v, u)
    root = np.repeat(trie.find("root", np.zeros(len(roots), dtype=np.int64), v[roots]), np.diff(np.append(roots, len(v))))
    context = np.repeat(trie.find("context", root[contexts], u[contexts]), np.diff(np.append(contexts, len(v))))
    triple = trie.find("triple", context, w)
    rest = np.flatnonzero(triple < 0)
    pair = trie.find("pair", root[rest], w[rest])
    low = trie.weights("pair", pair)
    none = np.flatnonzero(pair < 0)
    low[none] = trie.weights("root", root[rest[none]]) + floor[w[rest[none]]]
    value = trie.weights("triple", triple)
    value[rest] = trie.weights("context", context[rest]) + low
    return value


def scored(pdf: pd.DataFrame, totals: Totals) -> pd.DataFrame:
    """A context shard: the trie of its training occurrences, and each batch's document sums over all its occurrences."""
    heads, parts, tails = (pdf[pdf.kind == k] for k in (BASE, OCCURRENCES, FOLLOWERS))
    out = [(BASE, b, -1, 0, 0, x) for b, x in zip(heads.batch, heads.blob, strict=True)]
    if not len(parts):
        return _frame(out)
    shard = int(parts["shard"].iloc[0])
    batches, ids, counts, slices = parts.batch.tolist(), [], [], []
    for blob in parts.blob:
        gid, count, *steps, d, held = unpacked(blob)
        ids.append(np.cumsum(gid, dtype=np.int64) + NONE_ID)
        counts.append(count.astype(np.int64))
        spot = np.argsort(-counts[-1], kind="stable")
        slices.append((spot, *(x.astype(np.int32) for x in _unstepped(*(x.astype(np.int64) for x in steps))), d, ~held[d]))
    del parts, pdf
    every, place = np.unique(np.concatenate(ids), return_inverse=True)  # ids that stand for no word come first
    place = place.astype(np.int32)
    count = np.zeros(len(every), dtype=np.int64)
    count[place] = np.concatenate(counts)
    at = 0
    for i, (spot, v, u, w, d, taught) in enumerate(slices):
        here = place[at : at + len(spot)][spot]
        at += len(spot)
        slices[i] = here[v], here[u], here[w], d, taught
    del place, ids, counts
    unigram = totals.unigram(np.where(every < 0, 0, count))
    total, kinds = np.zeros(len(every), dtype=np.int64), np.zeros(len(every), dtype=np.int64)
    split = [np.zeros(0, dtype=np.int64)] * 3
    if len(tails):
        a, b, n = (np.concatenate(x).astype(np.int64) for x in zip(*map(unpacked, tails.blob), strict=True))
        v_at, w_at = (np.minimum(np.searchsorted(every, x), len(every) - 1) for x in (a, b))
        here = every[v_at] == a
        np.add.at(total, v_at[here], n[here])
        np.add.at(kinds, v_at[here], 1)
        here &= every[w_at] == b
        split = [v_at[here], w_at[here], n[here]]
    none = 0 if every[0] == NONE_ID else -1
    v, u, w = (np.concatenate([x[k][x[4]] for x in slices]) for k in range(3))
    trie = built(u, v, w, none, (*split, total, kinds), unigram)
    del u, v, w, split, total, kinds
    floor = -STEP * quantised(np.log10(unigram))
    for batch, (v, u, w, d, _) in zip(batches, slices, strict=True):  # equal triples of a batch stand together and are asked once
        order = np.lexsort((w, u, v))
        v, u, w, d = v[order], u[order], w[order], d[order]
        starts = _starts(v, u, w)
        value = np.repeat(asked(trie, u[starts], v[starts], w[starts], floor), np.diff(np.append(starts, len(v))))
        sums = np.bincount(d, value)
        present = np.unique(d)
        out.append((SUMS, batch, shard, 0, 0, packed(present, sums[present])))
    trie.close()
    return _frame(out)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def gathered(pdf: pd.DataFrame, tokens: int) -> pd.DataFrame:
    """A batch's documents with the sums of all shards."""
    doc_ids, known, held, sizes, n_known, base, score = unpacked(pdf.blob[pdf.kind == BASE].iloc[0])
    for blob in pdf[pdf.kind == SUMS].sort_values("shard").blob:
        docs, sums = unpacked(blob)
        score[docs] += sums
    ids = pd.array(doc_ids, dtype="Int64")
    ids[~known] = pd.NA
    return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": sizes, "n_known": n_known, "train_tokens": tokens, "base_score": base, "score": score})


def score_documents(docs: DataFrame) -> DataFrame:
    """log10 probabilities of all whole texts under a trigram model of the training rows.

    Training rows are those whose crc32(doc_id as text) mod 7 is not 2; a null
    doc_id trains. Null text is empty: only its end token counts. Repeated rows
    count each. The model interpolates absolutely discounted trigrams, bigrams
    and add-one unigrams, one of them for all unknown words; a text's first word
    follows the place before it. Stored probabilities are rounded down, so that
    those of a context never sum to more than 1. Words are told apart by 64-bit
    hashes. No training rows at all: every token is unknown. No rows give no
    rows.

    Texts are read once more after a count of their code points, into batches of
    ids. Exchanges of coded blobs follow: a batch's words to word shards and
    back with counts; the counted followers of common words to those shards
    that need them; occurrences to context shards, each of which builds its
    levels from training rows, maps them and answers all rows; the sums per
    document back to the batch. The occurrences after a word are dealt in
    pieces of PIECE_TOKENS, by the word before, so that no shard grows with a
    word; their follower counts are summed over all rows, so the scores are the
    same however words are split. Shards follow from counted code points and
    tokens, and only such counts reach the driver.
    """
    size = docs.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    made = stored(batches_of(docs, 1 + size // WORD_SHARD_CHARS), "lm-batches")
    answers = stored(made.where(F.col("kind") == WORDS).groupBy("shard").applyInPandas(counted, ROWS), "lm-words")
    seen = made.where(F.col("kind") == BATCH).agg(F.sum("train_tokens").alias("tokens"), F.sum("known").alias("texts")).first()
    known_words = sorted((r["shard"], r.n) for r in answers.groupBy("shard").agg(F.max("known").alias("n")).collect())  # a number a word shard
    before = dict(zip([s for s, _ in known_words], np.cumsum([0, *[n for _, n in known_words]]).tolist(), strict=False))
    totals = Totals(seen.tokens or 0, sum(n for _, n in known_words), seen.texts or 0, 1 + (seen.tokens or 0) // SHARD_TOKENS, PIECE_TOKENS, before)
    known = stored(made.where(F.col("kind") == BATCH).union(answers).groupBy("batch").applyInPandas(lambda pdf: resolved(pdf, totals), ROWS), "lm-resolved")
    dropped(made)  # all that follows reads what is resolved
    dropped(answers)
    tails = known.where(F.col("kind") == FOLLOWERS).groupBy("shard").applyInPandas(lambda pdf: followed(pdf, totals), ROWS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = dealt((number, blob.as_py()), totals)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _KINDS, strict=True)], names=_NAMES)

    spread = known.where(F.col("kind") == RESOLVED).select("batch", "blob").mapInArrow(deal, ROWS).union(tails)
    # as many tasks as shards, whatever the session's partitions are: a task then keeps its size as the corpus grows
    sums = spread.repartition(totals.shards, "shard").groupBy("shard").applyInPandas(lambda pdf: scored(pdf, totals), ROWS)
    return sums.groupBy("batch").applyInPandas(lambda pdf: gathered(pdf, totals.tokens), RESULT)


def digest(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
