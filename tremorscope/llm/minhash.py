"""MinHash over sets of five-word shingles: tuned bands, band keys of whole units and of every window of a text."""

from __future__ import annotations

from itertools import chain
from math import ceil, log

import numpy as np
import xxhash

WORDS, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.999, 64
#: A window is a paragraph of so many words, wherever lines begin and end. Minima in a window's one band: equal windows always agree on them.
RUN, WINDOW_ROWS = 51, 1
#: Words of a window that is compared by similarity, and its bands and their minima. At SIMILARITY two windows share 50 shingles of 56, so they hold more than 50 words in common. A passage has several windows, so few bands are enough.
NEAR, NEAR_BANDS, NEAR_ROWS = 60, 4, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = pow(int(_BASE), -1, 1 << 64)


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and then the fewest bands, that find a pair of the wanted similarity with the wanted probability by ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = similarity**rows
        bands = 1 if p >= recall else ceil(log(1 - recall) / log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


BANDS, ROWS = tuned_bands()
_RANDOM = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_XOR, _ODD = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; null is empty."""
    return text.encode().lower().split() if text else []


def identity(words: list[bytes]) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash of the words."""
    h = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashed: np.ndarray) -> np.ndarray:
    """A hash of each WORDS words in turn, from the words' hashes; fewer words are one shingle."""
    width = min(WORDS, len(hashed))
    n = len(hashed) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out + hashed[k : k + n]) * _BASE
    return _mixed(out)


def shingles(words: list[bytes]) -> list[bytes]:
    return [b" ".join(w) for w in zip(*[words[i:] for i in range(WORDS)])] or [b" ".join(words)]


def jaccard(a: str, b: str) -> float:
    """The exact similarity of two units, given as words joined by spaces."""
    x, y = set(shingles(a.encode().split())), set(shingles(b.encode().split()))
    return len(x & y) / len(x | y)


def _folded(key: np.ndarray, low: np.ndarray) -> np.ndarray:
    key = (key ^ (low ^ (low >> np.uint64(31)))) * _BASE
    return key ^ (key >> np.uint64(32))


def _marks_of(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes of all units, one after the other, and where each unit's begin."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    if len(lists) and sizes.min() >= WORDS:
        # all words at once, without the shingles that reach into the next unit
        marks, kept = shingle_hashes(word_hashes(list(chain.from_iterable(lists)))), np.ones(sizes.sum() - WORDS + 1, dtype=bool)
        for k in range(1, WORDS):
            kept[np.cumsum(sizes)[:-1] - k] = False
        return marks[kept], np.cumsum(sizes - WORDS + 1) - (sizes - WORDS + 1)
    marks = [shingle_hashes(word_hashes(w)) for w in lists]
    return np.concatenate(marks), np.cumsum([0, *map(len, marks)])[:-1]


def band_keys(lists: list[list[bytes]]) -> np.ndarray:
    """One row a unit of BANDS keys, each of ROWS minima over its shingles."""
    flat, starts = _marks_of(lists)
    keys = np.empty((len(lists), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(lists), band + 1, dtype=np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            key = _folded(key, np.minimum.reduceat((flat ^ _XOR[j]) * _ODD[j], starts))
        keys[:, band] = key
    return keys


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        a, size = np.minimum(a[:-size], a[size:]), 2 * size
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def window_keys(hashed: np.ndarray) -> np.ndarray:
    """The band key of the RUN words from each word on: WINDOW_ROWS minima over their shingles. It stays the same over several windows on end."""
    n = max(len(hashed) - RUN + 1, 0)
    key = np.full(n, BANDS + 1, dtype=np.uint64)
    if n:
        marks = shingle_hashes(hashed)
        for j in range(WINDOW_ROWS):
            key = _folded(key, _sliding_min((marks ^ _XOR[j]) * _ODD[j], RUN - WORDS + 1))
    return key


def near_places(hashed: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles' hashes, starts, anchors, sides) of the windows of NEAR words that begin with, end with or lie around a shingle whose window key is in ``shared``.

    Where such a shingle stands in two texts, edits elsewhere don't move the windows that hang on it.
    """
    marks = shingle_hashes(hashed) if len(hashed) >= NEAR else np.empty(0, dtype=np.uint64)
    alone = _folded(np.full(len(marks), BANDS + 1, dtype=np.uint64), (marks ^ _XOR[0]) * _ODD[0])
    at = np.flatnonzero(np.isin(alone, shared))
    begin = np.concatenate([at - shift for shift in (0, (NEAR - WORDS) // 2, NEAR - WORDS)])
    fits = (begin >= 0) & (begin + NEAR <= len(hashed))
    return marks, begin[fits], np.tile(alone[at], 3)[fits], np.repeat(np.arange(1, 4, dtype=np.uint64), len(at))[fits]


def near_bands(marks: np.ndarray, begin: np.ndarray, anchor: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The band keys of the windows that ``near_places`` names, of one text or of several, whose marks stand one after the other. A window's minima are taken once, however many shingles it hangs on."""
    places, back = np.unique(begin, return_inverse=True)
    least = np.empty((NEAR_BANDS * NEAR_ROWS, len(places)), dtype=np.uint64)
    for i in range(0, len(places), 1024):  # bounded scratch
        sets = marks[places[i : i + 1024] + np.arange(NEAR - WORDS + 1)[:, None]]
        for j in range(len(least)):
            least[j, i : i + 1024] = ((sets ^ _XOR[j + 1]) * _ODD[j + 1]).min(axis=0)
    made = np.empty((len(begin), NEAR_BANDS), dtype=np.uint64)
    for band in range(NEAR_BANDS):
        key = _folded(anchor, side * np.uint64(1000) + np.uint64(band))
        for j in range(band * NEAR_ROWS, (band + 1) * NEAR_ROWS):
            key = _folded(key, least[j][back])
        made[:, band] = key
    return made


def near_windows(hashed: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, band keys) of the windows that ``near_places`` names in one text."""
    marks, begin, anchor, side = near_places(hashed, shared)
    return begin, near_bands(marks, begin, anchor, side)


def window_identity(words: list[bytes]) -> tuple[int, int]:
    """As ``identity``, but no line has the same."""
    return identity([b"\n", *words])


def window_identities(words: list[bytes], starts: list[int]) -> bytes:
    """The ``window_identity`` of the NEAR words from each start on, as bytes one after the other; the words are joined once."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1).tolist()
    return b"".join([xxhash.xxh3_128_digest(b"\n " + joined[ends[x - 1] if x else 0 : ends[x + NEAR - 1] - 1]) for x in starts])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(hashed: np.ndarray) -> np.ndarray:
    """A hash of all RUN words from each word on, in their order."""
    n = max(len(hashed) - RUN + 1, 0)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashed * _powers(int(_BASE), len(hashed)), dtype=np.uint64)])
    return _mixed((sums[RUN:] - sums[:-RUN]) * _powers(_UNBASE, n)) if n else np.empty(0, dtype=np.uint64)
