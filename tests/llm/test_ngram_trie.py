import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tremorscope.llm import ngram_trie as lm


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + ["\n"]


class Brute:
    def __init__(self, rows):
        self.c1, self.c2, self.c3 = Counter(), defaultdict(Counter), defaultdict(Counter)
        for doc_id, text in rows:
            if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
                t = words_of(text)
                self.c1.update(t)
                self.c2[None][t[0]] += 1
                for i in range(1, len(t)):
                    self.c2[t[i - 1]][t[i]] += 1
                    self.c3[(t[i - 2] if i > 1 else None, t[i - 1])][t[i]] += 1
        self.n, self.v = sum(self.c1.values()), len(self.c1)

    def p1(self, w):
        return (self.c1[w] + 1) / (self.n + self.v + 1)

    def mixed(self, seen, w, lower):
        if not seen:
            return lower
        c = sum(seen.values())
        return max(seen[w] - 0.75, 0) / c + 0.75 * len(seen) / c * lower

    def p(self, u, v, w):
        return self.mixed(self.c3.get((u, v)), w, self.mixed(self.c2.get(v), w, self.p1(w)))

    def row(self, doc_id, text):
        t = words_of(text)
        score = math.log10(self.mixed(self.c2.get(None), t[0], self.p1(t[0]))) + sum(math.log10(self.p(t[i - 2] if i > 1 else None, t[i - 1], t[i])) for i in range(1, len(t)))
        return len(t), sum(self.c1[w] > 0 for w in t), self.n, sum(math.log10(self.p1(w)) for w in t), score


@pytest.mark.parametrize("batch_bytes", [600, 10**7])
def test_scores_match_brute_force(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(lm, "BATCH_BYTES", batch_bytes)
    rng = random.Random(8)
    vocab = [rng.choice("abcdefé") * rng.randint(1, 3) + rng.choice("xyzXYZ") for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice((5, 60))]) for _ in range(rng.choice((0, 1, 2, 30, 80))))) for i in range(150)]
    rows += [(200, None), (None, "only here\n null"), (201, " \t\x0b"), (202, "a a a a " * 3000), (203, "unseen words é" if zlib.crc32(b"203") % 7 == 2 else "x"), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kind", "1 as batch").repartition(3)
    brute = Brute(rows)
    got = sorted(lm.digest(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, known, total, base, score = brute.row(r.doc_id, texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert abs(r.base_score - base) < 1e-6 * max(1, n)
        assert -3 * lm.STEP * n - 1e-9 <= r.score - score <= 1e-6
    assert lm.digest(docs.limit(0)).count() == 0


def test_split_words_score_as_whole_ones(spark, monkeypatch):
    """However words are split over shards, the scores are the same; the shares of a context sum to at most 1."""
    rng = random.Random(1)
    vocab = ("the", "the", "the", "a", "b", "c", *(f"w{i}" for i in range(40)))
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((0, 1, 50))))) for i in range(90)]
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    following = sorted({"", *vocab, "zzz"})
    texts = {d: f"a the {w}".strip() for d, w in zip(held, following, strict=False)} | {d: f"zzz the {w}".strip() for d, w in zip(held[60:], following, strict=False)}
    docs = spark.createDataFrame(rows + list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "BATCH_BYTES", 400)
    whole = {r.doc_id: r.score for r in lm.digest(docs).collect()}
    for piece, shard in ((40, 10**6), (10, 150)):
        monkeypatch.setattr(lm, "PIECE_TOKENS", piece)
        monkeypatch.setattr(lm, "SHARD_TOKENS", shard)
        monkeypatch.setattr(lm, "WORD_SHARD_CHARS", 800)
        split = {r.doc_id: r.score for r in lm.digest(docs).collect()}
        assert split.keys() == whole.keys() and all(abs(split[d] - whole[d]) < 1e-9 for d in whole)
    brute = Brute(rows)
    for u, ids in (("a", held), ("zzz", held[60:])):
        n = len(following)
        shares = [10 ** (whole[d] - whole[ids[0]]) for d in ids[:n]]  # against the end of the text
        assert sum(brute.p(u, "the", w or "\n") for w in following) <= 1 + 1e-9 and all(x > 0 for x in shares)


def test_steps_round_trip():
    rng = np.random.default_rng(4)
    x, y, z = (rng.integers(0, 5, 300) for _ in range(3))
    o = np.lexsort((z, y, x))
    got = lm._unstepped(*(a.astype(np.int64) for a in lm._steps(x[o], y[o], z[o])))
    assert all((a == b).all() for a, b in zip(got, (x[o], y[o], z[o]), strict=True))


def test_held_out_gains_on_repeated_phrases(spark):
    rng = random.Random(2)
    phrases = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(6)) for _ in range(20)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(8))) for i in range(200)]
    got = [r for r in lm.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 0), (7, 5), (1000, 10**9), (5000, 100), (3, 2**50), (8, 7)):
        values = np.unique(rng.integers(0, top + 1, n))
        n = len(values)
        coded = lm.EliasFano(*(x if isinstance(x, int) else np.frombuffer(x, dtype=np.uint8) for x in lm.EliasFano.coded(values)))
        assert coded.get(np.arange(n)).tolist() == values.tolist()
        asked = np.concatenate([values, rng.integers(0, top + 3, 200)])
        for first, end in ((0, n), (n // 3, n // 2)):
            want = [next((i for i in np.flatnonzero(values == x) if first <= i < end), -1) for x in asked]
            assert coded.find(asked, np.full(len(asked), first), np.full(len(asked), end)).tolist() == want
