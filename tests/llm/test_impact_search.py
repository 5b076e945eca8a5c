import math
import random

import numpy as np

from tremorscope.llm import impact_search as search


def test_index_is_exact():
    rng = np.random.default_rng(5)
    for n, dim, spread in ((1, 3, 9), (40, 1, 2), (900, 16, 60), (700, 8, 1), (300, 4, 10**6)):
        vectors = rng.integers(-spread, spread + 1, (n, dim))
        ids = rng.permutation(3 * n)[:n].astype(np.int64)
        index = search.ImpactIndex(ids, vectors)
        for q in [*vectors[:10], np.zeros(dim, dtype=np.int64), rng.integers(-spread, spread + 1, dim)]:
            own = int(ids[0])
            want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, vectors, strict=True) if i != own)[:5]
            got_ids, got_scores = index.search(own, q)
            assert [(-int(s), int(i)) for i, s in zip(got_ids, got_scores, strict=True)] == want


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 40)
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(220)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(300, None), (350, [math.nan] * 6), (401, [None] * 6), (402, [math.inf] * 6), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (None, [1.0] * 6), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as b", "2 as c", "3 as dim").repartition(3)
    got = {}
    for r in search.digest(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    valid = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in valid:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in valid if i != q and len(w) == len(v))[:5]
            if best:
                want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert search.digest(frame.limit(0)).count() == 0


def test_components_too_large_for_scores_raise(spark):
    import pytest

    frame = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large for 64-bit scores"):
        search.digest(frame).collect()


def test_index_is_exact_up_to_the_guard():
    rng = np.random.default_rng(7)
    for dim in (1, 3, 16):
        most = math.isqrt(2**60 // dim) - 2
        vectors = np.vstack([rng.choice([-most, most, most - 1, 0, 5], (150, dim)), rng.integers(-most, most + 1, (150, dim))])
        ids = np.arange(300)
        index = search.ImpactIndex(ids, vectors)
        for own in range(0, 300, 7):
            query = [int(x) for x in vectors[own]]
            want = sorted((-sum(a * int(b) for a, b in zip(query, v, strict=True)), i) for i, v in enumerate(vectors) if i != own)[:5]
            found, scores = index.search(own, vectors[own])
            assert [(-int(s), int(i)) for i, s in zip(found, scores, strict=True)] == want


def test_whole_search_at_the_guard(spark):
    import pytest

    near = math.isqrt(2**60 // 4) / 256 - 1
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * near * rng.choice([1.0, 0.5, 1.0]) for _ in range(4)]) for i in range(200)]
    got = search.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    kept = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = {(q, n + 1, i, -s) for q in range(0, 200, 50) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(kept[q], w, strict=True)), i) for i, w in kept.items() if i != q)[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    with pytest.raises(Exception, match="too large for 64-bit scores"):
        search.digest(spark.createDataFrame([(0, [near + 2] * 4)], "vec_id long, embedding array<double>")).collect()
