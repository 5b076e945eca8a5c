import random

import pytest
import xxhash

from tremorscope.llm import simhash
from tremorscope.llm.components import components


def brute(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "one TWO", "a b c", "Ünï Ça a b a b a b c" * 9):
        assert simhash.simhash(text) == brute(text)


@pytest.mark.parametrize("hot_key", [3, 128])
def test_links_join_what_brute_force_joins(spark, hot_key):
    rng = random.Random(5)
    marks = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):  # chains of near copies and a few just out of reach
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 2, 3))))
            marks.add(base)
    marks = sorted(marks)
    rows = [(simhash._signed(fp), i) for i, fp in enumerate(marks)]
    fps = spark.createDataFrame(rows, "fp long, rep long")
    close = [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2]
    want = roots(range(len(marks)), close)
    got = {r.node: r.component for r in components(simhash.links(fps, hot_key=hot_key)).collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_thresholds_sum_and_cost():
    costs = [{-1: 0.0, 0: 5.0, 1: 9.0, 2: 50.0}, {-1: 0.0, 0: 100.0, 1: 200.0, 2: 300.0}, {-1: 0.0, 0: 4.0, 1: 30.0, 2: 40.0}]
    assert simhash.allotted(costs, 0) == (13.0, [1, -1, 0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark):
    rows = [(1, "a b c d e", "x"), (2, "a b c d e", None), (3, None, "x"), (4, "", "x"), (5, "q " * 50000, "x"), (5, "q " * 50000, "x"), (None, "a b c d e", "x"), (None, "zz", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").selectExpr("*", "1 as fp")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.digest(docs).collect() if r.doc_id or r.component_id)
    assert got == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5)]
    assert simhash.digest(docs.limit(0)).count() == 0
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5]
    clash = docs.selectExpr("*", "1 as t", "2 as id", "3 as h1", "4 as n").union(docs.selectExpr("*", "5", "6", "7", "8").where("doc_id is null"))
    left = simhash.keep_one_each(clash)
    assert left.columns == clash.columns and sorted((r.doc_id or 0, (r.text or "")[:2]) for r in left.collect()) == [(0, "zz"), (1, "a "), (3, ""), (5, "q ")]
    assert simhash.keep_one_each(docs.limit(0)).count() == 0


def test_near_copies_go_from_jaccard_08(spark):
    """One of each pair of Jaccard 0.8 to 0.95 stays, and both of a pair just below; SimHashes within 2 bits miss them."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want, far = [], set(), 0
    for i in range(120):
        base = [word() for _ in range(204)]  # 200 shingles
        near = list(base)
        for j in range(i % 6 + 1):  # each changed word costs five of them: Jaccard 0.951, 0.905, 0.860, 0.818, 0.778, 0.739
            near[20 + 30 * j] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, "\n".join(near).upper())]
        want |= {2 * i} if i % 6 < 4 else {2 * i, 2 * i + 1}
        far += i % 6 < 4 and (simhash.simhash(rows[-1][1], 5) ^ simhash.simhash(rows[-2][1], 5)).bit_count() > 2
    assert far > 60
    kept = {r.doc_id for r in simhash.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert want <= kept and len(kept - want) <= 1
