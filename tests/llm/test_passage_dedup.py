import random
from pathlib import Path

import numpy as np

from tremorscope.llm import components, minhash, passage_runs
from tremorscope.llm import passage_dedup as pd_


def test_bands_reach_the_recall():
    bands, rows = pd_.tuned_bands()
    assert bands * rows <= 64 and 1 - (1 - 0.8**rows) ** bands >= 0.999
    assert pd_.tuned_bands(0.9, 0.99, 32)[1] > 1


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def brute(docs, min_words=20):
    """{doc_id: (components, removed positions)} from all pairs of lines."""
    items = [(d, pos, line.lower().split()) for d, text in docs for pos, line in enumerate((text or "").split("\n")) if len(line.split()) >= min_words]
    sets = [shingle_set(w) for _, _, w in items]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(items)):
        groups.setdefault(find(i), []).append(i)
    out = {d: (set(), set()) for d, _ in docs}
    for g in groups.values():
        held = {items[i][0] for i in g}
        if len(held) > 1:
            for i in g:
                out[items[i][0]][0].add(min(held))
                if items[i][0] > min(held):
                    out[items[i][0]][1].add(items[i][1])
    return out


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    line = lambda n: [word() for _ in range(n)]
    bases, stock = [line(70) for _ in range(6)], [line(n) for n in (19, 20, 45)]
    docs = []
    for d in range(120):
        lines = [line(rng.choice((3, 25, 50, 60))) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 2)):
            near = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 1, 2, 4))):  # a changed word costs up to five of 66 shingles
                near[rng.randrange(70)] = word()
            lines.insert(0, near)
        if rng.random() < 0.5:
            lines.append(rng.choice(stock))
        docs.append((d * 3, "\n".join(" ".join(x) for x in lines)))
    return docs


def test_matches_brute_force(spark):
    docs = sample(1) + [(1000, None), (1001, ""), (1002, "W " * 3000), (1003, "w " * 3000), (1004, "short line\nshort line")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as pid", "3 as d_", "4 as gone_").repartition(4)
    want = brute(docs)
    got = {r.doc_id: (set(r.component_ids), {s.pos for s in r.removed}) for r in pd_.digest(frame).collect()}
    assert got == want
    for r in pd_.digest(frame).collect():
        text = dict(docs)[r.doc_id]
        for s in r.removed:
            assert text[s.start : s.start + s.length] == text.split("\n")[s.pos]
    cut = {r.doc_id: r.text for r in pd_.remove_repeated_passages(frame).collect()}
    for d, text in docs:
        assert cut[d] == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[d][1]))


def test_empty(spark):
    assert pd_.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = pd_.digest(spark.createDataFrame([(None, "x " * 30), (None, "x " * 30)], "doc_id long, text string")).collect()
    assert [r.n_repeated for r in one] == [0, 0]


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    rng = random.Random(3)
    long_line = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(60))
    a, b, c = long_line(), long_line(), long_line()
    docs = [(1, a), (5, f"x\n{a}\nz"), (5, f"y\n{b}\n{c}")]
    got = {(r.doc_id, r.text) for r in pd_.remove_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {docs[0], (5, "x\nz"), docs[2]}


def test_jaccard_and_shingles_by_hand():
    words = [str(i).encode() for i in range(55)]
    changed = [*words[:30], b"x", *words[31:]]
    assert len(pd_.shingles(words)) == 51 and pd_.shingles([b"a"]) == [b"a"]
    assert pd_.jaccard(b" ".join(words).decode(), b" ".join(changed).decode()) == 46 / 56


def foreign(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(10**7)}" for _ in range(n)]


def edited_docs(seed, edits, size=120, pairs=20):
    """Pairs (i, 1000 + i) that share a passage of ``size`` words, edited in the second, amid other words on one line; ids from 5000 share stock phrases of 45 words only."""
    rng = random.Random(seed)
    docs, stock = [], foreign(rng, 45)
    for i in range(pairs):
        base = foreign(rng, size)
        other = list(base)
        for k in range(edits, 0, -1):
            at = k * size // (edits + 1)
            other[at : at + 1] = ([], [base[at], "new"], ["changed"])[i % 3 if edits == 1 else 2]
        docs += [(d, " ".join([*foreign(rng, 70 + i), *part, *foreign(rng, 90 - i)])) for d, part in ((i, base), (1000 + i, other))]
    return docs + [(5000 + i, " ".join([*foreign(rng, 40), *stock, *foreign(rng, 40)])) for i in range(60)]


def test_edited_passages_in_foreign_surroundings(spark):
    """Two words of 120 changed, so that few texts have 51 words on end in common; ids below 5000 come in pairs."""
    for docs in (edited_docs(11, 2),):
        texts = dict(docs)
        rows = {r.doc_id: r for r in pd_.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
        assert {d: r.component_id for d, r in rows.items()} == {d: d - 1000 if 1000 <= d < 2000 else d for d in texts}
        for d, r in rows.items():
            for s in r.edited:  # each window is as near as promised to one of the document named
                part = texts[d][s.start : s.start + s.length].split()
                other = texts[s.component_id].split()
                mine = shingle_set(part)
                best = max((len(mine & x) / len(mine | x) for x in (shingle_set(other[i : i + 60]) for i in range(len(other) - 59))), default=0)
                assert len(part) == 60 and best >= 0.8


def test_recall_of_edited_passages():
    """Of 160 passages, how many have two windows that share a band and are similar enough."""
    for edits, size, least in ((2, 120, 0.98), (1, 100, 0.98), (1, 75, 0.8)):
        found = 0
        for k in (1, 2):
            docs = dict(edited_docs(100 * k + size, edits, size, 80))
            for d in range(80):
                sides = []
                for words in (docs[d].encode().lower().split(), docs[1000 + d].encode().lower().split()):
                    hashed = minhash.word_hashes(words)
                    sides.append((words, hashed, minhash.window_keys(hashed)))
                shared = np.intersect1d(sides[0][2], sides[1][2])
                (a, b), words = [minhash.near_windows(h, shared) for _, h, _ in sides], [w for w, _, _ in sides]
                meet = [(x, y) for i, x in enumerate(a[0]) for j, y in enumerate(b[0]) if (a[1][i] == b[1][j]).any()]
                sets = [(shingle_set(words[0][x : x + 60]), shingle_set(words[1][y : y + 60])) for x, y in meet]
                found += any(5 * len(x & y) >= 4 * len(x | y) for x, y in sets)
        assert found >= 160 * least


def test_short_lines_repeat_but_join_no_documents(spark):
    rng = random.Random(13)
    lines = [" ".join(foreign(rng, 45)) for _ in range(20)]
    docs = [(d + 100 * k, "\n".join([" ".join(foreign(rng, 9)), line])) for d, line in enumerate(lines) for k in (0, 1)]
    for r in pd_.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r.component_id == r.doc_id and r.component_ids == [r.doc_id % 100] and [s.pos for s in r.removed] == [1] * (r.doc_id >= 100)


def test_rarest_shingles_lose_no_pair(spark):
    rng = random.Random(14)
    sets = []
    for _ in range(60):
        base = rng.sample(range(400), rng.choice((5, 9, 20, 40)))
        for _ in range(4):
            sets.append(sorted(set(rng.sample(base, len(base) - rng.randrange(1 + len(base) // 6)) + [rng.randrange(400) for _ in range(rng.randrange(3))])))
    full = spark.createDataFrame([(i, 4, i % 2, s) for i, s in enumerate(sets)], "pid long, kind int, label long, s array<long>")
    got = {(r.u, r.v) for r in pd_._rare_in_common(full, 0.8).collect()}
    near = {(i, j) for i in range(len(sets)) for j in range(i) if (i - j) % 2 and 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    assert len(near) > 20 and near <= got | {(v, u) for u, v in got}


def test_a_stock_phrase_makes_no_candidates(spark):
    """A thousand units that share 36 shingles of 56 and 20 of their own each: none meet."""
    full = spark.range(1000).selectExpr("id as pid", "4 as kind", "id as label", "concat(sequence(1, 36), transform(sequence(1, 20), x -> 100 + 20 * id + x)) as s")
    assert pd_._rare_in_common(full, 0.8).count() == 0


def test_windows_that_overlap_by_half_make_no_candidates(spark):
    """Of 40 texts, windows of 56 shingles, each beginning 28 on: neighbours share half of their shingles; a near copy of each shares 52 of 60."""
    sets = [(100 * t + k, [10**6 * t + 7919 * x for x in range(28 * k, 28 * k + 56)]) for t in range(40) for k in range(8)]
    sets += [(100 * t + 50 + k, [10**6 * t + 7919 * x for x in range(28 * k + 4, 28 * k + 60)]) for t in range(40) for k in range(8)]
    full = spark.createDataFrame([(i, 4, i, s) for i, s in sets], "pid long, kind int, label long, s array<long>")
    got = {(min(r), max(r)) for r in pd_._rare_in_common(full, 0.8).collect()}
    assert {(i, i + 50) for i, _ in sets if i % 100 < 50} <= got and len(got) < 1.2 * 320


def test_a_run_deletes_its_spent_tables(spark, monkeypatch):
    """What is left on disk is what the result is read from, not every step's table."""
    made, keep = [], pd_.stored

    def stored(df, name):
        out = keep(df, name)
        made.append(out.stored_at)
        return out

    for module in (pd_, passage_runs, components):
        monkeypatch.setattr(module, "stored", stored)
    docs = edited_docs(11, 2) + [(9000 + i, d) for i, (_, d) in enumerate(edited_docs(11, 2)[:5])]
    found = pd_.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    left = sorted(Path(x.removeprefix("file://")).name.rsplit("-", 1)[0] for x in made if Path(x.removeprefix("file://")).exists())
    assert left == ["tremorscope-passage-documents", "tremorscope-passage-lines", "tremorscope-passage-near", "tremorscope-passage-runs"] and len(made) > 20
    assert found.count() == len(docs)
