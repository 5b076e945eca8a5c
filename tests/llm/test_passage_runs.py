import random

import numpy as np
import pyarrow as pa

from tremorscope.llm import minhash, passage_runs
from tremorscope.llm import passage_dedup as pd_

SCHEMA = "doc_id long, text string"


def brute(docs):
    """{(doc_id, text): [(start, end)]} of the stretches whose every 51 words on end stand in an earlier document."""
    words = {}
    for d, text in docs:
        at, found = 0, []
        for w in text.split():
            at = text.index(w, at)
            found.append((w.encode().lower(), at, at + len(w)))
            at += len(w)
        words[d, text] = found
    first = {}
    for (d, _), found in words.items():
        for i in range(len(found) - 50):
            g = tuple(w for w, _, _ in found[i : i + 51])
            first[g] = min(d, first.get(g, d))
    out = {}
    for (d, text), found in words.items():
        hit = [first[tuple(w for w, _, _ in found[i : i + 51])] < d for i in range(len(found) - 50)] + [False]
        start = 0
        for i, x in enumerate(hit):
            if not x:
                if i > start:
                    out.setdefault((d, text), []).append((found[start][1], found[i + 49][2]))
                start = i + 1
    return out


def sample():
    rng = random.Random(6)
    line = lambda n: [rng.choice("abcdefghijé😀") * 2 + str(rng.randrange(10**6)) for _ in range(n)]
    docs, held = [], [line(120) for _ in range(12)]
    for d, words in enumerate(held):
        docs.append((d, " ".join(words)))
    for d in range(12, 60):
        size, words = rng.choice((30, 50, 51, 52, 69, 120)), held[d % 12]
        at = rng.randrange(len(words) - size + 1)
        part = line(rng.randrange(150)) + words[at : at + size] + line(rng.randrange(150))
        if d % 3:  # one long line, or lines of under 20 words
            docs.append((d, " ".join(part).encode().upper().decode()))
        else:
            docs.append((d, "".join(w + rng.choice("   \n") for w in part)))
    return docs


def test_passages_in_long_lines_and_over_short_lines(spark):
    docs = sample()
    docs += [(200 + i, docs[20 + i % 4][1]) for i in range(12)]  # copies of whole texts
    want = {d: spans for (d, _), spans in brute(docs).items()}
    assert len(want) > 30
    frame = spark.createDataFrame([*docs, (100, None), (None, docs[0][1])], SCHEMA).selectExpr("*", "1 as t", "2 as start", "3 as what", "4 as n_").repartition(4)
    rows = {r.doc_id: r for r in pd_.digest(frame).collect()}
    assert {d: [(s.start, s.start + s.length) for s in r.passages] for d, r in rows.items() if r.passages} == want
    holders = {}
    for d, text in docs:
        parts = text.encode().lower().split()
        for i in range(len(parts) - 50):
            holders.setdefault(tuple(parts[i : i + 51]), set()).add(d)
    classes = {d: d for d, _ in docs}
    for _ in range(5):  # the smallest doc_id spreads over shared windows
        for held in holders.values():
            least = min(classes[d] for d in held)
            classes |= dict.fromkeys(held, least)
    assert {d: rows[d].component_id for d, _ in docs} == classes
    texts = {d: t for d, t in docs}
    cut = pd_.remove_repeats(frame)
    assert cut.columns == frame.columns
    left = [(r.doc_id, r.text) for r in cut.collect()]
    assert len(left) == len(docs) + 2 and (None, docs[0][1]) in left and (100, None) in left
    left = [(d, t) for d, t in left if d is not None and t is not None]
    assert not brute(left) and all(len(t) <= len(texts[d]) for d, t in left) and all(t == texts[d] for d, t in left if d < 12)


def test_rows_of_one_id_and_repeats_inside_one(spark):
    rng = random.Random(7)
    base = [str(rng.randrange(10**6)) for _ in range(60)]
    docs = [(1, " ".join(base)), (1, " ".join(base + base)), (2, "x " + "\n".join(base) + " y"), (2, "z\n" + " ".join(base)), (2, "w"), (3, "v " * 500), (4, "u " + "v " * 60)]
    got = {(r.doc_id, r.text) for r in pd_.remove_repeated_runs(spark.createDataFrame([*docs, docs[3]], SCHEMA)).collect()}
    assert got == {*docs[:2], (2, "x  y"), (2, "z\n"), (2, "w"), docs[5], (4, "u  ")}
    assert pd_.repeated_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_size_changes_the_window_rule(spark):
    """50 words on end are no passage and 51 are, at any place of the line breaks."""
    rng = random.Random(8)
    for n in (50, 51):
        base = [str(rng.randrange(10**6)) for _ in range(n)]
        docs = [(i, "\n".join([f"a{i} " * i, " ".join(base[: i + 3]), *base[i + 3 :], f"b{i}"])) for i in range(6)]
        got = pd_.digest(spark.createDataFrame(docs, SCHEMA)).collect()
        assert {r.component_id for r in got} == ({0} if n == 51 else set(range(6)))


class Taken:
    """Takes the place of a table: keeps the function that ``mapInArrow`` would run in tasks."""

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def test_windows_of_many_texts_are_made_together():
    draw = random.Random(9)
    texts = [" ".join(draw.choice("abcdefgh") * draw.randrange(1, 4) for _ in range(draw.randrange(40, 140))) for _ in range(300)]
    keys = [np.unique(minhash.window_keys(minhash.word_hashes(minhash.words_of(x)))).view(np.int64) for x in texts]
    asked = [k[[draw.random() < 0.7 for _ in k]] for k in keys]
    lists = pa.array(asked, pa.list_(pa.int64()))
    near, runs = Taken(), Taken()
    passage_runs.near_units(near)
    passage_runs._windows(runs)
    found = list(near.run(iter([pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts), lists], names=["doc_id", "text", "shared"])])))
    assert len(found) == 1
    wanted = []
    for i, (text, shared) in enumerate(zip(texts, asked, strict=True)):
        words, spans = minhash.words_of(text), passage_runs.word_spans(text)
        for x, bands in zip(*minhash.near_windows(minhash.word_hashes(words), shared.view(np.uint64)), strict=True):
            h1, h2 = minhash.window_identity(words[x : x + minhash.NEAR])
            wanted.append({"doc_id": i, "h1": h1, "h2": h2, "start": spans[x, 0], "length": spans[x + minhash.NEAR - 1, 1] - spans[x, 0], "n_words": minhash.NEAR, "bands": bands.view(np.int64).tolist()})
    assert wanted and found[0].to_pylist() == wanted
    copies = [i % 2 == 0 for i in range(300)]
    windows = list(runs.run(iter([pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([7] * 300), pa.array(texts), pa.array(copies), lists], names=["doc_id", "tag", "text", "copy", "shared"])])))
    assert len(windows) == 1
    rows = windows[0].to_pylist()
    assert [(r["doc_id"], r["start"], r["end"]) for r in rows if r["g1"] is None] == [(i, 0, len(texts[i])) for i in range(0, 300, 2)]
    for i in range(1, 300, 2):
        own = minhash.window_keys(minhash.word_hashes(minhash.words_of(texts[i]))).view(np.int64)
        assert [r["pos"] for r in rows if r["doc_id"] == i] == np.flatnonzero(np.isin(own, asked[i])).tolist()
