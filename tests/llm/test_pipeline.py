"""Each stage on its own, then the whole, against plain Python."""

from collections import Counter

import pytest

import corpus_pipeline
from tremorscope.llm import compression_lang, source_mixing
from tremorscope.llm.packing import Encoder, tokenizer_paths

from .test_native import LANGS, line_oracle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(160):
        lang = rng.choice(sorted(LANGS))
        text = "\n".join("".join(rng.choice(LANGS[lang]) for _ in range(30)) for _ in range(3))
        rows.append((i, text, lang, rng.choice(("hot", "hot", "cold")), len(text)))
    rows += [(200 + i, rows[i][1], rows[i][2], "copy", rows[i][4]) for i in range(20)] + [(300, None, None, None, 0), (301, "1 2 3", "aa", "cold", 5)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_and_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "source_mixing", "packing"]
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        steps.append(docs)
        if len(steps) < 5:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [x.collect() for x in steps]
    source = spark.read.parquet(f"{folder}/documents.parquet")
    rejected = {r.doc_id for r in compression_lang.digest(source).collect() if r.rejected}
    assert {300, 301} <= rejected and {r.doc_id for r in rows[0]} == {r.doc_id for r in source.collect()} - rejected
    want = line_oracle([(r.doc_id, r.text) for r in rows[0]])
    assert {r.doc_id: r.text for r in rows[1]} == {d: x[2] for d, x in want.items()} and all(r.n_chars == len(r.text) for r in rows[1])
    words = {r.doc_id: r.text.lower().split() for r in rows[1]}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[root[a]] for a in sets):
            break
    assert sorted(r.doc_id for r in rows[2]) == sorted(set(root.values()))
    drawn = source_mixing.mix_sources(steps[2]).groupBy("doc_id").count().collect()
    assert Counter(r.doc_id for r in rows[3]) == {r.doc_id: r["count"] for r in drawn}
    encode = Encoder(tokenizer_paths())
    assert sum(r.length for r in rows[4]) == sum(len(encode(r.text)) + 1 for r in rows[3])
    whole = corpus_pipeline.run(spark, folder)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, whole.collect())) == sorted(map(key, rows[4]))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
