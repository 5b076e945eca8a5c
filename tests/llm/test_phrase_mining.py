"""Phrase mining against plain Python counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tremorscope.llm import common, phrase_mining
from tremorscope.llm.common import block_writes, dropped, stored


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=30, kept=2000, longest=4):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        some = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        rows = []
        for phrase, a in some.items():
            inside = [b for longer, b in some.items() if len(longer) > len(phrase) and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, _, left, right = min((2000000 * a // (found[phrase[:k]] + found[phrase[k:]]), k, found[phrase[:k]], found[phrase[k:]]) for k in range(1, len(phrase)))
            rows.append((-score, -a, " ".join(phrase).encode(), a, left, right))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(rows)[:kept], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, total[lang], -score))
    return sorted(out)


def shown(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(n=400, seed=1):
    draw = random.Random(seed)
    words = ["the", "The", "of", "ünion", "a", "b", "c-d", "𐍈x", "new", "york", "city", "\x0b", "x\x00y"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" "] * 6 + ["  ", "\t", ". ", ",", "\n", " new york city "]) for _ in range(draw.randrange(30)))
    return [(draw.choice(["en", "fr", None, "und", ""]), text()) for _ in range(n)] + [("en", None), ("en", ""), (None, " . ,")]


@pytest.mark.parametrize("block_bytes", [200, 1 << 24])
def test_as_by_counting(spark, block_bytes):
    rows = made()
    docs = spark.createDataFrame([(i % 7, *r, 0) for i, r in enumerate(rows)], "doc_id long, lang string, text string, H0 int")
    assert shown(phrase_mining.mine_phrases(docs, block_bytes=block_bytes)) == brute(rows)
    assert shown(phrase_mining.mine_phrases(docs, least=3, kept=11, longest=3, block_bytes=block_bytes)) == brute(rows, 3, 11, 3)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = made(120, 2)
    monkeypatch.setattr(phrase_mining, "group_filter", lambda *_: np.full(128, -1, dtype=np.int64))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert shown(phrase_mining.mine_phrases(docs, least=4)) == brute(rows, 4)


def test_words_that_share_a_hash_are_hashed_anew(spark, monkeypatch):
    rows, own = made(120, 3), phrase_mining.word_hash
    monkeypatch.setattr(phrase_mining, "word_hash", lambda salt, lang, word: own(salt, lang, word) % 5 if salt < 1 else own(salt, lang, word))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert shown(phrase_mining.mine_phrases(docs, least=4)) == brute(rows, 4)


def test_no_words(spark):
    for rows in ([], [("en", None), (None, "")], [("en", "one word apart, two")]):
        assert phrase_mining.digest(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_a_task_adds_up_a_part_of_its_groups_at_a_time(monkeypatch):
    """Room beside the counts themselves is for one part of them, and no batch for the JVM is large."""
    monkeypatch.setattr(phrase_mining, "COMBINED_ROWS", 1 << 10)
    monkeypatch.setattr(phrase_mining, "MOST_ROWS", 1 << 13)
    monkeypatch.setattr(phrase_mining, "BATCH_BYTES", 1 << 14)
    own, asked = phrase_mining._added, []
    monkeypatch.setattr(phrase_mining, "_added", lambda table: asked.append(table.num_rows) or own(table))
    draw, sums, wanted, found, batches = np.random.default_rng(5), phrase_mining.GroupSums(2, 1000), Counter(), Counter(), []
    for _ in range(60):
        groups = np.unique(draw.integers(-3000, 3000, (1000, 2)) // [1, 3000], axis=0)
        counts = draw.integers(1, 9, len(groups))
        wanted.update({tuple(g): int(c) for g, c in zip(groups.tolist(), counts, strict=True)})
        batches += sums.put([np.ascontiguousarray(groups[:, 0]), np.ascontiguousarray(groups[:, 1])], counts)
    batches += sums.flushed()
    for batch in batches:
        for row in batch.to_pylist():
            for h0, h1, c in zip(row["h0"], row["h1"], row["c"], strict=True):
                found[h0, h1] += c
    assert found == wanted
    assert max(asked) * 8 < len(wanted)
    assert max(len(b) and sum(len(x) for x in b.column(1).to_pylist()) for b in batches) * 24 < 2 << 14


def test_blocks_close_row_groups_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(common, "GROUP_BYTES", 1 << 20)
    rows = spark.range(0, 24, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 8192), x -> sha2(cast(x * 1000 + id as string), 256)), '') as block")
    with block_writes(spark):
        out = stored(rows, "blocks")
    groups = pq.ParquetFile(out.inputFiles()[0].removeprefix("file://")).metadata
    assert groups.num_rows == 24
    assert groups.num_row_groups >= 4
    dropped(out)
