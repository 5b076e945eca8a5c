import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tremorscope.llm import packing

ENCODE = packing.Encoder(packing.tokenizer_paths())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n'sdt \x85\x1c<|endoftext|>")), max_size=60))
def test_ids_are_the_tokenizers(text):
    assert ENCODE(text).tolist() == ENCODE.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_and_far_texts():
    for text in ("a <|endoftext|> b", "漢字 and 🙂 text", "x" * 5000, ""):
        assert ENCODE(text).tolist() == ENCODE.tokenizer.encode(text, add_special_tokens=False).ids


def padding(total, capacity=1024):
    return 0 if total & (total - 1) == 0 else capacity - total


def held(rows, texts):
    """Checks the pieces against the texts; the padding over all windows."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, mine in pieces.items():
        ids, at = np.append(ENCODE(texts[doc_id]), 0).astype("<u4"), 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.length >= 1 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = 0
    for mine in windows.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        pad += padding(at)
    return pad


def test_pack(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(("alpha", "beta", "gamma delta", "ça va")) for _ in range(rng.choice((0, 1, 5, 300, 900, 2500)))) for i in range(300)}
    texts |= {1000 + i: "hot copy " * 350 for i in range(200)}
    texts[7] = None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as lane", "2 as length", "3 as kept").repartition(5)
    assert held(packing.digest(docs).collect(), texts) == 0
    assert packing.digest(docs.limit(0)).count() == 0
    same = packing.digest(spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x")], "doc_id long, text string")).collect()
    assert len(same) == 3


def test_patterns_fill_windows():
    rng = random.Random(9)
    for _ in range(30):
        counts = {rng.randint(1, 1023): rng.randint(1, 400) for _ in range(rng.randint(1, 200))}
        segments, stream, windows, streamed = packing.patterns(counts)
        taken, filled = defaultdict(int), defaultdict(list)
        for n, first, after, share, window, offset in segments:
            assert first == taken[n] and (after - first) % share == 0
            taken[n] = after
            for j in range(after - first):
                filled[window + j // share].append((offset + (j % share) * n, n))
        for n, first, _ in stream:
            assert first == taken[n]
            taken[n] = counts[n]
        assert taken == counts and len(filled) == windows
        assert streamed == sum(n * (counts[n] - first) for n, first, _ in stream)
        for mine in filled.values():
            at = 0
            for offset, n in sorted(mine):
                assert offset == at
                at += n
            assert padding(at) == 0


def test_fullest_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 2) for _ in range(rng.randint(1, 5))}
        top, items = max(counts), [n for n, c in counts.items() for _ in range(c)]
        items.remove(top)
        sums = {top + sum(n for i, n in enumerate(items) if m >> i & 1) for m in range(1 << len(items))}
        used = packing.fullest(counts, 64)
        total = sum(n * k for n, k in used.items())
        assert all(k <= counts[n] for n, k in used.items()) and used[top] >= 1
        assert padding(total, 64) == min(padding(s, 64) for s in sums if s <= 64)
