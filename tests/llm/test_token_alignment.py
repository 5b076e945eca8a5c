"""The alignment against the definitions, token by token, with both tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer, pre_tokenizers

from tremorscope.llm import token_alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_level():
    """Byte of each character, asked from the library's own byte-level coder."""
    out = {}
    coder = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for c in map(chr, range(0x800)):
        data, shown = c.encode(), coder.pre_tokenize_str(c)[0][0]
        out.update(zip(shown, data, strict=True))
    for lead in range(0xE0, 0xF0):
        c = bytes([lead, 0xA0 if lead == 0xE0 else 0x80, 0x80]).decode(errors="ignore")
        if c:
            out.update(zip(coder.pre_tokenize_str(c)[0][0], c.encode(), strict=True))
    for c in ("\U00010000", "\U00040000", "\U00080000", "\U000C0000", "\U00100000"):
        out.update(zip(coder.pre_tokenize_str(c)[0][0], c.encode(), strict=True))
    return out


def tokens(text):
    if not text:
        return None
    want, value = (" " + text).encode(), byte_level()
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a_bytes = [bytes(value[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = []
    for i in b:
        piece = B.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode())
    return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == want == b"".join(b_bytes) else None


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    counts, found = Counter(), []
    for doc_id, text in rows:
        known = tokens(text)
        if known is None:
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, a_bytes, b, b_bytes = known
        sa, sb = spans(a_bytes), spans(b_bytes)
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(sa[i][0], sb[j][0]) < min(sa[i][1], sb[j][1])]
        counts.update(links)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for cut in cuts:
            part = lambda ids, where: ",".join(str(x) for x, (s, e) in zip(ids, where, strict=True) if low <= s and e <= cut)  # noqa: B023, E731
            groups.append(part(a, sa) + "|" + part(b, sb))
            low = cut
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, na, nb, ng, links, sha in found]


def shown(df):
    names = ("doc_id", *token_alignment.MEASURES, "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=str)


TEXTS = ["Is and retitioning ouen the of, nterti.", "Is and retitioning ouen the of, nterti.", None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "▁ not a space", "é ☃ 𐍈 ́a", "<|endoftext|> <s> <unk> <0x41>", "a" * 200, "x\x00y", "ﬁ ligature", "1234567890 don't I'LL", " nbsp　wide", "the the the the"]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_odd_texts_as_by_definition(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(token_alignment, "aligned_blocks", lambda *x, f=token_alignment.aligned_blocks: f(*x, block_bytes=block_bytes))
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (0, "the")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, Key int")
    assert shown(token_alignment.digest(docs)) == sorted(brute(rows), key=str)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.digest(docs).count() == 0
    only_null = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert shown(token_alignment.digest(only_null)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("doc_id", "text")
    rows = [(r.doc_id, r.text[:1500]) for r in docs.collect()]
    assert shown(token_alignment.digest(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute(rows), key=str)


def test_pair_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([(i, "the cat") for i in range(50)] + [(99, "cat the")], "doc_id long, text string")
    counts = {(r.pair // token_alignment.PAIR, r.pair % token_alignment.PAIR): r.n for r in token_alignment.align_tokenizers(docs)[1].collect()}
    want = Counter()
    for text, n in (("the cat", 50), ("cat the", 1)):
        a, a_bytes, b, b_bytes = tokens(text)
        for i, (s, e) in enumerate(spans(a_bytes)):
            for j, (t, f) in enumerate(spans(b_bytes)):
                if max(s, t) < min(e, f):
                    want[a[i], b[j]] += n
    assert counts == want


def test_words_one_by_one_as_whole_texts():
    pair, draw = token_alignment.Pair(token_alignment.tokenizer_paths(), token_alignment.piece_model_path()), random.Random(4)
    assert pair.by_word
    parts = ["the", " ", " ", "  ", "é☃", "\n", "\t", "x", "ation", "12", "▁", "<0x41>", "'s", "\x00", "　", "ﬁ", " " * 5]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 25)))
        assert pair.piece_ids(text).tolist() == B.encode(text)
