"""The automaton and the secret scan against Python's own regular expressions."""

import hashlib
import random
import re

import pytest

from tremorscope.llm.automaton import Combined
from tremorscope.llm.secret_scan import BASE, RULES, digest, secret_spans, spans_of

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
PARTS = ["password", "passwd", "secret", "token", "api_key", "apikey", "AKIA", "tok", "pass", "=", ":", " ", "'", '"', "abcdef0123456789", "deadbeef", "XYZ012345678", "A1", "\n", ",", "secretoken", "-", "é", "𐍈", "Passwd", "TOKEN", "ſecret", "\x00", "ghp_" + "a1B2" * 9, "xoxb-" + "1" * 12]


def plain(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m.group()) >= 16]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def texts(n=1500, seed=5):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randrange(60))) for _ in range(n)]


def test_spans_as_by_re():
    some = texts()
    found = spans_of([t.encode() for t in some])
    base = {i: r.kind for i, r in enumerate(BASE)}
    for text, spans in zip(some, found, strict=True):
        assert [(base[r], a, b) for r, a, b in spans if r in base] == plain(text)
    kinds = {RULES[r].kind for spans in found for r, _, _ in spans}
    assert {"assign", "access", "hex", "github", "slack"} <= kinds


def test_long_texts_without_a_cut():
    value = "Zy" * 400_000
    text = f"aa password={value} " + "b" * 100_000 + ", " + "secret: " + "x" * 11 + "token=" + "y" * 12
    assert [(RULES[r].kind, a, b) for r, a, b in spans_of([text.encode()])[0]] == plain(text)


@pytest.mark.parametrize("pattern", ["ab|a[bc]{2,3}d*", "foo(bar)?[x-z]+", "(ab)+c[cd]*", "[^a]b"[1:], r"\x41[0-9]{2,4}"])
def test_patterns_as_by_re(pattern):
    draw = random.Random(pattern)
    try:
        machine = Combined([pattern])
    except ValueError:
        pytest.skip("a rule that the automaton refuses")
    for _ in range(300):
        text = "".join(draw.choice("abcdfoxyzA019]^ ") for _ in range(draw.randrange(40)))
        assert [(a, b) for _, a, b in machine.matches(text.encode())] == [m.span() for m in re.finditer(pattern, text)]


@pytest.mark.parametrize("pattern", ["a", "a?", "ab(cd)?", "(ab", "é+x"])
def test_refused_patterns(pattern):
    with pytest.raises(ValueError):
        Combined([pattern])


def test_query_and_odd_rows(spark):
    rows = [(1, "token = abcdefghijkl", "x"), (1, "token = abcdefghijk", "x"), (None, "AKIA" + "B" * 14, None), (2, None, "x"), (3, "", "x"), (4, "é" * 5 + "0" * 16 + "é", "x"), (5, "é password:" + "q" * 12 + " " + "f" * 20, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Spans string")
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in digest(docs).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        spans = plain(text or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((doc_id, *[sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")], hashlib.sha256(shown.encode()).hexdigest(), shown))
    assert got == sorted(want, key=str)
    assert digest(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("assign", "access", "hex")] for r in secret_spans(docs).collect()}
    assert got == {r.doc_id: plain(r.text or "") for r in docs.collect()}
