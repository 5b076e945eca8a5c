import hashlib
import random

from tremorscope.llm import order_minhash as omh


def test_next_and_edit_match_brute_force(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1000), 60)
    texts = {i: "".join(rng.choice("ab é\n") for _ in range(rng.choice((0, 1, 3, 4, 9, 200)))) for i in ids}
    texts[ids[0]] = None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in omh.digest(docs).collect()}
    order = sorted(ids)
    assert sorted(got) == order
    for i, doc_id in enumerate(order):
        text, after = texts[doc_id] or "", texts[order[(i + 1) % len(order)]] or ""
        n = len(text) // 4
        edit = text[: len(text) - n] + after[:n]
        row = got[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert row.fingerprint == omh.fingerprint(text.encode()) and row.edited_fingerprint == omh.fingerprint(edit.encode())
        assert row.near_edited == omh.likeness(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == omh.likeness(row.fingerprint, omh.fingerprint(after.encode()))


def test_likeness_follows_edit_distance():
    rng = random.Random(1)
    words = [rng.choice(("tion", "the", "re", "and", "of", "er")) + rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(600)]
    text = " ".join(words)
    swapped = " ".join(words[300:] + words[:300])  # same content, other order
    changed = " ".join(words[:590] + ["xyz"] * 10)
    near = lambda other: omh.likeness(omh.fingerprint(text.encode()), omh.fingerprint(other.encode()))
    assert near(text) == 1.0
    assert near(changed) > 0.7 > near(swapped)
    assert near(" ".join(rng.choice("xyzw") * 5 for _ in range(600))) < 0.1


def test_repeats_are_numbered():
    assert len(set(omh.numbered_kmers(b"a" * 100).tolist())) == 93
    assert omh.fingerprint(b"") == "0" * 128 and omh.fingerprint(b"ab") != omh.fingerprint(b"abc")
    long = b"lorem ipsum dolor " * 20000
    assert omh.fingerprint(long) == omh.fingerprint(bytes(long))


def test_odd_rows(spark):
    rows = [(None, "x" * 40), (4, None), (4, "same"), (4, "same"), (9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as edge", "3 as fingerprint")
    got = omh.digest(docs).collect()
    assert len(got) == 5 and sum(r.near_next == 1.0 for r in got) == 1
    one = omh.digest(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert omh.digest(docs.limit(0)).count() == 0


def mixed(x):
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 32


def signature(data):
    """The fingerprint in plain integers: number the k-mers' occurrences, take each order's smallest, put them back in text order, hash the tuple."""
    if not data:
        return "0" * 8 * 16
    data = data.ljust(8, b"\0")
    step, seen, marks = 0x9E3779B97F4A7C15, {}, []
    for i in range(len(data) - 7):
        kmer = data[i : i + 8]
        n = seen[kmer] = seen.get(kmer, -1) + 1
        mark = mixed(int.from_bytes(kmer, "little"))
        marks.append(mixed((mark + n * step) % 2**64) if n else mark)
    out = ""
    for r in range(16):
        xor, odd = mixed((r + 1) * step % 2**64), mixed((r + 17) * step % 2**64) | 1
        least = sorted(range(len(marks)), key=lambda i: ((marks[i] ^ xor) * odd % 2**64, i))[:2]
        joined = 0
        for i in sorted(least):
            joined = mixed((joined * 0x94D049BB133111EB + marks[i] + step) % 2**64)
        out += f"{joined >> 32:08x}"
    return out


def test_signature_against_plain_integers():
    rng = random.Random(9)
    texts = [b"a", b"ab" * 3, b"abcdefgh", b"abcdefghi", b"a" * 60, "é😀x".encode() * 9, *(bytes(rng.choice(b"ab \n") for _ in range(rng.choice((5, 40, 400)))) for _ in range(30)), b"the same words again " * 4000]
    for text in texts:
        assert omh.fingerprint(text) == signature(text)
