import random

import xxhash

from tremorscope.llm.line_dedup import drop_repeated_lines

P1, P2, FULL = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1


def round_(acc, lane):
    x = (acc + lane * P2) & FULL
    return ((x << 31 | x >> 33) & FULL) * P1 & FULL


def colliding():
    """Two lines of 64 letters and signs that XXH64 with seed 42 can't tell apart: the second block undoes the first one's difference."""
    rng, fine = random.Random(9), bytes(c for c in range(33, 127) if not 65 <= c <= 90)
    back = pow(P2, -1, 1 << 64)
    lane = lambda: bytes(rng.choices(fine, k=8))
    number = lambda b: int.from_bytes(b, "little")
    rest = [lane() for _ in range(6)]
    start = (42 + P1 + P2) & FULL
    while True:
        a, b, c = lane(), lane(), lane()
        d = ((number(c) + (round_(start, number(a)) - round_(start, number(b))) * back) & FULL).to_bytes(8, "little")
        if a != b and set(d) <= set(fine):
            return [b"".join([x, *rest[:3], y, *rest[3:]]).decode() for x, y in ((a, c), (b, d))]


def test_lines_that_collide_on_one_hash_stay(spark):
    a, b = colliding()
    assert a != b and xxhash.xxh64_intdigest(a, 42) == xxhash.xxh64_intdigest(b, 42)
    for min_docs in (2, 3):
        docs = [(1, a), (2, b), (3, f"x\n{b}"), (4, f"{a}\ny"), (5, b)]
        got = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_docs=min_docs).collect()}
        assert got == ({1: a, 2: b, 3: "x", 4: "y", 5: ""} if min_docs == 2 else {1: a, 2: b, 3: "x", 4: f"{a}\ny", 5: ""})
