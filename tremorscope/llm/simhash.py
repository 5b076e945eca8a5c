"""SimHash near-dedup by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored
from .components import components
from .minhash import BANDS, SIMILARITY, WORDS, band_keys, words_of
from .passage_dedup import SLICE, identity, near_paragraphs, whole

BITS, MOST_BITS, SHINGLE = 64, 2, 3
#: A key that more fingerprints share than this is not paired up; its members take the exact detour of ``_through_flips``.
HOT_KEY = 128
_SLICE = 1 << 16


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint, unsigned. Null or no words: 0. Fewer words than a shingle: the whole sequence is the one shingle."""
    parts = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    shingles = zip(*[parts[i:] for i in range(words)]) if len(parts) >= words else [parts]
    hashed = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashed), _SLICE):
        part = hashed[i : i + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def with_simhash(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row's whole text; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([simhash(x.as_py(), words) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j set: 64 x 64 counts over all of them."""
    columns = ["i", *[f"c{j}" for j in range(BITS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            marks = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            bits = np.unpackbits(marks.view(np.uint8).reshape(len(marks), 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS)), *[pa.array(total[:, j].astype(np.int64)) for j in range(BITS)]], names=columns)

    rows = fps.select("fp").mapInArrow(run, ", ".join(f"{c} long" for c in columns)).groupBy("i").agg(*[F.sum(c).alias(c) for c in columns[1:]]).collect()
    counts = np.zeros((BITS, BITS))
    for r in rows:
        counts[r.i] = r[1:]
    return fps.count(), counts


def grouped_bits(n: int, counts: np.ndarray, m: int) -> list[list[int]]:
    """All bits in ``m`` parts of about equal width, each grown from its most correlated bits.

    What correlated bits repeat of each other then costs one part its power to
    tell apart, and not all of them.
    """
    p = np.diag(counts) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    bond = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(bond, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = BITS * (k + 1) // m - BITS * k // m
        order = sorted(free)
        part = [max(order, key=lambda b: (bond[b, order].sum(), -b))]
        while len(part) < width:
            part.append(max((b for b in order if b not in part), key=lambda b: (bond[b, part].sum(), -b)))
        free -= set(part)
        parts.append(sorted(part))
    return parts


def probes(width: int, threshold: int) -> int:
    return sum(comb(width, j) for j in range(threshold + 1))


def allotted(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, one a part, that sum to ``total``: dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t, more in cost.items():
                if spent + t not in nxt or c + more < nxt[spent + t][0]:
                    nxt[spent + t] = (c + more, [*chosen, t])
        best = nxt
    return best[total]


def _mask(part: list[int]) -> int:
    return _signed(sum(1 << b for b in part))


def plan(fps: DataFrame, most: int = MOST_BITS) -> list[tuple[list[int], int]]:
    """The parts of the bits, each with the distance up to which it is probed.

    By the generalised pigeonhole principle two fingerprints within ``most``
    bits are within t_i on some part i whenever the t_i, -1 or more, sum to
    ``most`` - m + 1 over m parts. For two and three parts and every such
    allotment the cost is estimated from counts over all fingerprints (pairs
    that share a part's value, carried to larger distances by the bits'
    frequencies) plus the probes; the cheapest wins.
    """
    n, counts = bit_statistics(fps)
    schemes = {m: grouped_bits(n, counts, m) for m in range(2, most + 2)} or {1: [list(range(BITS))]}
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(part))).alias("x")) for m, parts in schemes.items() for i, part in enumerate(parts)]))
    shared = fps.select(keys.alias("k")).groupBy("k.m", "k.i", "k.x").agg(F.count("*").alias("n")).groupBy("m", "i").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()
    pairs = {(r.m, r.i): r.pairs for r in shared}
    p = np.diag(counts) / max(n, 1)
    differ = 2 * p * (1 - p)
    best = None
    for m, parts in schemes.items():
        costs = []
        for i, part in enumerate(parts):
            at = np.zeros(most + 2)
            at[0] = 1.0
            for q in differ[part]:  # how many bits of the part differ in a random pair
                at[1:] = at[1:] * (1 - q) + at[:-1] * q
                at[0] *= 1 - q
            base = max(pairs.get((m, i), 0.0), n * (n - 1) / 2 * at[0], 1e-9)
            costs.append({-1: 0.0} | {t: base * at[: t + 1].sum() / max(at[0], 1e-300) + 2.0 * n * probes(len(part), t) for t in range(most + 1)})
        cost, thresholds = allotted(costs, most - m + 1)
        if best is None or cost < best[0]:
            best = (cost, list(zip(parts, thresholds, strict=True)))
    return best[1]


def _through_flips(fps: DataFrame) -> DataFrame:
    """Edges that connect just what lies within 2 bits, from rows (fp, rep), with no pairing.

    Two fingerprints are within 2 bits if and only if both are within 1 bit of
    some third value. Each is sent to its 65 such values; a value has 65
    senders at most, all within 2 bits of each other, and they are hung on the
    smallest.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(BITS)])
    sent = fps.select("rep", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("x"))
    met = sent.groupBy("x").agg(F.min("rep").alias("v"), F.collect_list("rep").alias("all")).where(F.size("all") > 1)
    return met.select(F.explode("all").alias("u"), "v").where("u != v").distinct()


def links(fps: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges (u, v) between reps of rows (fp, rep), fp distinct, that join exactly what chains of links within MOST_BITS bits join.

    Fingerprints are indexed by each part's value and looked up by every value
    within the part's threshold; candidates are checked on all bits. Keys with
    over ``hot_key`` members are not paired: whoever touches such a key links
    by ``_through_flips``, which is exact and linear.
    """
    found = [(i, part, t) for i, (part, t) in enumerate(plan(fps)) if t >= 0]
    index = fps.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(part))).alias("x")) for i, part, _ in found])).alias("k")).select("fp", "rep", "k.i", "k.x")
    asked = []
    for i, part, t in found:
        near = [_mask(list(bits)) for j in range(t + 1) for bits in combinations(part, j)]
        value = F.col("fp").bitwiseAND(F.lit(_mask(part)))
        asked.append(fps.select("fp", "rep", F.lit(i).alias("i"), F.explode(F.transform(F.array(*[F.lit(x) for x in near]), lambda f: value.bitwiseXOR(f))).alias("x")))
    probe = asked[0]
    for more in asked[1:]:
        probe = probe.union(more)
    sizes = index.groupBy("i", "x").agg(F.count("*").alias("n"))
    hot = stored(sizes.where(F.col("n") > hot_key).select("i", "x"), "hot-keys")
    touch = stored(probe.join(hot, ["i", "x"], "left_semi").select("fp", "rep").union(index.join(hot, ["i", "x"], "left_semi").select("fp", "rep")).distinct(), "hot-marks")
    a, b = probe.join(hot, ["i", "x"], "left_anti"), index.join(hot, ["i", "x"], "left_anti")
    b = b.select(F.col("fp").alias("fp2"), F.col("rep").alias("rep2"), F.col("i").alias("i2"), F.col("x").alias("x2"))
    close = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MOST_BITS)
    pairs = a.join(b, (a["i"] == b["i2"]) & (a["x"] == b["x2"]) & close).select(F.col("rep").alias("u"), F.col("rep2").alias("v"))
    return pairs.union(_through_flips(touch))


def near_duplicates(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): documents linked, over any number of steps, by fingerprints within MOST_BITS bits.

    component_id is the smallest doc_id of the component. Equal fingerprints
    always link, so the search runs on distinct ones, and copies are never
    paired up. Null and empty texts have fingerprint 0 and link like others.
    Rows with a null doc_id keep their fingerprint and link nothing; their
    component_id is that of the documents with the same fingerprint, null if
    there are none. Repeated rows stay repeated. No rows give no rows.
    """
    marks = stored(with_simhash(docs, words), "simhash")
    distinct = stored(marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    found = components(links(distinct), "simhash-components")
    root = distinct.join(found, distinct["rep"] == found["node"], "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component_id"))
    # a hint and one plain key on either side: AQE may split a fingerprint that a third of all rows share
    return marks.join(root, marks["fp"] == root["fp_"], "left").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


def _near_marks(rows: DataFrame) -> DataFrame:
    """(doc_id, t, t2, h1, h2, bands, fp) of each row (doc_id, t, t2, text): the whole text's identity, MinHash bands and five-word SimHash."""

    def made(part: pa.RecordBatch, texts: list, lists: list) -> pa.RecordBatch:
        keys = band_keys(lists)
        both = [identity(w) for w in lists]
        marks = np.array([simhash(x, WORDS) for x in texts], dtype=np.uint64).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).reshape(-1)))
        return pa.RecordBatch.from_arrays([*[part.column(i) for i in range(3)], pa.array([x for x, _ in both], pa.int64()), pa.array([x for _, x in both], pa.int64()), bands, pa.array(marks)], names=["doc_id", "t", "t2", "h1", "h2", "bands", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, texts, lists, held = 0, [], [], 0
            for i, text in enumerate(batch.column(3)):
                texts.append(text.as_py())
                lists.append(words_of(texts[-1]))
                held += len(lists[-1]) + 1
                if held >= SLICE or i + 1 == batch.num_rows:  # bounded scratch
                    yield made(batch.slice(start, i + 1 - start), texts, lists)
                    start, texts, lists, held = i + 1, [], [], 0

    return rows.mapInArrow(run, "doc_id long, t long, t2 long, h1 long, h2 long, bands array<long>, fp long")


def keep_one_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` of each group of near copies: that of the smallest doc_id.

    Two documents link if their sets of five-word shingles have a Jaccard
    similarity of ``similarity`` or more; a group is what links join over any
    number of steps. Candidates are the texts whose five-word SimHashes are
    within MOST_BITS bits, found as in ``links``. At 0.8 two 64-bit SimHashes
    differ in about ten bits, too many to look up, so texts that share a MinHash
    band, tuned to find such a pair with probability 0.999, are candidates as
    well. Each is checked on the shingles themselves. Null and empty texts are
    one group; fewer than five words are one shingle. Rows with a null doc_id
    belong to groups like others and stay only where no row of the group has an
    id; of rows with equal doc_id and text one stays.
    """
    shown = {x: free_name(x, docs) for x in ("t", "t2", "id")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    marks = stored(_near_marks(rows), "near-marks")
    merged = marks.groupBy("h1", "h2").agg(F.min("doc_id").alias("d"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    distinct = stored(merged.select(F.monotonically_increasing_id().alias("pid"), "*"), "near-distinct")
    fps = stored(distinct.groupBy("fp").agg(F.min("pid").alias("rep")), "near-fingerprints")
    alike = distinct.join(fps.select(F.col("fp").alias("fp_"), "rep"), distinct["fp"] == F.col("fp_")).where("pid != rep").select(F.col("rep").alias("u"), F.col("pid").alias("v"))
    near = stored(links(fps).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).union(alike).distinct(), "near-simhash-links")
    found = near_paragraphs(distinct, rows.select("doc_id", "text"), whole, similarity, near)
    labelled = stored(distinct.select("pid", "h1", "h2").join(found, distinct["pid"] == found["node"], "left").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.coalesce("component", "pid").alias("label")), "near-labels")
    choice = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "t2")
    texts = marks.groupBy("h1", "h2", "doc_id", "t", "t2").agg(F.count("*").alias("n"))
    texts = texts.join(labelled, (texts["h1"] == labelled["k1"]) & (texts["h2"].bitwiseXOR(labelled["k2"]) == 0))
    kept = texts.groupBy("label").agg(F.min_by(F.struct("doc_id", "t", "t2", "n"), choice).alias("x")).select(F.col("x.doc_id").alias("c_id"), F.col("x.t").alias("c1"), F.col("x.t2").alias("c2"), F.col("x.n").alias("n"))
    kept = stored(kept, "near-kept")
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.select(*names, F.xxhash64("text").alias(shown["t"]), F.xxhash64(F.lit(1), "text").alias(shown["t2"]), F.col("doc_id").cast("long").alias(shown["id"]))
    meets = lambda x: (keyed[shown["t"]] == x["c1"]) & (keyed[shown["t2"]].bitwiseXOR(x["c2"]) == 0) & keyed[shown["id"]].eqNullSafe(x["c_id"])
    single, several = kept.where("n = 1"), kept.where("n > 1")
    once = keyed.join(single, meets(single), "left_semi").select(*names)
    if several.isEmpty():
        return once
    again = keyed.join(several, meets(several), "left_semi")
    one = again.groupBy(shown["t"], shown["t2"], shown["id"]).agg(F.first(F.struct(*names)).alias("row_")).select("row_.*")
    return once.union(one)
