"""Substring dedup: paragraphs that stand, alike or nearly so, in several documents, and runs of words that an earlier one holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, free_name, stored
from .components import components, contracted
from .minhash import BANDS, RUN, SIMILARITY, band_keys, identity, jaccard, shingles, tuned_bands, window_identity, words_of
from .passage_runs import near_units, repeated_runs, run_windows, runs_of

__all__ = ["band_keys", "digest", "identity", "jaccard", "paragraphs", "remove_repeats", "repeated_passages", "repeated_runs", "shingles", "tuned_bands"]
#: Lines of fewer words are left alone: stock phrases, headings.
MIN_WORDS = 20


def paragraphs(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(position, start, length, words) of each line with ``min_words`` words or more; words are split at ASCII white space, A-Z lower-cased."""
    start = 0
    for pos, line in enumerate((text or "").split("\n")):
        if len(line) >= 2 * min_words - 1:
            words = words_of(line)
            if len(words) >= min_words:
                yield pos, start, len(line), words
        start += len(line) + 1


#: A text's units, as ``paragraphs`` gives them.
Cut = Callable[[str | None], Iterator[tuple[int, int, int, list[bytes]]]]


def whole(text: str | None) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """The whole text as one unit; null is empty."""
    yield 0, 0, len(text or ""), words_of(text)


#: Words that are banded at once.
SLICE = 100_000


def with_bands(docs: DataFrame, cut: Cut) -> DataFrame:
    """(doc_id, h1, h2, start, length, n_words, bands) of every unit."""
    names = ["doc_id", "start", "length", "n_words", "h1", "h2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(places: list, lists: list) -> pa.RecordBatch:
            keys = band_keys(lists).view(np.int64)
            both = [identity(w) for w in lists]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
            columns = [*zip(*places, strict=True), map(len, lists), *zip(*both, strict=True)]
            return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], bands], names=names)

        for batch in batches:
            places, lists, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for _, start, length, words in cut(text.as_py()):
                    places.append((doc_id, start, length))
                    lists.append(words)
                    held += len(words) + 1
                    if held >= SLICE:
                        yield made(places, lists)
                        places, lists, held = [], [], 0
            if places:
                yield made(places, lists)

    return docs.mapInArrow(run, "doc_id long, start long, length long, n_words long, h1 long, h2 long, bands array<long>")


#: Words that a batch of located units holds.
LOCATED_WORDS = 500_000


def located(docs: DataFrame, cut: Cut, with_text: bool = False) -> DataFrame:
    """(doc_id, t, pos, start, length, h1, h2[, words]) of every unit; t is the XXH64 of the row's text."""
    names = ["doc_id", "t", "pos", "start", "length", "h1", "h2", *(["words"] if with_text else [])]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:7]], *[pa.array([x.decode() for x in c], pa.string()) for c in columns[7:]]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                t = xxhash.xxh64_intdigest((text or "").encode(), 42)
                t -= (t >> 63) << 64
                for pos, start, length, words in cut(text):
                    rows.append((doc_id, t, pos, start, length, *identity(words), *([b" ".join(words)] if with_text else [])))
                    held += len(words)
                    if held >= LOCATED_WORDS:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    return docs.mapInArrow(run, "doc_id long, t long, pos long, start long, length long, h1 long, h2 long" + (", words string" if with_text else ""))


def fetched(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(pid, words) of the units ``members`` (pid, m1, m2, d, start, length), lines or windows, cut out of the texts of the documents d."""
    asked = members.groupBy(F.col("d").alias("d_")).agg(F.collect_list(F.struct("pid", "start", "length", "m1", "m2")).alias("asked"))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x.decode() for _, x in rows], pa.string())], names=["pid", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                for x in wanted.as_py():
                    words = words_of(text[x["start"] : x["start"] + x["length"]])
                    if (x["m1"], x["m2"]) in (identity(words), window_identity(words)):  # rows may share a doc_id
                        rows.append((x["pid"], b" ".join(words)))
                        held += len(words)
                    if held >= LOCATED_WORDS:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    return docs.join(asked, docs["doc_id"] == asked["d_"]).select("text", "asked").mapInArrow(run, "pid long, words string")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those (u, v) whose texts' exact Jaccard similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(a.as_py(), b.as_py()) >= similarity for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    a, b = texts.select(F.col("pid").alias("u"), F.col("words").alias("a")), texts.select(F.col("pid").alias("v"), F.col("words").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _shingled(texts: DataFrame) -> DataFrame:
    """(pid, s): the hashes of the text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[xxhash.xxh3_64_intdigest(x) - 2**63 for x in set(shingles(t.as_py().encode().split()))] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["pid", "s"])

    return texts.select("pid", "words").mapInArrow(run, "pid long, s array<long>")


def _kept(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """``df``, stored; the tables that ``df`` and only it still needed go."""
    out = stored(df, name)
    for x in (df, *spent):
        dropped(x)
    return out


def _labelled(met: DataFrame, found: DataFrame) -> DataFrame:
    """Bucket members (key, pid) with their component in ``found``, of buckets that hold several, and the bucket's last member."""
    rows = met.join(found, met["pid"] == found["node"], "left").select("key", "pid", F.coalesce("component", "pid").alias("label"))
    open_ = stored(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("pid").alias("last")).where("lo < hi").select(F.col("key").alias("key_"), "last"), "passage-open")
    out = rows.join(open_, rows["key"] == open_["key_"]).select("key", "pid", "label", "last")
    out.stored_at = open_.stored_at
    return out


#: 64-bit words of a sketch.
SKETCH = 4


def _sketch(s: str) -> list:
    """k0 to k3: the bits of the classes of hashes of which ``s`` holds an odd number."""
    return [F.expr(f"aggregate({s}, 0L, (bits, x) -> bits ^ if(shiftrightunsigned(x, 6) & {SKETCH - 1} = {i}, shiftleft(1L, cast(x & 63 as int)), 0L))").alias(f"k{i}") for i in range(SKETCH)]


def _rare_in_common(full: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of units (pid, kind, label, s) of one kind and different labels that share one of their rarest shingles, as all do whose similarity is high enough.

    Two sets as similar as t share at least t of the larger, and 2 t / (1 + t)
    of the smaller. So of any common order of the shingles, here by how many
    units hold them, the larger's first n - ceil(t n) + 1 and the smaller's
    first n - ceil(2 t n / (1 + t)) + 1 have one in common. Units that share
    nothing but a stock passage, however many, don't meet, as their rarest
    shingles are their own.

    Windows that overlap by half share rare shingles too. A unit's sketch has a
    bit for each class of hashes, set if an odd number of its shingles are in the
    class, so two sketches differ in no more bits than there are shingles of
    one unit alone. Pairs whose sketches differ in more than similar sets can
    are left out before any text is fetched for them.
    """
    parts = full.select("pid", "kind", "label", F.size("s").alias("n"), F.explode("s").alias("part"))
    common = parts.groupBy(F.col("part").alias("part_")).agg(F.count("*").alias("units")).where("units > 1")
    least = lambda share: F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1
    rare = parts.join(common, parts["part"] == common["part_"], "left").withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy(F.coalesce("units", F.lit(1)), "part"))).where("units > 1")
    rare = stored(rare.where(F.col("place") <= least(similarity)).join(full.select("pid", *_sketch("s")), "pid"), "passage-rare")
    larger = rare.select("part", "kind", F.col("pid").alias("u"), F.col("label").alias("x"), F.col("n").alias("n_u"), *[f"k{i}" for i in range(SKETCH)])
    smaller = rare.where(F.col("place") <= least(2 * similarity / (1 + similarity))).select(F.col("part").alias("part_"), F.col("kind").alias("kind_"), F.col("pid").alias("v"), F.col("label").alias("y"), F.col("n").alias("n_v"), *[F.col(f"k{i}").alias(f"l{i}") for i in range(SKETCH)])
    apart = sum((F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"l{i}"))) for i in range(SKETCH)), F.lit(0))
    alike = apart * (1 + similarity) <= (F.col("n_u") + F.col("n_v")) * (1 - similarity) + 1e-9
    order = (F.struct("n_v", "v") < F.struct("n_u", "u")) & (F.col("n_v") >= similarity * F.col("n_u") - 1e-9) & (F.col("x") != F.col("y"))
    out = larger.join(smaller, (larger["part"] == smaller["part_"]) & (F.col("kind") == F.col("kind_")) & order & alike).select("u", "v").distinct()
    out.stored_at = rare.stored_at
    return out


def near_paragraphs(distinct: DataFrame, docs: DataFrame, cut: Cut, similarity: float, also: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """(node, component) over distinct units (pid, h1, h2, d, bands) of ``docs`` under ``cut`` that link to another; ``also`` holds further pairs (u, v) to check. If ``placed``, units come with their start and length in a text of d.

    A bucket is a band key that several distinct units share. Its members
    are first checked against its smallest, then its largest member, which is
    linear in its size and joins a group of near copies at once. Members of a
    bucket that are not in one component by then meet over their rarest shingles
    if ``placed``, else in a join on the key that puts out links only.
    No link between members of a bucket is lost: a pair that goes unchecked is
    in one component already, or not similar enough.
    """
    keys = distinct.select("pid", F.explode("bands").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("pid").alias("first"), F.max("pid").alias("other")).where("first < other").select(F.col("key").alias("key_"), "first"), "passage-buckets")
    met = _kept(keys.join(shared, keys["key"] == shared["key_"]).select("key", "pid", "first"), "passage-members", shared)
    pairs = met.where("pid != first").select(F.col("first").alias("u"), F.col("pid").alias("v"))
    wanted = met.select("pid")
    if also is not None:
        pairs, wanted = pairs.union(also.select("u", "v")), wanted.union(also.select("u")).union(also.select("v"))
    members = distinct.select("pid", F.col("h1").alias("m1"), F.col("h2").alias("m2"), "d", *(["start", "length"] if placed else []))
    members = stored(members.join(wanted.distinct(), "pid", "left_semi"), "passage-candidates")
    if placed:
        found = fetched(docs, members)
    else:
        rows = located(docs, cut, True)
        same = (rows["h1"] == members["m1"]) & (rows["h2"] == members["m2"]) & rows["doc_id"].eqNullSafe(members["d"])
        found = rows.join(members, same).select("pid", "words")
    texts = _kept(found.dropDuplicates(["pid"]), "passage-texts", members)
    edges = stored(_verified(pairs.distinct(), texts, similarity), "passage-edges")
    # what is known stands as stars from here on, so each step adds its own links only
    found = contracted(edges, "passage-stars")
    rest = _kept(_labelled(met, found), "passage-rest")
    if not rest.isEmpty():
        pairs = rest.where("pid != last").select(F.col("pid").alias("u"), F.col("last").alias("v")).distinct()
        found, spent = components(_joined(found, _verified(pairs, texts, similarity)), "passage-components"), [found, rest]
        rest = _kept(_labelled(met, found), "passage-rest", *spent)
        if not rest.isEmpty():
            if placed:
                full = stored(rest.select("pid", "label").distinct().select("*", F.lit(0).alias("kind")).join(_shingled(texts), "pid"), "passage-shingles")
                pairs = _rare_in_common(full, similarity)
            else:
                full = rest.join(_shingled(texts), "pid")
                a, b = full.select("key", F.col("pid").alias("u"), F.col("label").alias("x"), "s"), full.select(F.col("key").alias("key_"), F.col("pid").alias("v"), F.col("label").alias("y"), F.col("s").alias("t"))
                sizes = F.size("s") + F.size("t")
                alike = (F.least(F.size("s"), F.size("t")) >= similarity * F.greatest(F.size("s"), F.size("t")) - 1e-9) & (F.size(F.array_intersect("s", "t")) * (1 + similarity) >= similarity * sizes - 1e-9)
                pairs = a.join(b, (F.col("key") == F.col("key_")) & (F.col("u") < F.col("v")) & (F.col("x") != F.col("y")) & alike).select("u", "v").distinct()
            found, spent = components(_joined(found, _verified(pairs, texts, similarity)), "passage-components"), [found, full, pairs]
            for x in spent:
                dropped(x)
    else:
        found, spent = components(edges, "passage-components"), [found]
        dropped(spent[0])
    for x in (met, texts, edges, rest):
        dropped(x)
    return found


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of the components ``found`` (node, component) and of ``links`` (u, v)."""
    return found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links)


def _classed(units: DataFrame, rows: DataFrame, cut: Cut, similarity: float) -> DataFrame:
    """(r1, r2, component_id, long_id) of the units (doc_id, h1, h2, start, length, n_words, bands) of components that several documents hold; long_id is the smallest doc_id that holds one of RUN words or more, null for shorter ones."""
    merged = units.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start", "length")).alias("p"), F.max("doc_id").alias("d_last"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"))
    distinct = stored(merged.select(F.monotonically_increasing_id().alias("pid"), "h1", "h2", F.col("p.doc_id").alias("d"), F.col("p.start").alias("start"), F.col("p.length").alias("length"), "d_last", "n_words", "bands"), "passages")
    found = near_paragraphs(distinct.select("pid", "h1", "h2", "d", "start", "length", "bands"), rows, cut, similarity, placed=True)
    long = F.col("n_words") >= RUN
    labelled = distinct.select("pid", "h1", "h2", "d", "d_last", long.alias("long")).join(found, distinct["pid"] == found["node"], "left").select("h1", "h2", "d", "d_last", "long", F.coalesce("component", "pid").alias("label"))
    labelled = _kept(labelled, "passage-labels", distinct, found)
    classes = labelled.groupBy("label").agg(F.min("d").alias("component_id"), F.max("d_last").alias("to_"), F.min(F.when(F.col("long"), F.col("d"))).alias("long_id")).where("component_id < to_").select(F.col("label").alias("label_"), "component_id", "long_id")
    return _kept(labelled.join(classes, labelled["label"] == classes["label_"]).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "component_id", F.when(F.col("long"), F.col("long_id")).alias("long_id")), "passage-classes", labelled)


def _placed(places: DataFrame, repeated: DataFrame) -> DataFrame:
    # equal on one half of the hash, checked on the other: AQE may split a line that a third of all rows hold
    return places.join(repeated, (places["h1"] == repeated["r1"]) & (places["h2"].bitwiseXOR(repeated["r2"]) == 0))


def _repeated_lines(docs: DataFrame, min_words: int, similarity: float) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    cut = partial(paragraphs, min_words=min_words)
    classes = _classed(with_bands(rows, cut), rows, cut, similarity)
    out = _placed(located(rows, cut), classes).select("doc_id", "t", "pos", "start", "length", "component_id", "long_id")
    out.stored_at = classes.stored_at
    return out


def edited_windows(docs: DataFrame, marks: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start, length, component_id) of windows of NEAR words that are near copies of windows in documents of another class.

    ``marks`` are the keys by text of ``run_windows``, ``classes`` (node,
    component) the classes of documents that are known already; others are their
    own. A window hangs on a shingle whose key documents of several classes
    share; it is banded by that key and further minima, candidates are checked
    by exact Jaccard similarity and clustered. Documents of one class need no
    further link, so their windows aren't compared.
    """
    keys = marks.where("not copy").select("d_", "t_", F.explode("shared").alias("key"))
    keys = keys.join(classes, keys["d_"] == classes["node"], "left").select("d_", "t_", "key", F.coalesce("component", "d_").alias("class"))
    open_ = keys.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select(F.col("key").alias("key_"))
    asked = stored(keys.join(open_, keys["key"] == open_["key_"]).groupBy("d_", "t_").agg(F.collect_set("key").alias("shared")), "near-keys")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").where("doc_id is not null and text is not null")
    texts = rows.join(asked, (rows["doc_id"] == asked["d_"]) & (rows["t"] == asked["t_"])).select("doc_id", "text", "shared")
    units = _kept(near_units(texts), "near-windows", asked)
    repeated = _classed(units, rows.select("doc_id", "text"), whole, similarity)
    out = _placed(units, repeated).select("doc_id", "start", "length", "component_id")
    out.stored_at = [units.stored_at, repeated.stored_at]
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, t, pos, start, length, component_id) of each line that stands, alike or nearly so, in two documents or more.

    Lines of ``min_words`` words or more count. Two lines link if their sets of
    five-word shingles have a Jaccard similarity of ``similarity`` or more;
    component_id is the smallest doc_id that holds any line linked to it over
    any number of steps. Positions and starts count from 0, in lines and code
    points. Repeats inside one document alone don't count. Null text has no
    lines; rows with a null doc_id take no part; rows that share a doc_id are
    one document, and t, the XXH64 of a row's text, tells them apart. Empty
    tables give no rows.

    Copies of a line are merged by a 128-bit hash before anything else, so
    a line that a third of all documents hold is one row from there on.
    """
    return _repeated_lines(docs, min_words, similarity).drop("long_id")


def _cut(docs: DataFrame, gone: DataFrame, kept: Callable[[str, list], str]) -> DataFrame:
    """``docs`` whose texts give way to ``kept(text, what)`` where ``gone`` (d_, t_, what) has a row for the doc_id and the text; all else as it is."""
    name = free_name("what", docs)
    same = (docs["doc_id"].cast("long") == gone["d_"]) & (F.xxhash64(docs["text"]) == gone["t_"])
    joined = docs.join(gone, same, "left").select(*[docs[f"`{c}`"] for c in docs.columns], gone["what"].alias(name))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column(len(docs_names)).to_pylist()
            if any(lost):
                texts = [kept(t, w) if w else t for t, w in zip(batch.column(at).to_pylist(), lost, strict=True)]
                columns = [batch.column(i) for i in range(len(docs_names))]
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=docs_names)
            else:
                yield batch.select(range(len(docs_names)))

    docs_names = docs.columns
    return joined.mapInArrow(run, docs.schema)


def _without_lines(text: str, lost: list[int]) -> str:
    gone = set(lost)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _without_spans(text: str, lost: list) -> str:
    parts, at = [], 0
    for start, length in sorted((s["start"], s["length"]) for s in lost):
        parts.append(text[at:start])
        at = max(at, start + length)
    return "".join([*parts, text[at:]])


def remove_repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that a document with a smaller doc_id holds, alike or nearly so. Null text stays null."""
    gone = repeated_passages(docs, min_words, similarity).where("doc_id > component_id").groupBy(F.col("doc_id").alias("d_"), F.col("t").alias("t_")).agg(F.collect_set("pos").alias("what"))
    return _cut(docs, gone, _without_lines)


def remove_repeated_runs(docs: DataFrame) -> DataFrame:
    """``docs`` without the runs of words that a document with a smaller doc_id holds. Null text stays null."""
    gone = repeated_runs(docs).groupBy(F.col("doc_id").alias("d_"), F.col("t").alias("t_")).agg(F.collect_set(F.struct("start", "length")).alias("what"))
    return _cut(docs, gone, _without_spans)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without lines that an earlier document holds, alike or nearly so, and then without the runs of RUN words or more that a document with a smaller doc_id still holds."""
    return remove_repeated_runs(stored(remove_repeated_passages(docs, min_words, similarity), "passages-cut"))


def digest(docs: DataFrame) -> DataFrame:
    """A row per document: its class, its lines' class ids, how many of its lines repeat, and the spans that stand elsewhere.

    A document's component_id is the smallest doc_id that it reaches over
    documents that share a passage of over 50 words: a line of RUN words or more
    alike or nearly so, RUN words on end anywhere, or NEAR words anywhere whose
    shingles have a Jaccard similarity of SIMILARITY. One that shares none has
    its own doc_id; a null doc_id has null. component_ids are the smallest
    doc_ids of the components of its lines, those of MIN_WORDS words and more
    counted in, which alone don't join documents; ``removed`` are those lines
    whose component reaches a smaller doc_id. ``passages`` are the runs of RUN
    words or more, inside a line or over several, that stand in documents with
    smaller doc_ids. ``edited`` are windows of NEAR words whose component reaches a
    smaller doc_id, where they lead to documents that lines and runs don't join.
    """
    marks, made = run_windows(docs)
    runs = _kept(runs_of(marks, made), "passage-runs", made)
    lines = _kept(_repeated_lines(docs, MIN_WORDS, SIMILARITY), "passage-lines")
    edge = lambda rows, to: rows.where(f"doc_id > {to}").select(F.col("doc_id").alias("u"), F.col(to).alias("v"))
    known = components(edge(lines, "long_id").union(edge(runs, "component_id")), "passage-documents")
    near = _kept(edited_windows(docs, marks, known), "passage-near", marks)
    edges = known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(edge(near, "component_id"))
    classes = components(edges, "passage-documents").withColumnsRenamed({"node": "n_", "component": "class_"})
    dropped(known)
    by_doc = lines.groupBy(F.col("doc_id").alias("d_")).agg(F.array_sort(F.collect_set(F.struct("pos", "start", "length", "component_id"))).alias("all_"))
    spans = lambda rows, key, name: rows.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start", "length", "component_id"))).alias(name))
    by_run, by_near = spans(runs, "r_", "runs_"), spans(near.where("doc_id > component_id"), "e_", "near_")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = ids.join(by_doc, ids["doc_id"] == by_doc["d_"], "left").join(by_run, ids["doc_id"] == by_run["r_"], "left").join(by_near, ids["doc_id"] == by_near["e_"], "left").join(classes, ids["doc_id"] == classes["n_"], "left")
    none = F.array().cast("array<struct<start:bigint,length:bigint,component_id:bigint>>")
    all_ = F.coalesce("all_", F.array().cast("array<struct<pos:bigint,start:bigint,length:bigint,component_id:bigint>>"))
    removed = F.filter(all_, lambda s: s["component_id"] < F.col("doc_id"))
    kinds = F.array_sort(F.array_distinct(F.transform(all_, lambda s: s["component_id"])))
    return joined.select("doc_id", F.coalesce("class_", "doc_id").alias("component_id"), kinds.alias("component_ids"), F.size(all_).cast("long").alias("n_repeated"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), F.coalesce("runs_", none).alias("passages"), F.coalesce("near_", none).alias("edited"))
