"""Paragraphs of 51 words on end that an earlier document holds, wherever lines begin and end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored
from .minhash import NEAR, NEAR_BANDS, RUN, near_bands, near_places, window_hashes, window_identities, window_keys, word_hashes, words_of


def word_spans(text: str) -> np.ndarray:
    """(start, end) of each word in code points; words lie between ASCII white space."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    blank = np.ones(len(codes) + 2, dtype=bool)
    blank[1:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return np.flatnonzero(blank[1:] != blank[:-1]).reshape(-1, 2)


def _keyed(rows: DataFrame) -> DataFrame:
    """(doc_id, t, t2, key): the distinct band keys of each row's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(window_keys(word_hashes(words_of(x.as_py())))) for x in batch.column(3)]
            at = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(at)) for i in range(3)], pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64())], names=["doc_id", "t", "t2", "key"])

    return rows.mapInArrow(run, "doc_id long, t long, t2 long, key long")


#: Windows that a batch holds, of as many texts.
SLICE = 1 << 16


def _windows(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, g1, g2, pos, start, end) of the windows whose key is among the row's ``shared`` ones; a copy of another text gives one row, its whole span, with g1 null.

    g1 hashes all words, g2 is a short piece of the key: 80 bits tell windows apart.
    """

    names = ["doc_id", "tag", "g1", "g2", "pos", "start", "end"]

    def made(texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(x[3]) for x in texts]
        columns = [np.repeat(np.array([x[i] for x in texts], dtype=np.int64), sizes) for i in (0, 1)]
        copy = np.repeat(np.array([x[2] for x in texts], dtype=bool), sizes)
        columns += [np.concatenate(x) for x in zip(*[x[3:] for x in texts], strict=True)]
        for i in range(0, len(copy), SLICE):
            part = [x[i : i + SLICE] for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64(), mask=copy[i : i + SLICE] if k == 2 else None) for k, x in enumerate(part)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = [], 0
        for batch in batches:
            for doc_id, tag, text, copy, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                text = text.as_py()
                spans = word_spans(text)
                if copy:
                    found = [np.array([x], dtype=np.int64) for x in (0, 0, 0, spans[0, 0], spans[-1, 1])]
                else:
                    hashed = word_hashes(words_of(text))
                    keys = window_keys(hashed)
                    pos = np.flatnonzero(np.isin(keys.view(np.int64), shared.values.to_numpy()))
                    found = [window_hashes(hashed)[pos].view(np.int64), keys[pos].view(np.int64) >> 48, pos, spans[pos, 0], spans[pos + RUN - 1, 1]]
                texts.append((doc_id, tag, copy, *found))
                held += len(found[0])
                if held >= SLICE:
                    yield from made(texts)
                    texts, held = [], 0
        if texts:
            yield from made(texts)

    return rows.mapInArrow(run, "doc_id long, tag long, g1 long, g2 long, pos long, start long, end long")


def near_units(rows: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, start, length, n_words, bands) of the windows of NEAR words beside the shingles that ``shared`` names, for rows (doc_id, text, shared)."""
    names = ["doc_id", "h1", "h2", "start", "length", "n_words", "bands"]

    def made(texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        # several texts at once: a text alone has few windows, and most of the time would go into calls
        base = np.cumsum([0, *(len(x[0]) for x in texts)])
        bands = near_bands(np.concatenate([x[0] for x in texts]), *[np.concatenate(x) for x in zip(*[(begin + low, anchor, side) for (_, begin, anchor, side, *_), low in zip(texts, base)])])
        places = np.concatenate([x[4] for x in texts])
        halves = np.frombuffer(b"".join([x[5] for x in texts]), dtype="<i8").reshape(-1, 2)
        for i in range(0, len(places), SLICE):
            flat = bands[i : i + SLICE].view(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, NEAR_BANDS, dtype=np.int32)), pa.array(flat))
            part = places[i : i + SLICE]
            columns = [part[:, 0], halves[i : i + SLICE, 0], halves[i : i + SLICE, 1], part[:, 1], part[:, 2], np.full(len(part), NEAR)]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns], lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = [], 0
        for batch in batches:
            for doc_id, text, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                words = words_of(text)
                marks, begin, anchor, side = near_places(word_hashes(words), shared.values.to_numpy().view(np.uint64))
                if len(begin):
                    spans = word_spans(text)
                    ids, again = np.unique(begin, return_inverse=True)
                    both = np.frombuffer(window_identities(words, ids.tolist()), dtype="<i8").reshape(-1, 2)[again].tobytes()
                    start = spans[begin, 0]
                    texts.append((marks, begin, anchor, side, np.column_stack([np.full(len(begin), doc_id), start, spans[begin + NEAR - 1, 1] - start]), both))
                    held += len(marks) + len(begin)
                    if held >= SLICE:
                        yield from made(texts)
                        texts, held = [], 0
        if texts:
            yield from made(texts)

    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, start long, length long, n_words long, bands array<long>")


def run_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts that hold shared keys, with those keys, and their windows, both stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2"), "text").where("doc_id is not null and text is not null")
    marked = stored(_keyed(rows), "run-keys")
    shared = marked.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.col("key").alias("key_"))
    by_doc = stored(marked.join(shared, marked["key"] == shared["key_"]).groupBy("doc_id", "t", "t2").agg(F.collect_set("key").alias("shared")), "run-documents")
    dropped(marked)
    texts = by_doc.groupBy("t", "t2").agg(F.min("doc_id").alias("rep")).select(F.col("t").alias("rt"), F.col("t2").alias("rt2"), "rep")
    # equal on one hash, checked on the other: AQE may split a text that a third of all rows share
    marks = by_doc.join(texts, (by_doc["t"] == texts["rt"]) & (by_doc["t2"].bitwiseXOR(texts["rt2"]) == 0)).select("doc_id", "t", "rep", (F.col("doc_id") > F.col("rep")).alias("copy"), "shared")
    several = by_doc.groupBy(F.col("doc_id").alias("s_")).agg(F.count("*").alias("n")).where("n > 1").select("s_")
    # texts are told apart by a tag, which is 0, and so takes no room, unless a doc_id has several
    marks = marks.join(several, marks["doc_id"] == several["s_"], "left").select(F.col("doc_id").alias("d_"), F.col("t").alias("t_"), F.when(F.col("s_").isNull(), F.lit(0).cast("long")).otherwise(F.col("t")).alias("tag"), "rep", "copy", F.when(F.col("copy"), F.array().cast("array<long>")).otherwise(F.col("shared")).alias("shared"))
    marks = stored(marks, "run-marks")
    dropped(by_doc)
    asked = rows.join(marks, (rows["doc_id"] == marks["d_"]) & (rows["t"] == marks["t_"])).select("doc_id", "tag", "text", "copy", "shared")
    return marks, stored(_windows(asked), "run-windows")


def runs_of(marks: DataFrame, made: DataFrame) -> DataFrame:
    """What ``repeated_runs`` returns, from what ``run_windows`` stored."""
    near = made.where("g1 is not null")
    first = stored(near.groupBy("g1", "g2").agg(F.min("doc_id").alias("first_d"), F.max("doc_id").alias("hi")).where("first_d < hi").select(F.col("g1").alias("f1"), F.col("g2").alias("f2"), "first_d"), "run-firsts")
    held = near.join(first, (near["g1"] == first["f1"]) & (near["g2"].bitwiseXOR(first["f2"]) == 0)).where("doc_id > first_d").select("doc_id", "tag", "pos", "start", "end", "first_d")
    island = F.col("pos") - F.dense_rank().over(Window.partitionBy("doc_id", "tag").orderBy("pos"))
    runs = held.withColumn("island", island).groupBy("doc_id", "tag", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_d").alias("first"))
    copies = made.where("g1 is null").select("doc_id", "tag", F.lit(0).cast("long").alias("island"), "start", "end", F.lit(None).cast("long").alias("first")).distinct()
    spans = runs.union(copies).join(marks.select("d_", "t_", F.col("tag").alias("g_"), "rep"), (F.col("doc_id") == F.col("d_")) & (F.col("tag") == F.col("g_"))).select("doc_id", F.col("t_").alias("t"), "start", "end", F.coalesce("first", "rep").alias("component_id"))
    out = spans.select("doc_id", "t", "start", (F.col("end") - F.col("start")).alias("length"), "component_id")
    out.stored_at = first.stored_at
    return out


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, t, start, length, component_id) of each run of RUN words or more that stands in documents with a smaller doc_id.

    Every RUN words on end are a paragraph here, so a passage keeps its
    paragraphs whatever stands around it; line breaks count as any white space.
    A run is the longest stretch of which each paragraph stands, word for word,
    in a document with a smaller doc_id; component_id is the smallest such
    doc_id over the stretch, or for a copy of a whole text its first holder. Starts and lengths are in code points. Repeats
    inside one document don't count. Null text has no runs; rows with a null
    doc_id take no part; rows that share a doc_id are one document, and t, the
    XXH64 of a row's text, tells them apart. Empty tables give no rows.

    Paragraphs collide by their MinHash over five-word shingles, on which equal
    ones always agree and neighbours mostly do, so a text has one key to about
    24 words. Keys are counted with map-side combining. Only texts that hold a
    shared key are read again, and only their paragraphs under shared keys
    compared, by a hash of all their words beside the key, again by counting.
    Equal texts count as one from there on. No pairs are formed.
    """
    return runs_of(*run_windows(docs))
