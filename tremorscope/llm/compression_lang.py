"""Language ID by compression: the language whose dictionary shortens a text most."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import crc_bucket

#: The classifier is fitted on at most this many labelled texts a language, of so many characters each; at most so many languages.
SAMPLE_DOCS, SAMPLE_CHARS, MAX_LANGUAGES = 160, 1024, 512
#: A text is coded in pieces of so many characters, so that its own repeats don't drown what the dictionary saves.
PIECE_CHARS, LEVEL, MIN_MARGIN = 1536, 3, 0.004
NOT_LETTERS = re.compile(r"[\W\d_]+")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def letters(text: str) -> str:
    """Lower case, each run of other characters than letters as one space."""
    return NOT_LETTERS.sub(" ", text.lower())


def learn(train: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """(lang, dictionary) by falling number of training rows, from rows (doc_id, text, lang).

    Of each language the ``sample_docs`` texts with the smallest id hashes give
    ``sample_chars`` characters each from their middle. That bound, times
    MAX_LANGUAGES, is all that reaches the driver. Rows with null text or lang
    don't count.
    """
    rows = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    middle = F.greatest(F.lit(1), (F.char_length("text") / 2).cast("int") - sample_chars // 2)
    small = rows.select("lang", F.xxhash64("doc_id", F.lit(7)).alias("h"), "doc_id", F.col("text").substr(middle, F.lit(sample_chars)).alias("part"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "part")
    picked = small.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_docs)
    by_lang = picked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "part"))).alias("parts"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    found = by_lang.join(counts, "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the dictionaries would not fit the driver")
    return [(x.lang, " ".join(letters(p.part) for p in x.parts).encode()) for x in sorted(found, key=lambda x: (-x.n, x.lang))]


class Judge:
    """Ready compressors; made once a Python worker and task."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = LEVEL):
        self.langs = [lang for lang, _ in dictionaries]
        self.coders = []
        for _, content in dictionaries:
            # a raw-content dictionary may not start with a trained one's magic number, nor be under 8 bytes
            d = zstandard.ZstdCompressionDict(b" " * 8 + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, margin): the margin is the share of the second-best size that the best saves."""
        clean = letters(text) if text else ""
        if not self.langs or not any(map(str.isalpha, clean)):
            return "und", 0.0
        pieces = [clean[i : i + PIECE_CHARS].encode() for i in range(0, len(clean), PIECE_CHARS)]
        sizes = [sum(len(coder.compress(p)) for p in pieces) for coder in self.coders]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.langs[best], 1.0 if rest is None else (rest - sizes[best]) / rest


def classify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of ``docs``.

    Whole texts are coded, piece by piece, with each dictionary. Null text or
    a text without letters is ``und``, score 0. ``rejected`` marks these and
    margins under ``min_margin``, where the best language saves too little
    against the second. Ties go to the language with more training rows, then
    the smaller name. No dictionaries at all: everything is ``und``.

    The dictionaries (bounded, see ``learn``) travel with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries)
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), pa.array([x == "und" or s < min_margin for x, s in got], pa.bool_())],
                names=SCHEMA.names,
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_bucket("doc_id", 4) != 2)


def digest(docs: DataFrame) -> DataFrame:
    got = classify(docs, learn(training_rows(docs)))
    return got.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are.

    The texts ride along with their verdict, so there is no join. A lang of
    null in a training row just isn't learned from.
    """
    dictionaries = learn(training_rows(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries)
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array([x != "und" and s >= MIN_MARGIN for x, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
