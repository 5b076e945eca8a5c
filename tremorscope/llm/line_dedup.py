"""Line dedup: drop lines that also stand in an earlier document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line):
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def without_positions(items, gone):
    """The array without the elements at the sorted 0-based positions: the stretches between them, each taken once."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(items)))

    def stretches(x):  # both arrays as a lambda's variable, so that neither is made anew for each stretch
        stretch = lambda k: F.slice(x["items"], F.get(x["ends"], k - 1) + 2, F.get(x["ends"], k) - F.get(x["ends"], k - 1) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(x["ends"]) - 1), stretch))

    return F.get(F.transform(F.array(F.struct(items.alias("items"), ends.alias("ends"))), stretches), F.lit(0))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines`` and ``n_dropped`` added.

    A key of ``min_chars`` code points or more that stands in ``min_docs``
    documents or more loses all its lines except those of the smallest doc_id
    that holds it. A line repeated only inside one document stays. A null or
    empty text is one empty line and comes out as the empty text. Rows that
    share a doc_id are one document to the counts; each row loses its own lines
    only. Rows with a null doc_id count for nothing and lose nothing. Other columns pass; an
    incoming n_lines or n_dropped gives way.

    Keys travel as two 64-bit hashes, the second salted before the key, as a
    salt after it would only hash the first anew. Lines of any length shuffle
    as 16 bytes; hot keys are pre-aggregated by min, max and (only where more than
    two documents are asked for) a distinct count. The text itself is shuffled
    once, to meet the positions that it loses, by doc_id and the text's hash; it
    is put together again from the stretches between them, in linear time.
    """
    lines = (
        docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
        .where("d is not null")
        .select("d", "t", "pos", line_key(F.col("line")).alias("k"))
        .where(F.char_length("k") >= min_chars)
        .select("d", "t", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))
    )
    if min_docs == 2:
        found = lines.groupBy("h1", "h2").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d")).where("first_d < last_d")
    else:
        found = lines.groupBy("h1", "h2", "d").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.min("d").alias("first_d"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    found = found.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first_d")
    # equal on h1, checked on h2: both sides are dealt anew by h1, so that AQE may split a line that a third of all rows hold
    same = (lines["h1"] == found["f1"]) & (lines["h2"].bitwiseXOR(found["f2"]) == 0)
    lost = lines.join(found, same).where("d > first_d").groupBy("d", "t").agg(F.array_sort(F.collect_set("pos")).alias("lost_pos"))
    split = F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)
    joined = docs.join(lost, (docs["doc_id"] == lost["d"]) & (F.xxhash64(docs["text"]) == lost["t"]), "left")
    gone = F.coalesce(lost["lost_pos"], F.array().cast("array<int>"))
    cut = F.array_join(without_positions(split, gone), "\n")
    kept = [F.when(F.size(gone) == 0, F.coalesce(docs["text"], F.lit(""))).otherwise(cut).alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*kept, F.size(split).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS t(i)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), found AS (
  SELECT k, min(doc_id) AS first_d FROM keyed
  WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT doc_id, pos, line, coalesce(keyed.doc_id > first_d, false) AS lost FROM keyed LEFT JOIN found USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
