"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

SEED, EXPONENT = 17, 0.5
#: A draw's largest rate; a larger one is split over several draws. Poisson table entries, over all sources, up to which the tables are broadcast (8 bytes each).
MOST_RATE, BROADCAST_ENTRIES = 700, 1_000_000


def target_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = EXPONENT, total: float | None = None) -> DataFrame:
    """(source, n, rate): how many times, on average, each row of a source is to appear.

    ``weights`` gives target weights by source; sources it doesn't name get
    none. Without it a source weighs its row count to the power ``exponent``.
    Weights are brought to a sum of 1, times ``total`` rows (as many as there
    are, if not given). Rows with a null source are a source of their own.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(exponent)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s__ string, w_ double")
        weighted = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s__")), "left").select("source", "n", F.coalesce("w_", F.lit(0.0)).alias("w"))
    sums = weighted.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    return weighted.crossJoin(F.broadcast(sums)).select("source", "n", F.coalesce(F.col("w") / F.nullif(F.col("all_w"), F.lit(0.0)) * wanted / F.col("n"), F.lit(0.0)).alias("rate"))


def uniform(seed: int, doc_id):
    """A number in [0, 1) from an id: the first 52 bits of md5 of 'seed|id'."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def poisson_table(rate):
    """P(X <= k) for k = 0, 1, ... as an array, up to where the rest is negligible."""
    most = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["sums"]


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = EXPONENT, seed: int = SEED, total: float | None = None) -> DataFrame:
    """Each row as many times as its Poisson count says, in a global random order.

    Adds ``copy`` (0, 1, ...), ``rate`` and ``shuffle_key``, by which the rows
    are ordered. A row's count inverts the Poisson distribution of its
    source's rate at a number hashed from seed and doc_id, so it depends on
    nothing else; rows that share a doc_id get the same count; a null doc_id
    hashes as the empty text. A rate over MOST_RATE is split over several such draws.
    A source of weight 0 goes. No rows give no rows. Incoming columns of the
    added names give way.

    Counting reduces map-side to a row a source. Those rows are stored with
    their Poisson tables; if these have BROADCAST_ENTRIES entries at most, they
    are broadcast, and texts move once, to their place in the order. Beyond
    that texts first meet them by a join on the source, whose hot sources AQE
    may split.
    """
    keep = [c for c in docs.columns if c.lower() not in ("copy", "rate", "shuffle_key")]
    source, draws, sums, times = (free_name(x, docs) for x in ("of", "draws", "sums", "times"))
    rates = target_rates(docs, weights, exponent, total).select(F.col("source").alias(source), "rate", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int").alias(draws))
    table = stored(rates.where("rate > 0").withColumn(sums, poisson_table(F.col("rate") / F.col(draws))), "source-rates")
    entries = table.agg(F.sum(F.size(sums))).first()[0] or 0
    joined = docs.select(*[f"`{c}`" for c in keep]).join(F.broadcast(table) if entries <= BROADCAST_ENTRIES else table, docs["source"].eqNullSafe(F.col(source)))
    # numbers first, as an array, so that each is hashed once and not once a table entry
    below = lambda units: F.transform(units, lambda u: F.size(F.filter(sums, lambda c: c <= u)))
    many = F.transform(F.sequence(F.lit(1), F.col(draws)), lambda i: uniform(seed, F.concat_ws("|", F.col("doc_id").cast("string"), i.cast("string"))))
    units = F.when(F.col(draws) == 1, F.array(uniform(seed, F.col("doc_id")))).otherwise(many)
    count = F.aggregate(below(units), F.lit(0), lambda a, x: a + x)
    copies = joined.withColumn(times, count).where(F.col(times) > 0).select(*[f"`{c}`" for c in keep], F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias("copy"), "rate")
    key = F.md5(F.concat_ws("|", F.lit(str(seed + 1)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("shuffle_key", key).orderBy("shuffle_key")


def digest(docs: DataFrame) -> DataFrame:
    out = mix_sources(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return out.select("doc_id", "copy", "source", F.round("rate", 9).alias("rate"), "shuffle_key", "text", "lang", "n_chars")


#: Rows of ``documents`` as mixed, for further SQL: {docs} is the table.
MIXED = f"""
rates AS (
  SELECT source, n, pow(n, {EXPONENT}) / sum(pow(n, {EXPONENT})) OVER () * sum(n) OVER () / n AS rate
  FROM (SELECT source, count(*)::DOUBLE AS n FROM {{docs}} GROUP BY source)
), terms AS (
  SELECT source, k, sum(CASE WHEN k = 0 THEN exp(-r) ELSE exp(k * ln(r) - r - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS p
  FROM (SELECT source, rate / greatest(1, ceil(rate / {MOST_RATE})) AS r FROM rates), generate_series(0, (SELECT ceil(max(least(rate, {MOST_RATE})) * 1.4 + 250)::BIGINT FROM rates)) AS t(k)
), drawn AS (
  SELECT row, doc_id, source, text, lang, n_chars, rate, i, ('0x' || substr(md5('{SEED}|' || CASE WHEN rate <= {MOST_RATE} THEN coalesce(doc_id::VARCHAR, '') ELSE concat_ws('|', doc_id, i) END), 1, 13))::BIGINT / {float(1 << 52)} AS unit
  FROM (SELECT d.*, row_number() OVER () AS row, rate, unnest(generate_series(1, greatest(1, ceil(rate / {MOST_RATE}))::BIGINT)) AS i FROM {{docs}} d JOIN rates ON rates.source IS NOT DISTINCT FROM d.source)
), numbered AS (
  SELECT row, doc_id, source, text, lang, n_chars, rate, sum((SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM drawn.source AND t.p <= drawn.unit))::BIGINT AS times
  FROM drawn GROUP BY ALL
), mixed AS (
  SELECT doc_id, copy::INT AS copy, source, round(rate, 9) AS rate, md5('{SEED + 1}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS shuffle_key, text, lang, n_chars
  FROM numbered, unnest(generate_series(0, times - 1)) AS t(copy)
)"""
ORACLE = f"WITH {MIXED.format(docs='documents')} SELECT * FROM mixed"
