import math

from pyspark.sql import functions as F

from tremorscope.llm import source_mixing as mix


def test_rates_and_counts(spark):
    rows = [(i, "t", "en", "big" if i % 3 else "small", 1) for i in range(3000)] + [(9000 + i, "t", "en", None, 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rates = {r.source: r.rate for r in mix.target_rates(docs, {"big": 1.0, "small": 3.0}, total=6000).collect()}
    assert rates == {"big": 0.75, "small": 4.5, None: 0.0}
    out = mix.mix_sources(docs, {"big": 1.0, "small": 3.0}, total=6000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"big", "small"} and abs(n["big"] - 1500) < 150 and abs(n["small"] - 4500) < 250
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    again = mix.mix_sources(docs.repartition(7), {"big": 1.0, "small": 3.0}, total=6000)
    assert [r.shuffle_key for r in again.collect()] == keys


def test_table_is_poisson(spark):
    for rate in (0.01, 1.0, 30.0, 700.0):
        table = spark.range(1).select(mix.poisson_table(F.lit(rate)).alias("t")).first().t
        p, total = math.exp(-rate), 0.0
        for k, got in enumerate(table):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            assert abs(got - total) < 1e-9
        assert 1 - table[-1] < 1e-9


def test_large_rates_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "x", "y", "a"), (4, "z", None, None)], "doc_id long, text string, lang string, source string").selectExpr("*", "5 as copy", "6 as table", "7 as draws", "8 as of", "9 as sums", "1 as times", "2 as s__")
    out = mix.mix_sources(docs, {"a": 1.0}, total=6000)
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(n) == {1, None} and 3600 < n[1] < 4400 and n[1] % 2 == 0 and 1700 < n[None] < 2300
    assert mix.mix_sources(docs.limit(0)).count() == 0


def test_sql_holds_at_large_rates(spark, tmp_path):
    """A rare source among many rows: its rate is over 200 in one table, over 700 in the other."""
    import duckdb

    for big in (70_000, 600_000):
        rows = spark.range(big).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "'big' as source", "1L as n_chars").union(spark.range(1).selectExpr("id", "'rare'", "'en'", "'rare'", "1L"))
        path = str(tmp_path / f"documents{big}")
        rows.repartition(4).write.parquet(path)
        docs = spark.read.parquet(path)
        got = mix.digest(docs).groupBy("source").agg(F.count("*").alias("n"), F.sum("copy").alias("c"), F.max("rate").alias("r")).collect()
        sql = mix.ORACLE.replace("documents", f"'{path}/*.parquet'")
        want = duckdb.sql(f"SELECT source, count(*) AS n, sum(copy) AS c, max(rate) AS r FROM ({sql}) GROUP BY source").fetchall()
        assert {(r.source, r.n, r.c, r.r) for r in got} == {(a, b, int(c), d) for a, b, c, d in want}
        assert max(r.r for r in got) > (700 if big == 600_000 else 130)
