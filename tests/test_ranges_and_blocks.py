"""Ranks, quantiles, dominance and the linear frontier at sizes where a shortcut would show."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import tremorscope as ts
from tremorscope.functions.stats import PAIRWISE, quantiles_by, ranked
from tremorscope.operators.frontier import undominated


def test_ranks_don_t_grow_the_plan(spark):
    values = spark.range(20_000).select(F.col("id").alias("case_id"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("double").alias("x"))
    small, large = (ranked(values, "x", "case_id", rows=r)._jdf.queryExecution().analyzed().toString() for r in (20_000, 500))
    assert abs(len(small) - len(large)) < 10
    got = {r.case_id: r["rank"] for r in ranked(values, "x", "case_id", rows=500).collect()}
    x = {r.case_id: r.x for r in values.collect()}
    assert [got[i] for i in sorted(x, key=lambda i: (x[i], i))] == list(range(20_000))


def test_quantiles_of_common_values_are_counted_by_value(spark):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(60_000) < 0.9, 3.25, rng.normal(3, 1, 60_000).round(1))
    rows = spark.createDataFrame([(0, float(v)) for v in values], "g int, v double").repartition(6)
    got = quantiles_by(rows, "g", "v", {"a": 0.02, "b": 0.5, "c": 0.97})
    assert list(got.first())[1:] == pytest.approx(np.percentile(values, [2, 50, 97]).tolist(), abs=1e-12)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    widest = rows.groupBy("g", "v").count().count()
    assert widest < 200  # so many rows at most meet in the last step, of 60000


def plain_front(least):
    """Of the least instability by score, those under all of higher scores."""
    best, out = float("inf"), set()
    for score in sorted(least, reverse=True):
        if least[score] < best:
            out.add((score, least[score]))
            best = least[score]
    return out


@pytest.mark.parametrize("shape", ["cloud", "all on the front", "ties"])
def test_a_million_points(spark, shape):
    n = 1_000_000
    base = spark.range(n).repartition(8).select("id", (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007.0).alias("u"), (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(9_973)) / 9_973.0).alias("v"))
    columns = {"cloud": ("u", "v"), "all on the front": (F.col("id") / float(n), F.col("id") / float(n)), "ties": (F.floor(F.col("u") * 5) / 5, F.floor(F.col("v") * 5) / 5 + F.floor(F.col("u") * 5) / 10)}[shape]
    points = base.select(F.col("id").alias("config_id"), *[(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(columns, ("score", "instability"), strict=True)])
    began = time.perf_counter()
    found = undominated(points)
    front = found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = plain_front({r.score: r.least for r in points.groupBy("score").agg(F.min("instability").alias("least")).collect()})
    pairs = {(r.score, r.instability) for r in found.select("score", "instability").distinct().collect()}
    assert pairs == want and front >= len(want)
    assert shape != "all on the front" or front == n
    assert time.perf_counter() - began < 90


def test_small_fronts_with_gaps(spark):
    nan = float("nan")
    rows = [(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 0.5, 2.0), (3, 2.0, 3.0), (4, 2.0, 4.0), (5, nan, 0.0), (6, 9.0, nan), (7, None, 0.0), (8, 0.0, float("inf")), (9, -0.0, 0.5), (10, 0.0, 0.5)]
    points = spark.createDataFrame(rows, "config_id int, score double, instability double")
    assert sorted(r.config_id for r in undominated(points, rows=2).collect()) == [0, 1, 3, 5, 6, 7, 9, 10]
    assert undominated(points.limit(0)).count() == 0 and undominated(points.where("config_id = 8")).count() == 1


def test_linear_frontier_of_fifty_columns(spark):
    rng = np.random.default_rng(2)
    n, p, sigma = 150, 50, 2.0
    x = rng.normal(size=(n, p)) @ np.diag(np.linspace(0.3, 3, p)) + rng.normal(size=(n, 1))
    y = x @ rng.normal(size=p) + sigma * rng.normal(size=n)
    names = [f"f{i}" for i in range(p)]
    design = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], ", ".join(f"{c} double" for c in [*names, "y"])).repartition(3)
    ts.linear_frontier(design.select("f0", "y"), ["f0"], "y", n_points=3).collect()  # workers started
    began = time.perf_counter()
    rows = ts.linear_frontier(design, names, "y", n_points=50, signal="per_direction").collect()
    assert time.perf_counter() - began < 15
    u, d, vt = np.linalg.svd(x, full_matrices=False)
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    noise = np.sum((y - x @ coef) ** 2) / (n - p)
    energy = d**2 * np.maximum((vt @ coef) ** 2 - noise / d**2, 0)
    assert len(rows) == 51
    for r in rows:
        kept = energy / (energy + r.mu * noise) if r.mu else (energy > 0).astype(float)
        assert r.bias2 == pytest.approx(np.sum((1 - kept) ** 2 * energy) / n) and r.variance == pytest.approx(noise * np.sum(kept**2) / n)
        assert r.s1 == pytest.approx(PAIRWISE * np.sqrt(noise) * np.mean(np.sqrt((u * kept) ** 2 @ np.ones(p))))
    assert [r.mu for r in rows[:-1]] == sorted(r.mu for r in rows[:-1])


def test_frontier_of_embeddings_as_by_numpy(spark):
    """The registered query on its whole table."""
    from tremorscope.plans import catalog

    folder = "/root/testdata/sf0.001"
    x = np.array([r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("embedding").where("embedding is not null").collect()], dtype=float)
    x = x[np.isfinite(x).all(axis=1)]
    y, x = x[:, 0], x[:, 1:]
    u, d, vt = np.linalg.svd(x, full_matrices=False)
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    noise = np.sum((y - x @ coef) ** 2) / (len(x) - x.shape[1])
    energy = d**2 * max(np.mean((vt @ coef) ** 2 - noise / d**2), 0)
    rows = catalog.QUERIES["linear_frontier_embeddings"](spark, folder).collect()
    assert len(rows) == 51
    for r in rows:
        kept = energy / (energy + r.mu * noise) if r.mu else (energy > 0).astype(float)
        assert r.risk == pytest.approx((np.sum((1 - kept) ** 2 * energy) + noise * np.sum(kept**2)) / len(x), abs=2e-8)
        assert r.s1 == pytest.approx(PAIRWISE * np.sqrt(noise) * np.mean(np.sqrt(np.sum((u * kept) ** 2, axis=1))), abs=2e-8)
