"""The registered queries once more, as SQL that shares nothing with the DataFrame code but its definitions."""

from __future__ import annotations

from ..functions.stats import CENTERED_MAD, PAIRWISE

SEED, DRAWS, TEST = 7, 8, 0.3
PENALTIES, STRENGTHS = (0.0, 1000.0, 10000.0, 100000.0, 1000000.0), (0.0, 50.0, 500.0)
LABEL_COLUMNS = ("g", "z")
THRESHOLDS = {"x": (0.0, 2.0, 4.0, 6.0, 8.0), "z": (2.0, 4.0, 6.0, 8.0)}
BUCKET = "greatest(1, least(2000, (count(*) + 63) // 64))"
NUMBER = "('0x' || substr(md5({0}), 1, 13))::BIGINT"

CASES = "cases AS (SELECT o_orderkey AS rid, o_totalprice / 1000 AS y, c_acctbal / 1000 AS x, (o_custkey % 97)::DOUBLE / 10.0::DOUBLE AS z, o_orderpriority AS g, o_orderstatus AS label FROM orders JOIN customer ON o_custkey = c_custkey)"

LINES = """cases AS (SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag)) AS rid,
  l_extendedprice / 1000 AS y, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS z, l_tax::DOUBLE AS g, l_returnflag AS label FROM lineitem)"""


def _split(strata: str = "") -> str:
    part = f"PARTITION BY {strata} " if strata else ""
    return f"split AS (SELECT *, row_number() OVER ({part}ORDER BY md5('{SEED}|split|' || rid), rid) <= ceil(count(*) OVER ({part}) * {TEST}::DOUBLE) AS is_test FROM cases)"


def _sides(target: str) -> str:
    keep = "rid, y, x, z, g, label" if target == "y" else "rid, label AS y, x, z, g"
    return f"""held AS (SELECT rid AS case_id, {keep.split(', ', 1)[1]} FROM split WHERE is_test),
train AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|rows|' || rid), rid) - 1 AS idx FROM (SELECT {keep} FROM split WHERE NOT is_test)),
buckets AS (
  SELECT draw::INT AS draw, n, m, {NUMBER.format(f"'{SEED}|' || draw || '|' || slot")} % n // m AS bucket, count(*) AS c
  FROM (SELECT count(*) AS n, {BUCKET} AS m FROM train), unnest(generate_series(1, {DRAWS})) AS d(draw), unnest(generate_series(0, n - 1)) AS s(slot) GROUP BY ALL
), weights AS (
  SELECT draw, bucket * m + {NUMBER.format(f"'{SEED}|' || draw || '|' || bucket || '|' || j")} % least(m, n - bucket * m) AS idx, count(*) AS w
  FROM buckets, unnest(generate_series(0, c - 1)) AS t(j) GROUP BY ALL
), weighted AS (SELECT 0 AS draw, 1 AS w, train.* FROM train UNION ALL SELECT draw, w, train.* FROM weights JOIN train USING (idx))"""


NUMERIC = f"{CASES}, {_split()}, {_sides('y')}"
LINE_SIDES = f"{LINES}, {_split()}, {_sides('y')}"
LABELS = f"{CASES}, {_split('label')}, {_sides('label')}"


def _ols(name: str = "ols", penalty: float = 0.0) -> str:
    return f"""{name}_means AS (SELECT draw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM weighted GROUP BY draw),
{name}_model AS (SELECT draw, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (y - my)) / (sum(w * (x - mx) * (x - mx)) + {penalty}::DOUBLE) AS slope FROM weighted JOIN {name}_means USING (draw) GROUP BY draw),
{name} AS (SELECT draw, case_id, my + slope * (x - mx) AS pred FROM {name}_model, held)"""


#: Least squares on x, z and g, by the cofactors of the centred products.
OLS_THREE = """ols_means AS (SELECT draw, sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * g) / sum(w) AS mg, sum(w * y) / sum(w) AS my FROM weighted GROUP BY draw),
ols_centred AS (SELECT draw, w, x - mx AS x, z - mz AS z, g - mg AS g, y - my AS y FROM weighted JOIN ols_means USING (draw)),
ols_products AS (SELECT draw, sum(w * x * x) AS xx, sum(w * x * z) AS xz, sum(w * x * g) AS xg, sum(w * z * z) AS zz, sum(w * z * g) AS zg, sum(w * g * g) AS gg, sum(w * x * y) AS xy, sum(w * z * y) AS zy, sum(w * g * y) AS gy FROM ols_centred GROUP BY draw),
ols_model AS (SELECT draw, xx * (zz * gg - zg * zg) - xz * (xz * gg - zg * xg) + xg * (xz * zg - zz * xg) AS det,
  ((zz * gg - zg * zg) * xy + (xg * zg - xz * gg) * zy + (xz * zg - xg * zz) * gy) / det AS bx,
  ((xg * zg - xz * gg) * xy + (xx * gg - xg * xg) * zy + (xz * xg - xx * zg) * gy) / det AS bz,
  ((xz * zg - xg * zz) * xy + (xz * xg - xx * zg) * zy + (xx * zz - xz * xz) * gy) / det AS bg FROM ols_products),
ols AS (SELECT draw, case_id, my + bx * (x - mx) + bz * (z - mz) + bg * (g - mg) AS pred FROM ols_model JOIN ols_means USING (draw), held)"""


def _group_mean(name: str = "gm", strength: float = 0.0) -> str:
    return f"""{name}_groups AS (SELECT draw, g, sum(w)::DOUBLE AS n, sum(w * y) AS s FROM weighted GROUP BY draw, g),
{name}_model AS (SELECT draw, g, sum(s) OVER (PARTITION BY draw) / sum(n) OVER (PARTITION BY draw) AS overall, (s + {strength}::DOUBLE * overall) / (n + {strength}::DOUBLE) AS value FROM {name}_groups),
{name} AS (SELECT m.draw, case_id, value AS pred FROM held JOIN {name}_model m USING (g))"""


SHARES = """shares AS (SELECT draw, g, y AS class, sum(w) / sum(sum(w)) OVER (PARTITION BY draw, g) AS p FROM weighted GROUP BY draw, g, y),
labels_model AS (SELECT draw, g, class AS pred FROM shares QUALIFY row_number() OVER (PARTITION BY draw, g ORDER BY p DESC, class) = 1),
preds AS (SELECT draw, case_id, pred FROM held JOIN labels_model USING (g)),
grid AS (SELECT d.draw, held.case_id, c.class, held.g FROM held, (SELECT DISTINCT draw FROM weighted) d, (SELECT DISTINCT y AS class FROM train) c),
probs AS (SELECT grid.draw, case_id, grid.class, coalesce(p, 0.0) AS p FROM grid LEFT JOIN shares ON shares.draw = grid.draw AND shares.g = grid.g AND shares.class = grid.class)"""


def _numeric_stats(preds: str) -> str:
    return f"moved AS (SELECT p.draw, p.case_id, p.pred, o.pred AS pred0 FROM {preds} p JOIN {preds} o ON o.draw = 0 AND o.case_id = p.case_id WHERE p.draw > 0), stats AS (SELECT case_id, var_samp(pred) AS per_point, 2 * var_samp(pred) AS pairwise, avg(abs(pred - pred0)) AS mape, avg(pred0) AS pred0 FROM moved GROUP BY case_id), by_draw AS (SELECT draw, avg(abs(pred - pred0)) AS m FROM moved GROUP BY draw)"


LABEL_STATS = """moved AS (SELECT p.draw, p.case_id, p.pred, o.pred AS pred0 FROM preds p JOIN preds o ON o.draw = 0 AND o.case_id = p.case_id WHERE p.draw > 0),
counts AS (SELECT case_id, pred, pred0, count(*) AS n FROM moved GROUP BY ALL),
stats AS (SELECT case_id, 1 - max(n) / sum(n) AS per_point, 1 - sum(n * (n - 1)) / (sum(n) * (sum(n) - 1)) AS pairwise, coalesce(sum(n) FILTER (WHERE pred <> pred0), 0) / sum(n) AS mape FROM counts GROUP BY case_id),
by_draw AS (SELECT draw, avg((pred <> pred0)::INT) AS m FROM moved GROUP BY draw)"""
VECTOR_STATS = """moved AS (SELECT p.draw, p.case_id, p.class, p.p, o.p AS p0 FROM probs p JOIN probs o ON o.draw = 0 AND o.case_id = p.case_id AND o.class = p.class WHERE p.draw > 0),
by_class AS (SELECT case_id, class, var_samp(p) AS v, avg(abs(p - p0)) AS m FROM moved GROUP BY ALL),
stats AS (SELECT case_id, sum(v) AS per_point, 2 * sum(v) AS pairwise, avg(m) AS mape FROM by_class GROUP BY case_id),
by_draw AS (SELECT draw, avg(abs(p - p0)) AS m FROM moved GROUP BY draw)"""
#: Distances between all pairs of draws, the long way round; leave-one-out means of them.
_LEAVE_OUT = """loo AS (SELECT d.draw, avg(dist) AS m FROM (SELECT DISTINCT a AS draw FROM dist UNION SELECT DISTINCT b FROM dist) d JOIN dist ON dist.a <> d.draw AND dist.b <> d.draw GROUP BY d.draw),
pair_se AS (SELECT sqrt((count(*) - 1) * var_pop(m)) AS standard_error FROM loo)"""
NUMERIC_PAIRS = f"dist AS (SELECT a.draw AS a, b.draw AS b, avg((a.pred - b.pred) * (a.pred - b.pred)) AS dist FROM moved a JOIN moved b ON a.case_id = b.case_id AND a.draw < b.draw GROUP BY ALL), {_LEAVE_OUT}"
LABEL_PAIRS = f"dist AS (SELECT a.draw AS a, b.draw AS b, avg((a.pred <> b.pred)::INT) AS dist FROM moved a JOIN moved b ON a.case_id = b.case_id AND a.draw < b.draw GROUP BY ALL), {_LEAVE_OUT}"
VECTOR_PAIRS = f"dist AS (SELECT a.draw AS a, b.draw AS b, sum((a.p - b.p) * (a.p - b.p)) / count(DISTINCT a.case_id) AS dist FROM moved a JOIN moved b ON a.case_id = b.case_id AND a.class = b.class AND a.draw < b.draw GROUP BY ALL), {_LEAVE_OUT}"
MAPE_SE = "(SELECT stddev_samp(m) / sqrt(count(*)) FROM by_draw)"


def _summary(places: int = 6, attempts: int = DRAWS) -> str:
    r = lambda x, name: f"round({x}, {places}) AS {name}"
    return f"SELECT {r('avg(per_point)', 'instability_mean')}, {r('quantile_cont(per_point, 0.9)', 'instability_p90')}, {r('max(per_point)', 'instability_max')}, {r('avg(mape)', 'mape')}, {r(MAPE_SE, 'mape_standard_error')}, {r('avg(pairwise)', 'pairwise_mean')}, {r('(SELECT standard_error FROM pair_se)', 'pairwise_standard_error')}, {DRAWS + 1}::BIGINT AS n_fit_attempts, {attempts}::BIGINT AS n_resample_attempts, {attempts - DRAWS}::BIGINT AS n_rejected_resamples FROM stats"


def _point(config: int, name: str, metric: str) -> str:
    """A frontier point of the predictions ``name``."""
    pairs = f"(SELECT sqrt((count(*) - 1) * var_pop(m)) FROM (SELECT d.draw, avg(dist) AS m FROM (SELECT DISTINCT draw FROM {name} WHERE draw > 0) d JOIN {name}_dist ON a <> d.draw AND b <> d.draw GROUP BY d.draw))"
    return f"""{name}_moved AS (SELECT p.draw, p.case_id, p.pred, o.pred AS pred0 FROM {name} p JOIN {name} o ON o.draw = 0 AND o.case_id = p.case_id WHERE p.draw > 0),
{name}_dist AS (SELECT a.draw AS a, b.draw AS b, avg((a.pred - b.pred) * (a.pred - b.pred)) AS dist FROM {name}_moved a JOIN {name}_moved b ON a.case_id = b.case_id AND a.draw < b.draw GROUP BY ALL),
{name}_draws AS (SELECT draw, avg(abs(pred - pred0)) AS m FROM {name}_moved GROUP BY draw),
{name}_point AS (SELECT *, {metric} AS instability, {metric}_standard_error AS instability_standard_error FROM (SELECT {config} AS config_id,
  (SELECT 1 - sum((y - pred) * (y - pred)) / sum((y - (SELECT avg(y) FROM held)) * (y - (SELECT avg(y) FROM held))) FROM {name} JOIN held USING (case_id) WHERE draw = 0) AS score,
  (SELECT avg(v) FROM (SELECT 2 * var_samp(pred) AS v FROM {name}_moved GROUP BY case_id)) AS pairwise, {pairs} AS pairwise_standard_error,
  (SELECT avg(m) FROM {name}_draws) AS mape, (SELECT stddev_samp(m) / sqrt(count(*)) FROM {name}_draws) AS mape_standard_error))"""


def _points(metric: str = "pairwise", means: bool = False) -> str:
    parts, names = [], []
    for i, penalty in enumerate(PENALTIES):
        names.append(f"r{i}")
        parts += [_ols(f"r{i}", penalty), _point(i, f"r{i}", metric)]
    for i, strength in enumerate(STRENGTHS if means else ()):
        names.append(f"g{i}")
        parts += [_group_mean(f"g{i}", strength), _point(len(PENALTIES) + i, f"g{i}", metric)]
    return ", ".join([NUMERIC, *parts, "points AS (" + " UNION ALL ".join(f"SELECT * FROM {n}_point" for n in names) + ")"])


def _label_points() -> str:
    """Frontier points of label shares by each of LABEL_COLUMNS."""
    parts, names = [], []
    for i, column in enumerate(LABEL_COLUMNS):
        n = f"c{i}"
        names.append(n)
        parts.append(f"""{n}_model AS (SELECT draw, {column} AS k, y AS pred FROM weighted GROUP BY draw, {column}, y QUALIFY row_number() OVER (PARTITION BY draw, {column} ORDER BY sum(w) DESC, y) = 1),
{n} AS (SELECT draw, case_id, held.y, pred FROM held JOIN {n}_model ON k = {column}),
{n}_moved AS (SELECT p.draw, p.case_id, p.pred, o.pred AS pred0 FROM {n} p JOIN {n} o ON o.draw = 0 AND o.case_id = p.case_id WHERE p.draw > 0),
{n}_dist AS (SELECT a.draw AS a, b.draw AS b, avg((a.pred <> b.pred)::INT) AS dist FROM {n}_moved a JOIN {n}_moved b ON a.case_id = b.case_id AND a.draw < b.draw GROUP BY ALL),
{n}_draws AS (SELECT draw, avg((pred <> pred0)::INT) AS m FROM {n}_moved GROUP BY draw),
{n}_point AS (SELECT *, pairwise AS instability, pairwise_standard_error AS instability_standard_error FROM (SELECT {i} AS config_id, (SELECT avg((pred = y)::INT) FROM {n} WHERE draw = 0) AS score, (SELECT avg(dist) FROM {n}_dist) AS pairwise,
  (SELECT sqrt((count(*) - 1) * var_pop(m)) FROM (SELECT d.draw, avg(dist) AS m FROM (SELECT DISTINCT draw FROM {n}_moved) d JOIN {n}_dist ON a <> d.draw AND b <> d.draw GROUP BY d.draw)) AS pairwise_standard_error,
  (SELECT avg(m) FROM {n}_draws) AS mape, (SELECT stddev_samp(m) / sqrt(count(*)) FROM {n}_draws) AS mape_standard_error))""")
    return ", ".join([LABELS, *parts, "points AS (" + " UNION ALL ".join(f"SELECT * FROM {n}_point" for n in names) + ")"])


def _front(metric: str = "instability") -> str:
    return f"front AS (SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.score >= p.score AND o.{metric} <= p.{metric} AND (o.score > p.score OR o.{metric} < p.{metric})) QUALIFY row_number() OVER (PARTITION BY round_even(score, 12), round_even({metric}, 12) ORDER BY score DESC, config_id) = 1)"


_POINT_COLUMNS = "config_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("score", "instability", "instability_standard_error", "pairwise", "pairwise_standard_error", "mape", "mape_standard_error"))


def _tree(depth: int) -> str:
    """Node tables of all draws, level by level."""
    options = " UNION ALL ".join(f"SELECT {f} AS feature, {t}::DOUBLE AS threshold" for f, name in enumerate(("x", "z")) for t in THRESHOLDS[name])
    out = [f"options AS ({options})", "rows0 AS (SELECT draw, w, y, x, z, 0 AS node FROM weighted)"]
    for level in range(depth + 1):
        rows = f"rows{level}"
        totals = f"totals{level} AS (SELECT draw, node, sum(w) AS n, sum(w * y) AS s FROM {rows} GROUP BY ALL)"
        if level == depth:
            out += [totals, f"nodes{level} AS (SELECT draw AS fit_id, node AS node_id, -1 AS l, -1 AS r, -1 AS feature, NULL::DOUBLE AS threshold, s / n AS value FROM totals{level})"]
            break
        out += [
            totals,
            f"""best{level} AS (SELECT r.draw, r.node, feature, threshold, sum(w) AS a, sum(w * y) AS b, round(b * b / a + (any_value(t.s) - b) * (any_value(t.s) - b) / (any_value(t.n) - a) - any_value(t.s) * any_value(t.s) / any_value(t.n), 9) AS gain
  FROM {rows} r JOIN totals{level} t ON t.draw = r.draw AND t.node = r.node, options WHERE CASE feature WHEN 0 THEN x ELSE z END <= threshold
  GROUP BY r.draw, r.node, feature, threshold HAVING a > 0 AND a < any_value(t.n) AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY r.draw, r.node ORDER BY gain DESC, feature, threshold) = 1)""",
            f"nodes{level} AS (SELECT t.draw AS fit_id, t.node AS node_id, CASE WHEN b.feature IS NULL THEN -1 ELSE 2 * t.node + 1 END AS l, CASE WHEN b.feature IS NULL THEN -1 ELSE 2 * t.node + 2 END AS r, coalesce(b.feature, -1) AS feature, b.threshold, t.s / t.n AS value FROM totals{level} t LEFT JOIN best{level} b ON b.draw = t.draw AND b.node = t.node)",
            f"rows{level + 1} AS (SELECT r.draw, w, y, x, z, CASE WHEN CASE feature WHEN 0 THEN x ELSE z END <= threshold THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node FROM {rows} r JOIN best{level} b ON b.draw = r.draw AND b.node = r.node)",
        ]
    return ", ".join([NUMERIC, *out, "nodes AS (" + " UNION ALL ".join(f"SELECT * FROM nodes{i}" for i in range(depth + 1)) + ")"])


TREES = _tree(2)
BAGS = "fits AS (SELECT DISTINCT fit_id FROM nodes), bags AS (SELECT fit_id, feature, count(*) AS n FROM nodes WHERE feature >= 0 GROUP BY ALL)"
PATHS = """go0 AS (SELECT fit_id, case_id, x, z, 0 AS node FROM held, (SELECT DISTINCT fit_id FROM nodes)),
go1 AS (SELECT g.*, n.feature AS f0, CASE WHEN n.feature < 0 THEN NULL WHEN CASE n.feature WHEN 0 THEN x ELSE z END <= n.threshold THEN n.l ELSE n.r END AS next FROM go0 g JOIN nodes n ON n.fit_id = g.fit_id AND n.node_id = g.node),
paths AS (SELECT g.fit_id, g.case_id, CASE WHEN f0 < 0 THEN '' WHEN coalesce(n.feature, -1) < 0 THEN f0::VARCHAR ELSE f0 || ',' || n.feature END AS path FROM go1 g LEFT JOIN nodes n ON n.fit_id = g.fit_id AND n.node_id = g.next)"""
GROUP_POOL = f"{NUMERIC}, {_group_mean()}, pool AS (SELECT draw, case_id, pred FROM gm WHERE draw > 0), centres AS (SELECT case_id, avg(pred) AS centre FROM pool GROUP BY case_id)"
POOL = f"{NUMERIC}, {_ols()}, pool AS (SELECT draw, case_id, pred FROM ols WHERE draw > 0), centres AS (SELECT case_id, avg(pred) AS centre FROM pool GROUP BY case_id)"
LABEL_POOL = f"{LABELS}, {SHARES}, pool AS (SELECT draw, case_id, pred FROM preds WHERE draw > 0), centres AS (SELECT case_id, pred AS centre FROM (SELECT case_id, pred, count(*) AS n FROM pool GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, pred) = 1)"
DESIGN = f"{CASES}, {_split()}, held AS (SELECT rid AS case_id, x FROM split WHERE is_test), design AS (SELECT x, y FROM split WHERE NOT is_test), g AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, n * sxx - sx * sx AS det FROM design)"
ONE = f"{DESIGN}, fitted AS (SELECT n, sxx, sqrt(sxx) AS d, sxy / sxx AS coef, (SELECT sqrt(sum((y - x * (SELECT sxy / sxx FROM g)) * (y - x * (SELECT sxy / sxx FROM g))) / (count(*) - 1)) FROM design) AS sigma FROM g), s AS (SELECT n, d, coef, sigma, sxx * greatest(coef * coef - sigma * sigma / sxx, 0) AS strength FROM fitted)"
_LINEAR = f"round(v, 8) AS variance, round(2 * v, 8) AS s2, round({PAIRWISE} * sqrt(v), 8) AS s1, round({CENTERED_MAD} * sqrt(v), 8) AS centered_mad"
SHOWN = f"{NUMERIC}, {_ols()}, {_numeric_stats('ols')}"
REGIONS = f"""small AS (SELECT r_regionkey AS rid, (r_regionkey = 0)::INT::VARCHAR AS y, (r_regionkey % 3)::VARCHAR AS k, row_number() OVER (ORDER BY md5('{SEED}|rows|' || r_regionkey), r_regionkey) - 1 AS idx FROM region),
tries AS (SELECT attempt, ('0x' || substr(md5('{SEED}|' || attempt || '|' || slot), 1, 13))::BIGINT % n AS idx, count(*) AS w
  FROM (SELECT count(*) AS n FROM region), unnest(generate_series(1, {DRAWS + 10})) AS d(attempt), unnest(generate_series(0, n - 1)) AS s(slot) GROUP BY ALL)"""


def _bins(k: int, name: str, source: str) -> str:
    """Equal-count bins of rows with x, numbered from 0; the first n mod k hold one row more, as ntile has them."""
    return f"{name} AS (SELECT *, ntile({k}) OVER (ORDER BY x, case_id) - 1 AS bin FROM {source})"


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


ORACLES = {
    "pairs_bootstrap_weights": _with(NUMERIC, "SELECT draw, idx, w FROM weights"),
    "stratified_bootstrap_weights": _with(
        CASES,
        f"""SELECT draw, stratum, bucket * m + {NUMBER.format(f"'{SEED}|' || draw || '|' || stratum || '|' || bucket || '|' || j")} % least(m, n - bucket * m) AS idx, count(*) AS w FROM (
          SELECT draw::INT AS draw, label AS stratum, n, m, {NUMBER.format(f"'{SEED}|' || draw || '|' || label || '|' || slot")} % n // m AS bucket, count(*) AS c
          FROM (SELECT label, count(*) AS n, {BUCKET} AS m FROM cases GROUP BY label), unnest(generate_series(1, {DRAWS})) AS d(draw), unnest(generate_series(0, n - 1)) AS s(slot) GROUP BY ALL
        ), unnest(generate_series(0, c - 1)) AS t(j) GROUP BY ALL""",
    ),
    "holdout_split": _with(f"{CASES}, {_split()}", "SELECT rid, is_test FROM split"),
    "stratified_holdout_split": _with(f"{CASES}, {_split('label')}", "SELECT rid, label, is_test FROM split"),
    "distinct_classes": _with(CASES, "SELECT DISTINCT label AS class FROM cases"),
    "original_fit_ols": _with(f"{NUMERIC}, {_ols()}", "SELECT case_id, round(pred, 6) AS pred0 FROM ols WHERE draw = 0"),
    "bootstrap_predictions_ols": _with(f"{NUMERIC}, {_ols()}", "SELECT draw, case_id, round(pred, 6) AS pred FROM ols WHERE draw > 0"),
    "case_variance": _with(SHOWN, "SELECT case_id, round(per_point, 6) AS per_point FROM stats"),
    "case_pairwise": _with(SHOWN, "SELECT case_id, round(pairwise, 6) AS pairwise FROM stats"),
    "case_mape": _with(SHOWN, "SELECT case_id, round(mape, 6) AS mape FROM stats"),
    "bootstrap_instability_ols": _with(f"{SHOWN}, {NUMERIC_PAIRS}", _summary()),
    "bootstrap_instability_constant": _with(f"{NUMERIC}, same AS (SELECT draw, case_id, 3.0::DOUBLE AS pred FROM held, (SELECT DISTINCT draw FROM weighted)), {_numeric_stats('same')}, {NUMERIC_PAIRS}", _summary()),
    "bootstrap_instability_group_mean": _with(f"{NUMERIC}, {_group_mean()}, {_numeric_stats('gm')}, {NUMERIC_PAIRS}", _summary()),
    "bootstrap_instability_labels": _with(f"{LABELS}, {SHARES}, {LABEL_STATS}, {LABEL_PAIRS}", _summary()),
    "bootstrap_instability_probabilities": _with(f"{LABELS}, {SHARES}, {VECTOR_STATS}, {VECTOR_PAIRS}", _summary(9)),
    "bootstrap_instability_lines": _with(f"{LINE_SIDES}, {OLS_THREE}, {_numeric_stats('ols')}, {NUMERIC_PAIRS}", _summary(8)),
    "bootstrap_instability_merged": _with(
        f"{LINE_SIDES}, steps AS (SELECT draw, floor(x / 10) AS step, sum(w * y) / sum(w) AS m FROM weighted GROUP BY ALL), overall AS (SELECT draw, sum(w * y) / sum(w) AS m FROM weighted GROUP BY draw), means AS (SELECT o.draw, case_id, coalesce(s.m, o.m) AS pred FROM held CROSS JOIN overall o LEFT JOIN steps s ON s.draw = o.draw AND s.step = floor(held.x / 10)), {_numeric_stats('means')}, {NUMERIC_PAIRS}",
        _summary(8),
    ),
    "mape_standard_error": _with(SHOWN, f"SELECT round({MAPE_SE}, 6) AS standard_error"),
    "pairwise_jackknife_numeric": _with(f"{SHOWN}, {NUMERIC_PAIRS}", "SELECT round(standard_error, 6) AS standard_error FROM pair_se"),
    "pairwise_jackknife_labels": _with(f"{LABELS}, {SHARES}, {LABEL_STATS}, {LABEL_PAIRS}", "SELECT round(standard_error, 6) AS standard_error FROM pair_se"),
    "pairwise_jackknife_vector": _with(f"{LABELS}, {SHARES}, {VECTOR_STATS}, {VECTOR_PAIRS}", "SELECT round(standard_error, 9) AS standard_error FROM pair_se"),
    "label_modal_disagreement": _with(f"{LABELS}, {SHARES}, {LABEL_STATS}", "SELECT case_id, round(per_point, 6) AS per_point FROM stats"),
    "label_pairwise": _with(f"{LABELS}, {SHARES}, {LABEL_STATS}", "SELECT case_id, round(pairwise, 6) AS pairwise FROM stats"),
    "label_mape": _with(f"{LABELS}, {SHARES}, {LABEL_STATS}", "SELECT case_id, round(mape, 6) AS mape FROM stats"),
    "vector_variance": _with(f"{LABELS}, {SHARES}, {VECTOR_STATS}", "SELECT case_id, round(per_point, 9) AS per_point FROM stats"),
    "vector_mape": _with(f"{LABELS}, {SHARES}, {VECTOR_STATS}", "SELECT case_id, round(mape, 9) AS mape FROM stats"),
    "one_class_rejections": _with(REGIONS, "SELECT attempt::INT AS attempt, count(DISTINCT y) AS n_classes FROM tries JOIN small USING (idx) GROUP BY attempt"),
    "redraw_accounting": _with(REGIONS, f"SELECT row_number() OVER (ORDER BY attempt)::INT AS draw, attempt::INT AS attempt FROM (SELECT attempt FROM tries JOIN small USING (idx) GROUP BY attempt HAVING count(DISTINCT y) > 1) QUALIFY draw <= {DRAWS}"),
    "class_alignment": _with(
        REGIONS,
        f"SELECT d.attempt::INT AS draw, n_nationkey::BIGINT AS case_id, c.class, round(coalesce(p, 0.0), 6) AS p FROM (SELECT DISTINCT attempt FROM tries) d, nation, (SELECT DISTINCT k AS class FROM small) c LEFT JOIN (SELECT attempt, k AS class, sum(w) / sum(sum(w)) OVER (PARTITION BY attempt) AS p FROM tries JOIN small USING (idx) GROUP BY attempt, k) s ON s.attempt = d.attempt AND s.class = c.class",
    ),
    "param_grid": "SELECT row_number() OVER (ORDER BY r_name, c_mktsegment)::INT - 1 AS config_id, r_name AS region, c_mktsegment AS segment FROM region, (SELECT DISTINCT c_mktsegment FROM customer)",
    "frontier_points_labels": _with(_label_points(), f"SELECT {_POINT_COLUMNS} FROM points"),
    "frontier_points_ridge": _with(_points(), f"SELECT {_POINT_COLUMNS} FROM points"),
    "pareto_front": _with(f"{_points()}, {_front()}", f"SELECT {_POINT_COLUMNS} FROM front"),
    "pareto_front_mape": _with(f"{_points('mape')}, {_front()}", f"SELECT {_POINT_COLUMNS} FROM front"),
    "frontier_two_families": _with(f"{_points(means=True)}, {_front()}", f"SELECT {_POINT_COLUMNS} FROM front"),
    "constrained_choice": _with(_points(), f"SELECT {_POINT_COLUMNS} FROM points WHERE score >= (SELECT max(score) FROM points) - 0.02 ORDER BY instability, score DESC LIMIT 1"),
    "plot_frontier": _with(f"{_points()}, {_front('mape')}", "SELECT 'ridge' AS family, config_id, round(score, 6) AS score, round(mape, 6) AS value, config_id IN (SELECT config_id FROM front) AS is_frontier, 'penalty=' || CASE config_id " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PENALTIES)) + " END AS label FROM points"),
    "r2_score": _with(f"{NUMERIC}, {_ols()}, j AS (SELECT draw, pred, y, avg(y) OVER (PARTITION BY draw) AS m FROM ols JOIN held USING (case_id))", "SELECT draw, round(1 - sum((y - pred) * (y - pred)) / sum((y - m) * (y - m)), 6) AS score FROM j GROUP BY draw"),
    "weighted_r2": _with(f"{NUMERIC}, {_ols()}, j AS (SELECT draw, pred, y, z + 1 AS k, sum((z + 1) * y) OVER (PARTITION BY draw) / sum(z + 1) OVER (PARTITION BY draw) AS m FROM ols JOIN held USING (case_id))", "SELECT draw, round(1 - sum(k * (y - pred) * (y - pred)) / sum(k * (y - m) * (y - m)), 6) AS score FROM j GROUP BY draw"),
    "accuracy_score": _with(f"{LABELS}, {SHARES}", "SELECT draw, round(avg((pred = y)::INT), 6) AS score FROM preds JOIN held USING (case_id) GROUP BY draw"),
    "weighted_accuracy": _with(f"{LABELS}, {SHARES}", "SELECT draw, round(sum((z + 1) * (pred = y)::INT) / sum(z + 1), 6) AS score FROM preds JOIN held USING (case_id) GROUP BY draw"),
    "centroid_numeric": _with(POOL, "SELECT case_id, round(centre, 6) AS centre FROM centres"),
    "centroid_labels": _with(LABEL_POOL, "SELECT case_id, centre FROM centres"),
    "proximity_rmse": _with(POOL, "SELECT draw, round(sqrt(avg((pred - centre) * (pred - centre))), 6) AS score FROM pool JOIN centres USING (case_id) GROUP BY draw"),
    "proximity_mae": _with(POOL, "SELECT draw, round(avg(abs(pred - centre)), 6) AS score FROM pool JOIN centres USING (case_id) GROUP BY draw"),
    "proximity_correlation": _with(GROUP_POOL, "SELECT draw, round(1 - corr(pred, centre), 6) AS score FROM pool JOIN centres USING (case_id) GROUP BY draw"),
    "proximity_disagreement": _with(LABEL_POOL, "SELECT draw, round(avg((pred <> centre)::INT), 6) AS score FROM pool JOIN centres USING (case_id) GROUP BY draw"),
    "proximity_probability_mse": _with(f"{LABELS}, {SHARES}, c AS (SELECT case_id, class, avg(p) AS centre FROM probs WHERE draw > 0 GROUP BY ALL)", "SELECT draw, round(avg((p - centre) * (p - centre)), 9) AS score FROM probs JOIN c USING (case_id, class) WHERE draw > 0 GROUP BY draw"),
    "medoid_distances": _with(POOL, "SELECT a.draw, round(avg((a.pred - b.pred) * (a.pred - b.pred)), 6) AS score FROM pool a JOIN pool b USING (case_id) GROUP BY a.draw"),
    "representative_index": _with(POOL, "SELECT draw, round(score, 6) AS score FROM (SELECT draw, sqrt(avg((pred - centre) * (pred - centre))) AS score FROM pool JOIN centres USING (case_id) GROUP BY draw) ORDER BY score, draw LIMIT 1"),
    "stump_nodes": _with(_tree(1), "SELECT fit_id, node_id, l, r, feature, threshold, round(value, 6) AS value FROM nodes"),
    "tree_nodes": _with(TREES, "SELECT fit_id, node_id, l, r, feature, threshold, round(value, 6) AS value FROM nodes"),
    "split_features": _with(f"{TREES}, {BAGS}", "SELECT fit_id, feature, n FROM bags"),
    "explanation_instability": _with(
        f"""{TREES}, {BAGS}, both_bags AS (SELECT a.fit_id AS a, b.fit_id AS b, f.feature, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM fits a JOIN fits b ON a.fit_id < b.fit_id, (SELECT DISTINCT feature FROM bags) f
        LEFT JOIN bags x ON x.fit_id = a.fit_id AND x.feature = f.feature LEFT JOIN bags y ON y.fit_id = b.fit_id AND y.feature = f.feature),
        d AS (SELECT a, b, CASE WHEN sum(greatest(x, y)) = 0 THEN 0 ELSE 1 - sum(least(x, y)) / sum(greatest(x, y)) END AS d FROM both_bags GROUP BY a, b)""",
        "SELECT round(avg(d), 6) AS jaccard_mean, round(max(d), 6) AS jaccard_max, round((SELECT count(DISTINCT coalesce(s, '')) FROM fits LEFT JOIN (SELECT fit_id, string_agg(feature || ':' || n, ',' ORDER BY feature) AS s FROM bags GROUP BY fit_id) USING (fit_id)) / (SELECT count(*) FROM fits), 6) AS distinct_structures FROM d",
    ),
    "root_agreement": _with(TREES, "SELECT round(max(n) / sum(n), 6) AS root_agreement FROM (SELECT feature, count(*) AS n FROM nodes WHERE node_id = 0 GROUP BY feature)"),
    "feature_paths": _with(f"{TREES}, {PATHS}", "SELECT fit_id, case_id, path FROM paths"),
    "path_agreement": _with(f"{TREES}, {PATHS}", "SELECT round(avg(s), 6) AS path_agreement FROM (SELECT case_id, max(n) / sum(n) AS s FROM (SELECT case_id, path, count(*) AS n FROM paths GROUP BY ALL) GROUP BY case_id)"),
    "gram_matrix": _with(DESIGN, "SELECT 0 AS i, 0 AS j, round(n, 3) AS value FROM g UNION ALL SELECT 0, 1, round(sx, 3) FROM g UNION ALL SELECT 1, 1, round(sxx, 3) FROM g"),
    "linear_instability": _with(f"{DESIGN}, v AS (SELECT case_id, 4 * (sxx - 2 * x * sx + n * x * x) / det AS v FROM held, g)", f"SELECT case_id, {_LINEAR} FROM v"),
    "linear_instability_hc0": _with(
        f"{DESIGN}, fit AS (SELECT (n * sxy - sx * sy) / det AS b, (sy - b * sx) / n AS a FROM g), m AS (SELECT sum(e) AS m00, sum(e * x) AS m01, sum(e * x * x) AS m11 FROM (SELECT x, (y - a - b * x) * (y - a - b * x) AS e FROM design, fit)), k AS (SELECT case_id, (sxx - x * sx) / det AS p, (n * x - sx) / det AS q FROM held, g), v AS (SELECT case_id, p * p * m00 + 2 * p * q * m01 + q * q * m11 AS v FROM k, m)",
        f"SELECT case_id, {_LINEAR} FROM v",
    ),
    "shrinkage_coefficients": _with(ONE, "SELECT round(coef * strength / (strength + 5 * sigma * sigma), 6) AS coefficient FROM s"),
    "linear_frontier": _with(
        f"{ONE}, mus AS (SELECT 0::DOUBLE AS mu, false AS risk_optimal UNION ALL SELECT 100 * pow(10, -6 + 6 * i / 4::DOUBLE), false FROM unnest(generate_series(0, 4)) AS t(i) UNION ALL SELECT 1, true), f AS (SELECT mu, risk_optimal, CASE WHEN mu = 0 THEN (strength > 0)::INT ELSE strength / (strength + mu * sigma * sigma) END AS k, s.* FROM mus, s)",
        f"SELECT round(mu, 8) AS mu, risk_optimal, round((1 - k) * (1 - k) * strength / n, 6) AS bias2, round(sigma * sigma * k * k / n, 6) AS variance, round((1 - k) * (1 - k) * strength / n + sigma * sigma * k * k / n, 6) AS risk, round(2 * sigma * sigma * k * k / n, 6) AS s2, round({PAIRWISE} * sigma * k / d * (SELECT avg(abs(x)) FROM design), 6) AS s1, round(sigma, 6) AS sigma FROM f",
    ),
    "plot_scatter": _with(f"{SHOWN}, shown AS (SELECT case_id, pred0 FROM stats ORDER BY md5('0|' || case_id), case_id LIMIT 400)", "SELECT case_id, draw, round(shown.pred0, 6) AS x, round(pred, 6) AS y FROM moved JOIN shown USING (case_id)"),
    "plot_limits": _with(SHOWN, "SELECT round(least(min(pred), min(pred0)), 6) AS low, round(greatest(max(pred), max(pred0)), 6) AS high FROM moved"),
    "plot_band": _with(
        f"{NUMERIC}, {_ols()}, shown AS (SELECT case_id, pred AS x FROM ols WHERE draw = 0), {_bins(25, 'binned', 'shown')}",
        "SELECT bin::INT AS bin, round((SELECT avg(x) FROM binned c WHERE c.bin = b.bin), 6) AS centre, round(quantile_cont(pred, 0.05), 6) AS lower, round(quantile_cont(pred, 0.95), 6) AS upper FROM ols JOIN binned b USING (case_id) WHERE draw > 0 GROUP BY bin",
    ),
    "plot_mape_bins": _with(
        f"{SHOWN}, shown AS (SELECT s.case_id, o.pred AS x, s.mape FROM stats s JOIN ols o ON o.draw = 0 AND o.case_id = s.case_id), {_bins(20, 'binned', 'shown')}",
        "SELECT bin::INT AS bin, round(avg(x), 6) AS centre, round(avg(mape), 6) AS mean, round(quantile_cont(mape, 0.9), 6) AS p90 FROM binned GROUP BY bin",
    ),
    "feature_paths_preorder": _with(f"{TREES}, {PATHS}", "SELECT fit_id, case_id, path FROM paths"),
    "representative_estimator_fit": _with(
        f"{POOL}, scores AS (SELECT draw, sqrt(avg((pred - centre) * (pred - centre))) AS score FROM pool JOIN centres USING (case_id) GROUP BY draw)",
        "SELECT draw, round(score, 6) AS score, draw = (SELECT draw FROM scores ORDER BY score, draw LIMIT 1) AS selected FROM scores",
    ),
    "representative_estimator_labels": _with(
        f"""{CASES}, {_split('label')}, held AS (SELECT rid AS case_id, g FROM split WHERE is_test),
        train AS (SELECT label, g, row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}|rows|' || rid), rid) - 1 AS idx FROM split WHERE NOT is_test),
        buckets AS (SELECT draw::INT AS draw, label, n, m, {NUMBER.format(f"'{SEED}|' || draw || '|' || label || '|' || slot")} % n // m AS bucket, count(*) AS c
          FROM (SELECT label, count(*) AS n, {BUCKET} AS m FROM train GROUP BY label), unnest(generate_series(1, {DRAWS})) AS d(draw), unnest(generate_series(0, n - 1)) AS s(slot) GROUP BY ALL),
        drawn AS (SELECT draw, label, bucket * m + {NUMBER.format(f"'{SEED}|' || draw || '|' || label || '|' || bucket || '|' || j")} % least(m, n - bucket * m) AS idx, count(*) AS w FROM buckets, unnest(generate_series(0, c - 1)) AS t(j) GROUP BY ALL),
        model AS (SELECT draw, g, label AS pred FROM drawn JOIN train USING (label, idx) GROUP BY draw, g, label QUALIFY row_number() OVER (PARTITION BY draw, g ORDER BY sum(w) DESC, label) = 1),
        pool AS (SELECT draw, case_id, pred FROM held JOIN model USING (g)),
        centres AS (SELECT case_id, pred AS centre FROM (SELECT case_id, pred, count(*) AS n FROM pool GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, pred) = 1),
        scores AS (SELECT draw, avg((pred <> centre)::INT) AS score FROM pool JOIN centres USING (case_id) GROUP BY draw)""",
        "SELECT draw, round(score, 6) AS score, draw = (SELECT draw FROM scores ORDER BY score, draw LIMIT 1) AS selected FROM scores",
    ),
    "frontier_points_holdout": _with(_points(), f"SELECT {_POINT_COLUMNS} FROM points"),
    "linear_summary": _with(
        f"{DESIGN}, v AS (SELECT 4 * (sxx - 2 * x * sx + n * x * x) / det AS v FROM held, g)",
        f"SELECT round(avg(v), 8) AS variance_mean, round(avg({PAIRWISE} * sqrt(v)), 8) AS s1_mean, round(avg({CENTERED_MAD} * sqrt(v)), 8) AS centered_mad_mean FROM v",
    ),
    "shrinkage_two_columns": _with(
        f"""{DESIGN}, centred AS (SELECT x - (SELECT avg(x) FROM design) AS c, y FROM design), k AS (SELECT count(*)::DOUBLE AS n, sum(c * c) AS scc, sum(c * y) AS scy, sum(y) AS sy FROM centred),
        line AS (SELECT n, scc, sy / n AS a, scy / scc AS b, (SELECT sum((y - (SELECT sy / n FROM k) - (SELECT scy / scc FROM k) * c) * (y - (SELECT sy / n FROM k) - (SELECT scy / scc FROM k) * c)) FROM centred) / (n - 2) AS noise FROM k),
        directions AS (SELECT 0 AS i, a AS coef, n AS d2, noise, 1.0::DOUBLE AS beta FROM line UNION ALL SELECT 1, b, scc, noise, 2.0 FROM line), raw AS (SELECT *, coef * coef - noise / d2 AS r FROM directions),
        signals AS (SELECT 'pooled' AS signal, i, coef, d2, noise, greatest((SELECT avg(r) FROM raw), 0) AS theta FROM raw UNION ALL SELECT 'per_direction', i, coef, d2, noise, greatest(r, 0) FROM raw UNION ALL SELECT 'beta', i, coef, d2, noise, beta * beta FROM raw)""",
        "SELECT signal, i::INT AS i, round(coef * d2 * theta / (d2 * theta + 500 * noise), 6) AS coefficient FROM signals",
    ),
    "linear_frontier_two_columns": _with(
        f"""{DESIGN}, line AS (SELECT *, (n * sxy - sx * sy) / det AS b1, (sxx * sy - sx * sxy) / det AS b0, (n + sxx) / 2 AS mid, sqrt((n - sxx) * (n - sxx) / 4 + sx * sx) AS half FROM g),
        noise AS (SELECT sum((y - b0 - b1 * x) * (y - b0 - b1 * x)) / (any_value(n) - 2) AS s2 FROM design, line),
        ways AS (SELECT k, n, s2, l, p / sqrt(p * p + q * q) AS p, q / sqrt(p * p + q * q) AS q, (p * b0 + q * b1) / sqrt(p * p + q * q) AS coef FROM (SELECT 1 AS k, mid + half AS l, sx AS p, mid + half - n AS q, * FROM line UNION ALL SELECT 2, det / (mid + half), sx, det / (mid + half) - n, * FROM line), noise),
        signal AS (SELECT *, l * (SELECT greatest(avg(coef * coef - s2 / l), 0) FROM ways) AS energy FROM ways),
        mus AS (SELECT 0::DOUBLE AS mu, false AS risk_optimal UNION ALL SELECT 100 * pow(10, -6 + 6 * i / 4::DOUBLE), false FROM unnest(generate_series(0, 4)) AS t(i) UNION ALL SELECT 1, true),
        f AS (SELECT mu, risk_optimal, CASE WHEN mu = 0 THEN (energy > 0)::INT ELSE energy / (energy + mu * s2) END AS kept, signal.* FROM mus, signal),
        turned AS (SELECT mu, risk_optimal, sqrt(sum(kept * kept * (p + q * x) * (p + q * x) / l)) AS u FROM f, (SELECT row_number() OVER () AS row, x FROM design) GROUP BY mu, risk_optimal, row),
        lengths AS (SELECT mu, risk_optimal, avg(u) AS u FROM turned GROUP BY mu, risk_optimal),
        costs AS (SELECT mu, risk_optimal, sum((1 - kept) * (1 - kept) * energy / n) AS bias2, sum(kept * kept * s2 / n) AS variance, sqrt(any_value(s2)) AS sigma FROM f GROUP BY mu, risk_optimal)""",
        f"SELECT round(mu, 8) AS mu, risk_optimal, round(bias2, 6) AS bias2, round(variance, 6) AS variance, round(bias2 + variance, 6) AS risk, round(2 * variance, 6) AS s2, round({PAIRWISE} * sigma * u, 6) AS s1, round(sigma, 6) AS sigma FROM costs JOIN lengths USING (mu, risk_optimal)",
    ),
    "plot_mape_overall": _with(SHOWN, "SELECT round(avg(mape), 6) AS mean FROM stats"),
}
