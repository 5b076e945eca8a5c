"""The series behind the diagnostic plots, as tables; drawing them is left to any plotting library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import equal_bins, quantiles_by, ranked
from ..sources.tables import require_columns
from .frontier import undominated
from .sampling import display_sample


MOST_CLASSES = 10_000


def class_codes(classes: DataFrame) -> dict[str, int]:
    """Labels to axis positions, in sorted order; more than MOST_CLASSES raise ValueError."""
    found = sorted(r[0] for r in classes.select("class").limit(MOST_CLASSES + 1).collect())
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return {c: i for i, c in enumerate(found)}


def displayed(audit, class_label: str | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(original (case_id, x), predictions (draw, case_id, value), whether the axis is numeric).

    Probabilities show one class, which must be named and known; labels show
    their position; a label unknown to the original classes raises.
    """
    if audit.kind == "vector":
        codes = class_codes(audit.classes)
        if class_label not in codes:
            raise ValueError("class_label must name one of the classes")
        original = audit.original.where(F.col("class") == class_label).select("case_id", F.col("p0").alias("x"))
        return original, audit.predictions.where(F.col("class") == class_label).select("draw", "case_id", F.col("p").alias("value")), True
    if class_label is not None:
        raise ValueError("class_label is for probabilities only")
    if audit.kind == "label":
        codes = class_codes(audit.classes)
        lost = audit.predictions.where(~F.col("pred").isin(*codes)).limit(1).collect()
        if lost:
            raise ValueError(f"unknown label {lost[0]['pred']!r}")
        spot = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(float(v)))])
        return audit.original.select("case_id", spot[F.col("pred0")].alias("x")), audit.predictions.select("draw", "case_id", spot[F.col("pred")].alias("value")), False
    return audit.original.select("case_id", F.col("pred0").alias("x")), audit.predictions.select("draw", "case_id", F.col("pred").alias("value")), True


#: How faint a dot may be and how strong, and how many full dots' worth of ink a plot gets.
FAINTEST, STRONGEST, INK = 0.02, 0.35, 3000.0


def opacity(n_points: int) -> float:
    """How strong to draw each of so many dots, that the middle of the cloud keeps its shape."""
    return min(max(INK / max(n_points, 1), FAINTEST), STRONGEST)


def described(params):
    """A map of parameters as text, 'k=v, ...' by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def scatter(original: DataFrame, predictions: DataFrame, max_points: int = 400, seed: int = 0) -> DataFrame:
    """(case_id, draw, x, y): each refit's prediction over the original one, for at most ``max_points`` cases."""
    shown = display_sample(original, "case_id", max_points, seed)
    return predictions.join(F.broadcast(shown), "case_id").select("case_id", "draw", "x", F.col("value").alias("y"))


def band(original: DataFrame, predictions: DataFrame, n_bins: int = 25) -> DataFrame:
    """(bin, centre, lower, upper): 5th and 95th percentile of all predictions in bins of equally many cases, where there are more cases than bins."""
    n = original.count()
    if n <= n_bins:
        return original.sparkSession.createDataFrame([], "bin int, centre double, lower double, upper double")
    binned = ranked(original, "x", "case_id").select("case_id", "x", equal_bins(F.col("rank"), n, n_bins).alias("bin"))
    centres = binned.groupBy("bin").agg(F.avg("x").alias("centre"))
    edges = quantiles_by(predictions.join(binned, "case_id"), "bin", "value", {"lower": 0.05, "upper": 0.95})
    return centres.join(edges, "bin").select("bin", "centre", "lower", "upper")


def limits(original: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row (low, high) over both axes."""
    return original.select(F.col("x").alias("v")).union(predictions.select("value")).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def mape_bins(original: DataFrame, case_stats: DataFrame, n_bins: int = 20) -> DataFrame:
    """(bin, centre, mean, p90): the absolute move by size of prediction; a bin a value where there are few values, else bins of equally many cases."""
    if n_bins < 2:
        raise ValueError("n_bins must be 2 or more")
    joined = original.join(case_stats.select("case_id", "mape"), "case_id")
    values = [r.x for r in joined.select("x").distinct().orderBy("x").limit(n_bins + 1).collect()]
    if len(values) <= n_bins:
        spots = F.create_map(*[v for i, x in enumerate(values) for v in (F.lit(x), F.lit(i))]) if values else F.create_map().cast("map<double,int>")
        binned = joined.withColumn("bin", spots[F.col("x")])
    else:
        binned = ranked(joined, "x", "case_id").withColumn("bin", equal_bins(F.col("rank"), joined.count(), n_bins))
    means = binned.groupBy("bin").agg(F.avg("x").alias("centre"), F.avg("mape").alias("mean"))
    return means.join(quantiles_by(binned, "bin", "mape", {"p90": 0.9}), "bin").select("bin", "centre", "mean", "p90")


def plot_prediction_instability(audit, max_points: int = 400, seed: int = 0, with_band: bool = True, n_bins: int = 25, class_label: str | None = None) -> dict[str, DataFrame]:
    """The tables of the instability plot: scatter, limits, how to draw it (dot opacity, axis texts) and, on a numeric axis, the band."""
    original, predictions, numeric = displayed(audit, class_label)
    dots = min(max_points, audit.n_cases) * audit.n_bootstrap
    axis = axis_text(class_label, numeric)
    style = original.sparkSession.createDataFrame([(opacity(dots), f"{axis}, original fit", f"{axis}, refits")], "opacity double, x_label string, y_label string")
    out = {"scatter": scatter(original, predictions, max_points, seed), "limits": limits(original, predictions), "style": style}
    return out | ({"band": band(original, predictions, n_bins)} if with_band and numeric else {})


def axis_text(class_label: str | None, numeric: bool) -> str:
    return f"probability of {class_label}" if class_label is not None else "prediction" if numeric else "predicted label"


def plot_mape_by_prediction(audit, n_bins: int = 20, class_label: str | None = None) -> dict[str, DataFrame]:
    """The tables of the plot of moves over predictions: bins, the overall mean, and the axis texts."""
    original, _, numeric = displayed(audit, class_label)
    moved = "share of refits with another label" if audit.kind == "label" else "mean absolute move of refits"
    style = original.sparkSession.createDataFrame([(f"{axis_text(class_label, numeric)}, original fit", moved)], "x_label string, y_label string")
    return {"bins": mape_bins(original, audit.case_stats, n_bins), "style": style, "overall": audit.case_stats.agg(F.avg("mape").alias("mean"))}


def plot_stability_frontier(families: dict[str, DataFrame], metric: str = "instability") -> DataFrame:
    """All families' points by rising metric, with is_frontier found anew, within the family, for the metric shown, and their parameters as a label (null where there are none)."""
    if metric not in ("instability", "pairwise", "mape"):
        raise ValueError("metric must be 'instability', 'pairwise' or 'mape'")
    out = None
    for family, points in families.items():
        require_columns(points, "config_id", "score", metric)
        kept = undominated(points, metric).select("config_id", F.lit(True).alias("is_frontier"))
        part = points.join(kept, "config_id", "left").select(F.lit(family).alias("family"), "config_id", "score", F.col(metric).alias("value"), F.coalesce("is_frontier", F.lit(False)).alias("is_frontier"), (described("params") if "params" in points.columns else F.lit(None).cast("string")).alias("label"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("value", "family", "config_id")


def frontier_axes(metric: str = "instability", score_name: str = "r2") -> dict[str, str]:
    """The axis texts of ``plot_stability_frontier``: what moves, and the score, of which more is better."""
    names = {"instability": "instability", "pairwise": "pairwise instability", "mape": "mean absolute move"}
    scores = {"r2": "R2 of the original fit", "accuracy": "accuracy of the original fit"}
    if metric not in names or score_name not in scores:
        raise ValueError(f"no axis for {metric!r} and {score_name!r}")
    return {"x_label": f"{names[metric]} (less is steadier)", "y_label": scores[score_name]}
