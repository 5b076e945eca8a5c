"""Choosing, among refits, the one nearest to what they predict on average."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import score_by
from ..sources.shared import dropped, stored
from ..sources.tables import checked, require_columns, require_scalar
from . import audit as audits
from .audit import Audit, aligned, columns_of, demand, no_shared_ids
from .procedures import SparkMl
from .sampling import holdout_split, numbered, resampled

REGRESSION, CLASSIFICATION = ("auto", "rmse", "mae", "correlation"), ("auto", "disagreement", "probability_mse")


def numeric_centroid(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("case_id").agg(F.avg("pred").alias("centre"))


def probability_centroid(probabilities: DataFrame) -> DataFrame:
    return probabilities.groupBy("case_id", "class").agg(F.avg("p").alias("centre"))


def label_centroid(predictions: DataFrame) -> DataFrame:
    """Each case's most frequent label, ties to the smallest."""
    counts = predictions.groupBy("case_id", "pred").agg(F.count("*").alias("n"))
    return counts.groupBy("case_id").agg(F.min_by("pred", F.struct(-F.col("n"), "pred")).alias("centre"))


def centroid(table: DataFrame, metric: str) -> DataFrame:
    return {"probability_mse": probability_centroid, "disagreement": label_centroid}.get(metric, numeric_centroid)(table)


def proximity_scores(table: DataFrame, metric: str, centre: DataFrame | None = None) -> DataFrame:
    """(draw, score): each candidate's distance to the centroid, in one aggregation by candidate.

    A candidate or centroid without variation has correlation distance 0 if the
    two are close throughout, else infinity.
    """
    centre = centroid(table, metric) if centre is None else centre
    joined = table.join(centre, ["case_id", "class"] if metric == "probability_mse" else "case_id")
    c = F.col("centre")
    if metric == "probability_mse":
        score = F.avg(F.pow(F.col("p") - c, F.lit(2)))
    elif metric == "disagreement":
        score = F.avg(F.when(F.col("pred") != c, 1.0).otherwise(0.0))
    elif metric == "rmse":
        score = F.sqrt(F.avg(F.pow(F.col("pred") - c, F.lit(2))))
    elif metric == "mae":
        score = F.avg(F.abs(F.col("pred") - c))
    elif metric == "correlation":
        flat = (F.min("pred") == F.max("pred")) | (F.min("centre") == F.max("centre"))
        close = F.max(F.abs(F.col("pred") - c) - (1e-8 + 1e-5 * F.abs(c))) <= 0
        product = F.sqrt(F.var_pop("pred") * F.var_pop("centre"))
        score = F.when(flat, F.when(close, 0.0).otherwise(float("inf"))).otherwise(1 - F.try_divide(F.covar_pop("pred", "centre"), product))
    else:
        raise ValueError(f"unknown proximity_metric {metric!r}")
    return joined.groupBy("draw").agg(score.alias("score"))


def audit_scores(audit: Audit, metric: str) -> DataFrame:
    """``proximity_scores`` of an audit's draws.

    A draw's summed squared distance to all draws is their number times that
    to the centroid, and the squares about the centroid besides. So where case
    ids are the cases' own, probability_mse follows from the audit's sums: no
    grid of classes is made and no prediction moves.
    """
    if metric != "probability_mse" or audit.kind != "vector" or not audit.own_ids:
        return proximity_scores(audit.predictions, metric)
    b = audit.n_bootstrap
    score = (F.col("r") - (b - 1) * F.col("instability_mean")) / (b * audit.n_classes)
    return audit.draw_rows.select("draw", F.greatest(F.lit(0.0), score).alias("score"))


def label_centre(cells: str):
    """The most frequent label of an array of (draw, pred), ties to the smallest."""
    names = F.transform(cells, lambda x: x["pred"])
    counted = F.transform(F.array_distinct(names), lambda p: F.struct((-F.size(F.filter(names, lambda q: q == p))).alias("n"), p.alias("pred")))
    return F.array_min(counted)["pred"]


def cell_disagreement(cells: DataFrame) -> DataFrame:
    """``proximity_scores`` of labels from (case_id, cells), a row a case: tasks send sums by draw only."""
    each = cells.select(label_centre("cells").alias("centre"), "cells").select("centre", F.explode("cells").alias("e"))
    return each.groupBy(F.col("e.draw").alias("draw")).agg(F.avg(F.when(F.col("e.pred") != F.col("centre"), 1.0).otherwise(0.0)).alias("score"))


def nearest(scores: DataFrame) -> DataFrame:
    """One row: the candidate of least score, the first among equals."""
    return scores.agg(F.min_by("draw", F.struct("score", "draw")).alias("draw"), F.min("score").alias("score"))


def medoid_distances(predictions: DataFrame) -> DataFrame:
    """(draw, score): mean squared distance to all candidates, which ranks them like the squared distance to the mean.

    Sums by case give it without forming pairs: the distance to all is
    n z^2 + sum z^2 - 2 z sum z.
    """
    sums = predictions.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("pred").alias("s1"), F.sum(F.pow("pred", F.lit(2))).alias("s2"))
    p = F.col("pred")
    return predictions.join(sums, "case_id").groupBy("draw").agg(F.avg((F.col("n") * p * p + F.col("s2") - 2 * p * F.col("s1")) / F.col("n")).alias("score"))


class RepresentativeEstimator:
    """Fits a pool of candidates and keeps the one nearest the pool's centroid on held-out rows.

    After ``fit``: selected_index_ (from 0), candidate_scores_,
    candidate_performance_scores_, ensemble_predictions_,
    validation_predictions_, validation_probabilities_, proximity_metric_,
    n_validation_samples_, classes_, and the fitted table of all candidates in
    model_. Tables are DataFrames by draw, which counts candidates from 1.
    Without a procedure the candidates are pyspark.ml decision trees on all
    columns but key and target. The split, the candidates' scores and the
    validation tables that give them are written once; ``release`` drops them and
    what fit keeps in memory. Probabilities that the metric doesn't ask for are
    made when they are read. Of MANY_CASES held-out rows and more whose ids are their
    own, labels of procedures with ``label_cells`` stay by row, are scored where
    they are, and predictions too are made when they are read.
    """

    def __init__(self, procedure=None, task: str = "classification", n_candidates: int = 20, proximity_metric: str = "auto", validation_fraction: float = 0.2, bootstrap_candidates: bool = True, seed: int = 0):
        self.procedure, self.task, self.n_candidates = procedure, task, n_candidates
        self.proximity_metric, self.validation_fraction = proximity_metric, validation_fraction
        self.bootstrap_candidates, self.seed = bootstrap_candidates, seed

    def _check(self) -> None:
        count, share = self.n_candidates, self.validation_fraction
        demand(
            (self.task in ("classification", "regression"), f"no such task: {self.task!r}"),
            (isinstance(count, int) and not isinstance(count, bool) and count > 0, f"no number of candidates: {count!r}"),
            (isinstance(share, float) and 0 < share < 1, f"no share to validate on: {share!r}"),
            (self.proximity_metric in (REGRESSION if self.task == "regression" else CLASSIFICATION), f"no proximity metric of {self.task}: {self.proximity_metric!r}"),
            (isinstance(self.bootstrap_candidates, bool), f"bootstrap_candidates is True or False, not {self.bootstrap_candidates!r}"),
        )

    def _metric(self, has_probabilities: bool) -> str:
        if self.proximity_metric == "probability_mse" and not has_probabilities:
            raise ValueError("probability_mse needs probabilities from every candidate")
        if self.proximity_metric != "auto":
            return self.proximity_metric
        return "rmse" if self.task == "regression" else "probability_mse" if has_probabilities else "disagreement"

    def fit(self, data: DataFrame, key: str = "rid", target: str = "y") -> RepresentativeEstimator:
        self._check()
        self.procedure_, self._rows = self.procedure, None
        require_columns(data, key, target)
        require_scalar(data, target)
        labels = self.task == "classification"
        finite = list(getattr(self.procedure, "finite", ()))
        checked(data, "rows", [*([] if labels else [target]), *finite], [key, target])
        data = data.withColumn("y", F.col(target).cast("string" if labels else "double"))
        self.features_ = [c for c in data.columns if c not in (key, target, "y")]
        if labels:
            self.classes_ = sorted(r.y for r in data.select("y").distinct().limit(10_001).collect())
            if not 2 <= len(self.classes_) <= 10_000:
                raise ValueError("a classification target needs 2 to 10000 classes")
        split = self._split = holdout_split(data, key, self.validation_fraction, f"{self.seed}|split", "y" if labels else None)
        train, cases = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test").withColumnRenamed(key, "case_id")
        weighted = self._weighted(train, key, labels)
        if self.procedure is None:
            self.procedure_ = self._default_tree()
        self.model_ = self.procedure_.fit(weighted)
        self.model_ = self.model_.where("draw > 0").persist() if isinstance(self.model_, DataFrame) else {k: v for k, v in self.model_.items() if k}
        truth = cases.select("case_id", "y")
        self.n_validation_samples_ = cases.count()
        has = labels and self._gives_probabilities()
        self.proximity_metric_ = self._metric(has)
        own = self.proximity_metric_ == "disagreement" and hasattr(self.procedure_, "label_cells") and self.n_validation_samples_ >= audits.MANY_CASES and no_shared_ids(cases)
        predictions = self.procedure_.predict(self.model_, cases)
        self.validation_predictions_ = predictions if own else stored(predictions, "selector-predictions")
        spark = data.sparkSession
        self.validation_probabilities_ = None
        if has:
            draws = spark.range(1, self.n_candidates + 1).select(F.col("id").cast("int").alias("draw"))
            classes = spark.createDataFrame([(c,) for c in self.classes_], "class string")
            table = aligned(self.procedure_.predict_proba(self.model_, cases), draws, cases, classes)
            self.validation_probabilities_ = stored(table, "selector-probabilities") if self.proximity_metric_ == "probability_mse" else table
        table = self.validation_probabilities_ if self.proximity_metric_ == "probability_mse" else self.validation_predictions_
        self.candidate_performance_scores_ = score_by(self.validation_predictions_.join(truth, "case_id"), ["draw"], "categorical" if labels else "continuous")
        if own:
            cells = self.procedure_.label_cells(self.model_, cases)
            self.ensemble_predictions_, scores = cells.select("case_id", label_centre("cells").alias("centre")), cell_disagreement(cells)
        else:
            self.ensemble_predictions_ = centroid(table, self.proximity_metric_)
            scores = proximity_scores(table, self.proximity_metric_, self.ensemble_predictions_)
        self.candidate_scores_ = stored(scores, "selector-scores")
        self.selected_index_ = int(nearest(self.candidate_scores_).first().draw) - 1
        return self

    def _weighted(self, train: DataFrame, key: str, labels: bool) -> DataFrame:
        spark, draws = train.sparkSession, spark_draws(train.sparkSession, self.n_candidates)
        if not self.bootstrap_candidates:
            return train.crossJoin(F.broadcast(draws)).withColumn("w", F.lit(1).cast("long"))
        rows = self._rows = numbered(train, key, f"{self.seed}|rows", "y" if labels else None)
        if columns := columns_of([self.procedure]):
            rows = rows.select(*dict.fromkeys(["idx", "y", *columns]))
        draws = range(1, self.n_candidates + 1)
        if not labels:
            return resampled(rows, {None: rows.count()}, draws, self.seed)
        sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
        return resampled(rows, sizes, draws, self.seed, "y")

    def _gives_probabilities(self) -> bool:
        """Whether every candidate gives probabilities: the fitted ones are asked where the procedure can tell."""
        ask = getattr(self.procedure_, "gives_probabilities", None)
        return hasattr(self.procedure_, "predict_proba") and (ask is None or ask(self.model_))

    def _default_tree(self) -> SparkMl:
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.regression import DecisionTreeRegressor

        return SparkMl(DecisionTreeClassifier() if self.task == "classification" else DecisionTreeRegressor(), self.features_, self.seed)

    def get_selected_estimator(self):
        """The selected candidate's fitted rows."""
        draw = self.selected_index_ + 1
        return self.model_.where(F.col("draw") == draw) if isinstance(self.model_, DataFrame) else {draw: self.model_[draw]}

    def release(self) -> None:
        if isinstance(self.model_, DataFrame):
            self.model_.unpersist()
        for table in (self._split, self._rows, self.validation_predictions_, self.validation_probabilities_, self.candidate_scores_):
            if table is not None:
                dropped(table)

    def _ready(self, cases: DataFrame) -> None:
        if not hasattr(self, "model_"):
            raise ValueError("fit comes first")
        require_columns(cases, "case_id", *self.features_)

    def predict(self, cases: DataFrame) -> DataFrame:
        self._ready(cases)
        return self.procedure_.predict(self.get_selected_estimator(), cases).drop("draw")

    def predict_proba(self, cases: DataFrame) -> DataFrame:
        self._ready(cases)
        if not self._gives_probabilities():
            raise AttributeError("the candidates give no probabilities")
        spark = cases.sparkSession
        classes = spark.createDataFrame([(c,) for c in self.classes_], "class string")
        one = spark.createDataFrame([(self.selected_index_ + 1,)], "draw int")
        return aligned(self.procedure_.predict_proba(self.get_selected_estimator(), cases), one, cases, classes).drop("draw")

    def score(self, cases: DataFrame, target: str = "y", weight: str | None = None) -> float:
        truth = cases.select("case_id", F.col(target).cast("string" if self.task == "classification" else "double").alias("y"), *([weight] if weight else []))
        return score_by(self.predict(cases).join(truth, "case_id"), [], "categorical" if self.task == "classification" else "continuous", weight).first().score


def spark_draws(spark, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("draw"))
