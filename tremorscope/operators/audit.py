"""The prediction table of all refits, and what it says about instability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.stats import NAN, exact_quantile
from ..sources.shared import dropped, stored
from ..sources.tables import checked, require_columns, require_numeric, require_scalar
from . import batches
from .sampling import dealt, drawn_rows, first_usable, numbered

ONE_STEP_CASES = 1_000_000
#: Cases from which an audit looks whether their ids are their own, as it then needs no exchange of predictions.
MANY_CASES = 200_000
TASKS, METHODS = ("continuous", "categorical"), ("predict", "predict_proba")


# Statistics of any prediction table (draw, case_id, pred) or (draw, case_id, class, p), draw 0 being the original fit.


#: All of them take ``by``, further columns that tell apart several tables in one, as the configurations of a grid are; results hold them too.


def _over(array, part):
    """Sum of part(x) over an array column."""
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + part(x))


def gathered(full: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cells): a row a case, with its (draw, pred) in one array."""
    return full.groupBy(*keys).agg(F.collect_list(F.struct("draw", F.col("pred").cast("double").alias("pred"))).alias("cells"))


def _numeric_batch(batch: pa.RecordBatch, n_keys: int) -> pa.RecordBatch:
    n, x = batch.num_rows, batches.numeric(batch.column(n_keys))
    known = lambda values, unknown: pa.array(values, pa.float64(), mask=unknown)
    cells = pa.StructArray.from_arrays([pa.array(x.draw, pa.int32()), known(x.move, x.no_move), known(x.d, x.no_d)], names=["draw", "move", "d"])
    each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(x.case, minlength=n))), pa.int32()), cells)
    numbers = [known(x.per_point, x.no_point), known(x.pairwise, x.no_point), known(x.mape, x.no_mape), pa.array(x.move0), pa.array(x.d0), each]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n_keys)], *numbers], names=[*batch.schema.names[:n_keys], "per_point", "pairwise", "mape", "move0", "d0", "each"])


def _numeric_cases(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Case rows from ``gathered`` ones, where they are."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield _numeric_batch(batch, len(keys))

    more = T._parse_datatype_string("per_point double, pairwise double, mape double, move0 double, d0 double, each array<struct<draw:int,move:double,d:double>>")
    return cells.select(*keys, "cells").mapInArrow(run, T.StructType([*[cells.schema[k] for k in keys], *more.fields]))


def _label_cases(full: DataFrame, keys: list[str]) -> DataFrame:
    drawn = F.col("draw") > 0
    # dealt by case once; both groupings then find their rows where they are
    alike = full.repartition(*keys).groupBy(*keys, "pred").agg(F.count_if(drawn).alias("n"), F.collect_list(F.when(drawn, F.col("draw"))).alias("draws"), F.max(~drawn).alias("first"))
    n = F.col("n")
    row = alike.groupBy(*keys).agg(F.sum("n").alias("b"), F.max("n").alias("most"), F.sum(n * (n - 1)).alias("same"), F.sum(F.when(F.col("first"), n).otherwise(0)).alias("kept"), F.collect_list(F.struct("n", "first", "draws")).alias("cells"))
    b = F.col("b")
    each = F.flatten(F.transform("cells", lambda c: F.transform(c["draws"], lambda d: F.struct(d.alias("draw"), F.when(c["first"], 0.0).otherwise(1.0).alias("move"), (b - c["n"]).cast("double").alias("d")))))
    return row.select(*keys, (1 - F.col("most") / b).alias("per_point"), (1 - F.try_divide(F.col("same"), b * (b - 1))).alias("pairwise"), (1 - F.col("kept") / b).alias("mape"), F.lit(0.0).alias("move0"), F.lit(0.0).alias("d0"), each.alias("each"))


def _vector_cases(full: DataFrame, keys: list[str], n_draws: int, n_classes: int) -> DataFrame:
    """Only classes that some fit knows for a case have rows; one that a draw lacks is a probability of 0, which enters by the number of draws."""
    drawn, b = F.col("draw") > 0, float(n_draws)
    p = F.when(drawn, F.col("p"))
    one = full.repartition(*keys).groupBy(*keys, "class").agg(F.count(p).alias("n"), (F.coalesce(F.sum(p), F.lit(0.0)) / b).alias("m"), F.coalesce(F.max(F.when(~drawn, F.col("p"))), F.lit(0.0)).alias("p0"), F.collect_list(F.when(drawn, F.struct("draw", "p"))).alias("cells"))
    lacking = b - F.col("n")
    one = one.withColumn("s2", _over("cells", lambda x: F.pow(x["p"] - F.col("m"), F.lit(2))) + lacking * F.col("m") * F.col("m")).withColumn("moved", _over("cells", lambda x: F.abs(x["p"] - F.col("p0"))) + lacking * F.abs("p0"))
    # against a draw without the class
    more = F.transform("cells", lambda x: F.struct(x["draw"].alias("draw"), ((F.abs(x["p"] - F.col("p0")) - F.abs("p0")) / n_classes).alias("move"), (b * x["p"] * (x["p"] - 2 * F.col("m"))).alias("d")))
    row = one.groupBy(*keys).agg(F.sum("s2").alias("s2"), F.sum("moved").alias("moved"), F.sum(F.col("m") * F.col("m")).alias("m2"), F.sum(F.abs("p0")).alias("unmoved"), F.flatten(F.collect_list(more)).alias("each"))
    v = F.col("s2") / (b - 1) if n_draws > 1 else F.lit(None).cast("double")
    return row.select(*keys, v.alias("per_point"), (2 * v).alias("pairwise"), (F.col("moved") / (b * n_classes)).alias("mape"), (F.col("unmoved") / n_classes).alias("move0"), (b * F.col("m2") + F.col("s2")).alias("d0"), "each")


def case_rows(full: DataFrame, kind: str, by: Sequence[str] = (), n_draws: int | None = None, n_classes: int | None = None) -> DataFrame:
    """A row a case, from one exchange of the prediction table.

    per_point, pairwise and mape are the case's statistics. For numbers:
    variance over draws, twice that, and the mean absolute move from the
    original. Labels are names: the share of draws off the modal label, the
    share of draw pairs that differ, the share off the original. For
    probabilities variances are summed over classes, and the absolute move is
    averaged over all ``n_classes``. ``each`` holds, by draw, the move and the
    summed distance to all draws, over move0 and d0: squared for numbers and
    probabilities (they are centred first, so large offsets don't cancel),
    disagreement for labels; no pair of draws is formed. A case's draws bound
    the row.
    """
    keys = [*by, "case_id"]
    if kind == "numeric":
        return _numeric_cases(gathered(full, keys), keys)
    if kind == "label":
        return _label_cases(full, keys)
    if n_draws is None:
        n_draws = full.where("draw > 0").select("draw").distinct().count()
    if n_classes is None:
        n_classes = full.select("class").distinct().count()
    return _vector_cases(full, keys, n_draws, n_classes)


def case_stats(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.select(*by, "case_id", "per_point", "pairwise", "mape")


def draw_rows(rows: DataFrame, by: Sequence[str] = (), percentile: bool = False) -> DataFrame:
    """(draw, m, r, and the cases' overall numbers on each row): a draw's mean move and mean summed distance, from ``case_rows``.

    A case is exploded to its draws beside one element, draw 0, for the case
    itself, so that cases and draws are added up in one aggregation.
    """
    marker = F.array(F.struct(F.lit(0).alias("draw"), F.col("move0").alias("move"), F.col("d0").alias("d")))
    cells = rows.select(*by, "per_point", "pairwise", "mape", F.explode(F.concat(marker, "each")).alias("e"))
    own = lambda name: F.when(F.col("e.draw") == 0, F.col(name))
    overall = {"instability_mean": F.avg(own("per_point")), "instability_max": F.max(own("per_point")), "mape": F.avg(own("mape")), "pairwise_mean": F.avg(own("pairwise"))}
    if percentile:
        overall["instability_p90"] = F.percentile(own("per_point"), F.lit(0.9))
    sums = cells.groupBy(*by, F.col("e.draw").alias("draw")).agg(F.count("*").alias("n"), F.sum("e.move").alias("move"), F.sum("e.d").alias("d"), *[v.alias(k) for k, v in overall.items()])
    table = Window.partitionBy(*(by or [F.lit(0)]))  # a row a draw
    base = lambda name: F.max(F.when(F.col("draw") == 0, F.col(name))).over(table)
    m, r = (base("move") + F.col("move")) / base("n"), (base("d") + F.col("d")) / base("n")
    return sums.select(*by, "draw", m.alias("m"), r.alias("r"), *[base(k).alias(k) for k in overall]).where("draw > 0")


def added_up(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What ``draw_rows`` gives, from the tasks' ``batches.sums``, with score_error and score_spread on each row beside."""
    whole = {"n": "n", "move": "move", "d": "d", "point": "per_point", "points": "n_point", "pairs": "pairwise", "mapes": "mape", "n_mape": "n_mape", "error": "error", "spread": "spread"}
    rows = sums.where("draw is not null").groupBy(*by, "draw").agg(*[F.sum(c).alias(k) for k, c in whole.items()], F.max("max_point").alias("most"))
    table = Window.partitionBy(*(by or [F.lit(0)]))  # a row a draw
    base = lambda name: F.max(F.when(F.col("draw") == 0, F.col(name))).over(table)
    m, r = (base("move") + F.col("move")) / base("n"), (base("d") + F.col("d")) / base("n")
    mean = lambda total, count: F.try_divide(base(total), base(count))
    overall = {"instability_mean": mean("point", "points"), "instability_max": base("most"), "mape": mean("mapes", "n_mape"), "pairwise_mean": mean("pairs", "points"), "score_error": base("error"), "score_spread": base("spread")}
    return rows.select(*by, "draw", m.alias("m"), r.alias("r"), *[v.alias(k) for k, v in overall.items()]).where("draw > 0")


def standard_error(samples: DataFrame, column: str = "m", by: Sequence[str] = ()) -> DataFrame:
    """One row: standard deviation over the root of the count; NaN under two rows."""
    return samples.groupBy(*by).agg(_spread(column).alias("standard_error"))


def _spread(column: str):
    n = F.count(column)
    return F.when(n < 2, F.lit(NAN)).otherwise(F.stddev_samp(column) / F.sqrt(n))


def _jackknife():
    """Of rows r, a draw's summed distance to all draws: the error of the mean over all pairs, leaving out one draw at a time."""
    b = F.count("*")
    pairs = (b - 1) * (b - 2) / 2.0
    return F.when(b < 3, F.lit(NAN)).otherwise(F.sqrt((b - 1) * F.var_pop("r")) / F.nullif(pairs, F.lit(0.0)))


def pairwise_standard_error(table: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """One row: the delete-one jackknife error of the mean pairwise distance of all draws in ``table``, in time linear in draws."""
    refits = table.withColumn("draw", F.col("draw") + 1)  # none of them is the original
    return draw_rows(case_rows(refits, kind, by), by).groupBy(*by).agg(_jackknife().alias("standard_error"))


def aligned(probabilities: DataFrame, draws: DataFrame, cases: DataFrame, classes: DataFrame) -> DataFrame:
    """Every (draw, case_id, class), with 0.0 where a draw never saw the class, for those who want the whole grid. Classes are checked as by ``require_classes``."""
    require_classes(probabilities, classes)
    return gridded(probabilities, draws, cases, classes)


def gridded(probabilities: DataFrame, draws: DataFrame, cases: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, "draw", "case_id", "class"]
    grid = cases.select("case_id").crossJoin(F.broadcast(draws.select(*by, "draw"))).crossJoin(F.broadcast(classes.select("class")))
    return grid.join(probabilities, keys, "left").select(*keys, F.coalesce("p", F.lit(0.0)).alias("p"))


def require_classes(probabilities: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> None:
    """Raises ValueError if a model names a class that the reference classes lack, or one class twice.

    Classes are a model's, so twice shows on any case; the first one of each draw is looked at.
    """
    unknown = probabilities.select("class").distinct().join(classes, "class", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"a model knows the class {unknown[0][0]!r}, which the reference classes lack")
    first = probabilities.groupBy(*by, "draw").agg(F.min("case_id").alias("case_id"))
    again = probabilities.join(F.broadcast(first), [*by, "draw", "case_id"]).groupBy(*by, "draw", "class").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"a model gives the class {again[0]['class']!r} {again[0]['count']} times")


@dataclass
class Audit:
    """What ``bootstrap_predictions`` found. Statistics are lazy; the prediction table, with draw 0 for the original fit, and what it was made from are in the shared folder until ``release``.

    Of numbers it is stored as a row a case, ``cells``, and moves as that. If
    ``own_ids``, no two cases share an id, ``cells`` are complete where they
    are, of labels and probabilities too, and nothing moves but sums by draw;
    procedures that are cheap to ask are then asked again and not written. Of
    probabilities the kept table holds the classes that a draw knows, and
    under draw -1 a zero for each case; ``predictions`` and ``original`` fill in
    zeros for the other classes.
    """

    task: str
    prediction_method: str
    kind: str
    original_labels: DataFrame
    kept: DataFrame
    cases: DataFrame
    classes: DataFrame | None
    n_classes: int | None
    n_bootstrap: int
    n_cases: int
    n_resample_attempts: int
    by: tuple[str, ...] = ()
    tables: list[DataFrame] = field(default_factory=list)
    cells: DataFrame | None = None
    own_ids: bool = False

    @property
    def n_rejected_resamples(self) -> int:
        return self.n_resample_attempts - self.n_bootstrap

    @property
    def n_fit_attempts(self) -> int:
        return 1 + self.n_bootstrap

    def _side(self, first: int, last: int) -> DataFrame:
        if self.kind != "vector":
            return self.kept.where(F.col("draw").between(first, last))
        draws = self.kept.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("draw"))
        if self.by:
            draws = draws.crossJoin(self.kept.select(*self.by).distinct())
        return gridded(self.kept, draws, self.cases, self.classes, self.by)

    @property
    def predictions(self) -> DataFrame:
        return self._side(1, self.n_bootstrap)

    @property
    def original(self) -> DataFrame:
        return self._side(0, 0).drop("draw").withColumnRenamed("p" if self.kind == "vector" else "pred", "p0" if self.kind == "vector" else "pred0")

    @property
    def case_rows(self) -> DataFrame:
        if self.kind == "numeric" and self.cells is not None:
            keys = [*self.by, "case_id"]
            if self.own_ids:
                return _numeric_cases(self.cells, keys)
            # rows that share a case_id are one case
            return _numeric_cases(self.cells.repartition(*keys).groupBy(*keys).agg(F.flatten(F.collect_list("cells")).alias("cells")), keys)
        return case_rows(self.kept, self.kind, self.by, self.n_bootstrap, self.n_classes)

    @property
    def case_stats(self) -> DataFrame:
        return case_stats(self.case_rows, self.by)

    def sums(self, **options) -> DataFrame:
        """What tasks add up of ``cells``, if ids are the cases' own."""
        return batches.sums(self.cells, self.kind, self.by, self.n_bootstrap, self.n_classes, **options)

    @property
    def draw_rows(self) -> DataFrame:
        return added_up(self.sums(), self.by) if self.own_ids else draw_rows(self.case_rows, self.by)

    def mape_standard_error(self) -> DataFrame:
        return standard_error(self.draw_rows, by=self.by)

    def pairwise_standard_error(self) -> DataFrame:
        return self.draw_rows.groupBy(*self.by).agg(_jackknife().alias("standard_error"))

    def release(self) -> None:
        """Delete every table that the audit wrote."""
        for table in self.tables:
            dropped(table)


def demand(*rules: tuple[bool, str]) -> None:
    """Raises ValueError with the text of the first rule that doesn't hold."""
    for holds, text in rules:
        if not holds:
            raise ValueError(text)


def _validated(train: DataFrame, cases: DataFrame, key: str, target: str, task: str, n_bootstrap: int, prediction_method: str) -> None:
    demand(
        (task in TASKS, f"no such task: {task!r}"),
        (n_bootstrap > 1, f"a spread needs two refits, not {n_bootstrap}"),
        (prediction_method in METHODS, f"no such prediction method: {prediction_method!r}"),
        (prediction_method == "predict" or task == "categorical", "a continuous target has no class probabilities"),
    )
    require_columns(train, key, target)
    require_columns(cases, "case_id")
    require_scalar(train, target)
    if task == "continuous":
        require_numeric(train, target)


def usable_draws(rows: DataFrame, n: int, n_bootstrap: int, seed: int) -> tuple[list[int], DataFrame, DataFrame]:
    """The first attempts whose draws hold two labels or more, the rows dealt to them, and the table behind that; attempts with one label only are passed over, up to a cap."""
    cap = n_bootstrap + max(100, 10 * n_bootstrap)
    tried = n_bootstrap  # mostly all of them will do
    while True:
        table = stored(dealt(rows, {None: n}, range(1, tried + 1), seed), "audit-draws")
        found = sorted(r.attempt for r in first_usable(drawn_rows(table), "y", n_bootstrap).collect())  # a row a draw
        if len(found) == n_bootstrap:
            return found, table.withColumn("times_", F.array(*[F.get("times_", F.lit(a - 1)) for a in found])) if found[-1] > n_bootstrap else table, table
        dropped(table)
        if tried == cap:
            raise ValueError(f"only {len(found)} of {n_bootstrap} resamples held two classes in {cap} attempts")
        tried = min(cap, 2 * tried)


def bootstrap_predictions(train: DataFrame, cases: DataFrame, procedure, *, key: str = "rid", target: str = "y", task: str = "continuous", n_bootstrap: int = 20, prediction_method: str = "predict", seed: int = 0) -> Audit:
    """Refit ``procedure`` on bootstrap resamples of ``train`` and score the same ``cases`` with every refit.

    Rows are resampled whole, n of n with replacement; the resamples depend on
    seed, draw and key alone, so every procedure and configuration sees the
    same ones. All draws are fitted in one aggregation keyed by draw; draw 0 is
    the fit to the rows as they are. Categorical draws with a single label are
    redrawn. Bad arguments and empty inputs raise ValueError, as do targets and
    keys that are null or NaN, infinite targets, and features of ``procedure.finite``
    that aren't finite, in training rows or cases; one aggregate a table looks
    for all of it.
    """
    if prediction_method == "predict_proba":
        require_probabilities(procedure)
    prepared = prepare(train, cases, key=key, target=target, task=task, n_bootstrap=n_bootstrap, prediction_method=prediction_method, seed=seed, finite=getattr(procedure, "finite", ()), columns=columns_of([procedure]))
    return audited(prepared, procedure, prediction_method)


@dataclass
class Prepared:
    """Resamples that any number of procedures can be fitted to."""

    weighted: DataFrame
    cases: DataFrame
    classes: DataFrame | None
    task: str
    n_bootstrap: int
    n_cases: int
    n_resample_attempts: int
    tables: list[DataFrame]
    rows: DataFrame | None = None
    own_ids: bool = False


def prepare(train: DataFrame, cases: DataFrame, *, key: str = "rid", target: str = "y", task: str = "continuous", n_bootstrap: int = 20, prediction_method: str = "predict", seed: int = 0, finite: Sequence[str] = (), columns: Sequence[str] | None = None) -> Prepared:
    """``columns`` are all that the procedures look at beside y; None keeps every column."""
    _validated(train, cases, key, target, task, n_bootstrap, prediction_method)
    require_numeric(train, *finite)
    require_numeric(cases, *finite)
    if task == "categorical" and train.schema[target].dataType.typeName() in ("float", "double"):
        train = train.withColumn(target, F.nanvl(target, F.lit(None)))
    rows = train.withColumn("y", F.col(target).cast("double" if task == "continuous" else "string"))
    rows, cases = numbered(rows, key, f"{seed}|rows"), stored(cases, "audit-cases")
    n = checked(rows, "training rows", [*(["y"] if task == "continuous" else []), *finite], [key, "y"])
    n_cases = checked(cases, "cases", finite, ["case_id"])
    kept = rows if columns is None else rows.select(*dict.fromkeys(["idx", "y", *columns]))
    attempts = range(1, n_bootstrap + 1)
    if task == "categorical":
        attempts, drawn, table = usable_draws(kept, n, n_bootstrap, seed)
    else:
        drawn = table = stored(dealt(kept, {None: n}, attempts, seed), "audit-draws")
    classes = rows.select(F.col("y").alias("class")).distinct() if task == "categorical" else None
    return Prepared(drawn_rows(drawn, True), cases, classes, task, n_bootstrap, n_cases, attempts[-1], [rows, table, cases], drawn, n_cases >= MANY_CASES and no_shared_ids(cases))


def no_shared_ids(cases: DataFrame) -> bool:
    """Whether no two cases share an id. Hashes of ids are what moves; where two different ids share one, the answer is no."""
    return cases.groupBy(F.xxhash64("case_id").alias("h")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def columns_of(procedures: Sequence[object]) -> list[str] | None:
    """All columns that the procedures say they look at; None if one doesn't say."""
    named = [getattr(p, "columns", None) for p in procedures]
    return None if any(x is None for x in named) else sorted({c for x in named for c in x})


def audited(prepared: Prepared, procedure, prediction_method: str = "predict") -> Audit:
    return audited_all(prepared, {0: procedure}, prediction_method, ())


CONFIG = ("config_id",)


def audited_all(prepared: Prepared, procedures: dict[int, object], prediction_method: str = "predict", by: tuple[str, ...] = CONFIG, also: Sequence[str] = ()) -> Audit:
    """An audit whose tables hold ``config_id``, if ``by`` has it: all procedures in one prediction table. Where ids are the cases' own, ``cells`` carry the columns ``also`` of the cases."""
    task, cases, classes, tables = prepared.task, prepared.cases, prepared.classes, list(prepared.tables)
    kind = "vector" if prediction_method == "predict_proba" else "numeric" if task == "continuous" else "label"
    asked = {"numeric": "cells", "label": "label_cells", "vector": "share_cells"}[kind]
    own = prepared.own_ids and all(hasattr(p, asked) for p in procedures.values())
    keep = not (own and all(getattr(p, "cheap", False) for p in procedures.values()))
    also = [c for c in also if own]
    parts, labelled, states = [], [], {}
    mark = lambda df, i: df.withColumn("config_id", F.lit(i)) if by else df
    for config_id, procedure in procedures.items():
        model = fitted(procedure, prepared, states, tables)
        if isinstance(model, DataFrame):
            model = stored(model, "audit-models")  # a few rows a draw, which several joins read
            tables.append(model)
        if kind == "vector":
            require_probabilities(procedure, model)
            first = model.where("draw = 0") if isinstance(model, DataFrame) else {0: model[0]}
            labelled.append(mark(procedure.predict(first, cases).select("case_id", F.col("pred").alias("pred0")), config_id))
        if own:
            parts.append(mark(getattr(procedure, asked)(model, cases, also) if also else getattr(procedure, asked)(model, cases), config_id))
        elif kind == "vector":
            parts.append(mark(procedure.predict_proba(model, cases).select("draw", "case_id", "class", "p"), config_id))
        elif kind == "numeric":
            one = procedure.cells(model, cases) if hasattr(procedure, "cells") else gathered(procedure.predict(model, cases), ["case_id"])
            parts.append(mark(one.select("case_id", "cells"), config_id))
        else:
            parts.append(mark(procedure.predict(model, cases).select("draw", "case_id", "pred"), config_id))
    n_classes = None
    if kind == "vector":
        classes = stored(classes, "audit-classes")
        tables.append(classes)
        n_classes, least = classes.agg(F.count("*"), F.min("class")).first()
        if not own:
            # a case of which no fit knows any class is a case all the same
            parts += [mark(cases.select(F.lit(-1).alias("draw"), "case_id", F.lit(least).alias("class"), F.lit(0.0).alias("p")), i) for i in procedures]
    full, cells = reduce(DataFrame.unionByName, parts), None
    if keep:
        full = stored(full, "audit-predictions")
        tables.append(full)
    if own or kind == "numeric":
        value = ["cell.class", "cell.p"] if kind == "vector" else ["cell.pred"]
        each = F.col("cells")
        if kind == "vector":
            each = F.concat(F.array(F.struct(F.lit(-1).alias("draw"), F.lit(least).alias("class"), F.lit(0.0).alias("p"))), each)
        cells, full = full, full.select("case_id", *by, F.explode(each).alias("cell")).select("cell.draw", "case_id", *value, *by)
    if kind == "vector":
        if keep:  # what is cheap gives classes of training rows, once each
            require_classes(full, classes, by)
        labels = reduce(DataFrame.unionByName, labelled)
    else:
        labels = full.where("draw = 0").select(*by, "case_id", F.col("pred").alias("pred0"))
    return Audit(task, prediction_method, kind, labels, full, cases, classes, n_classes, prepared.n_bootstrap, prepared.n_cases, prepared.n_resample_attempts, by, tables, cells, own)


def fitted(procedure, prepared: Prepared, states: dict, tables: list[DataFrame]):
    """The procedure's model. What procedures of one state_key add up is added up once; ``states`` and ``tables`` get to know it."""
    if prepared.rows is None or not hasattr(procedure, "states"):
        return procedure.fit(prepared.weighted)
    key = getattr(procedure, "state_key", None)
    if key is None:
        return procedure.solved(procedure.states(prepared.rows))
    if key not in states:
        states[key] = stored(procedure.states(prepared.rows), "audit-states")
        tables.append(states[key])
    return procedure.solved(states[key])


def require_probabilities(procedure, model=None) -> None:
    """Raises ValueError for a procedure, or fitted models, without class probabilities."""
    ask = getattr(procedure, "gives_probabilities", None)
    if not hasattr(procedure, "predict_proba") or (ask is not None and model is not None and not ask(model)):
        raise ValueError(f"{type(procedure).__name__} gives no class probabilities, which prediction_method='predict_proba' asks for")


def bootstrap_instability(train: DataFrame, cases: DataFrame, procedure, **options) -> DataFrame:
    """One row of ten numbers; options as for ``bootstrap_predictions``. What the audit wrote is deleted."""
    audit = bootstrap_predictions(train, cases, procedure, **options)
    row = summarised(audit)
    out = train.sparkSession.createDataFrame(row.collect(), row.schema)
    audit.release()
    return out


def _stored_quantile(rows: DataFrame, column: str, q: float) -> float:
    """The exact quantile of one column, which is made once for all passes."""
    one = stored(rows.select(column), "audit-column")
    found = exact_quantile(one, column, q)
    dropped(one)
    return found


def summarised(audit: Audit, scored: dict | None = None) -> DataFrame:
    """A row (a configuration): mean, 90th percentile and maximum of per_point, mean mape and pairwise with their errors, counters. With configurations there is no percentile. ``scored`` are options of ``batches.sums`` that tell the truth; then score_error and score_spread too, where ids are the cases' own."""
    by, exact = audit.by, not audit.by and audit.n_cases <= ONE_STEP_CASES
    if audit.own_ids:
        exact = False
        sums = audit.sums(values=not by, **(scored or {}))
        if not by:
            sums = stored(sums, "audit-sums")
            audit.tables.append(sums)
        draws = added_up(sums, by)
    else:
        rows = audit.case_rows
        draws = draw_rows(rows, by, exact)
    taken = {k: F.max(k) for k in ("instability_mean", "instability_max", "mape", "pairwise_mean")}
    if scored:
        taken |= {k: F.max(k) for k in ("score_error", "score_spread")}
    if not by:
        taken["instability_p90"] = F.max("instability_p90") if exact else F.first(F.lit(exact_quantile(sums.where("draw is null"), "per_point", 0.9) if audit.own_ids else _stored_quantile(rows, "per_point", 0.9)))
    one = draws.groupBy(*by).agg(*[v.alias(k) for k, v in taken.items()], _spread("m").alias("mape_standard_error"), _jackknife().alias("pairwise_standard_error"))
    counters = {"n_fit_attempts": audit.n_fit_attempts, "n_resample_attempts": audit.n_resample_attempts, "n_rejected_resamples": audit.n_rejected_resamples}
    numbers = [c for c in ("instability_mean", "instability_p90", "instability_max", "mape", "mape_standard_error", "pairwise_mean", "pairwise_standard_error", "score_error", "score_spread") if c in one.columns]
    return one.select(*by, *numbers, *[F.lit(v).cast("long").alias(k) for k, v in counters.items()])
