"""Model-building procedures: fit all draws at once, score all cases with each.

A procedure has ``fit(weighted)``, from rows (draw, w, y, features) to a table
with a row or a few a draw, and ``predict(model, cases)``, to (draw, case_id,
pred); ``cells(model, cases, also)``, if there is one, to the same as (case_id, ``also``,
array of (draw, pred)), a row a case, which spares audits an exchange; ``label_cells`` and
``share_cells``, of (draw, class, p), do so for labels. If it says that these are ``cheap``,
audits of many cases make them anew in place of writing them. ``states``, from the same rows or
from rows with array ``times_`` by draw, and ``solved`` are a fit in two steps, of which procedures with one ``state_key``
share the first. Those for labels may have ``predict_proba``, to (draw, case_id, class,
p). Fits are weighted aggregates by draw: a repeated row is a weight, never a
copy, and what is fitted is far smaller than the data. ``finite``, if there is
one, names the columns that must hold finite numbers; audits check them.
``columns``, if there is one, names all that fits look at beside y, so that
audits leave other columns behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .sampling import drawn_rows


def each_draw(cases: DataFrame, model: DataFrame) -> DataFrame:
    """Cases with each draw's model row; the model side has one row a draw, which bounds the broadcast."""
    return cases.crossJoin(F.broadcast(model))


def each_cell(cases: DataFrame, model: DataFrame, pred: Callable, also: Sequence[str] = ()) -> DataFrame:
    """(case_id, also, cells) of each case: (draw, pred) of all draws in one array; ``pred`` makes a value of a draw's model row."""
    models = model.agg(F.collect_list(F.struct(*model.columns)).alias("models_"))
    cell = lambda m: F.struct(m["draw"].alias("draw"), pred(m).cast("double").alias("pred"))
    return each_draw(cases, models).select("case_id", *also, F.transform("models_", cell).alias("cells"))


class Constant:
    """Predicts one value, whatever the data."""

    columns, cheap = (), True

    def __init__(self, value=0.0):
        self.value = value

    def fit(self, weighted: DataFrame) -> DataFrame:
        return weighted.select("draw").distinct()

    def predict(self, model: DataFrame, cases: DataFrame) -> DataFrame:
        return each_draw(cases, model).select("draw", "case_id", F.lit(self.value).alias("pred"))

    def cells(self, model: DataFrame, cases: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        return each_cell(cases, model, lambda m: F.lit(self.value), also)


def known_weight():
    """A row's weight, if its y is known."""
    return F.when(F.col("y").isNotNull(), F.col("w"))


class Mean:
    """The weighted mean of y; rows without y don't count."""

    columns, cheap = (), True

    def fit(self, weighted: DataFrame) -> DataFrame:
        return weighted.groupBy("draw").agg((F.sum(F.col("w") * F.col("y")) / F.sum(known_weight())).alias("pred"))

    def predict(self, model: DataFrame, cases: DataFrame) -> DataFrame:
        return each_draw(cases, model).select("draw", "case_id", "pred")

    def cells(self, model: DataFrame, cases: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        return each_cell(cases, model, lambda m: m["pred"], also)


class GroupMean:
    """The weighted mean of y in the case's group, drawn to the draw's mean by ``strength`` pseudo-rows; unseen groups get that mean. Rows without y don't count."""

    cheap = True

    def __init__(self, column: str, strength: float = 0.0):
        self.column, self.strength = column, strength
        self.columns, self.state_key = [column], ("group sums", column)

    def fit(self, weighted: DataFrame) -> DataFrame:
        return self.solved(self.states(weighted))

    def states(self, weighted: DataFrame) -> DataFrame:
        sums = (F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"))
        return by_draw(weighted).where("y is not null").groupBy("draw", F.col(self.column).alias("group")).agg(*sums)

    def solved(self, groups: DataFrame) -> DataFrame:
        over = Window.partitionBy("draw")
        overall = F.sum("s").over(over) / F.sum("n").over(over)
        return groups.select("draw", "group", ((F.col("s") + self.strength * overall) / (F.col("n") + self.strength)).alias("value"), overall.alias("overall"))

    def predict(self, model: DataFrame, cases: DataFrame) -> DataFrame:
        overall = model.groupBy("draw").agg(F.first("overall").alias("overall"))
        spread = each_draw(cases.select("case_id", F.col(self.column).alias("own")), overall)
        groups = model.select(F.col("draw").alias("d_"), "group", "value")
        return spread.join(groups, (F.col("draw") == F.col("d_")) & (F.col("own") == F.col("group")), "left").select("draw", "case_id", F.coalesce("value", "overall").alias("pred"))

    def cells(self, model: DataFrame, cases: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        overall = model.groupBy("draw").agg(F.first("overall").alias("overall")).agg(F.collect_list(F.struct("draw", "overall")).alias("overalls_"))
        groups = model.where("group is not null").groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("draw", "value"))).alias("values_"))
        joined = each_draw(cases.select("case_id", *also, F.col(self.column).alias("own")), overall).join(groups, F.col("own") == F.col("group"), "left")
        cell = lambda o: F.struct(o["draw"].alias("draw"), F.coalesce(F.try_element_at("values_", o["draw"]), o["overall"]).cast("double").alias("pred"))
        return joined.select("case_id", *also, F.transform("overalls_", cell).alias("cells"))


#: Rows of draws that a task gathers before it adds them to states, and groups in which a draw's states meet first.
GATHERED, MEETINGS = 1 << 19, 32


def by_draw(rows: DataFrame) -> DataFrame:
    """Rows (draw, w, ...) of what may come as rows with ``times_``."""
    return drawn_rows(rows, True) if "times_" in rows.columns else rows


def merged(weighted: DataFrame, columns: Sequence[str], protocol, finish: Callable[[object], dict], schema: str) -> DataFrame:
    """(draw, ``schema``): of each draw, what ``finish`` makes of its rows' state.

    ``protocol`` has start() to a state, update(state, X, y, w) and
    merge(state, other) to the next one; X is a pandas frame of the columns, w
    the weights. A task keeps a state a draw, whatever its rows; states of a
    draw meet in groups, then in one row, so nothing but states moves, and no
    task holds a resample. Rows that come with ``times_``, how often each of draws 1, 2, ...
    holds them, aren't copied for each draw, and reach Python once; draw 0 is each row once.
    """
    columns = list(columns)
    together_ = "times_" in weighted.columns
    states = "draw int, at int, state binary"

    def table(rows: list[tuple]) -> pa.Table:
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("draw", pa.int32()), ("at", pa.int32()), ("state", pa.binary())))})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting, size = {}, [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                waiting.append(batch)
                size += len(batch.column(0).flatten()) + batch.num_rows if together_ else batch.num_rows
            if waiting and (batch is None or size >= GATHERED) and together_:
                table_ = pa.Table.from_batches(waiting)
                times = table_.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table_.num_rows, -1)
                rows = table_.select(range(1, table_.num_columns)).to_pandas()
                for draw in range(times.shape[1] + 1):
                    w = times[:, draw - 1] if draw else np.ones(len(rows), dtype=np.int64)
                    at = np.flatnonzero(w)
                    if len(at):
                        part = rows.iloc[at] if draw else rows
                        state = found[draw] if draw in found else protocol.start()
                        found[draw] = protocol.update(state, part[columns], part["y"], w[at].astype(np.int64))
                waiting, size = [], 0
            elif waiting and (batch is None or size >= GATHERED):
                rows = pa.Table.from_batches(waiting).to_pandas().sort_values("draw", kind="stable")
                draws = rows["draw"].to_numpy()
                cuts = np.flatnonzero(np.append(True, draws[1:] != draws[:-1])).tolist()
                for low, high in zip(cuts, [*cuts[1:], len(rows)], strict=True):
                    part, draw = rows.iloc[low:high], int(draws[low])
                    state = found[draw] if draw in found else protocol.start()
                    found[draw] = protocol.update(state, part[columns], part["y"], part["w"].to_numpy())
                waiting, size = [], 0
        at = TaskContext.get().partitionId() % MEETINGS
        yield from table([(draw, at, cloudpickle.dumps(state)) for draw, state in found.items()]).to_batches()

    def met(parts: pa.Table):
        return reduce(protocol.merge, map(cloudpickle.loads, parts.column("state").to_pylist()))

    def together(parts: pa.Table) -> pa.Table:
        return table([(parts.column("draw")[0].as_py(), parts.column("at")[0].as_py(), cloudpickle.dumps(met(parts)))])

    def finished(parts: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{"draw": parts.column("draw")[0].as_py()} | finish(met(parts))], schema=arrow)

    out = T._parse_datatype_string(f"draw int, {schema}")
    arrow = to_arrow_schema(out)
    rows = weighted.select(*(["times_"] if together_ else ["draw", "w"]), "y", *columns).mapInArrow(local, states)
    return rows.groupBy("draw", "at").applyInArrow(together, states).groupBy("draw").applyInArrow(finished, out)


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square R factor of a QR factorisation, filled up with zeros where there are few rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def shrunk_slopes(r: np.ndarray, penalty: float) -> np.ndarray:
    """Slopes of the last column on those between it and the first, a column of ones, from their R factor.

    The block behind the first row is the factor of the centred columns, so a
    large offset costs no digits. A column without spread gets no slope;
    columns that depend on one another share theirs, of least norm.
    """
    inner, right = r[1:-1, 1:-1], r[1:-1, -1]
    spread = np.linalg.norm(inner, axis=0)
    live = spread > 1e-13 * np.linalg.norm(r[:, 1:-1], axis=0)
    out = np.zeros(len(right))
    if live.any():
        scaled = inner[:, live] / spread[live]
        held = np.diag(np.sqrt(penalty) / spread[live])
        out[live] = np.linalg.lstsq(np.vstack([scaled, held]), np.append(right, np.zeros(len(held))), rcond=1e-12)[0] / spread[live]
    return out


class Triangles:
    """States of a least-squares fit: the R factor of the weighted rows of [1, X, y]."""

    def start(self) -> np.ndarray | None:
        return None

    def update(self, state, x: pd.DataFrame, y: pd.Series, w: np.ndarray):
        rows = np.column_stack([np.ones(len(y)), x.to_numpy(dtype=float), y.to_numpy(dtype=float)]) * np.sqrt(w.astype(float))[:, None]
        return triangle(rows if state is None else np.vstack([state, rows]))

    def merge(self, state: np.ndarray, other: np.ndarray) -> np.ndarray:
        return triangle(np.vstack([state, other]))


class Ols:
    """Least squares of y on one feature or several, with a ridge ``penalty`` on the slopes.

    Each task keeps one triangle a draw, the R factor of its weighted rows,
    and triangles merge. Sums of squares are never formed, so offsets and
    near-collinear features keep their digits. What moves is
    (features + 2)^2 numbers a draw and task. Rows with a null or NaN in y or a
    feature don't count. The model has a row a draw: the level at the features'
    centre, the centre and the slopes.
    """

    cheap = True

    def __init__(self, feature: str | Sequence[str] = "x", penalty: float = 0.0):
        self.features, self.penalty = [feature] if isinstance(feature, str) else list(feature), penalty
        self.finite = self.columns = self.features
        self.state_key = ("triangles", *self.features)
        if not self.features or not 0 <= penalty < float("inf"):
            raise ValueError("least squares takes a feature at least and a finite penalty from 0")

    def fit(self, weighted: DataFrame) -> DataFrame:
        return self.solved(self.states(weighted))

    def states(self, weighted: DataFrame) -> DataFrame:
        """(draw, r): the R factor of each draw's rows, row by row."""
        held = ["times_"] if "times_" in weighted.columns else ["draw", "w"]
        rows = weighted.select(*held, *[F.col(c).cast("double").alias(c) for c in [*self.features, "y"]])
        known = [F.col(c).isNotNull() & ~F.isnan(c) for c in [*self.features, "y"]]
        return merged(rows.where(reduce(lambda a, b: a & b, known)), self.features, Triangles(), lambda r: {"r": r.reshape(-1).tolist()}, "r array<double>")

    def solved(self, states: DataFrame) -> DataFrame:
        penalty, size = self.penalty, len(self.features) + 2

        def one(draw: int, flat: list[float]) -> dict:
            r = np.array(flat).reshape(size, size)
            mean = r[0, 1:] / r[0, 0]
            return {"draw": draw, "level": float(mean[-1]), "centre": mean[:-1].tolist(), "slope": shrunk_slopes(r, penalty).tolist()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pylist([one(*x) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)], schema=arrow)

        out = T._parse_datatype_string("draw int, level double, centre array<double>, slope array<double>")
        arrow = to_arrow_schema(out)
        return states.select("draw", "r").mapInArrow(run, out)

    def predict(self, model: DataFrame, cases: DataFrame) -> DataFrame:
        return each_draw(cases, model).select("draw", "case_id", self._value(F.col).alias("pred"))

    def cells(self, model: DataFrame, cases: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        return each_cell(cases, model, lambda m: self._value(lambda name: m[name]), also)

    def _value(self, of: Callable):
        steps = [(F.col(c).cast("double") - F.get(of("centre"), F.lit(i))) * F.get(of("slope"), F.lit(i)) for i, c in enumerate(self.features)]
        return reduce(lambda a, b: a + b, steps, of("level"))


class ClassShares:
    """Label shares in the case's group (or overall, without ``column``); the label is the largest, ties to the smallest label."""

    cheap = True

    def __init__(self, column: str | None = None):
        self.column = column
        self.columns = [column] if column else []

    def fit(self, weighted: DataFrame) -> DataFrame:
        group = F.col(self.column) if self.column else F.lit("")
        counts = weighted.groupBy("draw", group.alias("group"), F.col("y").alias("class")).agg(F.sum("w").alias("n"))
        shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("draw", "group")))
        return shares.select("draw", "group", "class", "p")

    def _own(self, cases: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        return cases.select("case_id", *also, (F.col(self.column) if self.column else F.lit("")).alias("own"))

    def _best(self, model: DataFrame) -> DataFrame:
        return model.groupBy("draw", "group").agg(F.min_by("class", F.struct(-F.col("p"), "class")).alias("pred"))

    def label_cells(self, model: DataFrame, cases: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        """(case_id, also, cells) of cases that some draw has a label for."""
        groups = self._best(model).groupBy("group").agg(F.collect_list(F.struct("draw", "pred")).alias("cells"))
        return self._own(cases, also).join(groups, F.col("own") == F.col("group")).select("case_id", *also, "cells")

    def share_cells(self, model: DataFrame, cases: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        """(case_id, also, cells) of all cases; one that no draw knows has no cells."""
        groups = model.groupBy("group").agg(F.collect_list(F.struct("draw", "class", "p")).alias("known_"))
        none = F.array().cast("array<struct<draw:int,class:string,p:double>>")
        return self._own(cases, also).join(groups, F.col("own") == F.col("group"), "left").select("case_id", *also, F.coalesce("known_", none).alias("cells"))

    def predict(self, model: DataFrame, cases: DataFrame) -> DataFrame:
        best = self._best(model)
        return self._own(cases).join(best, F.col("own") == F.col("group")).select("draw", "case_id", "pred")

    def predict_proba(self, model: DataFrame, cases: DataFrame) -> DataFrame:
        return self._own(cases).join(model, F.col("own") == F.col("group")).select("draw", "case_id", "class", "p")


def seeded(model, seed: int):
    """``model`` with its own and nested random states, those that are None, set from ``seed``: parameters named random_state, or ending in __random_state."""
    params = model.get_params(deep=True) if hasattr(model, "get_params") else vars(model) if hasattr(model, "__dict__") else {}
    free = {k: (seed + i) % 2**31 for i, k in enumerate(sorted(params)) if (k == "random_state" or k.endswith("__random_state")) and params[k] is None}
    if free and hasattr(model, "set_params"):
        model.set_params(**free)
    else:
        for k, v in free.items():
            setattr(model, k, v)
    return model


#: Bytes of pickled objects that go to the tasks at once.
OBJECT_BYTES = 64 << 20
OBJECTS = "object binary, has_probabilities boolean, classes array<string>"


def as_row(fitted) -> dict:
    classes = getattr(fitted, "classes_", None)
    return {"object": cloudpickle.dumps(fitted), "has_probabilities": hasattr(fitted, "predict_proba"), "classes": None if classes is None else [str(c) for c in classes]}


class _Objects:
    """Predictions of fitted Python objects, a row (draw, object, has_probabilities, classes) a draw.

    Objects go to where the cases are, some MB of them at a time, so that no
    case is shuffled or copied before it is scored; each group of objects is one
    scan of the cases. For a string target predictions are strings.
    """

    features: list[str]
    kind = "double"

    def gives_probabilities(self, model: DataFrame) -> bool:
        """Whether every fitted object has predict_proba. One that has it, but doesn't say its classes, or names one twice, raises ValueError."""
        has, named, again = model.agg(F.min("has_probabilities"), F.min(F.col("classes").isNotNull()), F.max(F.when(F.size("classes") > F.size(F.array_distinct("classes")), F.array_join("classes", ", ")))).first()
        if has and not named:
            raise ValueError("an object with predict_proba needs classes_")
        if has and again:
            raise ValueError(f"an object gives a class more than once: {again}")
        return bool(has)

    def _scored(self, model: DataFrame, cases: DataFrame, more: list[T.StructField], give: Callable) -> DataFrame:
        features, names = self.features, ["draw", "case_id", *[f.name for f in more]]
        schema = T.StructType([T.StructField("draw", T.IntegerType()), cases.schema["case_id"], *more])
        groups, size = [[]], 0
        for draw, n in sorted(tuple(r) for r in model.select("draw", F.length("object")).collect()):
            if groups[-1] and size + n > OBJECT_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(draw)
            size += n
        out = None
        for draws in groups:
            held = cases.sparkSession.sparkContext.broadcast([(r.draw, bytes(r.object)) for r in model.where(F.col("draw").isin(draws)).select("draw", "object").collect()])

            def run(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
                fitted = [(draw, cloudpickle.loads(x)) for draw, x in held.value]
                for frame in frames:
                    for draw, one in fitted if len(frame) else ():
                        yield give(one, frame[features]).assign(draw=draw, case_id=lambda x, ids=frame["case_id"].to_numpy(): np.repeat(ids, len(x) // len(ids)))[names]

            part = cases.select("case_id", *[c for c in features if c != "case_id"]).mapInPandas(run, schema)
            out = part if out is None else out.unionByName(part)
        return out

    def cells(self, model: DataFrame, cases: DataFrame, also: Sequence[str] = ()) -> DataFrame:
        """(case_id, also, cells) of numbers: a case's predictions by all objects in one array, made where the case is. Objects that don't fit in one go are gathered."""
        sizes = dict(tuple(r) for r in model.select("draw", F.length("object")).collect())
        if sum(sizes.values()) > OBJECT_BYTES:
            rows = self.predict(model, cases).groupBy("case_id").agg(F.collect_list(F.struct("draw", F.col("pred").cast("double").alias("pred"))).alias("cells"))
            return rows.join(cases.select("case_id", *also), "case_id") if also else rows
        features, names, draws = self.features, ["case_id", *also, "cells"], sorted(sizes)
        held = cases.sparkSession.sparkContext.broadcast({r.draw: bytes(r.object) for r in model.select("draw", "object").collect()})
        schema = T.StructType([*[cases.schema[c] for c in ("case_id", *also)], T.StructField("cells", T._parse_datatype_string("array<struct<draw:int,pred:double>>"))])
        ready = cases.select("case_id", *also, F.struct(*features).alias("x_"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted = [cloudpickle.loads(held.value[d]) for d in draws]
            for batch in batches:
                n = batch.num_rows
                if n:
                    x = pa.RecordBatch.from_arrays(batch.column(n_also).flatten(), names=features).to_pandas()
                    preds = np.column_stack([np.asarray(one.predict(x), dtype=float) for one in fitted]).reshape(-1)
                    flat = pa.StructArray.from_arrays([pa.array(np.tile(draws, n), pa.int32()), pa.array(preds, pa.float64(), from_pandas=True)], names=["draw", "pred"])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(draws), pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:n_also], lists], names=names)

        n_also = 1 + len(also)
        return ready.mapInArrow(run, schema)

    def predict(self, model: DataFrame, cases: DataFrame) -> DataFrame:
        text = self.kind == "string"

        def give(fitted, x: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"pred": pd.Series(np.asarray(fitted.predict(x))).astype(str if text else float).to_numpy()})

        return self._scored(model, cases, [T.StructField("pred", T.StringType() if text else T.DoubleType())], give)

    def predict_proba(self, model: DataFrame, cases: DataFrame) -> DataFrame:
        def give(fitted, x: pd.DataFrame) -> pd.DataFrame:
            p = np.asarray(fitted.predict_proba(x), dtype=float)
            return pd.DataFrame({"class": np.tile([str(c) for c in fitted.classes_], len(x)), "p": p.reshape(-1)})

        return self._scored(model, cases, [T.StructField("class", T.StringType()), T.StructField("p", T.DoubleType())], give)

    def _told(self, weighted: DataFrame) -> None:
        self.kind = "string" if weighted.schema["y"].dataType.simpleString() == "string" else "double"


class Merging(_Objects):
    """Any Python model whose fit is a state that merges, on tables of any size.

    ``protocol`` has start(), update(state, X, y, w), merge(state, other), as
    for ``merged``, and finish(state) to an object with predict(X) and perhaps
    predict_proba(X) and classes_. X holds ``features`` in a pandas frame; those
    in ``finite`` are checked by audits.
    """

    def __init__(self, protocol, features: list[str], finite: Sequence[str] = ()):
        self.protocol, self.features, self.finite = protocol, list(features), list(finite)
        self.columns, self.state_key = self.features, None
        if lacking := [n for n in ("start", "update", "merge", "finish") if not callable(getattr(protocol, n, None))]:
            raise ValueError(f"the protocol lacks {', '.join(lacking)}")

    def fit(self, weighted: DataFrame) -> DataFrame:
        protocol = self.protocol
        self._told(weighted)
        return merged(weighted, self.features, protocol, lambda state: as_row(protocol.finish(state)), OBJECTS)

    def states(self, weighted: DataFrame) -> DataFrame:
        return self.fit(weighted)

    def solved(self, states: DataFrame) -> DataFrame:
        return states


class StepMeans:
    """A model for ``Merging``: the mean of y in each step of ``width`` of one feature, and the mean of all in steps without rows. The state is a dict of (weight, sum) by step."""

    def __init__(self, width: float):
        self.width = width

    def _steps(self, x: pd.DataFrame) -> np.ndarray:
        return np.floor(x.iloc[:, 0].to_numpy(dtype=float) / self.width)

    def start(self) -> dict:
        return {}

    def update(self, state: dict, x: pd.DataFrame, y: pd.Series, w: np.ndarray) -> dict:
        steps, at = np.unique(self._steps(x), return_inverse=True)
        sums = zip(steps.tolist(), np.bincount(at, w).tolist(), np.bincount(at, w * y.to_numpy(dtype=float)).tolist(), strict=True)
        return self.merge(state, {k: (n, s) for k, n, s in sums})

    def merge(self, state: dict, other: dict) -> dict:
        return state | {k: (state.get(k, (0.0, 0.0))[0] + n, state.get(k, (0.0, 0.0))[1] + s) for k, (n, s) in other.items()}

    def finish(self, state: dict) -> StepMeans:
        n, s = (sum(x[i] for x in state.values()) for i in (0, 1))
        fitted = StepMeans(self.width)
        fitted.means, fitted.overall = {k: b / a for k, (a, b) in state.items()}, s / n
        return fitted

    def predict(self, x: pd.DataFrame) -> list[float]:
        return [self.means.get(k, self.overall) for k in self._steps(x).tolist()]


class Fitted(_Objects):
    """Any Python object with fit(X, y) and predict(X), and perhaps predict_proba(X) and classes_, on small tables.

    Each draw's rows go to one task as a pandas frame, rows repeated as drawn:
    what such an object asks for. It must fit a task's memory; where it may not,
    use ``Merging`` or ``SparkMl``. A free random_state of the object, or of a
    part of it, follows ``seed`` and the draw. Fitted objects are pickled by
    value, so that classes of scripts and notebooks work.
    """

    def __init__(self, factory: Callable[[], object], features: list[str], seed: int = 0):
        self.factory, self.features, self.seed = factory, features, seed
        self.columns = features

    def fit(self, weighted: DataFrame) -> DataFrame:
        factory, features, seed = self.factory, self.features, self.seed
        self._told(weighted)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            draw = int(pdf["draw"].iloc[0])
            rows = pdf.loc[pdf.index.repeat(pdf["w"])].reset_index(drop=True)
            model = seeded(factory(), zlib.crc32(f"{seed}|{draw}".encode()) % 2**31)
            fitted = model.fit(rows[features], rows["y"])
            return pd.DataFrame([{"draw": draw} | as_row(model if fitted is None else fitted)])

        return weighted.select("draw", "w", "y", *features).groupBy("draw").applyInPandas(one, f"draw int, {OBJECTS}")


def is_text(rows: DataFrame, name: str) -> bool:
    return rows.schema[name].dataType.typeName() in ("string", "char", "varchar")


def numbered_values(name: str, values: list[str]):
    """The place of a string column's value among ``values``; null for others."""
    return F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(float(i)))])[F.col(name)] if values else F.lit(None).cast("double")


class SparkMl:
    """A pyspark.ml Estimator on ``features``, refitted draw by draw with ``w`` as its weights where it takes any.

    The loop over draws is on the driver, the rows of each fit are not. String
    targets are indexed in the order of all draws' labels (``most_labels`` at
    most, which the driver holds) and come back as strings. String features are
    numbered alike; a value that no draw held is NaN, as a missing one is. An estimator with a
    seed parameter gets one of ``seed`` and the draw.
    """

    def __init__(self, estimator, features: list[str], seed: int = 0, most_labels: int = 10_000):
        self.estimator, self.features, self.seed, self.most_labels, self.labels = estimator, features, seed, most_labels, None
        self.columns = features

    def fit(self, weighted: DataFrame) -> dict[int, object]:
        from pyspark.ml.feature import VectorAssembler

        self.labels = None
        if is_text(weighted, "y"):
            self.labels = self._values(weighted, "y")
            weighted = weighted.withColumn("y", numbered_values("y", self.labels))
        self.texts = {c: self._values(weighted, c) for c in self.features if is_text(weighted, c)}
        weighted = self._numbers(weighted)
        self.assembler = VectorAssembler(inputCols=self.features, outputCol="features_", handleInvalid="keep")
        rows = self.assembler.transform(weighted.withColumn("w", F.col("w").cast("double"))).persist()
        params = {"featuresCol": "features_", "labelCol": "y"} | ({"weightCol": "w"} if self.estimator.hasParam("weightCol") else {})
        fitted = {}
        for draw in sorted(r.draw for r in rows.select("draw").distinct().collect()):
            own = params | ({"seed": zlib.crc32(f"{self.seed}|{draw}".encode())} if self.estimator.hasParam("seed") else {})
            fitted[draw] = self.estimator.copy({self.estimator.getParam(k): v for k, v in own.items()}).fit(rows.where(F.col("draw") == draw))
        rows.unpersist()
        return fitted

    def _values(self, rows: DataFrame, name: str) -> list[str]:
        found = sorted(r[0] for r in rows.select(name).where(F.col(name).isNotNull()).distinct().limit(self.most_labels + 1).collect())
        if len(found) > self.most_labels:
            raise ValueError(f"{name} has more than {self.most_labels} labels")
        return found

    def _numbers(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.coalesce(numbered_values(c, values), F.lit(float("nan"))) for c, values in self.texts.items()})

    def gives_probabilities(self, model: dict[int, object]) -> bool:
        return all(m.hasParam("probabilityCol") for m in model.values())

    def _transformed(self, model: dict[int, object], cases: DataFrame, what: Callable[[DataFrame], DataFrame]) -> DataFrame:
        ready, out = self.assembler.transform(self._numbers(cases)), None
        for draw, fitted in model.items():
            part = what(fitted.transform(ready).withColumn("draw", F.lit(draw)))
            out = part if out is None else out.unionByName(part)
        return out

    def predict(self, model: dict[int, object], cases: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(x) for x in self.labels]) if self.labels else None
        pred = F.get(names, F.col("prediction").cast("int")) if self.labels else F.col("prediction")
        return self._transformed(model, cases, lambda rows: rows.select("draw", "case_id", pred.alias("pred")))

    def predict_proba(self, model: dict[int, object], cases: DataFrame) -> DataFrame:
        """(draw, case_id, class, p); labels that a draw never saw have no row."""
        from pyspark.ml.functions import vector_to_array

        names = F.array(*[F.lit(x) for x in self.labels])
        each = lambda rows: rows.select("draw", "case_id", F.posexplode(vector_to_array("probability")).alias("at", "p")).select("draw", "case_id", F.get(names, F.col("at")).alias("class"), "p")
        return self._transformed(model, cases, each)
