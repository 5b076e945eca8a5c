"""Statistics of cases whose draws lie in one array, and their sums by draw, batch by batch where the cases are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Numbers(NamedTuple):
    """Of a batch: per_point, pairwise and mape of each case, with what is unknown, move0 and d0, and of each cell of a draw its case, draw, move and d; ``first`` is the original prediction of cases not ``gone``."""

    per_point: np.ndarray
    no_point: np.ndarray
    pairwise: np.ndarray
    mape: np.ndarray
    no_mape: np.ndarray
    move0: np.ndarray
    d0: np.ndarray
    case: np.ndarray
    draw: np.ndarray
    move: np.ndarray
    no_move: np.ndarray
    d: np.ndarray
    no_d: np.ndarray
    first: np.ndarray
    gone: np.ndarray


def _cells(lists: pa.Array) -> tuple[int, np.ndarray, pa.Array]:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return len(lists), np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def numeric(lists: pa.Array) -> Numbers:
    n, case, flat = _cells(lists)
    draw, pred = flat.field("draw").to_numpy(), flat.field("pred")
    lost, pred = pred.is_null().to_numpy(zero_copy_only=False), pred.to_numpy(zero_copy_only=False)
    first, gone = np.zeros(n), np.ones(n, dtype=bool)
    at = (draw == 0) & ~lost
    first[case[at]], gone[case[at]] = pred[at], False
    at = draw > 0
    case, draw, pred, lost = case[at], draw[at], pred[at], lost[at]
    total = lambda x: np.bincount(case, x, minlength=n)
    some, b = total(lost.astype(float)) > 0, total((~lost).astype(float))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        mean = total(np.where(lost, 0.0, pred)) / b
        z = pred - mean[case]
        s2, s1 = total(np.where(lost, 0.0, z * z)), total(np.where(lost, 0.0, z))
        move, d = np.abs(pred - first[case]), b[case] * z * z + s2[case] - 2 * z * s1[case]
        per_point, mape = s2 / (b - 1), total(np.where(lost, 0.0, move)) / b
    none = np.zeros(n)
    return Numbers(per_point, b < 2, 2 * per_point, mape, some | gone | (b == 0), none, none, case, draw, move, lost | gone[case], d, some[case], first, gone)


def _alike(case: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Groups of cells of one case and name: each cell's group, the groups' case and name's place, and the names."""
    coded = names.dictionary_encode()
    kinds = max(1, len(coded.dictionary))
    both, group = np.unique(case * kinds + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    return group, both // kinds, both % kinds, coded.dictionary


def labels(lists: pa.Array) -> Numbers:
    n, case, flat = _cells(lists)
    draw = flat.field("draw").to_numpy()
    group, owner, kind, names = _alike(case, flat.field("pred"))
    drawn = draw > 0
    count = np.bincount(group, drawn, minlength=len(owner))
    original = np.bincount(group, draw == 0, minlength=len(owner)) > 0
    total = lambda x: np.bincount(owner, x, minlength=n)
    b, same, kept, most = total(count), total(count * (count - 1)), total(np.where(original, count, 0.0)), np.zeros(n)
    np.maximum.at(most, owner, count)
    first, gone = np.full(n, None, dtype=object), np.ones(n, dtype=bool)
    first[owner[original]], gone[owner[original]] = np.array(names.to_pylist(), dtype=object)[kind[original]], False
    case, draw, group = case[drawn], draw[drawn], group[drawn]
    with np.errstate(invalid="ignore", divide="ignore"):
        per_point, pairwise, mape = 1 - most / b, 1 - same / (b * (b - 1)), 1 - kept / b
    none, known = np.zeros(n), np.zeros(len(case), dtype=bool)
    return Numbers(per_point, b < 2, pairwise, mape, b == 0, none, none, case, draw, np.where(original[group], 0.0, 1.0), known, b[case] - count[group], known, first, gone)


def shares(lists: pa.Array, n_draws: int, n_classes: int) -> Numbers:
    """A class that a draw lacks is a probability of 0, which enters by the number of draws."""
    n, case, flat = _cells(lists)
    draw, p, b = flat.field("draw").to_numpy(), flat.field("p").to_numpy(zero_copy_only=False), float(n_draws)
    group, owner, _, _ = _alike(case, flat.field("class"))
    drawn, original = draw > 0, draw == 0
    by_group = lambda x, at: np.bincount(group[at], x, minlength=len(owner))
    p0 = by_group(p[original], original)
    lacking, m = b - by_group(None, drawn), by_group(p[drawn], drawn) / b
    case, draw, p, own = case[drawn], draw[drawn], p[drawn], group[drawn]
    moved = np.abs(p - p0[own])
    s2 = np.bincount(own, (p - m[own]) ** 2, minlength=len(owner)) + lacking * m * m
    moves = np.bincount(own, moved, minlength=len(owner)) + lacking * np.abs(p0)
    total = lambda x: np.bincount(owner, x, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        v = total(s2) / (b - 1)
    none, known, cells = np.zeros(n, dtype=bool), np.zeros(len(case), dtype=bool), b * p * (p - 2 * m[own])
    point = np.full(n, n_draws < 2)
    return Numbers(v, point, 2 * v, total(moves) / (b * n_classes), none, total(np.abs(p0)) / n_classes, b * total(m * m) + total(s2), case, draw, (moved - np.abs(p0[own])) / n_classes, known, cells, known, np.zeros(n), none)


#: What a task adds up for a draw; draw 0 is the cases themselves, and a null draw one case's per_point.
SUMS = "draw int, n long, move double, d double, per_point double, n_point long, max_point double, pairwise double, mape double, n_mape long, error double, spread double"


class _Adder:
    """Sums of one table's batches."""

    def __init__(self):
        self.own = dict.fromkeys(("n", "move", "d", "per_point", "n_point", "pairwise", "mape", "n_mape", "error", "spread"), 0.0)
        self.most, self.draws = -np.inf, np.zeros((5, 1))

    def add(self, x: Numbers, truth: pa.Array | None, mean: float | None, least: int = 0) -> None:
        """``least`` draws count, even if no case has a cell of theirs."""
        points, mapes = x.per_point[~x.no_point], x.mape[~x.no_mape]
        for k, v in (("n", len(x.per_point)), ("move", x.move0.sum()), ("d", x.d0.sum()), ("per_point", points.sum()), ("n_point", len(points)), ("pairwise", x.pairwise[~x.no_point].sum()), ("mape", mapes.sum()), ("n_mape", len(mapes))):
            self.own[k] += v
        if len(points):
            self.most = max(self.most, np.inf if np.isinf(points).any() else points.max()) if not (np.isnan(points).any() or np.isnan(self.most)) else np.nan
        if truth is not None:
            y, there, known = truth.to_numpy(zero_copy_only=False), ~truth.is_null().to_numpy(zero_copy_only=False), ~x.gone
            if mean is None:  # labels: right ones of all
                self.own["error"] += float((x.first[known] == y[known]).sum())
                self.own["spread"] += float(known.sum())
            else:
                self.own["error"] += ((y - x.first)[known & there] ** 2).sum()
                self.own["spread"] += ((y[there] - mean) ** 2).sum()
        if len(x.draw) or least:
            size = max(self.draws.shape[1], int(x.draw.max(initial=0)) + 1, least + 1)
            grown = np.zeros((5, size))
            grown[:, : self.draws.shape[1]] = self.draws
            for i, (values, unknown) in enumerate(((x.move, x.no_move), (x.d, x.no_d))):
                at = x.draw[~unknown]
                grown[i] += np.bincount(at, values[~unknown], minlength=size)
                grown[2 + i] += np.bincount(at, minlength=size)
            grown[4] += np.bincount(x.draw, minlength=size)
            grown[2:, 1 : least + 1] += 1
            self.draws = grown

    def rows(self) -> list[dict]:
        whole = self.own | {k: int(self.own[k]) for k in ("n", "n_point", "n_mape")}
        out = [{"draw": 0, "max_point": float(self.most) if self.own["n_point"] else None} | whole]
        for draw, (move, d, moves, ds, seen) in enumerate(self.draws.T.tolist()):
            if draw and seen:
                out.append({"draw": draw, "move": move if moves else None, "d": d if ds else None})
        return out


def sums(cells: DataFrame, kind: str, by: Sequence[str] = (), n_draws: int | None = None, n_classes: int | None = None, values: bool = False, truth: str | None = None, mean: float | None = None) -> DataFrame:
    """(by, SUMS) of rows (by, case_id, cells), each a case of its own: a few rows a task, and with ``values`` a row a case with its per_point.

    With ``truth``, a column of the rows, ``error`` and ``spread`` are the
    squared errors of the original fit and the squares about ``mean``; for labels
    the right ones and all.
    """
    by, extra = list(by), [truth] if truth else []
    schema = T.StructType([*[cells.schema[k] for k in by], *T._parse_datatype_string(SUMS).fields])
    names, many = [f.name for f in schema.fields], len(by)
    arrow = to_arrow_schema(schema)

    def numbers(lists: pa.Array) -> Numbers:
        return numeric(lists) if kind == "numeric" else labels(lists) if kind == "label" else shares(lists, n_draws, n_classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adders: dict[tuple, _Adder] = {}
        for batch in batches:
            for key, part in _split(batch, many):
                x = numbers(part.column(many))
                adders.setdefault(key, _Adder()).add(x, part.column(many + 1) if truth else None, mean, n_draws if kind == "vector" else 0)
                if values:
                    held = {"draw": pa.nulls(len(x.per_point), pa.int32()), "per_point": pa.array(x.per_point, pa.float64(), mask=x.no_point)} | {b: pa.array([k] * len(x.per_point), arrow.field(b).type) for b, k in zip(by, key, strict=True)}
                    yield pa.RecordBatch.from_arrays([held[c] if c in held else pa.nulls(len(x.per_point), arrow.field(c).type) for c in names], schema=arrow)
        found = [dict(zip(by, key, strict=True)) | row for key, adder in adders.items() for row in adder.rows()]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return cells.select(*by, "cells", *extra).mapInArrow(run, schema)


def _split(batch: pa.RecordBatch, many: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch by its first ``many`` columns; mostly all rows are alike in them."""
    if not batch.num_rows:
        return
    keys = list(zip(*[batch.column(i).to_pylist() for i in range(many)], strict=True)) if many else [()] * batch.num_rows
    kinds = dict.fromkeys(keys)
    if len(kinds) == 1:
        yield keys[0], batch
        return
    for kind in kinds:
        yield kind, batch.take(pa.array([i for i, k in enumerate(keys) if k == kind], pa.int64()))
