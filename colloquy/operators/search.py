"""Search over many logistic models that share their scans.

All points of a grid and all folds are fitted together by Newton's method: a step is one pass over the rows, in which every
task adds up the gradients and Hessians of all models that learn from a row; the partial sums are added by model, and
only these sums (a fixed size for each model, whatever the number of rows) reach the driver, which solves the small
systems. The number of passes is that of the steps, not that of the models.

The loss is ``|w|^2 / 2 + C * sum of weighted losses`` with a free intercept. ``max_iter`` bounds the steps; axes of a grid that
only name another solver for the same optimum have no counterpart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.features import hash_rank

TOLERANCE = 1e-9
ALL = -1                    #: "fold" of a model that learns from all rows


@dataclass(frozen=True)
class Point:
    c: float
    balanced: bool
    intercept: bool
    max_iter: int


@dataclass
class Found:
    point: Point
    accuracy: float
    f1_macro: float
    coefficients: np.ndarray    #: of the model refitted on all rows, intercept last


def with_folds(df: DataFrame, id_col: str, label: str, features: str, folds: int) -> DataFrame:
    """``(x, y, fold)`` with stratified folds: ranks by hash of the id within each class, modulo ``folds``."""
    ranked = hash_rank(df, [label], id_col)
    return ranked.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), (F.col("_rank") % folds).cast("int").alias("fold"))


def _design(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return np.hstack([x, np.ones((n, 1))]), batch.column("y").to_numpy(), batch.column("fold").to_numpy()


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _summed(rows: DataFrame, partial, n_models: int, size: int) -> np.ndarray:
    """Sums over all rows of ``partial(x, y, fold) -> (models, size)``: added in each task, then by model."""
    schema = "m int, sums array<double>"

    def one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_models, size))
        for b in batches:
            if b.num_rows:
                total += partial(*_design(b))
        yield _record(np.arange(n_models, dtype=np.int32), total)

    def by_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for m, sums in zip(b.column("m").to_pylist(), b.column("sums").flatten().to_numpy().reshape(-1, size), strict=True):
                totals[m] = totals[m] + sums if m in totals else sums.copy()
        if totals:
            yield _record(np.array(list(totals), np.int32), np.stack(list(totals.values())))

    added = rows.mapInArrow(one_task, schema).repartition("m").mapInArrow(by_model, schema)
    out = np.zeros((n_models, size))
    for r in added.collect():
        out[r["m"]] += r["sums"]
    return out


def _record(models: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(models) + 1, dtype=np.int32) * sums.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(models), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))], names=["m", "sums"])


def logistic_search(df: DataFrame, points: list[Point], id_col: str, label: str = "label", features: str = "features", folds: int = 5) -> list[Found]:
    """Cross-validated accuracy and macro F1 (means over the folds) and refitted coefficients of every point, in the order given.

    ``df`` is read once for each Newton step and once for the scores; pass a stored table. Labels are 0 and 1.
    """
    rows = with_folds(df, id_col, label, features, folds)
    counts = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    width = len(df.select(vector_to_array(features).alias("x")).first()["x"]) + 1
    kinds = list(dict.fromkeys((p.c, p.balanced, p.intercept) for p in points))
    fits = [(k, f) for k in kinds for f in [ALL, *range(folds)]]
    weights = np.array([_class_weights(k, f, counts) for k, f in fits])
    out_of = np.array([f for _, f in fits])
    learned = _newton(rows, fits, weights, out_of, width, sorted({p.max_iter for p in points}))

    snapshots = [(i, m) for i in range(len(fits)) for m in learned if out_of[i] != ALL]
    w = np.stack([learned[m][:, i] for i, m in snapshots], 1)
    held = np.array([out_of[i] for i, _ in snapshots])

    def confusion(x, y, fold):
        hit = fold[:, None] == held
        said = x @ w > 0
        true = y[:, None] > 0.5
        return np.stack([(hit & (true == t) & (said == s)).sum(0) for t in (False, True) for s in (False, True)], 1).astype(float)

    cells = _summed(rows, confusion, len(snapshots), 4)
    with np.errstate(invalid="ignore", divide="ignore"):
        tn, fp, fn, tp = cells.T
        accuracy = (tn + tp) / cells.sum(1)
        f1 = [np.nan_to_num(2 * a / (2 * a + fp + fn)) for a in (tn, tp)]
    scores: dict[tuple, list] = {}
    for (i, m), a, f in zip(snapshots, accuracy, (f1[0] + f1[1]) / 2, strict=True):
        scores.setdefault((fits[i][0], m), []).append((a, f))
    out = []
    for p in points:
        kind = (p.c, p.balanced, p.intercept)
        a, f = np.nanmean(scores[kind, p.max_iter], axis=0)
        out.append(Found(p, float(a), float(f), learned[p.max_iter][:, fits.index((kind, ALL))]))
    return out


def _class_weights(kind: tuple, fold: int, counts: dict) -> tuple[float, float]:
    if not kind[1]:
        return 1.0, 1.0
    n = [sum(c for (f, y), c in counts.items() if f != fold and y == label) for label in (0.0, 1.0)]
    return tuple(sum(n) / (2 * c) if c else 1.0 for c in n)


def _newton(rows: DataFrame, fits: list, weights: np.ndarray, out_of: np.ndarray, width: int, bounds: list[int]) -> dict[int, np.ndarray]:
    """Coefficients (a column a model) after each of the bounds on the steps, or once they have settled."""
    c = np.array([k[0] for k, _ in fits])
    free = np.ones((len(fits), width), bool)
    free[:, -1] = [k[2] for k, _ in fits]
    penalty = np.ones(width)
    penalty[-1] = 0
    w = np.zeros((width, len(fits)))
    done: dict[int, np.ndarray] = {}
    moving = np.arange(len(fits))
    for step in range(1, bounds[-1] + 1):
        at, own, skip = w[:, moving], weights[moving], out_of[moving]

        def partial(x, y, fold, at=at, own=own, skip=skip):
            p = _sigmoid(x @ at)
            use = np.where(y[:, None] > 0.5, own[:, 1], own[:, 0]) * (fold[:, None] != skip)
            curve = use * p * (1 - p)
            hessian = np.stack([(x.T * curve[:, j]) @ x for j in range(at.shape[1])]).reshape(at.shape[1], -1)
            return np.hstack([(x.T @ (use * (p - y[:, None]))).T, hessian])

        sums = _summed(rows, partial, len(moving), width + width * width)
        largest = np.zeros(len(moving))
        for j, m in enumerate(moving):
            f = free[m]
            g = penalty * w[:, m] + c[m] * sums[j, :width]
            h = np.diag(penalty) + c[m] * sums[j, width:].reshape(width, width)
            move = np.linalg.lstsq(h[np.ix_(f, f)], g[f], rcond=None)[0]
            move *= min(1.0, 10 / max(np.abs(move).max(), 1e-300))
            w[f, m] -= move
            largest[j] = np.abs(move).max()
        moving = moving[largest > TOLERANCE]
        if step in bounds:
            done[step] = w.copy()
        if not len(moving):
            break
    return {b: done.get(b, w) for b in bounds}
