"""Ridge models of many targets, feature families, splits, folds, slices and penalties from one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task holds before it hands them on.
HELD_BYTES = 64 << 20
#: Rows of this fold are never trained on.
HELD_OUT = -1
CELL = ["family", "target", "split", "slice"]
c = F.col


def _summed(features: list[str], targets: list[str], splits: list[str]):
    """Batches of rows to rows (family, target, split, slice, fold, i, g): row i of the sums of products of (1, features, target)."""

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (family, target, split, slice_, fold), g in held.items():
            n = len(g)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x] * n, pa.string()) for x in (family, target, split, slice_)), pa.array([fold] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))],
                names=[*CELL, "fold", "i", "g"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = {t: batch.column(t).to_numpy(zero_copy_only=False).astype(np.float64) for t in targets}
            folds = {s: batch.column(s).to_numpy(zero_copy_only=False).astype(np.float64) for s in splits}
            of, names = batch.column("slice").dictionary_encode(), None
            names, of = of.dictionary.to_pylist(), of.indices.to_numpy()
            for family in features:
                column = batch.column(family)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                if not known.any():
                    continue
                x = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(known.sum(), -1)
                known[known] = np.isfinite(x).all(1)
                x = x[np.isfinite(x).all(1)]
                for target in targets:
                    z = np.column_stack([np.ones(len(x)), x, values[target][known]])
                    good = np.isfinite(z[:, -1])
                    for split in splits:
                        fold = folds[split][known]
                        for k in np.unique(fold[good & np.isfinite(fold)]):
                            for s in np.unique(of[known][good & (fold == k)]):
                                some = z[good & (fold == k) & (of[known] == s)]
                                key = family, target, split, names[s], int(k)
                                if key not in held:
                                    held[key] = np.zeros((z.shape[1], z.shape[1]))
                                    size += held[key].nbytes
                                held[key] += some.T @ some
            if size > HELD_BYTES:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    return run


def fold_grams(rows: DataFrame, features: dict[str, int], targets: list[str], splits: list[str], slices: Column | None = None) -> DataFrame:
    """(family, target, split, slice, fold, i, g): for each, row i of the matrix of sums of products of (1, features, target) over its rows.

    ``features`` names columns of arrays with their lengths, ``targets`` numeric columns, ``splits`` columns that hold a fold. A row counts for a family whose array it has in whole and for
    each target that it has. ``slices`` is an array of names that a row falls under (``ALL`` if none is given). A task adds up its rows and sends a row of numbers for each row of a matrix; these are added before and after the shuffle.
    """
    rows = rows.select(*features, *(c(t).cast("double").alias(t) for t in targets), *(c(s).cast("int").alias(s) for s in splits), F.explode(F.array(F.lit("ALL")) if slices is None else slices).alias("slice"))
    schema = ", ".join(f"{k} string" for k in CELL) + ", fold int, i int, g array<double>"
    found = rows.mapInArrow(_summed(list(features), targets, splits), schema)
    most = max(features.values()) + 2
    return found.groupBy(*CELL, "fold", "i").agg(F.array_compact(F.array(*[F.sum(F.get("g", F.lit(j))) for j in range(most)])).alias("g"))


def ridge(gram: np.ndarray, penalty: float) -> np.ndarray:
    """(intercept, weights) of the ridge on features scaled to unit deviation, from sums of products; the intercept is free."""
    n, d = gram[0, 0], len(gram) - 2
    mean = gram[0] / n
    cov = gram - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[1:-1] / n, 0))
    scale = np.where(scale > 1e-9 * np.maximum(np.abs(mean[1:-1]), 1), scale, 1)
    w = np.linalg.solve(cov[1:-1, 1:-1] / np.outer(scale, scale) + penalty * np.eye(d), cov[1:-1, -1] / scale) / scale
    return np.concatenate([[mean[-1] - w @ mean[1:-1]], w])


def fit_of(gram: np.ndarray, w: np.ndarray) -> tuple[float | None, float]:
    """(R2, RMSE) of a linear model on the rows that the sums of products are of."""
    n, mean = gram[0, 0], gram[0, -1] / gram[0, 0]
    lost = max(gram[-1, -1] - 2 * w @ gram[:-1, -1] + w @ gram[:-1, :-1] @ w, 0)
    spread = gram[-1, -1] - n * mean * mean
    return (1 - lost / spread if spread > 1e-12 * max(gram[-1, -1], 1e-300) else None), float(np.sqrt(lost / n))


def _solved(penalties: list[float], least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        names = [x.as_py() for x in key]
        grams: dict[int, list] = {}
        for fold, i, g in sorted(zip(table["fold"].to_pylist(), table["i"].to_pylist(), table["g"].to_pylist())):
            grams.setdefault(fold, []).append(g)
        parts = {k: np.array(g) for k, g in grams.items()}
        out, whole = [], sum(parts.values())
        learnt = sum((g for k, g in parts.items() if k != HELD_OUT), np.zeros_like(whole))
        for fold, test in sorted(parts.items()):
            train = learnt if fold == HELD_OUT else learnt - test
            if whole[0, 0] < least or train[0, 0] < 2:
                continue
            for p in penalties:
                w = ridge(train, p)
                r2, rmse = fit_of(test, w)
                out.append((*names, fold, p, int(round(train[0, 0])), int(round(test[0, 0])), r2, rmse, w.tolist()))
        kinds = [pa.string()] * 4 + [pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        columns = list(zip(*out)) or [[]] * len(kinds)
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=[*CELL, "fold", "penalty", "n_train", "n_test", "r2", "rmse", "weights"])

    return run


def ridge_models(grams: DataFrame, penalties: list[float], least: int = 100) -> DataFrame:
    """(family, target, split, slice, fold, penalty, n_train, n_test, r2, rmse, weights) for every fold of every cell and every penalty.

    A fold is tested on its own rows, by a model of all others; rows of fold HELD_OUT are tested by a model of all folds.
    Models and their errors come from sums alone, so the rows are not read again. ``weights`` begins with the intercept. Cells of fewer than ``least`` rows are left out.
    """
    schema = ", ".join(f"{k} string" for k in CELL) + ", fold int, penalty double, n_train long, n_test long, r2 double, rmse double, weights array<double>"
    return grams.groupBy(*CELL).applyInArrow(_solved(penalties, least), schema)  # folds times features rows in a group


def best_penalty(models: DataFrame, by: list[str]) -> DataFrame:
    """(by, penalty, mean_r2, folds): the penalty of the best mean R2 over folds, the smaller one of equals."""
    means = models.groupBy(*by, "penalty").agg(F.avg("r2").alias("mean_r2"), F.count("r2").alias("folds"))
    best = means.groupBy(*by).agg(F.max(F.struct(F.round("mean_r2", 9).alias("r2"), (-c("penalty")).alias("p"), "mean_r2", "folds")).alias("best"))
    return best.select(*by, (-c("best.p")).alias("penalty"), "best.mean_r2", "best.folds")


def predictions(rows: DataFrame, models: DataFrame, features: dict[str, int], targets: list[str], keep: list[str]) -> DataFrame:
    """(keep, family, target, y, prediction) of every row by the models (family, target, weights), of which there is one for each family and target; they are sent to every task."""
    out = rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("family"), c(f).alias("x")) for f in features])).alias("f"), F.array(*[F.struct(F.lit(t).alias("target"), c(t).cast("double").alias("y")) for t in targets]).alias("t"))
    out = out.select(*keep, "f.family", "f.x", F.explode("t").alias("t")).select(*keep, "family", "x", "t.target", "t.y").filter("x is not null and y is not null")
    out = out.join(F.broadcast(models.select("family", "target", "weights")), ["family", "target"])
    value = F.aggregate(F.zip_with("x", F.slice("weights", 2, F.size("x")), lambda a, b: a * b), F.get("weights", F.lit(0)), lambda a, b: a + b)
    return out.select(*keep, "family", "target", "y", value.alias("prediction"))
