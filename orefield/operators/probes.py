"""Linear probes of many methods, concepts and seeds at once: each Newton step of all of them is one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions import vectors as V
from orefield.operators import metrics as M
from orefield.operators.features import hash_share
from orefield.operators.shared_rows import cut

CELL = ["method", "concept", "seed"]
c = F.col


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -500, 500)))


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(method, x, ys, trains) for each method's rows of a batch: a column of ``ys`` for each concept (nan: none), one of ``trains`` for each seed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        methods = np.array(batch.column("method").to_pylist())
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(methods), dims)
        ys = batch.column("ys").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(methods), -1)
        trains = batch.column("trains").flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(len(methods), -1)
        for m in np.unique(methods):
            yield str(m), x[methods == m], ys[methods == m], trains[methods == m]


def _sums(weights: dict, classes: dict, dims: int):
    """Row i of the weighted sums of products, and of the gradient, for each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for method, x, ys, trains in _batches(batches, dims):
            one = np.column_stack([np.ones(len(x)), x])
            for (m, k, s), w in weights.items():
                use = trains[:, s] & np.isfinite(ys[:, k]) if m == method else np.zeros(1, bool)
                if not use.any():
                    continue
                z, y = one[use], ys[use, k]
                p, weight = probability(z[:, 1:], w), np.where(y == 1, *classes[m, k, s][::-1])
                part = np.column_stack([(z * (weight * p * (1 - p))[:, None]).T @ z, z.T @ (weight * (p - y))])
                held[m, k, s] = held.get((m, k, s), 0) + part
        for (m, k, s), g in held.items():
            n = len(g)
            yield pa.RecordBatch.from_arrays([pa.array([m] * n), pa.array([k] * n, pa.int32()), pa.array([s] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], names=[*CELL, "i", "h"])

    return run


def _stepped(weights: dict, penalty: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell = tuple(x.as_py() for x in key)
        rows = np.array([h for _, h in sorted(zip(table["i"].to_pylist(), table["h"].to_pylist()))])
        w, fixed = weights[cell], np.diag([1e-9] + [penalty] * (len(rows) - 1))
        new = w - np.linalg.solve(rows[:, :-1] + fixed, rows[:, -1] + fixed @ w)
        return pa.table({"method": pa.array([cell[0]]), "concept": pa.array([cell[1]], pa.int32()), "seed": pa.array([cell[2]], pa.int32()), "w": pa.array([new.tolist()], pa.list_(pa.float64()))})

    return run


def _scored(weights: dict, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for method, x, ys, trains in _batches(batches, dims):
            for (m, k, s), w in weights.items():
                use = ~trains[:, s] & np.isfinite(ys[:, k]) if m == method else np.zeros(1, bool)
                if use.any():
                    n = int(use.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([m] * n), pa.array([k] * n, pa.int32()), pa.array([s] * n, pa.int32()), pa.array(ys[use, k].astype(np.int32)), pa.array(probability(x[use], w))], names=[*CELL, "y", "score"])

    return run


def logistic_probes(methods: dict[str, DataFrame], labels: DataFrame, key: str, vector: str, seeds: int = 3, share: float = 0.8, penalty: float = 1.0, most_steps: int = 15) -> DataFrame:
    """(method, concept, seed, auc, n, direction): a logistic regression of every concept on every method's vectors, for every split, with its held-out AUC and unit coefficients.

    ``methods`` are tables (key, vector) of vectors of one length, ``labels`` is (key, concept, y) with a row per key and concept, y null where it says nothing. Classes weigh alike, coefficients
    have a ridge ``penalty``. All probes take a Newton step in one job: tasks add up a matrix for each probe, whose rows are summed before and after the shuffle, and each probe's system is solved in a group of its own.
    The driver holds one vector of coefficients for each probe. Probes whose training rows are of one class are left out.
    """
    names = sorted(r[0] for r in labels.select("concept").distinct().na.drop().collect())  # a row per concept
    if not names:
        raise ValueError("labels hold no concept")
    known = labels.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("concept", "y"))).alias("__m")).select(key, F.array(*[c("__m")[x].cast("int") for x in names]).alias("ys"))
    trains = F.array(*[hash_share(key, seed=s) < share for s in range(seeds)]).alias("trains")
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(m).alias("method"), key, F.transform(vector, lambda x: x.cast("double")).alias("v")) for m, df in methods.items()])
    rows = cut(rows.filter(c("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).join(known, key).select("method", "v", "ys", trains), "probe-rows")
    first = rows.select(F.size("v")).first()
    dims = first[0] if first else 0
    counts: dict[tuple, list] = {}
    seen = rows.select("method", F.posexplode("ys").alias("k", "y"), "trains").filter("y is not null").select("method", "k", "y", F.posexplode("trains").alias("s", "train")).filter("train")
    for m, k, y, s, n in seen.groupBy("method", "k", "y", "s").count().select("method", "k", "y", "s", "count").collect():  # two rows per probe
        counts.setdefault((m, k, s), [0, 0])[y] = n
    classes = {cell: (sum(n) / (2 * n[0]), sum(n) / (2 * n[1])) for cell, n in counts.items() if all(n)}
    weights = {cell: np.zeros(dims + 1) for cell in classes}
    kinds = "method string, concept int, seed int"
    for _ in range(most_steps if weights else 0):
        sums = rows.mapInArrow(_sums(weights, classes, dims), f"{kinds}, i int, h array<double>")
        sums = sums.groupBy(*CELL, "i").agg(F.array(*[F.sum(F.get("h", F.lit(j))) for j in range(dims + 2)]).alias("h"))
        new = {(r.method, r.concept, r.seed): np.array(r.w) for r in sums.groupBy(*CELL).applyInArrow(_stepped(weights, penalty), f"{kinds}, w array<double>").collect()}  # a row per probe
        moved = max(float(np.abs(new[cell] - weights[cell]).max()) for cell in weights)
        weights = new
        if moved < 1e-7:
            break
    spark = rows.sparkSession
    found = spark.createDataFrame([(*cell, names[cell[1]], w.tolist()) for cell, w in weights.items()], f"{kinds}, name string, w array<double>")
    auc = M.roc_auc(rows.mapInArrow(_scored(weights, dims), f"{kinds}, y int, score double"), CELL)
    direction = V.l2_normalize(F.slice("w", 2, max(dims, 1)))
    return F.broadcast(found).join(auc, CELL).select("method", c("name").alias("concept"), "seed", "auc", "n", direction.alias("direction"))


def probe_summary(probes: DataFrame) -> DataFrame:
    """(method, concept, auc_mean, auc_std, seeds)."""
    return probes.groupBy("method", "concept").agg(F.avg("auc").alias("auc_mean"), F.coalesce(F.stddev_pop("auc"), F.lit(0.0)).alias("auc_std"), F.count("*").alias("seeds"))


def cross_method_cosines(probes: DataFrame) -> DataFrame:
    """(concept, a, b, cosine): the mean cosine between two methods' directions of a concept, over seeds."""
    rows = probes.select("method", "concept", "seed", "direction")
    both = rows.withColumnsRenamed({"method": "a", "direction": "x"}).join(rows.withColumnsRenamed({"method": "b", "direction": "y"}), ["concept", "seed"]).filter("a < b")
    return both.groupBy("concept", "a", "b").agg(F.avg(V.cosine(c("x"), c("y"))).alias("cosine"))
