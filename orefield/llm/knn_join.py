"""Exact top-k by inner product: a k-nearest-neighbour join over Voronoi cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orefield.llm.shared import cut

CELLS = "row long, id long, vector array<long>, is_query boolean, cell int, distance double"
SUMMARY = "cell int, near array<double>, far double, n long"
#: Queries that are scored against a chunk at once.
SLICE = 256


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    length = np.diff(offsets)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < length[:, None]] = flat
    return out


def _cells(pivots: np.ndarray):
    """The nearest pivot of each vector and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                x = _matrix(batch.column("vector"), pivots.shape[1]).astype(np.float64)
                cell = ((pivots * pivots).sum(1) - 2 * x @ pivots.T).argmin(1)
                # Taken anew without cancellation; a hair more, as the bounds must hold for the true distance.
                distance = np.sqrt(np.square(x - pivots[cell]).sum(1)) * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance)], names=[*batch.schema.names, "cell", "distance"])

    return run


def _summaries(k: int):
    """(cell, near, far, n) of a batch's cells: the k smallest distances, the largest, and the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = batch.column("cell").to_numpy(), batch.column("distance").to_numpy()
            order = np.lexsort((distance, cell))
            parts = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []
            out = [[int(cell[p[0]]) for p in parts], [distance[p[:k]].tolist() for p in parts], [float(distance[p[-1]]) for p in parts], [len(p) for p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64()))], names=["cell", "near", "far", "n"])

    return run


@dataclass
class Cells:
    """Summaries of all cells: pivots, the k + 1 smallest distances to each (infinite where there are fewer vectors) and the largest, sizes, and groups.

    Small cells that lie near each other share a group of about ``chunk_rows`` vectors; a larger cell is a group of its own, dealt into chunks.
    """

    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    group: np.ndarray
    n_chunks: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray, rows: list[tuple], k: int, chunk_rows: int) -> "Cells":
        near, far, size = np.full((len(pivots), k + 1), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        for cell, some, most, n in rows:
            near[cell, : len(some)], far[cell], size[cell] = some, most, n
        # Neighbours first: cells stand by the nearest of a few pivots, then by the distance to it.
        few = pivots[: math.isqrt(len(pivots) - 1) + 1]
        apart = np.sqrt(np.maximum((pivots * pivots).sum(1)[:, None] - 2 * pivots @ few.T + (few * few).sum(1), 0))
        group, n_chunks, filled = np.zeros(len(pivots), np.int64), [], chunk_rows
        for cell in np.lexsort((apart.min(1), apart.argmin(1))):
            chunks = max(1, -(-int(size[cell]) // chunk_rows))
            if chunks > 1 or filled + size[cell] > chunk_rows:
                n_chunks.append(chunks)
                filled = chunk_rows if chunks > 1 else 0
            group[cell] = len(n_chunks) - 1
            filled += int(size[cell])
        return cls(pivots, near, far, group, np.array(n_chunks, np.int64))

    def needed(self, q: np.ndarray) -> np.ndarray:
        """[query, cell]: whether the cell may hold one of the query's answers.

        A vector x at distance d of its pivot p has a score within |q| d of q.p. The (k + 1)-th largest lower bound that the summaries give (one of
        them may be the query's own row) is a score that every answer reaches; a cell whose upper bound stays below it holds none.
        """
        middle, length = q @ self.pivots.T, np.sqrt(np.square(q).sum(1))[:, None]
        slack = 1e-6 * (np.abs(middle) + 1)
        low = (middle - slack)[:, :, None] - length[:, :, None] * np.where(np.isfinite(self.near), self.near, 0)
        low[:, ~np.isfinite(self.near)] = -np.inf
        low = low.reshape(len(q), -1)
        k = self.near.shape[1]
        theta = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        high = middle + slack + length * np.where(np.isfinite(self.far), self.far, 0)
        return (high >= theta[:, None]) & np.isfinite(self.far)


def _asked(shared):
    """(row, id, vector, group, n_kept): each query once for each group that it needs, with the number of cells that it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value
        for whole in batches:
            for start in range(0, len(whole), 64):
                batch = whole.slice(start, 64)
                use = cells.needed(_matrix(batch.column("vector"), cells.pivots.shape[1]).astype(np.float64))
                groups = np.zeros((len(batch), len(cells.n_chunks)), bool)
                query, cell = np.nonzero(use)
                groups[query, cells.group[cell]] = True
                query, group = np.nonzero(groups)
                part = batch.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([*part.select(["row", "id", "vector"]).columns, pa.array(group, pa.int32()), pa.array(use.sum(1)[query], pa.int64())], names=["row", "id", "vector", "group", "n_kept"])

    return run


def _local(k: int):
    """The k best of a chunk for each query of a block."""

    def run(both: pd.DataFrame) -> pd.DataFrame:
        queries, data = both[both["asks"]], both[~both["asks"]].sort_values(["id", "row"], ignore_index=True)
        names = ["query_row", "query_id", "row", "id", "score"]
        if queries.empty or data.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        dims = max(data["vector"].map(len).max(), queries["vector"].map(len).max())
        x, q = (np.stack([np.pad(v, (0, dims - len(v))) for v in frame["vector"]]).astype(np.int64) for frame in (data, queries))
        exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * dims < 2**53
        if exact:
            x, q = x.astype(np.float64), q.astype(np.float64)
        rows, ids, asks, ask_ids = (frame[c].to_numpy() for frame, c in ((data, "row"), (data, "id"), (queries, "row"), (queries, "id")))
        out = []
        for start in range(0, len(q), SLICE):
            scores = (q[start : start + SLICE] @ x.T).astype(np.int64)
            for i, s in enumerate(scores, start):
                other = np.flatnonzero(rows != asks[i])
                s = s[other]
                least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else s.min(initial=0)
                above = np.flatnonzero(s > least)
                best = np.concatenate((above, np.flatnonzero(s == least)[: max(k - len(above), 0)]))
                at = other[best]
                out.append((np.full(len(at), asks[i]), np.full(len(at), ask_ids[i]), rows[at], ids[at], s[best]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*out))})

    return run


def top_k_inner_product(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int | None = None, chunk_rows: int = 4096, max_pivots: int = 1024, with_cells: bool = False
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row whose id is divisible by ``every``.

    Components x count as floor(256 * x); vectors that are null or hold null or non-finite components, and rows with a null
    id, take no part; shorter vectors count as filled with zeros. A query's own row is no answer, other rows of its id are.
    Equal scores: smaller id first, then any row of it. Returns query_id, rank (from 1), vec_id, score;
    ``with_cells`` adds in how many cells the query's answers were looked for, and of how many. No vectors give an empty table. Scores are 64-bit
    integers: where the longest query and the longest vector could give one beyond that, a ValueError is raised before anything is scored.

    Rows go to the cell of the nearest of about ``n_pivots`` pivots, rows of the table chosen by a hash (by default the square root of the number of rows,
    at most ``max_pivots``). Summaries of the cells bound the score that each query's answers reach; a query is sent only to
    those groups of cells that may hold one, in place of copies of the vectors being sent to queries, as queries are few. Both are dealt into
    chunks of about ``chunk_rows``, so neither a cell nor a cell's queries meet in one task.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("v", lambda x: F.floor(256 * x)).alias("vector"), (F.col("id") % every == 0).alias("is_query"))
    rows = cut(rows, "vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n_rows, dims, longest, longest_query = rows.agg(F.count("*"), F.max(F.size("vector")), F.max(length), F.max(F.when(F.col("is_query"), length))).first()
    # No sum of products, in part or whole, is above the product of lengths; components that floor() cannot hold are at least 2 ** 63 long.
    if (longest or 0) * (longest_query or 0) * (1 + 1e-9) >= 2.0**63:
        raise ValueError("scores may not fit 64 bits: the longest query times the longest vector is 2 ** 63 or more")
    if not n_rows:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    want = n_pivots or min(max_pivots, max(16, math.isqrt(n_rows)))
    turn = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    # A hash leaves about twice as many as are wanted, so that few rows leave their tasks.
    some = rows.filter(turn < min(int((2 * want + 20) / n_rows * (1 << 30)), 1 << 30)).orderBy(turn, "row").limit(want).select("vector").collect()
    pivots = np.unique(np.array([[*v, *[0] * (dims - len(v))] for (v,) in some or [rows.select("vector").first()]], np.float64).reshape(-1, dims), axis=0)
    rows = cut(rows.mapInArrow(_cells(pivots), CELLS), "cells")
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")
    found = rows.select("cell", "distance").mapInArrow(_summaries(k + 1), SUMMARY).withColumn("part", F.pmod(F.xxhash64("far", "n"), F.lit(64)))
    for by in (["cell", "part"], ["cell"]):
        found = found.groupBy(*by).agg(near, F.max("far").alias("far"), F.sum("n").alias("n"))
    cells = Cells.of(pivots, [(r.cell, r.near, r.far, r.n) for r in found.collect()], k, chunk_rows)  # a row per pivot
    shared = spark.sparkContext.broadcast(cells)
    asked = cut(rows.filter("is_query").select("row", "id", "vector").mapInArrow(_asked(shared), "row long, id long, vector array<long>, group int, n_kept long"), "asked")
    # Per group of cells, of which there are no more than pivots: chunks of data, and blocks of queries.
    n_asked = {r[0]: r[1] for r in asked.groupBy("group").count().collect()}
    deal = [(int(c), int(g), int(cells.n_chunks[g]), -(-n_asked[g] // chunk_rows)) for c, g in enumerate(cells.group) if g in n_asked]
    deal = spark.createDataFrame(deal, "cell int, group int, n_chunks long, n_blocks long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n))
    sent = rows.join(F.broadcast(deal), "cell").withColumn("chunk", own("n_chunks")).withColumn("block", each("n_blocks"))
    asked = asked.join(F.broadcast(deal.drop("cell").distinct()), "group").withColumn("block", own("n_blocks")).withColumn("chunk", each("n_chunks"))
    keys = ["group", "block", "chunk"]
    both = [x.select(*keys, "row", "id", "vector", F.lit(asks).alias("asks")) for x, asks in ((asked, True), (sent, False))]
    best = both[0].unionByName(both[1]).groupBy(*keys).applyInPandas(_local(k), "query_row long, query_id long, row long, id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = best.select("query_row", "query_id", "rank", F.col("id").alias("vec_id"), "score")
    if with_cells:
        out = out.join(asked.select(F.col("row").alias("query_row"), F.col("n_kept").alias("kept_cells")).distinct(), "query_row").withColumn("n_cells", F.lit(len(pivots)))
    return out.drop("query_row")
