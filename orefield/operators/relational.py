"""A relational message-passing layer with given weights: composed messages, shared bases, self-loops, layer norm; relations are updated too."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions import vectors as V
from orefield.operators.shared_rows import attach, cut

c = F.col


@dataclass
class Layer:
    """Weights of one layer: ``coefficients`` (a row of B numbers for each relation), ``bases`` (B, d, d), ``w_in``, ``w_loop`` and ``w_rel`` (d, d), ``loop``, ``bias``, ``gain``, ``shift`` (d)."""

    coefficients: dict
    bases: np.ndarray
    w_in: np.ndarray
    w_loop: np.ndarray
    w_rel: np.ndarray
    loop: np.ndarray
    bias: np.ndarray
    gain: np.ndarray
    shift: np.ndarray
    composition: str = "sub"


def compose(x: np.ndarray, r: np.ndarray, how: str) -> np.ndarray:
    if how == "corr":
        return np.fft.irfft(np.conj(np.fft.rfft(x)) * np.fft.rfft(r), n=x.shape[-1])
    return x - r if how == "sub" else x * r


def activated(total: np.ndarray, x: np.ndarray, layer: Layer) -> np.ndarray:
    """New vectors of nodes from their summed messages and their own vectors."""
    y = (total @ layer.w_in + compose(x, layer.loop, layer.composition) @ layer.w_loop) * 0.5 + layer.bias
    y = (y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5) * layer.gain + layer.shift
    return np.maximum(y, 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _list(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).ravel()), m.shape[1]).cast(pa.list_(pa.float64()))


def _weighted(layer: Layer):
    """Rows (id, r, m) to (id, m): each message times its relation's weights, which are mixed from the bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, dims = {}, len(layer.loop)
        for batch in batches:
            m, coded = _matrix(batch.column("m"), dims), batch.column("r").dictionary_encode()
            of, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            out = np.zeros_like(m)
            for i, r in enumerate(names):
                if r not in weights:
                    weights[r] = np.tensordot(np.asarray(layer.coefficients[r], float), layer.bases, 1)
                out[of == i] = m[of == i] @ weights[r]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _list(out)], names=["id", "m"])

    return run


def _finished(layer: Layer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = len(layer.loop)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _list(activated(_matrix(batch.column("m"), dims), _matrix(batch.column("v"), dims), layer))], names=["id", "v"])

    return run


def _related(layer: Layer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("r"), _list(np.maximum(_matrix(batch.column("w"), len(layer.loop)) @ layer.w_rel, 0))], names=["r", "w"])

    return run


def relational_layer(edges: DataFrame, vectors: DataFrame, relations: DataFrame, layer: Layer) -> tuple[DataFrame, DataFrame]:
    """(vectors (id, v), relations (r, w)) after one layer over ``edges`` (h, r, t), which hold inverse edges under relations of their own.

    A node gets the mean of two parts, then bias, layer norm and ReLU: the sum over its edges of comp(head, relation) times the relation's weights, through ``w_in``;
    and comp(own vector, loop) through ``w_loop``. As weights are linear, messages are summed for each (node, relation) first, within each task before the
    shuffle, and meet their weights once for each of these. Vectors of heads with many edges go to every task. Nodes without edges keep their self-loop alone; edges whose head has no vector don't count.
    ``relations`` has a row per relation; its rows and the layer's weights are sent to every task.
    """
    dims = len(layer.loop)
    double = lambda x: F.transform(x, lambda y: y.cast("double"))
    edges = cut(edges.select("h", "r", "t").na.drop(), "layer-edges")
    heads = cut(edges.groupBy("h").agg(F.count("*").alias("deg")).join(vectors.select(c("id").alias("h"), double("v").alias("v")), "h"), "layer-heads")
    combine = {"sub": V.subtract, "mult": V.multiply, "corr": V.circular_correlation}[layer.composition]
    rows = attach(edges, heads, "h", "deg", edges.count()).join(F.broadcast(relations.select("r", "w")), "r").select(c("t").alias("id"), "r", combine(c("v"), c("w")).alias("m"))
    summed = lambda df, *by: df.groupBy(*by).agg(F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(dims)]).alias("m"))
    kind, r_kind = vectors.schema["id"].dataType.simpleString(), relations.schema["r"].dataType.simpleString()
    total = summed(summed(rows, "id", "r").mapInArrow(_weighted(layer), f"id {edges.schema['t'].dataType.simpleString()}, m array<double>"), "id")
    zero = F.array_repeat(F.lit(0.0), dims)
    nodes = vectors.select("id", double("v").alias("v")).join(total, "id", "left").select("id", "v", F.coalesce("m", zero).alias("m"))
    new = nodes.mapInArrow(_finished(layer), f"id {kind}, v array<double>")
    return new, relations.select("r", double("w").alias("w")).mapInArrow(_related(layer), f"r {r_kind}, w array<double>")
