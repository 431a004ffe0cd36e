"""Quality of documents: random-indexing word vectors, pooled, and a small network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.shared import cut, free_name
from orefield.llm.textnum import SPACE, buffers, hashes, runs

#: Kinds of bytes whose runs are tokens: letters (and all of UTF-8 beyond ASCII), digits, other signs.
KIND = np.full(256, 3, np.uint8)
KIND[128:] = 1
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[48:58] = 2
KIND[SPACE == 1] = 0
BUCKETS = 1 << 15
DIMS = 48
WINDOW = 2
#: Tokens whose vectors are held at once.
SLICE = 1 << 14


@dataclass
class QualityModel:
    """vectors: a row per bucket of words; the network's layers on standardised pooled vectors; a temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, pooled: np.ndarray) -> np.ndarray:
        x = np.clip((pooled - self.mean) / self.std, -8, 8)
        z = (np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each token."""
    start, end, row = runs(KIND[data], offsets)
    return (hashes(data, start, end) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), row


def index_vectors(seed: int) -> np.ndarray:
    """A sparse vector of -1, 0 and 1 for each bucket."""
    random = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for _ in range(4):
        out[np.arange(BUCKETS), random.integers(DIMS, size=BUCKETS)] += random.choice([-1, 1], BUCKETS)
    return out


def word_vectors(bucket: np.ndarray, row: np.ndarray, seed: int) -> np.ndarray:
    """For each bucket the sum of its neighbours' index vectors, at unit length; zero where it never occurs."""
    return summed_vectors([(bucket, row)], seed)


def summed_vectors(parts: Iterable[tuple[np.ndarray, np.ndarray]], seed: int) -> np.ndarray:
    """``word_vectors`` of tokens that come in parts of whole rows; only one part's tokens are held at once.

    Index vectors hold whole numbers, so sums are exact and don't depend on the parts.
    """
    index, out = index_vectors(seed), np.zeros((BUCKETS, DIMS), np.float32)
    for bucket, row in parts:
        for step in range(1, WINDOW + 1):
            same = row[step:] == row[:-step]
            left, right = bucket[:-step][same], bucket[step:][same]
            for word, other in ((left, right), (right, left)):
                order = np.argsort(word, kind="stable")
                for some in np.array_split(order, len(order) // 200_000 + 1):
                    if len(some):
                        first = np.flatnonzero(np.concatenate(([True], word[some][1:] != word[some][:-1])))
                        out[word[some][first]] += np.add.reduceat(index[other[some]], first)
    out /= np.maximum(np.sqrt(np.square(out).sum(1, keepdims=True)), 1)
    return out


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per row: mean and spread of its tokens' vectors, and how many tokens are known; zeros for a row without tokens.

    Sums run over slices of tokens, so that the vectors held at once stay few, however long a text is.
    """
    bucket, row = tokens(data, offsets)
    n_rows = len(offsets) - 1
    total, squares = np.zeros((n_rows, DIMS)), np.zeros((n_rows, DIMS))
    for at in range(0, len(bucket), SLICE):
        own = row[at : at + SLICE]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        found = vectors[bucket[at : at + SLICE]]
        total[own[first]] += np.add.reduceat(found, first)
        squares[own[first]] += np.add.reduceat(np.square(found, out=found), first)
    count = np.maximum(np.bincount(row, minlength=n_rows), 1)[:, None]
    mean, square = total / count, squares / count
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), square.sum(1, keepdims=True)], axis=1).astype(np.float32)


def train_network(x: np.ndarray, y: np.ndarray, seed: int, hidden: int = 32, epochs: int = 400) -> tuple:
    """Two layers by full-batch Adam; the temperature is fitted on every fourth row, which training leaves out."""
    random = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-4
    x = np.clip((x - mean) / std, -8, 8).astype(np.float64)
    late = np.arange(len(x)) % 4 == 3
    params = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    a, b = x[~late], y[~late].astype(np.float64)
    for step in range(1, epochs + 1):
        h = np.tanh(a @ params[0] + params[1])
        error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - b) / max(len(b), 1)
        back = error[:, None] * params[2] * (1 - h * h)
        for i, g in enumerate((a.T @ back, back.sum(0), h.T @ error, error.sum(keepdims=True))):
            g = g + 1e-4 * params[i] * (i in (0, 2))
            moment[i][0] = 0.9 * moment[i][0] + 0.1 * g
            moment[i][1] = 0.999 * moment[i][1] + 0.001 * g * g
            params[i] = params[i] - 0.01 * (moment[i][0] / (1 - 0.9**step)) / (np.sqrt(moment[i][1] / (1 - 0.999**step)) + 1e-8)
    z = np.tanh(x[late] @ params[0] + params[1]) @ params[2] + params[3]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, -np.where(y[late] == 1, z, -z) / t)) if len(z) else 0 for t in grid]
    temperature = float(grid[int(np.argmin(loss))]) if len(z) else 1.0
    return mean, std, params[0], params[1], params[2], float(params[3][0]), temperature


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """(text, quality) of at most ``max_rows`` different labelled rows of at most ``max_bytes`` bytes, the first by a hash of the id.

    They are chosen by ids and text hashes, so texts are never shuffled and never sorted: only the chosen rows' texts
    leave the scan. Before the sort, a hash of the id leaves about twice as many candidates as are wanted.
    """
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    short = docs.filter(F.octet_length("text") <= max_bytes).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = cut(short.select("doc_id", "text_hash").join(known, "doc_id").distinct(), "labelled-rows")
    turn = F.xxhash64("doc_id")
    share = min(1.0, 2 * max_rows / max(found.count(), 1))
    few = found.filter(F.pmod(turn, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod(turn, F.lit(1 << 30)), turn, "doc_id", "text_hash").limit(max_rows)
    few = cut(few, "training-rows")
    return short.join(F.broadcast(few), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.max("text").alias("text"), F.max("quality").alias("quality"))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 20_000, seed: int = 11) -> QualityModel:
    """A model from the ``training_rows`` of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    Rows without a label, id or text are not used; of repeated rows one is. Without any row
    of both labels every text scores the share of label 1 (or 0.5).
    """
    rows = training_rows(docs, labels, max_rows, max_bytes).toArrow()
    order = pc.sort_indices(rows, [("doc_id", "ascending"), ("text_hash", "ascending")]).to_numpy()
    order = order[np.random.default_rng(seed).permutation(len(order))]
    y = rows.column("quality").to_numpy().astype(np.int64)[order]
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        zero = np.zeros(2 * DIMS + 1)
        return QualityModel(np.zeros((BUCKETS, DIMS), np.float32), zero, zero + 1, np.zeros((len(zero), 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    texts = rows.column("text").take(pa.array(order)).combine_chunks()
    del rows
    vectors = summed_vectors((tokens(data, offsets) for _, data, offsets in buffers(texts)), seed)
    x = np.concatenate([pooled(data, offsets, vectors) for _, data, offsets in buffers(texts)])
    del texts
    pa.default_memory_pool().release_unused()  # the driver goes on without them
    return QualityModel(vectors, *train_network(x, y, seed))


def _scored(model, names: list[str], text: str, score_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in buffers(batch.column(text)):
                score = model.value.score(pooled(data, offsets, model.value.vectors))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(score)).select(names).columns, pa.array(score, pa.float64())], names=[*names, score_col])

    return run


def score_quality(docs: DataFrame, model: QualityModel, score_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the new column ``score_col``, the probability of label 1; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: BUCKETS x DIMS numbers
    names = docs.columns
    schema = type(docs.schema)([*docs.schema.fields]).add(score_col, "double")
    text = free_name(docs, "__text")
    return docs.withColumn(text, F.col(text_col).cast("string")).mapInArrow(_scored(shared, names, text, score_col), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 4, remainder: int = 2, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; only labels of rows that are not held out are learned from.

    A null text scores as an empty one; a null id is not held out and has no label; each of repeated rows is scored alike;
    an empty table gives an empty one; of several labels of an id the larger counts; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    model = fit_quality(rows.filter(~held_out(F.col("doc_id"), modulus, remainder)), own.filter(~held_out(F.col("doc_id"), modulus, remainder)), **options)
    scored = score_quality(rows.withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder)), model, "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; rows, nulls and repeats count as in ``quality_scores``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    fitted = fit_quality(rows.filter(~held_out(F.col("doc_id"), 4, 2)), own.filter(~held_out(F.col("doc_id"), 4, 2)), **options)
    score = free_name(docs, "__score")
    return score_quality(docs, fitted, score).filter(F.col(score) >= threshold).drop(score)
