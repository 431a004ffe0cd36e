"""Scores of texts by a small causal self-attention model over subword ids, beside a unigram of words."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.packing import Ids, ids_of
from orefield.llm.quality import held_out
from orefield.llm.shared import cut
from orefield.llm.textnum import LOWER, SPACE, buffers, hashes, runs

DIMS, HIDDEN = 32, 64
WINDOW, STRIDE = 32, 24
BATCH = 96
#: Rows of a large parameter that travel together.
CHUNK = 512
TOP = 63
#: Rows of a group that are added up together with those of other groups.
LAYERS = 24
#: How fast small parameters learn beside large ones.
DENSE = 0.03
LARGE = ("E", "N", "n")
DISTANCE = np.arange(WINDOW)[:, None] - np.arange(WINDOW)


def row_sums(x: np.ndarray, first: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """Sums of consecutive rows of ``x`` (of ``x[by]``), of those from each place of ``first`` to the next: first rows of all groups, then second ones, and so on.

    What ``np.add.reduceat`` gives, which goes through short groups of wide rows column by column.
    """
    by = np.arange(len(x)) if by is None else by
    n = np.diff(first, append=len(by))
    order = np.argsort(-n)
    n, at = n[order], first[order]
    out = x.take(by[at], 0)
    for i, more in enumerate(np.searchsorted(-n, -np.arange(1, LAYERS)).tolist(), 1):
        if not more:
            break
        out[:more] += x.take(by[at[:more] + i], 0)
    for i in range(np.searchsorted(-n, -LAYERS)):
        out[i] += x.take(by[at[i] + LAYERS : at[i] + n[i]], 0).sum(0)
    found = np.empty_like(out)
    found[order] = out
    return found


def sums_by(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, sums of their rows of ``x``)."""
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], row_sums(x, first, by)


@dataclass
class Tree:
    """A Huffman tree over ids: an id's probability is the product of the turns on its way from the root.

    ``node`` and ``turn`` (1: left, -1: right) hold the ways of all ids, that of id i from ``start[i]`` on; ``bias``: log odds of left, by counts.
    A way goes up to the root, so its numbers rise: its first ``deep[i]`` nodes are not among the TOP that are near the root.
    """

    start: np.ndarray
    node: np.ndarray
    turn: np.ndarray
    bias: np.ndarray
    deep: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> "Tree":
        n = len(counts)
        mass = np.concatenate((counts + 0.1, np.zeros(n - 1)))
        parent, right = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, bool)
        heap = [(float(m), i) for i, m in enumerate(mass[:n])]
        heapq.heapify(heap)
        for new in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = new
            right[j], mass[new] = True, a + b
            heapq.heappush(heap, (a + b, new))
        depth = np.zeros(2 * n - 1, np.int64)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        start = np.concatenate(([0], np.cumsum(depth[:n])))
        node, turn = np.zeros(start[-1], np.int32), np.zeros(start[-1], np.float32)
        now, at = np.arange(n), start[:-1].copy()
        while len(now):
            more = depth[now] > 0
            now, at = now[more], at[more]
            node[at], turn[at] = parent[now] - n, np.where(right[now], -1, 1)
            now, at = parent[now], at + 1
        inner, side = parent[: 2 * n - 2] - n, right[: 2 * n - 2]
        left, other = (np.bincount(inner[s], mass[: 2 * n - 2][s], minlength=n - 1) for s in (~side, side))
        deep = np.concatenate(([0], np.cumsum(node < n - 1 - TOP)))[start]
        return cls(start, node, turn, np.log(left / other).astype(np.float32), np.diff(deep))

    def near(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of a node near the root in a matrix of a row for each id, turn) of each step there on the ways to ``ids``, and where each way's steps begin."""
        start, low = self.start[ids] + self.deep[ids], max(len(self.bias) - TOP, 0)
        n = self.start[ids + 1] - start
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(start - begin, n)
        return self.node[at] + np.repeat(np.arange(len(ids)) * (len(self.bias) - low) - low, n), self.turn[at], begin

    def levels(self, ids: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """An order of ``ids``, longest ways first, and (node, turn) of their first steps, of their second ones, and so on, below the nodes near the root: each for as many ids as have one."""
        n = self.deep[ids]
        order = np.argsort(-n, kind="stable")
        n, start = n[order], self.start[ids[order]]
        with_one = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0)).tolist()
        return order, ((self.node[start[:m] + i], self.turn[start[:m] + i]) for i, m in enumerate(with_one))


@dataclass
class AttentionModel:
    """One causal attention layer with a bias by distance, a tanh layer, and turns in a tree of ids.

    params: E (id vectors), Q, K, V, D (bias by distance), W, O, b (tanh layer), N and n (vectors and biases of the tree's nodes).
    """

    tree: Tree
    params: dict[str, np.ndarray]
    end_id: int

    @classmethod
    def new(cls, counts: np.ndarray, end_id: int, seed: int) -> "AttentionModel":
        """A model that gives each id its share of ``counts``, whatever stands before it, until it learns."""
        random, tree = np.random.default_rng(seed), Tree.of(counts)
        shapes = {"E": (len(counts), DIMS), "Q": (DIMS, DIMS), "K": (DIMS, DIMS), "V": (DIMS, DIMS), "W": (DIMS, HIDDEN), "O": (DIMS, HIDDEN)}
        p = {k: random.normal(0, DIMS**-0.5 if k != "E" else 0.3, s) for k, s in shapes.items()}
        p |= {"D": np.zeros(WINDOW), "b": np.zeros(HIDDEN), "N": np.zeros((len(counts) - 1, HIDDEN)), "n": tree.bias}
        return cls(tree, {k: v.astype(np.float32) for k, v in p.items()}, end_id)

    def forward(self, x: np.ndarray, first: int = 0) -> dict[str, np.ndarray]:
        """``g``: what the model knows after each position from ``first`` on; x: [window, position] of ids. ``both``: id vectors there, and what attention brings."""
        p = self.params
        n, w = x.shape
        e = p["E"].take(x, 0)
        both = np.empty((n, w - first, 2 * DIMS), np.float32)
        both[:, :, :DIMS] = e[:, first:]
        q = (both.reshape(-1, 2 * DIMS)[:, :DIMS] @ p["Q"]).reshape(n, w - first, DIMS)
        k, v = ((e.reshape(-1, DIMS) @ p[m]).reshape(n, w, DIMS) for m in ("K", "V"))
        a = q @ k.transpose(0, 2, 1)
        a += np.where(DISTANCE >= 0, p["D"][np.maximum(DISTANCE, 0)], np.float32(-1e4))[first:w, :w]
        a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a *= 1 / (a @ np.ones((w, 1), np.float32))
        np.matmul(a, v, out=both[:, :, DIMS:])
        g = both.reshape(-1, 2 * DIMS) @ np.concatenate((p["W"], p["O"]))
        g += p["b"]
        return {"e": e, "both": both, "q": q, "k": k, "v": v, "a": a, "g": np.tanh(g, out=g)}

    def log_of(self, g: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of ids after ``g``.

        Most steps are at the TOP nodes that are near the root: these are multiplied for all rows at once.
        """
        if not len(ids):
            return np.empty(0)
        n, bias, log = self.params["N"], self.params["n"], lambda z: np.log(1 + np.exp(np.minimum(z, 60)))
        at, turn, begin = self.tree.near(ids)
        z = g @ n[-TOP:].T + bias[-TOP:]
        out = np.add.reduceat(log(-turn * z.ravel().take(at)), begin)
        order, levels = self.tree.levels(ids)
        own, deep = g.take(order, 0), np.zeros(len(ids), np.float32)
        for node, turn in levels:
            m = len(node)
            deep[:m] += log(-turn * (np.einsum("ij,ij->i", own[:m], n.take(node, 0)) + bias[node]))
        out[order] += deep
        return -out

    def log_probabilities(self, stream: np.ndarray, begin: np.ndarray, length: np.ndarray, most: int = 192) -> np.ndarray:
        """Natural log probability of each id of the documents that lie in ``stream``, scored once each.

        A document is read in windows of WINDOW ids that overlap by WINDOW - STRIDE; the first window scores all
        its ids, a later one those that no window before has scored.
        """
        out = np.zeros(len(stream), np.float64)
        # What stands before an id: the end id at a document's begin, the id before it elsewhere.
        before = np.concatenate((stream[:1], stream[:-1]))
        before[begin] = self.end_id
        n_windows = np.maximum(-(-(length - WINDOW) // STRIDE), 0) + 1
        doc = np.repeat(np.arange(len(begin)), n_windows)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        start, over = begin[doc] + turn * STRIDE, (begin + length)[doc]
        for first, chosen in ((0, np.flatnonzero(turn == 0)), (WINDOW - STRIDE, np.flatnonzero(turn))):
            for part in np.array_split(chosen, len(chosen) // most + 1):
                if not len(part):
                    continue
                at = start[part][:, None] + np.arange(WINDOW)
                real = at < over[part][:, None]
                at = np.where(real, at, start[part][:, None])
                g = self.forward(before[at], first)["g"]
                at, real = at[:, first:].ravel(), real[:, first:].ravel()
                out[at[real]] = self.log_of(g[real], stream[at[real]])
        return out

    def gradients(self, windows: np.ndarray) -> dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]:
        """Of the mean loss over the ids of ``windows`` ([window, 1 + position], -1 where a document is over): dense ones, and (different rows, gradients) of large parameters."""
        p = self.params
        x, y = windows[:, :-1], windows[:, 1:].ravel()
        x, real = np.where(x < 0, self.end_id, x), np.flatnonzero(y >= 0)
        f, y, top = self.forward(x), y[real], len(p["N"][-TOP:])
        g = f["g"] if len(real) == x.size else f["g"].take(real, 0)
        slope = lambda turn, z: (-turn / (1 + np.exp(np.clip(turn * z, -30, 30))) / len(real)).astype(np.float32)
        # Turns near the root are nearly all: a matrix of them, rows of which are multiplied at once; the others level by level.
        at, turn, _ = self.tree.near(y)
        near = np.zeros((len(real), top), np.float32)
        near.ravel()[at] = slope(turn, (g @ p["N"][-TOP:].T + p["n"][-TOP:]).ravel().take(at))
        dg = near @ p["N"][-TOP:]
        order, levels = self.tree.levels(y)
        n_steps = int(self.tree.deep[y].sum())
        own, far, done = g.take(order, 0), np.zeros_like(g), 0
        nodes, dz, dn = np.empty(n_steps, np.int32), np.empty((n_steps, 1), np.float32), np.empty((n_steps, HIDDEN), np.float32)
        for node, turn in levels:
            m = len(node)
            part, vectors = slice(done, done + m), p["N"].take(node, 0)
            nodes[part], dz[part, 0] = node, slope(turn, np.einsum("ij,ij->i", own[:m], vectors) + p["n"][node])
            np.multiply(own[:m], dz[part], out=dn[part])
            far[:m] += np.multiply(vectors, dz[part], out=vectors)
            done += m
        dg[order] += far
        rows, dn = sums_by(nodes, dn)
        rows = np.concatenate((rows, np.arange(len(p["N"]) - top, len(p["N"]))))
        deep_n = np.bincount(nodes, dz[:, 0], minlength=len(p["N"]))[rows[: len(dn)]]
        dh = np.multiply(f["g"], f["g"], out=f["g"] if len(real) < x.size else None)
        np.subtract(1, dh, out=dh)
        if len(real) < x.size:
            whole = np.zeros_like(dh)
            whole[real] = dg
            dg = whole
        dh *= dg
        flat = lambda t: t.reshape(-1, t.shape[-1])
        ones = np.ones(len(dh), np.float32)
        both = flat(f["both"]).T @ dh
        out = {"W": both[:DIMS], "O": both[DIMS:], "b": ones @ dh, "N": (rows, np.concatenate((dn, near.T @ g)))}
        out["n"] = rows, np.concatenate((deep_n.astype(np.float32), ones[: len(near)] @ near))[:, None]
        d_both = (dh @ np.concatenate((p["W"], p["O"])).T).reshape(f["both"].shape)
        dc, a = d_both[:, :, DIMS:], f["a"]
        ds = dc @ f["v"].transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", ds, a)[:, :, None]
        ds *= a
        w, by_distance = x.shape[1], ds.sum(0)
        known = DISTANCE[:w, :w] >= 0
        out["D"] = np.bincount(DISTANCE[:w, :w][known], by_distance[known], minlength=WINDOW).astype(np.float32)
        d = np.empty((*x.shape, 3 * DIMS), np.float32)
        np.matmul(ds, f["k"], out=d[:, :, :DIMS])
        np.matmul(ds.transpose(0, 2, 1), f["q"], out=d[:, :, DIMS : 2 * DIMS])
        np.matmul(a.transpose(0, 2, 1), dc, out=d[:, :, 2 * DIMS :])
        out["Q"], out["K"], out["V"] = np.split(flat(f["e"]).T @ flat(d), 3, 1)
        de = flat(d) @ np.concatenate((p["Q"], p["K"], p["V"]), 1).T
        de += flat(d_both)[:, :DIMS]
        out["E"] = sums_by(x.ravel(), de)
        return out

    def learn(self, windows: np.ndarray, steps: int, seed: int, rate: float, squares: dict[str, np.ndarray], warm_up: int = 0, least: float = 0.05) -> dict[str, np.ndarray]:
        """Take ``steps`` of BATCH windows at falling rates by the sums of ``squares`` of gradients, which go on growing; which rows of large parameters changed."""
        random, touched = np.random.default_rng(seed), {k: np.zeros(len(self.params[k]), bool) for k in LARGE}
        order = np.concatenate([random.permutation(len(windows)) for _ in range(-(-steps * BATCH // max(len(windows), 1)))]) if len(windows) else []
        for step in range(steps if len(windows) else 0):
            now = rate * min(1, (step + 1) / max(warm_up, 1)) * (1 - (1 - least) * step / steps)
            for name, g in self.gradients(windows[order[step * BATCH : (step + 1) * BATCH]]).items():
                p, s = self.params[name], squares[name]
                if name in LARGE:
                    rows, g = g
                    touched[name][rows] = True
                    sums = s.reshape(len(s), -1).take(rows, 0)
                    sums *= 0.999
                    sums += g * g
                    s.reshape(len(s), -1)[rows] = sums
                    g *= now
                    g /= np.sqrt(sums, out=sums)
                    p.reshape(len(p), -1)[rows] -= g
                else:
                    s += 0.01 * (g * g - s)
                    p -= (DENSE * now * g / (np.sqrt(s) + 1e-6)).astype(np.float32)
        return touched


def fresh_squares(params: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.full_like(v, 1e-8) for k, v in params.items()}


def id_stream(ids: Ids, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begin, length) of texts with A-Z lower-cased, an end id after each."""
    end = np.array([end_id], "<u4").tobytes()
    parts = [ids.bytes(t) + end for t in texts]
    length = np.array([len(p) // 4 for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), "<u4").astype(np.int64), np.cumsum(length) - length, length


def _lowered(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = LOWER[data].tobytes()
    return [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


TOKENS = "row long, doc_id long, held_out boolean, ids binary, words binary"


def id_kind(n_ids: int) -> str:
    """The shortest numbers that hold the ids of a vocabulary."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def _tokens(file: str, ranks: str, end_id: int, kind: str):
    """Each text's subword ids, an end id last, and the hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(file, ranks)
        of = lambda t: np.append(np.frombuffer(ids.bytes(t), "<u4"), end_id).astype(kind).tobytes()
        for batch in batches:
            for first, data, offsets in buffers(batch.column("text")):
                start, end, row = runs(1 - SPACE[data], offsets)
                value = hashes(LOWER[data], start, end)
                cuts = np.cumsum(np.bincount(row, minlength=len(offsets) - 1))[:-1]
                columns = [[of(t) for t in _lowered(data, offsets)], [v.tobytes() for v in np.split(value, cuts)]]
                part = batch.slice(first, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([*part.select(["row", "doc_id", "held_out"]).columns, *(pa.array(c, pa.binary()) for c in columns)], names=["row", "doc_id", "held_out", "ids", "words"])

    return run


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each row) of a binary column of numbers."""
    column = column.cast(pa.large_binary())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.empty(0, np.uint8)
    return data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _counts(column: str, kind: str, name: str):
    """(value, n) of the numbers in a binary column of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                value, n = np.unique(_flat(whole.slice(at, 1000).column(column), kind)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.uint64).view(np.int64)), pa.array(n, pa.int64())], names=[name, "n"])

    return run


def windows_of(ids: np.ndarray, end_id: int) -> np.ndarray:
    """A document's windows: [window, 1 + WINDOW], what stands before first, -1 where the document is over."""
    padded = np.concatenate(([end_id], ids, np.full(WINDOW, -1))).astype(np.int32)
    return padded[np.arange(0, len(ids), WINDOW)[:, None] + np.arange(WINDOW + 1)]


def _documents_windows(batches: Iterator[pa.RecordBatch], end_id: int, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for row, ids in zip(batch.column("row").to_pylist(), batch.column("ids")):
            yield row, windows_of(np.frombuffer(ids.as_buffer(), kind), end_id)


def _drawn(end_id: int, kind: str, share: float):
    """Each window with the chance ``share``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, windows in _documents_windows(batches, end_id, kind):
            windows = windows[np.random.default_rng(row).random(len(windows)) < share]
            if len(windows):
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(windows), pa.int64()), pa.array([w.tobytes() for w in windows], pa.binary())], names=["row", "window"])

    return run


CHANGES = "name string, chunk int, part int, rows binary, change binary"


def _trained(shared, kind: str, trainer_windows: int, rate: float, seed: int):
    """What a task's windows change. Each ``trainer_windows`` of them, in order, are a trainer that learns on its own from the shared model.

    Of each chunk of a parameter: how many trainers changed each row, and by how much in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, squares = shared.value
        change = {k: np.zeros_like(v) for k, v in held.params.items()}
        times = {k: np.zeros(len(v), np.int32) for k, v in held.params.items()}

        def train(windows: np.ndarray) -> None:
            model = AttentionModel(held.tree, {k: v.copy() for k, v in held.params.items()}, held.end_id)
            touched = model.learn(windows.astype(np.int64), -(-len(windows) // BATCH), seed, rate, {k: v.copy() for k, v in squares.items()}, least=0.5)
            for name, new in model.params.items():
                change[name] += new - held.params[name]
                times[name] += touched.get(name, 1)

        pool, n = [], 0
        for _, windows in _documents_windows(batches, held.end_id, kind):
            pool.append(windows)
            n += len(windows)
            if n >= trainer_windows:
                whole = np.concatenate(pool)
                full = n // trainer_windows * trainer_windows
                for at in range(0, full, trainer_windows):
                    train(whole[at : at + trainer_windows])
                pool, n = [whole[full:].copy()], n - full
        if n:
            train(np.concatenate(pool))
        part, out = TaskContext.get().partitionId() % 64, []
        for name, of_rows in times.items():
            for at in range(0, len(of_rows), CHUNK):
                own = of_rows[at : at + CHUNK]
                if own.any():
                    out.append((name, at // CHUNK, part, own.tobytes(), change[name][at : at + CHUNK].tobytes()))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["name", "chunk", "part", "rows", "change"])

    return run


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    """Changes of one chunk by several tasks, added up."""
    first = frame.iloc[0]
    rows, change = (sum(np.frombuffer(b, kind).astype(wide) for b in frame[c]).astype(kind).tobytes() for c, kind, wide in (("rows", np.int32, np.int64), ("change", np.float32, np.float64)))
    return pd.DataFrame([(first["name"], first["chunk"], first["part"], rows, change)], columns=list(frame.columns))


def fit_attention(tokens: DataFrame, n_ids: int, end_id: int, seed: int = 5, steps: int = 1700, rounds: int = 2, rate: float = 0.4, trainer_windows: int = 8192) -> AttentionModel:
    """A model of the documents of ``tokens`` (row, ids; a written table).

    All ids of all documents are counted for the tree. ``steps`` of BATCH windows, drawn from all windows by a fixed chance, start the model on the driver. After that every window
    of every document trains: documents are dealt into ``rounds`` by a hash, and in each round every ``trainer_windows`` windows of a partition learn on their own from the model so far,
    in the task that reads them; each row of a parameter moves by the mean of what the trainers that changed it have changed. Windows are never written or shuffled, and work grows with the corpus.
    """
    spark = tokens.sparkSession
    kind = id_kind(n_ids)
    counted = tokens.select("ids").mapInArrow(_counts("ids", kind, "id"), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id of the vocabulary
    counts = np.zeros(n_ids)
    for i, n in counted:
        counts[i] = n
    model = AttentionModel.new(counts, end_id, seed)
    long = F.ceil(F.octet_length("ids") / (np.dtype(kind).itemsize * WINDOW))
    n_windows = tokens.agg(F.coalesce(F.sum(long), F.lit(0))).first()[0]
    if not n_windows:
        return model
    some = tokens.select("row", "ids").mapInArrow(_drawn(end_id, kind, steps * BATCH / n_windows), "row long, window binary").toArrow()  # about steps * BATCH windows, or all
    some = some.sort_by([("row", "ascending"), ("window", "ascending")]).column("window").to_pylist()
    squares = fresh_squares(model.params)
    if some:
        model.learn(np.stack([np.frombuffer(w, np.int32) for w in some]).astype(np.int64), steps, seed, rate, squares, warm_up=50)
    for i in range(rounds):
        shared = spark.sparkContext.broadcast((model, squares))  # of the vocabulary's size
        own = tokens.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == i).select("row", "ids")
        changes = cut(own.mapInArrow(_trained(shared, kind, trainer_windows, rate * 0.05, seed + i), CHANGES), "changes")
        for by in (["name", "chunk", "part"], ["name", "chunk"]):
            changes = changes.groupBy(*by).applyInPandas(_added, CHANGES)
        for r in changes.collect():  # the parameters once
            p = model.params[r.name][r.chunk * CHUNK : (r.chunk + 1) * CHUNK]
            times = np.maximum(np.frombuffer(r.rows, np.int32), 1).reshape(-1, *[1] * (p.ndim - 1))
            p += (np.frombuffer(r.change, np.float32).reshape(p.shape) / times).astype(np.float32)
        shared.unpersist()
    return model


SCORED = "row long, doc_id long, held_out boolean, n_words long, n_common long, common_log double, score double, rare array<long>"


def _scored(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common, logs = shared.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                n_rows = len(batch)
                value, n_words = _flat(batch.column("words"), "<u8")
                row = np.repeat(np.arange(n_rows), n_words)
                place = np.minimum(np.searchsorted(common, value), max(len(common) - 1, 0))
                hit = common[place] == value if len(common) else np.zeros(len(value), bool)
                stream, length = _flat(batch.column("ids"), kind)
                begin = np.cumsum(length) - length
                score = np.add.reduceat(model.log_probabilities(stream.astype(np.int64), begin, length), begin) / np.log(10)
                rare = np.concatenate(([0], np.cumsum(np.bincount(row[~hit], minlength=n_rows))))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.select(["row", "doc_id", "held_out"]).columns, pa.array(n_words, pa.int64()), pa.array(np.bincount(row[hit], minlength=n_rows), pa.int64()),
                        pa.array(np.bincount(row[hit], logs[place[hit]], minlength=n_rows)), pa.array(score), pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(value[~hit].view(np.int64))),
                    ],
                    names=["row", "doc_id", "held_out", "n_words", "n_common", "common_log", "score", "rare"],
                )

    return run


def score_texts(docs: DataFrame, file: str, ranks: str, modulus: int = 7, remainder: int = 2, most_common: int = 1 << 17, end_id: int = 2, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Words (A-Z lower-cased) of rows that are not held out are counted over the whole corpus; a text's tokens are its words and one end.
    ``base_score`` is the add-one unigram's log10 probability of them. ``score`` is the causal attention model's log10 probability of the text's subword ids and the end id;
    the model learns from all rows that are not held out (``fit_attention``, which takes the ``options``). A null text is
    empty: its only token is the end. Repeated rows are rows like others; a null id is not held out; an empty table gives an empty one. Without training rows all counts are 0
    and the model is uniform. The most frequent words, at most ``most_common``, go to every task with their counts;
    all other words of a document meet their counts by a join.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"held_out": held_out(F.col("doc_id"), modulus, remainder), "row": F.monotonically_increasing_id()})
    n_vocabulary = Ids(file, ranks).whole.get_vocab_size()
    kind = id_kind(n_vocabulary)
    tokens = cut(rows.select("row", "doc_id", "held_out", "text").mapInArrow(_tokens(file, ranks, end_id, kind), TOKENS), "tokens")
    train = tokens.filter(~F.col("held_out"))
    counts = cut(train.select("words").mapInArrow(_counts("words", "<u8", "word"), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts", release=True)
    n_types, n_words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs = train.count()
    total, types = n_words + n_docs, n_types + (n_docs > 0)
    end_log, total_log = float(np.log10(n_docs + 1)), float(np.log10(total + types + 1))
    # How many words have each count: as many rows as there are different counts.
    sizes, room, least = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect(), most_common, None
    for n, n_same in sizes:
        room -= n_same
        if room < 0:
            break
        least = n
    top = counts.filter(F.col("n") >= least if least is not None else F.lit(False)).toArrow()
    value, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(value)
    model = fit_attention(train, n_vocabulary, end_id, **options)
    # At most most_common words and a model of the vocabulary's size.
    shared = docs.sparkSession.sparkContext.broadcast((model, value[order], np.log10(n[order] + 1.0)))
    scored = cut(tokens.mapInArrow(_scored(shared, kind), SCORED), "scored", release=True)
    log = F.log10(F.coalesce("n", F.lit(0)) + 1)
    found = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left").groupBy("row").agg(F.count("n").alias("n_rare"), F.sum(log).alias("rare_log"))
    n_tokens = F.col("n_words") + 1
    base = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) + end_log - n_tokens * total_log
    return scored.drop("rare").join(found, "row", "left").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + int(n_docs > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
