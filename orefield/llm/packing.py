"""Tokens of documents packed into fixed-length sequences by vector best-fit."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.shared import bounded_batches, cut

#: A task forgets the ids of words beyond so many different ones, and starts anew.
REMEMBER = 250_000
SPECIAL = "<|endoftext|>"


class Ids:
    """Ids of texts as little-endian bytes, as ``tokenizers`` gives them for a byte-level BPE file.

    Text between single spaces stands alone for this vocabulary's splitting pattern, so the ids of such a
    stretch are remembered; merges of new stretches run on the same vocabulary as ranks.
    """

    def __init__(self, file: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.table = table
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def sizes(self) -> np.ndarray:
        """How many bytes of text each id stands for."""
        out = np.zeros(self.whole.get_vocab_size(), np.int64)
        for piece, i in self.table.items():
            out[i] = len(piece)
        out[self.whole.token_to_id(SPECIAL)] = len(SPECIAL)
        return out

    def bytes(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text or "  " in text or text[0] == " " or text[-1] == " ":
            return np.array(self.encode(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        known = self.known
        try:
            body = b"".join([known[w] for w in rest])
        except KeyError:
            if len(known) > REMEMBER:
                known.clear()
            for w in set(rest).difference(known):
                # White space beside the space belongs to one run with it.
                if w[0].isspace() or w[-1].isspace():
                    return np.array(self.encode(text), "<u4").tobytes()
                known[w] = np.array(self.encode(" " + w), "<u4").tobytes()
            body = b"".join([known[w] for w in rest])
        if head[-1].isspace():
            return np.array(self.encode(text), "<u4").tobytes()
        return np.array(self.encode(head), "<u4").tobytes() + body


@functools.lru_cache(maxsize=1)
def ids_of(file: str, ranks: str) -> Ids:
    """A worker's own, which it keeps for its later tasks."""
    return Ids(file, ranks)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(file: str, ranks: str, most: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(file, ranks), np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                all_ids = ids.bytes(text.as_py() or "") + end
                total = len(all_ids) // 4
                cuts = [0, *range(total % most or most, total + 1, most)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = all_ids[4 * a : 4 * b]
                    for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(part), part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

    return run


def token_pieces(docs: DataFrame, file: str, ranks: str, most: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``most`` ids of each document and its end id: doc_id, piece, start, length, ids_crc32, and ``ids`` if asked for.

    Only a longer document is cut; its first piece takes what is over, all others are full.
    A null or empty text is the end id alone.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pieces(file, ranks, most, end_id, with_ids), PIECES + ", ids binary" * with_ids)


def vector_best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in its first dimension) of each item, largest first.

    An item goes to an open bin that has room in every dimension: by ``norm`` the one whose weighted residual
    left by the item is shortest, by ``dot`` the one whose residual has the largest weighted dot product with the
    item; else to a new bin.
    """
    n = len(sizes)
    part = sizes / capacity
    order = np.lexsort((np.arange(n), -part.max(axis=1), -sizes[:, 0]))
    left = np.zeros((n, sizes.shape[1]))
    ids = np.zeros(n, np.int64)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    n_open = n_bins = 0
    least = np.minimum.accumulate(sizes[order][::-1], axis=0)[::-1]
    for at, i in enumerate(order):
        room = left[:n_open]
        good = np.flatnonzero((room >= sizes[i]).all(axis=1))
        if len(good):
            rest = (room[good] - sizes[i]) / capacity
            if rule == "norm":
                best = good[np.argmin(np.square(rest * weights).sum(axis=1))]
            else:
                best = good[np.argmax((room[good] / capacity * part[i] * weights).sum(axis=1))]
        else:
            best = n_open
            left[best], ids[best] = capacity, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        where[i], offset[i] = ids[best], capacity[0] - left[best][0]
        left[best] -= sizes[i]
        if (left[best] < least[at]).any():
            # Nothing that is still to come fits: the last open bin takes its place.
            n_open -= 1
            left[best], ids[best] = left[n_open], ids[n_open]
    return where, offset


def _packed(capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "piece_row"], ascending=[False, True], ignore_index=True)
        length = rows["length"].to_numpy(np.float64)
        sizes = np.stack([length, np.ones(len(rows)), length * length], axis=1)
        where, offset = vector_best_fit(sizes, np.array(capacity), np.array(weights), rule)
        return rows.drop(columns=["pack_group", "piece_row"]).assign(sequence_id=(rows["pack_group"].to_numpy(np.int64) << 32) + where, offset=offset)

    return run


def pack_pieces(
    pieces: DataFrame, most_tokens: int = 1024, most_docs: int | None = None, most_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm", group_rows: int = 4096,
) -> DataFrame:
    """``pieces`` with sequence_id and offset: the sequence that each goes to, and its place there.

    A sequence has room for so many tokens, documents and attention cost (the sum of squared lengths); by default
    the last two are as large as the first allows. A piece that fills a sequence has one to itself. Others are dealt
    by row number into groups of about ``group_rows`` in which ``vector_best_fit`` runs, so no task
    sees more than a group; all but a few sequences of a group are nearly full. A piece longer than a sequence raises an error.
    """
    rows = cut(pieces.withColumn("piece_row", F.monotonically_increasing_id()), "pieces")
    capacity = (float(most_tokens), float(most_docs or most_tokens), float(most_attention or most_tokens**2))
    seen = rows.agg(F.count(F.when(F.col("length") < most_tokens, 1)), F.max("length")).first()
    if (seen[1] or 0) > min(capacity[0], capacity[2] ** 0.5):
        raise ValueError("a piece is longer than a sequence")
    groups = max(1, -(-seen[0] // group_rows))
    full = rows.filter(F.col("length") == most_tokens).withColumns({"sequence_id": F.col("piece_row") + F.lit(1 << 62), "offset": F.lit(0).cast("long")}).drop("piece_row")
    rest = rows.filter(F.col("length") < most_tokens).withColumn("pack_group", F.pmod(F.xxhash64("piece_row"), F.lit(groups)))
    packed = rest.groupBy("pack_group").applyInPandas(_packed(capacity, weights, rule), full.schema)
    return full.unionByName(packed)
