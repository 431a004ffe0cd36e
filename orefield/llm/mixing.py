"""Sources mixed to target weights by drawing fixed-length blocks of their words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orefield.llm.prefix_sums import global_prefix
from orefield.llm.shared import cut, free_name, numbered
from orefield.llm.textnum import mix

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of ``sizes`` by weight, none above ``most`` times its size; what is over is shared anew."""
    out = [0.0] * len(sizes)
    free, left = [i for i in range(len(sizes)) if sizes[i]], float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def draws(slots: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard: multinomial by what each source has left, and in the end all of it."""
    random, left = np.random.default_rng(seed), slots.astype(np.int64).copy()
    out = np.zeros((n_shards, len(slots)), np.int64)
    for shard in range(n_shards):
        total = int(left.sum())
        want = total // (n_shards - shard)
        if not want:
            continue
        got = np.minimum(random.multinomial(want, left / total), left)
        while (lack := want - int(got.sum())) > 0:
            room = left - got
            got = np.minimum(got + random.multinomial(lack, room / room.sum()), left)
        out[shard], left = got, left - got
    return out


def permuted(at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of index ``at`` in a pseudorandom permutation of 0..n-1 that ``key`` names: a Feistel network, walked until it is in range."""
    bits = np.array([max(int(x - 1).bit_length(), 2) for x in n.tolist()], np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = at.astype(np.uint64), np.arange(len(at))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        high, low = out[todo] >> h, out[todo] & m
        for turn in range(4):
            high, low = low, high ^ (mix(low + k + np.uint64(turn * 0x9E3779B9)) & m)
        out[todo] = (high << h) | low
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _picks(counts: np.ndarray, blocks: np.ndarray, seed: int):
    """(source_at, block, shard) of each output slot."""
    flat = counts.ravel()
    ends = np.cumsum(flat)
    before = np.cumsum(counts, axis=0) - counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("id").to_numpy()
            cell = np.searchsorted(ends, slot, side="right")
            shard, source = np.divmod(cell, counts.shape[1])
            k = before[shard, source] + slot - (ends[cell] - flat[cell])
            turn, at = np.divmod(k, blocks[source])
            key = mix(np.uint64(seed) + source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn.astype(np.uint64))
            block = permuted(at, blocks[source], key)
            yield pa.RecordBatch.from_arrays([pa.array(source, pa.int32()), pa.array(block), pa.array(shard, pa.int32())], names=["source_at", "block", "shard"])

    return run


def source_plan(rows: DataFrame, most: float, block_words: int) -> list[tuple]:
    """(source, size, target, blocks, slots, start, block length) of each source in code-point order, null last; weights 1, 2, 3 repeat.

    Blocks have ``block_words`` words; those of a source of fewer than 256 such blocks are shorter, so that it comes near its target too.
    One row per source comes to the driver: a list of names, which doesn't grow with the number of documents. The driver and each task that
    draws hold eight bytes for each source and output shard: half a megabyte for a thousand sources and 64 shards.
    """
    found = [tuple(r) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    want = targets([r[1] for r in found], [1.0 + i % 3 for i in range(len(found))], most)
    plan, start = [], 0
    for (source, size), target in zip(found, want):
        each = max(1, min(block_words, size // 256))
        blocks = -(-size // each)
        slots = min(round(target * blocks / size), int(most) * blocks) if size else 0
        plan.append((source, size, target, blocks, slots, start, each))
        start += size
    return plan


def mixed_blocks(rows: DataFrame, most: float = 3, block_words: int = 64, n_shards: int = 64, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (row, doc_id, source, size): (row, doc_id, size, source_size, target, place) and the spans that the mix takes (place, from_word, to_word, shards).

    Words of a source stand in a row, documents ordered by a hash of their id, and are cut into blocks of fixed length.
    A source gets as many slots as its target has blocks; each output shard draws its share of slots;
    the k-th slot of a source takes the k-th block of a pseudorandom permutation, a new permutation each time all blocks are used,
    so no block is taken more than ``most`` times. ``shards`` names the output shard of each time that the span is taken.
    """
    spark = rows.sparkSession
    plan = source_plan(rows, most, block_words)
    schema = "source string, source_at int, source_size long, target double, source_start long, each long"
    known = F.broadcast(spark.createDataFrame([(s, i, size, t, start, each) for i, (s, size, t, _, _, start, each) in enumerate(plan)], schema))
    rows = rows.join(known.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    rows = rows.withColumn("turn", F.xxhash64("doc_id"))
    placed, _ = global_prefix(rows, "source_at", "turn", "doc_id", "size", "row")
    placed = cut(placed.withColumn("start", F.col("start") - F.col("source_start")), "source-places")
    counts = draws(np.array([p[4] for p in plan], np.int64), n_shards, seed)
    slots = spark.range(int(counts.sum())) if plan else spark.range(0)
    picks = slots.mapInArrow(_picks(counts, np.array([p[3] for p in plan], np.int64), seed), "source_at int, block long, shard int")
    # At most ``most`` shards of a block.
    picks = picks.groupBy("source_at", "block").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    parts = placed.filter("size > 0").select("source_at", "place", "start", "size", "each", F.explode(F.expr("sequence(start div each, (start + size - 1) div each)")).alias("block"))
    spans = parts.join(picks, ["source_at", "block"]).select(
        "place", (F.greatest("start", F.col("block") * F.col("each")) - F.col("start")).alias("from_word"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("each")) - F.col("start")).alias("to_word"), "shards",
    )
    return placed.select("row", "doc_id", "size", "source_size", "target", "place"), spans


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))


def mix_to_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """How many words of each row a mix by source weights takes: doc_id, size, source_size, target, taken, and ``shards``: (shard, words) of each output shard that takes some.

    A null text has no words and none are taken; a null source is a source of its own, the last. Repeated rows are rows like
    others. An empty table gives an empty one. ``options`` go to ``mixed_blocks``.
    """
    rows = cut(_rows(docs, id_col, text_col, source_col), "sizes")
    placed, spans = mixed_blocks(rows, **options)
    taken = spans.select("place", (F.col("to_word") - F.col("from_word")).alias("words"), F.explode("shards").alias("shard")).groupBy("place", "shard").agg(F.sum("words").alias("words"))
    taken = taken.groupBy("place").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    none = F.array().cast("array<struct<shard:int,words:bigint>>")
    return placed.join(taken, "place", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", none).alias("shards"))


def copies(spans: list[tuple[int, int, list[int]]], by_shard: bool) -> list[tuple[int, list[list[int]]]]:
    """(shard, stretches of words) of each copy that is made of a document: a copy for each shard, or as few as there are times that its words are taken."""
    found: dict[tuple[int, int], list[list[int]]] = {}
    for a, b, shards in sorted(spans):
        for turn, shard in enumerate(shards):
            own = found.setdefault((shard, turn - shards.index(shard)) if by_shard else (0, turn), [])
            if own and own[-1][1] == a:
                own[-1][1] = b
            else:
                own.append([a, b])
    return [(key[0], own) for key, own in sorted(found.items())]


def _copies(text_col: str, schema: list[str], spans_col: str, shard_col: str | None):
    """Each row once for each copy that the mix makes of it, with the words that it takes then."""
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 500):
                batch, at, texts, shards = whole.slice(first, 500), [], [], []
                for i, (text, spans) in enumerate(zip(batch.column(text_col).to_pylist(), batch.column(spans_col).to_pylist())):
                    ends = [m.span() for m in word.finditer(text)]
                    for shard, runs in copies([(s["from_word"], s["to_word"], s["shards"]) for s in spans], bool(shard_col)):
                        at.append(i)
                        shards.append(shard)
                        texts.append(text if runs == [[0, len(ends)]] else "\n".join(text[ends[a][0] : ends[b - 1][1]] for a, b in runs))
                out = batch.select(schema).take(pa.array(at, pa.int64()))
                out = out.set_column(schema.index(text_col), batch.schema.field(text_col), pa.array(texts, batch.schema.field(text_col).type))
                yield out.append_column(shard_col, pa.array(shards, pa.int32())) if shard_col else out

    return run


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_col: str | None = None, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: rows whose texts are the words taken.

    With ``shard_col``, a row for each output shard that takes words of a document, and the shard's number in that new column. Without,
    the shards' words of a document stand together again: a row for each time that its words are taken, so documents stay as whole as they can.
    Stretches that don't touch are joined by a line feed; a document taken whole keeps its text as it is. Nulls, repeats and empty tables count as in ``mix_to_weights``.
    """
    held, row = numbered(docs)
    spans_col = free_name(held, "__mix_spans")
    rows = held.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    placed, spans = mixed_blocks(rows, **options)
    by_row = spans.groupBy("place").agg(F.collect_list(F.struct("from_word", "to_word", "shards")).alias(spans_col))
    by_row = placed.join(by_row, "place").select(F.col("row").alias(row), spans_col)
    names = docs.columns
    schema = StructType([f for f in docs.schema.fields])
    if shard_col:
        schema = schema.add(shard_col, "integer")
    return held.join(by_row, row).select(*names, spans_col).mapInArrow(_copies(text_col, names, spans_col, shard_col), schema)
