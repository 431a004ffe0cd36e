"""Ranked lexical search: lists in order of impact are read from the top, with score intervals, until the best are settled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from orefield.llm.prefix_sums import global_prefix
from orefield.llm.shared import cut
from orefield.llm.textnum import LOWER, buffers, hashes, runs

#: Bytes of terms: digits, letters and all of UTF-8 beyond ASCII.
TERM = np.zeros(256, np.uint8)
TERM[128:] = 1
TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
#: Bits of the fixed table that tells which terms any item has; items that are searched at once; documents whose lists are held at once.
TABLE_BITS = 1 << 22
ITEM_BLOCK = 1024
DOC_BLOCK = 1 << 14
#: Postings that are read of each list first; each later round reads twice as many.
FIRST_READ = 64
SCALE = 1_000_000_000


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each term of a buffer, A-Z lower-cased."""
    start, end, row = runs(TERM[data], offsets)
    return hashes(LOWER[data], start, end).view(np.int64), row


def folded_terms(term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of distinct terms of rows."""
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])))) if len(term) else np.zeros(0, np.int64)
    return row[first], term[first], np.diff(np.append(first, len(term)))


def _lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), pa.int32()), pa.array(values, kind))


def _indexer(table: np.ndarray | None):
    """Rows (id, text) to rows (id, n, terms, counts); only terms whose bit is set in ``table`` are listed."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in buffers(batch.column(1)):
                term, row = terms_of(data, offsets)
                rows = len(offsets) - 1
                n = np.bincount(row, minlength=rows)
                if table is not None:
                    bit = term & (TABLE_BITS - 1)
                    known = (table[bit >> 6] >> (bit & 63)) & 1 == 1
                    term, row = term[known], row[known]
                row, term, count = folded_terms(term, row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(n, pa.int64()), _lists(term, row, rows, pa.int64()), _lists(count, row, rows, pa.int32())],
                    names=["id", "n", "terms", "counts"],
                )

    return index


def indexed(texts: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """``texts`` (id long, text): id, n terms, distinct terms as 64-bit hashes and their counts; null texts have none."""
    schema = StructType().add("id", LongType()).add("n", LongType()).add("terms", ArrayType(LongType())).add("counts", ArrayType(IntegerType()))
    return texts.mapInArrow(_indexer(table), schema)


class ImpactLists:
    """Postings of a block of documents, those of each term in order of falling impact."""

    def __init__(self, terms: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray):
        impact = SCALE * tf // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-impact, term))
        self.terms, self.doc, self.impact = terms, doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(terms) + 1))
        #: The least impact that any term can have in a document: that of one occurrence.
        self.least = SCALE // (1000 + 8 * m)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold the ``k`` best of the block and all their ties, if their score reaches ``known``.

        No-random-access reading: each round reads on in every list. A document's score lies between what was read of it
        and that plus, for each list in which it was not met, the last impact read there; or nothing there, if even one occurrence would have
        stood above that. Reading ends when every document whose upper bound reaches the k-th lower bound has one value left.
        """
        place = np.searchsorted(self.terms, terms)
        held = place < len(self.terms)
        held[held] = self.terms[place[held]] == terms[held]
        place, weights = place[held], weights[held]
        at, end = self.first[place], self.first[place + 1]
        low, unmet = np.zeros(len(self.least), np.int64), np.ones((len(place), len(self.least)), bool)
        step = FIRST_READ
        while True:
            high = low.copy()
            for i in range(len(place)):
                stop = min(at[i] + step, end[i])
                met = self.doc[at[i] : stop]
                low[met] += weights[i] * self.impact[at[i] : stop]
                unmet[i, met] = False
                at[i] = stop
            high[:] = low
            for i in range(len(place)):
                if at[i] < end[i]:
                    last = self.impact[at[i] - 1]
                    high += (weights[i] * last) * (unmet[i] & (self.least <= last))
            bound = max(known, 1, int(np.partition(low, -k)[-k]) if len(low) >= k else 0)
            open_ = np.flatnonzero(high >= bound)
            if (low[open_] == high[open_]).all():
                return open_, low[open_]
            step *= 2


def _order(score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.lexsort((doc, ~known, -score))


def _searcher(items: list[tuple[int, np.ndarray, np.ndarray]], k: int, n_docs: int, n_terms: int):
    """Rows of the index to rows (item, doc_id, score): for each item the best of the task's documents."""
    vocabulary = np.unique(np.concatenate([t for _, t, _ in items])) if items else np.zeros(0, np.int64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
            term, tf = batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), lengths)
            place = np.minimum(np.searchsorted(vocabulary, term), max(len(vocabulary) - 1, 0))
            real = vocabulary[place] == term if len(vocabulary) else np.zeros(len(term), bool)
            ids = batch.column("id")
            held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), n, place[real], row[real] + size, tf[real].astype(np.int64)))
            size += len(n)
            if size >= DOC_BLOCK:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for ids, known, n, term, doc, tf in blocks(batches):
            lists = ImpactLists(vocabulary, term, doc, tf, 10 + 90 * n * n_docs // n_terms)
            for i, (_, terms, weights) in enumerate(items):
                score, doc_id, has_id = found[i]
                at, more = lists.best(terms, weights, k, int(score[-1]) if len(score) == k else 0)
                score, doc_id, has_id = np.append(score, more), np.append(doc_id, ids[at]), np.append(has_id, known[at])
                best = _order(score, doc_id, has_id)[:k]
                found[i] = score[best], doc_id[best], has_id[best]
        out = [(item, *x) for (item, _, _), rows in zip(items, found) for x in zip(*rows)]
        if out:
            item, score, doc_id, has_id = map(np.array, zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64(), mask=~has_id), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return search


def nra_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item, ties by ascending id.

    Texts are read once, into an index of the terms that any item has; a table of ``TABLE_BITS`` bits of their hashes, of fixed size, goes to every task, and what it lets through by
    chance does no harm. Documents' lists are never gathered by term: each task holds those of ``DOC_BLOCK`` documents, reads them by impact and
    hands its best of an item on as the next block's bound, so a very frequent term needs no list of its own. Items are searched ``ITEM_BLOCK`` at a time. Terms are told apart by 64-bit hashes.
    Null and empty texts of either side match nothing; repeated rows of documents are documents of their own and repeated rows of items are items of their own;
    null document ids come last among equal scores. Empty tables give an empty result; other columns are not read.
    """
    held = cut(items.select(F.monotonically_increasing_id().alias("id"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "items")
    questions = indexed(held.select("id", "text")).filter("n > 0").join(held.select("id", "item_id"), "id").select("item_id", "terms", F.lit(1).cast("long").alias("size"))
    questions, n_items = global_prefix(questions, "item_id")
    questions = cut(questions.select(F.col("place").alias("item"), "item_id", "terms"), "numbered-items")
    terms = questions.select("item", F.explode("terms").alias("term"))
    bit = F.col("term").bitwiseAND(F.lit(TABLE_BITS - 1).cast("long"))
    words = terms.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(term & 63 as int)))").alias("bits")).collect()
    table = np.zeros(TABLE_BITS >> 6, np.int64)
    table[[w for w, _ in words]] = [b for _, b in words]
    index = cut(indexed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), table), "impact-index")
    n_docs, n_terms = index.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    found = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * (n_docs or 0) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = cut(terms.join(found, "term").select("item", "term", weight.alias("weight")).filter("weight > 0").groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms")), "weighted-items")
    schema = StructType().add("item", LongType()).add("doc_id", LongType()).add("score", LongType())
    best = []
    for first in range(0, max(n_items, 1), ITEM_BLOCK):
        some = weighted.filter((F.col("item") >= first) & (F.col("item") < first + ITEM_BLOCK)).collect()  # at most ITEM_BLOCK rows
        some = [(r.item, *np.array(sorted(map(tuple, r.terms)), np.int64).T) for r in some]
        best.append(index.filter(F.size("terms") > 0).mapInArrow(_searcher(some, k, n_docs or 0, n_terms or 1), schema))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = reduce(DataFrame.unionByName, best).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(questions.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
