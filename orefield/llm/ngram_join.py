"""Jaccard join of documents on word shingles: size bands, hashed bitmaps, exact intersections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.components import components
from orefield.llm.shared import cut, join_groups, numbered
from orefield.llm.textnum import buffers, mix, words

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: A cost parameter only: this share of documents, by a hash, is looked at for shingles that many documents share.
HOT_SHARE = 16
#: At most so many of them are told to the tasks; they come last in the order of shingles.
HOT_MOST = 1 << 16
HOT_LEAST = 8
#: Up to so many rows of two numbers are sent to every task instead of being joined by a shuffle.
MOST_HELD = 1 << 21
#: Cost parameters only: a tile of more classes than this is cut into blocks of about as many.
BLOCK = 2048
#: Up to so many sharers of a shingle are told apart, and held in a task.
MOST_SHARERS = 1 << 16
#: A task forgets the sets that it has listed beyond so many.
MOST_LISTED = 1 << 15
#: Tasks over which the sharers of a widespread shingle are spread.
SALTS = 256
#: A cost parameter only: a class carries so many of its tiles, in order, to each of them, to tell which pairs have left from an earlier one.
FIRST_TILES = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; of a row with fewer words, its whole sequence as one."""
    value, row = words(data, offsets)
    n_rows = len(offsets) - 1
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)))
    total = np.zeros(max(len(value) - n_words + 1, 0), np.uint64)
    for i in range(n_words):
        total += mix(value[i : i + len(total)] + ODD[i % len(ODD)] * np.uint64(i // len(ODD) + 1))
    total = mix(total)
    out = []
    for r in range(n_rows):
        if count[r] >= n_words:
            out.append(np.unique(total[first[r] : first[r + 1] - n_words + 1]))
        elif count[r]:
            few = value[first[r] : first[r + 1]]
            out.append(mix(np.array([mix(few + ODD[: len(few)] * np.uint64(len(few) + 977)).sum(dtype=np.uint64)], np.uint64) + np.uint64(len(few))))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    """Two sets whose Jaccard is at least percent / 100 share one of the first so many elements of either, in any one order of all."""
    return n - -(-n * percent // 100) + 1


def ordered_prefix(elements: np.ndarray, percent: int, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """(the first elements of a sorted set in the order of all shingles, the ``hot`` ones last; how many of these are not hot)."""
    k = prefix_length(len(elements), percent) if len(elements) else 0
    if not len(hot) or not k:
        return elements[:k], k
    late = hot[np.minimum(np.searchsorted(hot, elements), len(hot) - 1)] == elements
    return np.concatenate((elements[~late][:k], elements[late][:k]))[:k], min(int((~late).sum()), k)


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    at = (values >> np.uint64(20)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return out


def width(n: int) -> int:
    """Bits of the bitmap of a set of n: at least eight for an element, from 64 to 8192."""
    return 1 << min(max(int(8 * n - 1).bit_length(), 6), 13)


def fold(maps: np.ndarray, n_bytes: int) -> np.ndarray:
    while maps.shape[-1] > n_bytes:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] | maps[..., half:]
    return maps


def may_link(map_a: np.ndarray, n_a: int, maps_b: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bit counts leave room for an overlap that links: a bit of one map alone stands for an element of one set alone."""
    only_a = np.bitwise_count(map_a & ~maps_b).sum(axis=1)
    only_b = np.bitwise_count(maps_b & ~map_a).sum(axis=1)
    most = np.minimum(n_a - only_a.astype(np.int64), n_b - only_b)
    return 100 * most >= percent * (n_a + n_b - most)


def set_id(elements: np.ndarray, seed: int) -> int:
    """A 64-bit number that equal sets share, as a signed one."""
    return int(mix(elements ^ mix(np.array([seed], np.uint64) + ODD[0])).sum(dtype=np.uint64).astype(np.int64))


PROFILE = "row long, doc_id long, n long, node long, proof long, prefix array<long>, n_plain int"


def _profile(n_words: int, percent: int, hot: np.ndarray, seed: int):
    """Per row: set size, two numbers that name the set, its first elements in the order (hot last, hash), and how many of those are not hot.

    A task lists the elements of a set once, however many copies it meets, as long as it remembers; listed again they do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: set[int] = set()
        for batch in batches:
            for first, data, offsets in buffers(batch.column("text")):
                sets, prefix, plain = shingle_sets(data, offsets, n_words), [], []
                names = [[set_id(s, x) for s in sets] for x in (2 * seed, 2 * seed + 1)]
                if len(listed) > MOST_LISTED:
                    listed.clear()
                for name, s in zip(names[0], sets):
                    own, n_plain = ordered_prefix(s[:0] if name in listed else s, percent, hot)
                    listed.add(name)
                    plain.append(n_plain)
                    prefix.append(own.view(np.int64))
                part = batch.slice(first, len(sets))
                flat = np.concatenate(prefix) if prefix else np.empty(0, np.int64)
                at = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in names), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64())), pa.array(plain, pa.int32())],
                    names=["row", "doc_id", "n", "node", "proof", "prefix", "n_plain"],
                )

    return run


def _sets(n_words: int, seed: int):
    """(node, elements): the name of each text's set, and the set; a task lists a set once, as long as it remembers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: set[int] = set()
        for batch in batches:
            for _, data, offsets in buffers(batch.column("text")):
                found = {set_id(s, 2 * seed): s for s in shingle_sets(data, offsets, n_words)}
                new = [x for x in found if x not in listed]
                if len(listed) > MOST_LISTED:
                    listed.clear()
                listed.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([found[x].tobytes() for x in new], pa.binary())], names=["node", "elements"])

    return run


def _signatures(n_words: int, seed: int):
    """(node, bits): the name of each text's set, and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in buffers(batch.column("text")):
                sets = shingle_sets(data, offsets, n_words)
                bits = [bitmap(s, width(len(s))).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s, 2 * seed) for s in sets], pa.int64()), pa.array(bits, pa.binary())], names=["node", "bits"])

    return run


def _hot(n_words: int):
    """Shingles that several documents of eight megabytes or a batch share, with how many do."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[np.ndarray] = [np.empty(0, np.uint64)]
            for _, data, offsets in buffers(batch.column("text")):
                parts += shingle_sets(data, offsets, n_words)
                if sum(map(len, parts)) > 1 << 20:
                    yield counted(parts)
                    parts = parts[:1]
            yield counted(parts)

    return run


def _shared(hot: np.ndarray):
    """Of rows sorted by shingle and set: each set once whose shingle others share, with about how many share it.

    The sharers of a hot shingle lie in several tasks, so all of them are kept. A run of more than MOST_SHARERS leaves in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, parted = np.empty((3, 0), np.int64), None

        def out(rows: np.ndarray) -> pa.RecordBatch:
            begin = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
            length = np.diff(np.append(begin, rows.shape[1]))
            sharers = np.minimum(np.repeat(length, length), MOST_SHARERS)
            if len(hot):
                value = rows[0].view(np.uint64)
                late = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value
                sharers[late] = np.minimum(sharers[late] * SALTS, MOST_SHARERS)
            if parted is not None:
                sharers[rows[0] == parted] = MOST_SHARERS
            return pa.RecordBatch.from_arrays([*(pa.array(x[sharers > 1]) for x in rows), pa.array(sharers[sharers > 1])], names=["shingle", "node", "n", "sharers"])

        for batch in batches:
            rows = np.concatenate((kept, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "node", "n")])), axis=1)
            if not rows.shape[1]:
                continue
            rows = rows[:, np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))]
            change = np.flatnonzero(rows[0] != rows[0][-1])
            done = change[-1] + 1 if len(change) else 0
            if done:
                yield out(np.ascontiguousarray(rows[:, :done]))
            kept = rows[:, done:].copy()
            if kept.shape[1] > MOST_SHARERS:
                parted = kept[0, 0]
                yield out(np.ascontiguousarray(kept[:, :-1]))
                kept = kept[:, -1:].copy()
        if kept.shape[1]:
            yield out(kept)

    return run


UNIT = ["shingle", "band", "band_b", "block", "block_b"]


def _in_blocks(tiles: DataFrame, percent: int, small) -> DataFrame:
    """``tiles`` with the units in which their pairs are compared: ``side`` and the columns of UNIT, a row for each unit of a class.

    A tile of up to BLOCK classes is one unit. A larger one is cut into bands of sizes, so wide that sets which link are in one band or in
    neighbours, and each band by a hash into blocks of about BLOCK classes; a unit is one block, or two of one band or of neighbours.
    """
    step = math.log(100 / percent) + 1e-6
    wide = tiles.groupBy("shingle").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK).select("shingle", F.lit(True).alias("wide"))
    marked = tiles.join(small(cut(wide, "wide-tiles")), "shingle", "left").withColumn("band", F.when(F.col("wide"), F.floor(F.log("n") / step).cast("long")))
    zero = F.lit(0).cast("long")
    whole = marked.filter("wide is null").select(*tiles.columns, F.lit(0).alias("side"), *[zero.alias(c) for c in UNIT[1:]])
    wide = marked.filter("wide")
    blocks = cut(wide.groupBy("shingle", "band").agg(F.ceil(F.count("*") / BLOCK).alias("own")), "blocks")
    beside = lambda name, by: blocks.select("shingle", (F.col("band") + by).alias("band"), F.col("own").alias(name))
    blocks = blocks.join(beside("below", 1), ["shingle", "band"], "left").join(beside("above", -1), ["shingle", "band"], "left")
    wide = wide.drop("wide").join(small(cut(blocks, "bands")), ["shingle", "band"]).withColumn("at", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("own")))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(zero, F.col(c) - 1)).otherwise(F.array().cast("array<long>"))
    unit = lambda side, *cells: F.struct(side.cast("int").alias("side"), *[v.cast("long").alias(c) for c, v in zip(UNIT[1:], cells)])
    at, band = F.col("at"), F.col("band")
    units = F.concat(
        F.transform(upto("own"), lambda j: unit(j < at, band, band, F.least(at, j), F.greatest(at, j))),
        F.transform(upto("above"), lambda j: unit(F.lit(0), band, band + 1, at, j)),
        F.transform(upto("below"), lambda j: unit(F.lit(1), band - 1, band, j, at)),
    )
    return whole.unionByName(wide.select(*tiles.columns, F.explode(units).alias("unit")).select(*tiles.columns, "unit.*"))


def _tile_pairs(percent: int):
    """Of rows sorted by (unit, n, set): pairs of one unit in different components that sizes and bitmaps let link.

    In a unit of two blocks, a pair has a class of either; in one of a single block, any two. ``met`` holds a class's first tiles in order; a pair that both
    lists show to have met in an earlier tile stays. It leaves from the first tile that both are in, and from a later one only where that first one is beyond the lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, tile = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            n, node, part, side = (np.array([t[i] for t in tile], np.int64) for i in range(4))

            def first_met(i: int, j: int) -> bool:
                x, y = tile[i][5], tile[j][5]
                before = x[: np.searchsorted(x, token[0])]
                return not len(before) or not (y[np.minimum(np.searchsorted(y, before), len(y) - 1)] == before).any()

            two = token[1] != token[2] or token[3] != token[4]
            a, b, found = [], [], 0
            by_width: dict[int, np.ndarray] = {}
            first = np.searchsorted(100 * n, percent * n)
            for i in range(1, len(tile)):
                other = np.arange(first[i], i)
                other = other[(part[other] != part[i]) & (side[other] != side[i])] if two else other[part[other] != part[i]]
                if not len(other):
                    continue
                size = len(tile[int(other[0])][4])
                if size not in by_width:
                    by_width[size] = np.stack([fold(np.frombuffer(t[4], np.uint8), size) if len(t[4]) >= size else np.zeros(size, np.uint8) for t in tile]).view(np.uint64)
                maps = by_width[size]
                good = other[may_link(maps[i], int(n[i]), maps[other], n[other], percent)]
                good = good[[first_met(i, j) for j in good.tolist()]] if len(good) else good
                if len(good):
                    a.append(np.full(len(good), node[i]))
                    b.append(node[good])
                    found += len(good)
                if found > 1 << 16:
                    yield named(a, b)
                    a, b, found = [], [], 0
            if found:
                yield named(a, b)

        def named(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            units = zip(*[batch.column(c).to_pylist() for c in UNIT])
            met, ends = batch.column("met").values.to_numpy(), batch.column("met").offsets.to_numpy()
            columns = [batch.column(c).to_pylist() for c in ("n", "node", "component", "side", "bits")] + [[met[a:b] for a, b in zip(ends, ends[1:])]]
            for t, rest in zip(units, zip(*columns)):
                if t != token and tile:
                    yield from pairs()
                    tile = []
                token = t
                tile.append(rest)
        if tile:
            yield from pairs()

    return run


def _exact(percent: int):
    """Of rows sorted by (b, salt, a), the one without an a first: pairs whose sorted arrays of elements overlap enough. A row may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, last = np.empty(0, np.uint64), None
        for batch in batches:
            keep = []
            for a, b, elements in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("elements")):
                if a is None or (a, b) == last:
                    if a is None:
                        x = np.frombuffer(elements.as_py(), np.uint64)
                    last = None if a is None else last
                    keep.append(False)
                    continue
                last = a, b
                y = np.frombuffer(elements.as_buffer(), np.uint64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80, row_col: str | None = None) -> DataFrame:
    """Which documents similar texts link, directly or through others.

    A document's set holds its distinct shingles of ``n_words`` words (A-Z lower-cased); of fewer words, the whole
    sequence; a null or empty text has an empty set and no links. Two documents link when
    100 * intersection >= ``percent`` * union. Returns a row for each row of ``docs``: row, doc_id, n_shingles,
    component_id (the smallest id of its component), class_id (a number of the component, null for an empty set), keep (true for one row of each component:
    the smallest id, null ids last); row is ``row_col`` if named, a column of fixed numbers, one for each row. Shingles count as equal when their 64-bit hashes are.

    Documents with equal sets form one class, found by grouping. Classes meet in tiles: a shingle among the
    first elements of both sets, in one order of all shingles in which widespread ones come last, and sizes
    in a ratio that lets them link. Every class is first held against one pivot of its tiles;
    what these exact links leave apart is then held against all others of its tiles, by bitmaps first, two bounded blocks at a time.
    A link between classes that others already connect is not looked for, as it changes no component.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    texts = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(HOT_SHARE)) == 0).select("text").mapInArrow(_hot(n_words), "shingle long, n long")
    some = some.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "shingle").limit(HOT_MOST)
    hot = np.sort(np.array([r[0] for r in some.select("shingle").collect()], np.int64).view(np.uint64))
    seed = 0
    while True:
        profile = cut(texts.select("row", "doc_id", "text").mapInArrow(_profile(n_words, percent, hot, seed), PROFILE), "profiles")
        classes = profile.filter("n > 0").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first"), ((F.min("proof") < F.max("proof")) | (F.min("n") < F.max("n"))).alias("mixed")
        )
        classes = cut(classes, "classes")
        if classes.filter("mixed").isEmpty():
            break
        seed += 1  # two different sets share a number: other numbers are tried

    met = profile.select("node", "n", "n_plain", F.posexplode("prefix").alias("at", "shingle"))
    salt = F.when(F.col("at") >= F.col("n_plain"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0)
    met = met.select("shingle", "node", "n", salt.cast("short").alias("salt")).repartition("shingle", "salt").sortWithinPartitions("shingle", "node")
    met = met.select("shingle", "node", "n").mapInArrow(_shared(hot), "shingle long, node long, n long, sharers long")
    met = cut(met, "tiles", release=True)

    def small(rows: DataFrame) -> DataFrame:
        """``rows``, sent to every task where there are few enough of them."""
        return F.broadcast(rows) if rows.limit(MOST_HELD + 1).count() <= MOST_HELD else rows

    def of_classes(nodes: DataFrame, run, schema: str) -> DataFrame:
        """What ``run`` makes of the text of each class's first row, for the classes of ``nodes``; where that row is repeated, it may come more than once."""
        wanted = cut(classes.join(nodes.distinct(), "node").select("node", F.col("first.doc_id").alias("id")), "wanted")
        again = texts.join(small(wanted.select("id").distinct()), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        return again.select("text").mapInArrow(run, schema).join(small(wanted.select("node")), "node", "left_semi")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs, those that link. A class that is in many pairs meets them in parts; each set is sent once for each of its pairs or parts."""
        shared = cut(pairs.groupBy("b").agg(F.count("*").alias("n_pairs")), "pairs-of-classes")
        pairs = join_groups(pairs, shared, ["b"], "n_pairs", pairs.count()).withColumn("salt", F.expr(f"pmod(xxhash64(a), ceil(n_pairs / {BLOCK}))"))
        roles = pairs.select(F.col("a").alias("node"), "a", "b", "salt").union(pairs.select(F.col("b").alias("node"), F.lit(None).cast("long"), "b", "salt").distinct())
        sets = of_classes(roles.select("node"), _sets(n_words, seed), "node long, elements binary").join(small(roles), "node")
        sets = sets.select("b", "salt", "a", "elements").repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
        return cut(sets.mapInArrow(_exact(percent), "a long, b long"), "exact-links", release=True)

    # A text that others were copied from shares most: each class is first held against the one class that is such a pivot
    # of most of its tiles. That is one pair for a class, however many copies of a text there are.
    fame = met.groupBy("node").agg(F.sum("sharers").alias("fame"))
    pivots = met.join(fame, "node").groupBy("shingle").agg(F.max(F.struct("fame", "node", "n")).alias("pivot")).select("shingle", F.col("pivot.node").alias("fit"), F.col("pivot.n").alias("m"))
    alike = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("node") != F.col("fit"))
    most = met.join(pivots, "shingle").filter(alike).groupBy("node", "fit").count().groupBy("node").agg(F.max(F.struct("count", "fit")).alias("met"))
    first = cut(most.select(F.col("node").alias("a"), F.col("met.fit").alias("b")), "first-pairs")
    links = linked(first)
    parts = components(links)
    tiles = cut(met.join(parts, "node", "left").select("shingle", "n", "node", F.coalesce("component", "node").alias("component")), "labelled-tiles")
    # Tiles with the same members hold the same pairs: one of them is looked at.
    own = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("key1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("key2")]
    apart = tiles.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), *own).filter("low <> high")
    apart = apart.groupBy("size", "key1", "key2").agg(F.min("shingle").alias("shingle")).select("shingle")
    tiles = cut(tiles.join(apart, "shingle", "left_semi"), "open-tiles", release=True)
    bits = of_classes(tiles.select("node"), _signatures(n_words, seed), "node long, bits binary").dropDuplicates(["node"])
    met_first = tiles.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("shingle")), 1, FIRST_TILES).alias("met"))
    bits = cut(bits.join(met_first, "node"), "signatures")
    rest = _in_blocks(tiles, percent, small).join(bits, "node").select(*UNIT, "n", "node", "component", "side", "bits", "met").repartition(*UNIT).sortWithinPartitions(*UNIT, "n", "node")
    rest = cut(rest.mapInArrow(_tile_pairs(percent), "a long, b long").distinct(), "more-pairs", release=True)
    rest = cut(rest.join(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "new-pairs")
    if not rest.isEmpty():
        parts = components(links.union(linked(rest)))

    known = classes.join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("class_id"))
    best = known.groupBy("class_id").agg(F.min("first").alias("best"))
    known = cut(known.join(best, "class_id").select("node", "class_id", "best"), "known")
    # A row with an empty set is a class of its own.
    key = F.when(F.col("n") > 0, F.col("node"))
    out = profile.select("row", "doc_id", "n", key.alias("node")).join(known, "node", "left")
    return out.select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        "class_id", F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("keep"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component of linked documents, with all columns; rows with an empty set all stay."""
    held, row = numbered(docs)
    kept = ngram_jaccard_join(held, id_col, text_col, row_col=row, **options).filter("keep").select(F.col("row").alias(row))
    return held.join(kept, row, "left_semi").drop(row)
