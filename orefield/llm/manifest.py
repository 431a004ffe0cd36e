"""A Merkle manifest of a dataset: leaf coordinates by rank in bitmaps, levels by arrays keyed by slot."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.llm.prefix_sums import global_prefix
from orefield.llm.shared import cut

FAN_OUT = 16
#: How many bits of a word's number each level of the popcount directory adds: no group holds more than 2 to the 16 rows.
DIRECTORY = (10, 16, 16)
#: The word of null ids: before every word of 64 ids.
NO_ID = -(1 << 57) - 1
c = F.col


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (group, doc_id, leaf and others) with ``slot``, the row's place in its group by doc_id, and ``n``, the group's rows.

    Ids of a group are ORed into words of 64 bits; words hold counts, and a directory of four levels holds the sums before each word, before each
    1,024 words and twice before 65,536 of what is below. A row's slot is what the directory holds before its word and
    the bits below its own, so ids are never sorted. Rows that share an id, or have none (these come first), have no bit of their own: the words that hold them
    are ranked by (id, leaf) in ranges.
    """
    at = F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_ID))
    rows = rows.withColumn("word", at)
    words = rows.groupBy("group", "word").agg(F.expr("coalesce(bit_or(shiftleft(1L, cast(doc_id & 63 as int))), 0L)").alias("bits"), F.count("*").alias("n"))
    words = cut(words, "bitmap-words")
    levels, key = [words], "word"
    for i, bits in enumerate(DIRECTORY):
        up = f"up{i}"
        levels[-1] = levels[-1].withColumn(up, F.shiftright(key, bits))
        levels.append(levels[-1].groupBy("group", up).agg(F.sum("n").alias("n")))
        key = up
    sums = lambda df, by, of: df.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("group", *by).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = sums(levels[-1], [], key).withColumn("total", F.sum("n").over(Window.partitionBy("group"))).select("group", key, "before", "total")
    for i in reversed(range(len(DIRECTORY))):
        up, own = f"up{i}", f"up{i - 1}" if i else "word"
        below = sums(levels[i], [up], own)
        kept = ["group", own, *(["bits", "n"] if not i else [])]
        whole = below.join(whole.withColumnRenamed("before", "start"), ["group", up]).select(*kept, (F.col("before") + F.col("start")).alias("before"), "total")
    found = rows.join(whole, ["group", "word"])
    plain = F.bit_count("bits") == F.col("n")
    bit = F.expr("bits & ~shiftleft(-1L, cast(doc_id & 63 as int))")
    out = found.filter(plain).withColumn("slot", F.col("before") + F.bit_count(bit)).select(*rows.columns, "slot", F.col("total").alias("n"))
    if not words.filter(~plain).isEmpty():
        shared = found.filter(~plain).withColumn("size", F.lit(1).cast("long"))
        shared = cut(global_prefix(shared, "group", "word", "doc_id", "leaf")[0], "shared-ids")
        first = shared.groupBy("group", "word").agg(F.min("place").alias("first"))
        shared = shared.join(first, ["group", "word"]).withColumn("slot", F.col("before") + F.col("place") - F.col("first"))
        out = out.unionByName(shared.select(*rows.columns, "slot", F.col("total").alias("n")))
    return out.drop("word")


def reduced(nodes: DataFrame, tallest: int, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """(runs by level, tops): trees over ``nodes`` (group, slot, hash, n and others), a tree for each group.

    A level's runs are (group, slot, n, nodes): ``slot`` is the run's own place among its level's results, ``n`` how many nodes its level has.
    ``tops`` has (group, hash) of what remains.
    """
    kept = [x for x in nodes.columns if x not in ("group", "n")]
    runs, tops = [], [nodes.filter("n = 1").select("group", "hash")]
    while tallest > 1:
        level = nodes.filter("n > 1").groupBy("group", F.expr(f"slot div {fan_out}").alias("run")).agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("nodes"), F.first("n").alias("n"))
        level = cut(level.withColumn("hash", F.sha2(F.concat_ws("", "nodes.hash"), 256)), "runs")
        runs.append(level)
        nodes = level.select("group", F.col("run").alias("slot"), "hash", F.ceil(F.col("n") / fan_out).alias("n"))
        tops.append(nodes.filter("n = 1").select("group", "hash"))
        kept, tallest = ["slot", "hash"], -(-tallest // fan_out)
    return runs, reduce(DataFrame.unionByName, tops)


def paths(runs: list[DataFrame], tops: DataFrame, lone: DataFrame, fan_out: int) -> DataFrame:
    """Each node of the lowest level with ``path``: for each level up to the root the digests that stand before and behind.

    ``tops`` has (group, above, and others) for each tree, ``above`` being the path from the tree's top; ``lone`` are the nodes of trees of one node.
    """
    more = [x for x in tops.columns if x not in ("group", "above")]
    node = runs[0].schema["nodes"].dataType.elementType.names if runs else []
    out = [lone.join(tops.withColumnRenamed("above", "path"), "group")]
    inner = None
    for level in reversed(range(len(runs))):
        last = F.ceil(F.col("n") / fan_out) == 1
        now = runs[level].filter(last).join(tops, "group").select("group", "nodes", "above", *more)
        if inner is not None:
            now = now.unionByName(runs[level].filter(~last).join(inner.withColumnRenamed("slot", "run"), ["group", "run"]).select("group", "nodes", "above", *more))
        beside = F.struct(
            F.concat_ws("", F.slice(F.col("nodes.hash"), F.lit(1), F.col("i"))).alias("before"),
            F.concat_ws("", F.slice(F.col("nodes.hash"), F.col("i") + 2, F.lit(fan_out))).alias("behind"),
        )
        now = now.select("group", "nodes", "above", *more, F.posexplode("nodes").alias("i", "node"))
        now = now.select("group", "node.*", F.concat(F.array(beside), "above").alias("path"), *more)
        if level:
            inner = now.select("group", "slot", F.col("path").alias("above"), *more)
        else:
            out.append(now.select("group", *node, "path", *more))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["behind"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda p: F.concat(p["before"], p["behind"])))


def lower_cased(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", id_col: str = "doc_id", text_col: str = "text", fan_out: int = FAN_OUT, tampered_share: int = 5) -> DataFrame:
    """A leaf for each row, a tree for each group, and a tree over the groups' roots.

    Returns group, doc_id, leaf, tampered_leaf, subroot, root and path (an array of what stands before and behind at each level, from which a proof is checked with
    ``folded``). ``tampered_leaf`` is the leaf of the row with its text in lower case (A-Z) where ``tampered_share`` divides the
    crc32 of its decimal id, else the leaf. A null value is told apart from an empty one; null groups come first. Rows of one id
    are leaves of their own, in the order of their leaves, and rows without an id come before the others of their group. Ids are 64-bit integers. Columns that are not named are not read.
    An empty table gives an empty manifest.
    """
    group = F.coalesce(F.concat(F.lit("v"), F.col(group_col).cast("string")), F.lit(""))
    value = lambda name, text: encoded(text if name == text_col else F.col(name))
    leaf = lambda text: digest(*(value(name, text) for name in columns))
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % tampered_share == 0
    rows = docs.select(
        group.alias("group"), F.col(id_col).cast("long").alias("doc_id"), leaf(F.col(text_col)).alias("leaf"),
        F.when(tampered, leaf(lower_cased(F.col(text_col)))).alias("tampered_leaf"),
    )
    rows = cut(rows, "leaves")
    leaves = cut(ranks(rows), "slots").select("group", "slot", F.col("leaf").alias("hash"), "n", "doc_id", "tampered_leaf")
    runs, subroots = reduced(leaves, leaves.agg(F.max("n")).first()[0] or 0, fan_out)
    subroots = cut(subroots, "subroots")
    places, n_groups = global_prefix(subroots.withColumn("size", F.lit(1).cast("long")), "group")
    places = places.select(F.lit("").alias("group"), F.col("start").alias("slot"), "hash", F.lit(n_groups).cast("long").alias("n"), F.col("group").alias("of"))
    upper, root = reduced(places, n_groups, fan_out)
    nothing = F.array().cast("array<struct<before:string,behind:string>>")
    top = root.select("group", nothing.alias("above"), F.col("hash").alias("root"))
    tops = paths(upper, top, places.filter("n = 1").drop("n"), fan_out)
    tops = cut(tops.select(F.col("of").alias("group"), F.col("path").alias("above"), F.col("hash").alias("subroot"), "root"), "group-paths")
    out = paths(runs, tops, leaves.filter("n = 1").drop("n"), fan_out)
    return out.select(
        F.when(F.col("group") != "", F.substring("group", 2, 1 << 30)).alias("group"), "doc_id", F.col("hash").alias("leaf"),
        F.coalesce("tampered_leaf", "hash").alias("tampered_leaf"), "subroot", "root", "path",
    )


def manifest_check(docs: DataFrame, **options) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's proof, checked with its tampered leaf."""
    rows = merkle_manifest(docs, **options)
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.col("tampered_leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
