"""Exact duplicates by naming blocks with integers, without a digest as identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.shared import cut, join_groups, numbered

#: What normalising deletes: space and the characters 09-0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def without_space(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE_SPACE, text)


def _route(block: Column, seed: int) -> Column:
    """128 bits that bring equal blocks together; names, not these bits, decide on equality."""
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("h2"))


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """Each distinct key with ``uses``, how often it occurs, and an integer name of its own: its place when keys are sorted."""
    return keys.groupBy(*by).agg(F.count("*").alias("uses")).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _with_names(rows: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the names of their keys; names that many rows share go to every task."""
    total = names.agg(F.sum("uses")).first()[0] or 0
    return join_groups(rows, names, by, "uses", total).drop("uses")


def identities(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_points, text_sha256, level, name.

    Two texts are equal when, and only when, level and name are. Blocks of ``block_bytes`` bytes are
    sorted into integer names; pairs of adjacent names are named again until one name is left.
    Whole blocks cross the network once, after each task has dropped its own repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    norm = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.char_length(text).alias("n_points"), without_space(text).cast("binary").alias("norm"))
    last = F.greatest(F.ceil(F.octet_length("norm") / block_bytes).cast("int") - 1, F.lit(0))
    blocks = F.when(last == 0, F.array("norm")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("norm"), i * block_bytes + 1, F.lit(block_bytes)))
    )
    seed = 0
    while True:
        found = norm.select(F.explode(blocks).alias("block")).select(_route(F.col("block"), seed).alias("route"), "block").select("route.*", "block")
        names = cut(_named(found, ["h1", "h2", "block"]).drop("block"), "block-names", release=True)
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
        seed += 1
    rows = cut(
        norm.select(
            "row", "doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"),
            F.transform(blocks, lambda b: _route(b, seed)).alias("routes"),
        ).withColumn("n", F.size("routes")),
        "block-rows", release=True,
    )
    known = ["row", "doc_id", "n_points", "text_sha256"]
    done = rows.filter("n = 1").select(*known, "routes")
    done = done.select(*known, F.col("routes")[0]["h1"].alias("h1"), F.col("routes")[0]["h2"].alias("h2"))
    done = _with_names(done, names, ["h1", "h2"])
    done = [done.select(*known, F.lit(0).alias("level"), "name")]
    most = rows.agg(F.max("n")).first()[0] or 1
    if most == 1:
        return done[0]
    now = rows.filter("n > 1").select("row", "n", F.posexplode("routes").alias("pos", "route")).select("row", "n", "pos", "route.*")
    now = cut(_with_names(now, names, ["h1", "h2"]).select("row", "n", "pos", "name"), "name-rows", release=True)
    for level in range(1, (most - 1).bit_length() + 1):
        pairs = now.groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.expr("cast((max(n) + 1) div 2 as int)").alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = cut(pairs, "name-pairs")
        again = cut(_named(pairs.select("a", "b"), ["a", "b"]), "pair-names")
        now = cut(_with_names(pairs, again, ["a", "b"]).select("row", "n", "pos", "name"), "name-rows")
        done.append(now.filter("n = 1").select("row", F.lit(level).alias("level"), "name").join(rows.select(*known), "row").select(*known, "level", "name"))
        now = now.filter("n > 1")
    return reduce(DataFrame.unionByName, done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16384, row_col: str | None = None) -> DataFrame:
    """Which rows hold equal texts once white space is deleted, and which of them stays.

    Returns a row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and
    ``row_col`` if named, a column of fixed numbers, one for each row.
    Null texts count as empty; empty texts are equal to each other. Of equal texts the one with the most
    code points stays, then the smallest id (null ids last); of repeated rows of one id exactly one is
    kept. An empty table gives an empty table; other columns of ``docs`` are not read.
    """
    rows = cut(identities(docs, id_col, text_col, block_bytes, row_col), "identities", release=True)
    best = F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    groups = cut(rows.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return join_groups(rows, groups, ["level", "name"], "group_size", rows.count()).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256",
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay of each group of equal texts, with all their columns."""
    held, row = numbered(docs)
    kept = exact_dedup(held, id_col, text_col, row_col=row, **options).filter("kept").select(row)
    return held.join(kept, row, "left_semi").drop(row)

