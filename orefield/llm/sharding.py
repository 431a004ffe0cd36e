"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.prefix_sums import global_prefix
from orefield.llm.shared import cut, join_groups


def balanced_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", whole_share: float = 1 / 64) -> DataFrame:
    """Put every row in one of ``n_shards`` contiguous stretches of near equal bytes.

    Rows stand in the order of (md5 of the text, id), so equal texts are neighbours. A row's size is its
    text's UTF-8 bytes plus 1 (null: 1, and equal to an empty text). A shard begins where the sum of the
    sizes before a row passes the next multiple of total / n_shards; a group of equal texts of at most
    ``whole_share`` of a shard goes whole to the shard where it begins, a larger one is cut between rows.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Repeated rows are rows like others, null ids
    come first among equal texts; with fewer rows than shards some shards are empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_key"))
    rows, total = global_prefix(rows, "text_key", "doc_id")
    total = max(total, 1)
    groups = rows.groupBy("text_key").agg(F.min("start").alias("group_start"), F.sum("size").alias("group_size"), F.count("*").alias("n"))
    groups = cut(groups.filter((F.col("n") > 1) & (F.col("group_size") <= total / n_shards * whole_share)).select("text_key", "group_start", "n"), "whole-groups")
    begin = F.coalesce("group_start", "start")
    rows = cut(join_groups(rows, groups, ["text_key"], "n", rows.count()).withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(begin * n_shards / F.lit(total))).cast("int")), "sharded")
    first = rows.groupBy("shard").agg(F.min("place").alias("first_place"))
    first = spark.createDataFrame(first.collect(), first.schema)  # a row per shard
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
