"""A graph's texts written once, each under a 64-bit number; its triples as numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefield.sources import stored

#: Low bits of a number tell texts of one hash apart.
RANK_BITS = 8
#: A term that stands in more than one of so many places of the graph is a hub; there are fewer hubs than that.
HUBS = 1024
#: Rows of a hub are dealt into so many parts where they meet their text.
SALTS = 256
TERMS, CLASHES = "id long, text string, hub boolean", "text string, rank int"


class Texts:
    """Terms that are texts already."""

    def of(self, text: str) -> Column:
        return F.lit(text)

    def text(self, rows: DataFrame, name: str) -> DataFrame:
        return rows

    def number(self, rows: DataFrame, name: str) -> DataFrame:
        return rows

    def different(self, rows: DataFrame, name: str) -> DataFrame:
        """(name, text): the different terms of a column, with their texts."""
        return self.text(rows.select(name).distinct().withColumn("text", F.col(name)), "text")


@dataclass(frozen=True)
class Terms(Texts):
    """Numbers for texts. A number is a text's hash, and its rank among the texts of the graph that share that hash, by code point; nearly all ranks are 0.

    ``table`` (id, text, hub) has a row for each text, ``clashes`` (text, rank) one for each rank above 0: about one in 2 ** 57 of all pairs of texts.
    Null stays null. A text that was not written has no number of its own: ``of`` and ``number`` are for texts of the graph and those that ``write`` was told of.
    """

    table: DataFrame
    clashes: DataFrame
    hash_bits: int = 64 - RANK_BITS

    def of(self, text: str) -> Column:
        """The number of a text, as a constant."""
        rank = self.clashes.filter(F.col("text") == text).select("rank").head()  # at most one row
        return _hash(F.lit(text), self.hash_bits) + F.lit(rank[0] if rank else 0)

    def text(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the numbers of a column replaced by their texts. Hubs' texts go to every task, and their rows do not meet by number."""
        hubs = self.table.filter("hub").select(F.col("id").alias(name), F.col("text").alias("__hub"))
        salt = F.when(F.col("__hub").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)) + 1).otherwise(0)
        marked = rows.join(F.broadcast(hubs), name, "left").withColumn("__salt", salt)
        found = self.table.filter(~F.col("hub")).select(F.col("id").alias(name), F.col("text").alias("__text"), F.lit(0).cast("long").alias("__salt"))
        return marked.join(found, [name, "__salt"], "left").withColumn(name, F.coalesce("__hub", "__text")).select(*rows.columns)

    def number(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the texts of a column replaced by their numbers."""
        return _numbered(rows, name, self.clashes, self.hash_bits)


TEXTS = Texts()


def _hash(text: Column, bits: int) -> Column:
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), RANK_BITS)


def _numbered(rows: DataFrame, name: str, clashes: DataFrame, bits: int) -> DataFrame:
    ranks = clashes.select(F.col("text").alias(name), F.col("rank").alias("__rank"))
    number = F.when(F.col(name).isNotNull(), _hash(F.col(name), bits) + F.coalesce("__rank", F.lit(0)))
    return rows.join(ranks, name, "left").withColumn(name, number).select(*rows.columns)


def write(triples: DataFrame, path: str, folders: list[str], more: list[str] = (), hash_bits: int = 64 - RANK_BITS) -> None:
    """Write the texts of ``triples`` (s, p, o and other columns), and of ``more``, and the triples with s and o as numbers.

    Triples are in folders by the columns ``folders``, and within a file in order of s. A text is moved once to be counted; triples are numbered
    where they are read, without a shuffle, and only then told apart, so repeated ones may be given. An empty graph gives empty tables. More than 256 texts of one hash raise an error.
    """
    spark = triples.sparkSession
    ends = triples.select(F.explode(F.array("s", "o")).alias("text"))
    if more:
        ends = ends.unionByName(spark.createDataFrame([(t,) for t in more], "text string"))
    counted = ends.filter("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    counted.select(_hash(F.col("text"), hash_bits).alias("id"), "text", "n").write.parquet(f"{path}/counted")
    counted = spark.read.schema("id long, text string, n long").parquet(f"{path}/counted")
    shared = counted.groupBy("id").agg(F.count("*").alias("sharers")).filter("sharers > 1").select("id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("text")) - 1
    rank = F.when(rank < 1 << RANK_BITS, rank).otherwise(F.raise_error(F.lit("too many texts share a hash")).cast("int"))
    ranks = counted.join(shared, "id", "left_semi").select("text", rank.alias("rank"))
    ranks.filter("rank > 0").write.parquet(f"{path}/clashes")
    clashes = spark.read.schema(CLASHES).parquet(f"{path}/clashes")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = counted.join(clashes, "text", "left").select((F.col("id") + F.coalesce("rank", F.lit(0))).alias("id"), "text", (F.col("n") * HUBS > total).alias("hub"))
    kept.write.partitionBy("hub").parquet(f"{path}/terms")
    stored.delete(counted)
    stored.release(spark)
    numbers = _numbered(_numbered(triples, "s", clashes, hash_bits), "o", clashes, hash_bits)
    numbers.distinct().sortWithinPartitions(*folders, "s").write.partitionBy(*folders).parquet(f"{path}/triples")
    stored.release(spark)


def read(spark: SparkSession, path: str, hash_bits: int = 64 - RANK_BITS) -> Terms:
    return Terms(spark.read.schema(TERMS).parquet(f"{path}/terms"), spark.read.schema(CLASHES).parquet(f"{path}/clashes"), hash_bits)
