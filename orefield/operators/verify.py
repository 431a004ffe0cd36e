"""Checks of an enriched graph, and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions.strings import local_name
from orefield.operators.graph import match
from orefield.operators.terms import TEXTS, Texts
from orefield.schema import ONTO, TYPE


def data_integrity(base: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: triples lost, triples added, pass or fail. Both graphs as texts, or both as numbers of the same terms."""
    if dict(base.dtypes)["s"] == "bigint":
        keys = ["s", "p", "o"]
        sides = [g.select(*keys, F.lit(b).alias("b"), F.lit(1 - b).alias("e")) for b, g in ((1, base), (0, enriched))]
    else:
        # Triples meet by two hashes: 16 bytes cross the network in place of three texts.
        keys = ["h1", "h2"]
        hashes = F.xxhash64("s", "p", "o").alias("h1"), F.xxhash64(F.lit(1), "o", "s", "p").alias("h2")
        sides = [g.select(*hashes, F.lit(b).alias("b"), F.lit(1 - b).alias("e")) for b, g in ((1, base), (0, enriched))]
    marks = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.max("b").alias("b"), F.max("e").alias("e"))
    out = marks.agg(F.count_if((F.col("b") == 1) & (F.col("e") == 0)).alias("lost"), F.count_if((F.col("b") == 0) & (F.col("e") == 1)).alias("added"))
    return out.withColumn("status", F.when(F.col("lost") == 0, "PASS").otherwise("FAIL"))


def missing_inverses(triples: DataFrame, predicate: str, inverse: str) -> DataFrame:
    """(s, o) of links without their inverse."""
    return match(triples, p=predicate).join(match(triples, p=inverse, names=("o", "s")), ["s", "o"], "left_anti")


def missing_chains(triples: DataFrame, first: str, second: str, inferred: str) -> DataFrame:
    path = match(triples, p=first, names=("s", "x")).join(match(triples, p=second, names=("x", "o")), "x").select("s", "o").distinct()
    return path.join(match(triples, p=inferred), ["s", "o"], "left_anti")


def disjoint_violations(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s, class_a, class_b) of nodes that are of two classes that ``pairs`` (class_a, class_b) sets apart."""
    kinds = triples.filter(F.col("p") == TYPE).select("s", local_name(F.col("o")).alias("kind")).distinct()
    a = kinds.join(F.broadcast(pairs), F.col("kind") == F.col("class_a")).drop("kind")
    return a.join(kinds.withColumnRenamed("kind", "class_b"), ["s", "class_b"]).select("s", "class_a", "class_b")


def inference_ratio(base: DataFrame, enriched: DataFrame, low: float = 0.001, high: float = 0.5) -> DataFrame:
    """One row: sizes, share added and whether it is in the expected band."""
    sizes = base.agg(F.count("*").alias("n_base")).crossJoin(enriched.agg(F.count("*").alias("n_enriched")))  # two single rows
    ratio = F.round((F.col("n_enriched") - F.col("n_base")) / F.col("n_base"), 6)
    return sizes.withColumn("ratio", ratio).withColumn("status", F.when(F.col("ratio").between(low, high), "PASS").otherwise("WARN"))


def overall_status(checks: DataFrame) -> DataFrame:
    """The worst ``status`` of all checks."""
    rank = F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "WARN", 1).otherwise(2)
    worst = checks.agg(F.min(rank).alias("rank"))
    return worst.select(F.element_at(F.array(F.lit("FAIL"), F.lit("WARN"), F.lit("PASS")), (F.coalesce("rank", F.lit(2)) + 1).cast("int")).alias("status"))


def class_totals(triples: DataFrame) -> DataFrame:
    """One row: distinct materials by class, and how many have a capability."""
    count = lambda kind: F.count_distinct(F.when((F.col("p") == TYPE) & (F.col("o") == ONTO + kind), F.col("s")))
    return triples.agg(
        F.count("*").alias("n_triples"), count("MOF").alias("n_mof"), count("ExperimentalMOF").alias("n_experimental"), count("HypotheticalMOF").alias("n_hypothetical"),
        count("FunctionalizedMOF").alias("n_functionalized"), F.count_distinct(F.when(F.col("p") == ONTO + "hasCapability", F.col("s"))).alias("n_with_capability"),
    )


def capability_distribution(triples: DataFrame) -> DataFrame:
    """How many materials have each number of capabilities."""
    each = match(triples, p="hasCapability").groupBy("s").agg(F.count_distinct("o").alias("n_capabilities"))
    return each.groupBy("n_capabilities").agg(F.count("*").alias("n_mof"))


def sample_inferences(base: DataFrame, enriched: DataFrame, each: int = 5, terms: Texts = TEXTS) -> DataFrame:
    """The first ``each`` added triples of each predicate, as texts."""
    added = enriched.select("s", "p", "o").join(base.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    added = terms.text(terms.text(added, "s"), "o")
    return added.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("s", "o"))).filter(F.col("rn") <= each).drop("rn")


def read_back(written: DataFrame, read: DataFrame) -> DataFrame:
    """One row: triples written, triples read, those lost and those that came from nowhere, pass or fail."""
    keys = ["s", "p", "o", "o_kind", "datatype"]
    sizes = written.select(*keys, F.lit(1).alias("w"), F.lit(0).alias("r")).unionByName(read.select(*keys, F.lit(0).alias("w"), F.lit(1).alias("r"))).groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("r").alias("r"))
    out = sizes.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("n_written", F.col("w")), ("n_read", F.col("r")), ("lost", F.greatest(F.col("w") - F.col("r"), F.lit(0))), ("extra", F.greatest(F.col("r") - F.col("w"), F.lit(0))))])
    return out.withColumn("status", F.when((F.col("lost") == 0) & (F.col("extra") == 0), "PASS").otherwise("FAIL"))


def summary_difference(base: DataFrame, enriched: DataFrame) -> DataFrame:
    """(relation, n_added, ratio): what the enriched graph, or its additions alone, add to each relation, and its share of the base graph's size."""
    named = F.broadcast(enriched.select("p").distinct())  # a row per predicate: others of the base graph meet nothing
    known = base.select("s", "p", "o").join(named, "p", "left_semi").select("s", "p", "o")
    added = enriched.select("s", "p", "o").join(known, ["s", "p", "o"], "left_anti").groupBy(local_name(F.col("p")).alias("relation")).agg(F.count("*").alias("n_added"))
    return added.crossJoin(F.broadcast(base.agg(F.count("*").alias("n")))).select("relation", "n_added", F.round(F.col("n_added") / F.col("n"), 6).alias("ratio"))  # one row
