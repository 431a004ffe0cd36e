"""Patterns, node and edge tables, and filters over triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.strings import local_name
from orefield.schema import NAME_PREDICATES, ONTO, TYPE


def match(triples: DataFrame, s: str | None = None, p: str | list[str] | None = None, o: str | None = None, names: tuple[str, str] = ("s", "o")) -> DataFrame:
    """Subjects and objects of the triples that a pattern fits; ``p`` may be several predicates."""
    out = triples
    if s is not None:
        out = out.filter(F.col("s") == s)
    if p is not None:
        out = out.filter(F.col("p").isin([ONTO + x if "/" not in x else x for x in ([p] if isinstance(p, str) else p)]))
    if o is not None:
        out = out.filter(F.col("o") == o)
    return out.select(F.col("s").alias(names[0]), F.col("o").alias(names[1]))


def typed(triples: DataFrame, kind: str, name: str = "s") -> DataFrame:
    return match(triples, p=TYPE, o=ONTO + kind, names=(name, "o")).select(name)


def join_patterns(*patterns: DataFrame) -> DataFrame:
    """Joins patterns one after another on the variables that they share with those before."""
    out = patterns[0]
    for nxt in patterns[1:]:
        out = out.join(nxt, [c for c in out.columns if c in nxt.columns])
    return out


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns], "left")


def union_patterns(*patterns: DataFrame) -> DataFrame:
    out = patterns[0]
    for nxt in patterns[1:]:
        out = out.unionByName(nxt, allowMissingColumns=True)
    return out


def display_names(triples: DataFrame) -> DataFrame:
    """(node, name): by the first of the name predicates that a node has, its least name; else its local name."""
    nodes = triples.select(F.col("s").alias("node")).union(triples.filter("o_kind = 'uri'").select("o")).distinct()
    order = F.create_map(*[x for i, p in enumerate(NAME_PREDICATES) for x in (F.lit(ONTO + p), F.lit(i))])
    named = triples.filter(F.col("p").isin([ONTO + p for p in NAME_PREDICATES])).groupBy(F.col("s").alias("node")).agg(F.min(F.struct(F.get(F.array(order[F.col("p")]), F.lit(0)).alias("i"), F.col("o").alias("name"))).alias("best"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("best.name", local_name(F.col("node"))).alias("name"))


def node_table(triples: DataFrame) -> DataFrame:
    """(node, types): every subject and linked object with its sorted types."""
    nodes = triples.select(F.col("s").alias("node")).union(triples.filter((F.col("o_kind") == "uri") & (F.col("p") != TYPE)).select("o")).distinct()
    types = triples.filter(F.col("p") == TYPE).groupBy(F.col("s").alias("node")).agg(F.array_sort(F.collect_set(local_name(F.col("o")))).alias("types"))
    return nodes.join(types, "node", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def edge_table(triples: DataFrame) -> DataFrame:
    """(source, relation, target, target_kind, datatype) of all triples but types."""
    return triples.filter(F.col("p") != TYPE).select(F.col("s").alias("source"), local_name(F.col("p")).alias("relation"), F.col("o").alias("target"), F.col("o_kind").alias("target_kind"), "datatype")


def without_leaks(triples: DataFrame, drop: list[str], parts: list[str] = ("Owner", "usedIn", "isComponent")) -> DataFrame:
    """Triples whose predicate is not in ``drop`` and holds none of ``parts``."""
    name = local_name(F.col("p"))
    keep: Column = ~name.isin(list(drop))
    for part in parts:
        keep = keep & ~name.contains(part)
    return triples.filter(keep)


def without_literals(triples: DataFrame) -> DataFrame:
    return triples.filter("o_kind <> 'literal'")


def simple_graph(triples: DataFrame) -> DataFrame:
    """(a, b): each pair of linked nodes once in either direction, no self-loops."""
    pairs = triples.filter("o_kind <> 'literal' and s <> o").select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def support_lists(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """(s, one array column per predicate): sorted local names of the objects."""
    rows = triples.filter(F.col("p").isin([ONTO + p for p in predicates])).select("s", local_name(F.col("p")).alias("p"), local_name(F.col("o")).alias("o"))
    return rows.groupBy("s").agg(*[F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(p) for p in predicates])


def relation_sizes(triples: DataFrame, least: int = 1) -> DataFrame:
    return triples.groupBy(local_name(F.col("p")).alias("relation")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def graph_statistics(triples: DataFrame) -> DataFrame:
    """Nodes by type and edges by predicate."""
    nodes = triples.filter(F.col("p") == TYPE).groupBy(local_name(F.col("o")).alias("name")).agg(F.countDistinct("s").alias("n")).withColumn("what", F.lit("node"))
    edges = triples.groupBy(local_name(F.col("p")).alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    return nodes.unionByName(edges)
