"""Merging and matching of records from several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_by_key(rows: DataFrame, key: str, order: str, unions: list[str], firsts: list[str], maps: list[str] = ()) -> DataFrame:
    """One row per key: sorted unions of array columns, the first non-null of others in source order, maps whose later entries win."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))
    cells = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in unions] + [first(c).alias(c) for c in firsts]
    out = rows.groupBy(key).agg(*cells)
    for m in maps:
        entries = rows.select(key, order, F.explode(m).alias("k", "v")).groupBy(key, "k").agg(F.max_by("v", order).alias("v"))
        out = out.join(entries.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(m)), key, "left")
    return out


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in others])).alias("x"))
    return best.select(key, *[F.col(f"x.__{c}").alias(c) for c in others])


def append(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def accumulate_relations(parts: dict[str, DataFrame], allowed: set[str]) -> DataFrame:
    """(rel_type, subject_id, object_id) of all parts; a type that is not allowed raises an error."""
    if unknown := set(parts) - allowed:
        raise ValueError(f"unknown relation types: {sorted(unknown)}")
    return append(*[df.select(F.lit(k).alias("rel_type"), F.col("subject_id").cast("string"), F.col("object_id").cast("string")) for k, df in parts.items()])


def relations_from_keys(rows: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """A relation for each foreign key that is not null, in one pass: relation type -> object."""
    cells = F.array(*[F.struct(F.lit(k).alias("rel_type"), F.col(subject).cast("string").alias("subject_id"), v.cast("string").alias("object_id")) for k, v in rules.items()])
    return rows.select(F.explode(cells).alias("r")).select("r.*").filter("object_id is not null")


def distinct_relations(relations: DataFrame) -> DataFrame:
    return relations.distinct().groupBy("rel_type").agg(F.count("*").alias("n"))


def lookup(rows: DataFrame, entities: DataFrame, keys: list[tuple[Column, Column]], entity_id: str, order: str) -> DataFrame:
    """``rows`` with ``match``: the entity whose first key that fits is equal; of several with one key the latest wins.

    ``keys``: pairs of a column of ``rows`` and one of ``entities``, in order of trust.
    """
    hits = []
    for i, (own, other) in enumerate(keys):
        table = entities.select(other.alias(f"__k{i}"), entity_id, order).filter(F.col(f"__k{i}").isNotNull()).groupBy(f"__k{i}").agg(F.max_by(entity_id, order).alias(f"__m{i}"))
        rows = rows.withColumn(f"__o{i}", own).join(table, F.col(f"__o{i}") == F.col(f"__k{i}"), "left").drop(f"__k{i}", f"__o{i}")
        hits.append(f"__m{i}")
    label = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in enumerate(hits)])
    return rows.withColumn("match", F.coalesce(*hits)).withColumn("match_step", label).drop(*hits)


def structural_match(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, mof_id): the first known material of the same topology whose linkers are all among the row's components.

    ``rows`` (row_id, topology, components), ``known`` (mof_id, topology, linkers), arrays of distinct strings.
    Each different set is looked up once, however many rows have it. Candidates share topology and the least linker of the known one, which must be among the components.
    """
    known = known.select("mof_id", "topology", F.array_sort("linkers").alias("linkers")).groupBy("topology", "linkers").agg(F.min("mof_id").alias("mof_id"))
    rows = rows.select("row_id", "topology", F.array_sort("components").alias("components"))
    parts = rows.select("topology", "components").distinct().withColumn("anchor", F.explode("components"))
    pairs = parts.join(known.withColumn("anchor", F.array_min("linkers")), ["topology", "anchor"])
    found = pairs.filter(F.size(F.array_except("linkers", "components")) == 0).groupBy("topology", "components").agg(F.min("mof_id").alias("mof_id"))
    return rows.join(found, ["topology", "components"]).select("row_id", "mof_id")


def restrict(children: dict[str, DataFrame], key: str, known: DataFrame) -> dict[str, DataFrame]:
    return {name: df.join(known.select(key).distinct(), key, "left_semi") for name, df in children.items()}


def unresolved(links: DataFrame, key: str, known: DataFrame, samples: int = 10) -> DataFrame:
    """(source, n, sample): links of each source whose key is unknown."""
    lost = links.join(known.select(key).distinct(), key, "left_anti").groupBy("source", key).agg(F.count("*").alias("n"))
    top = F.row_number().over(Window.partitionBy("source").orderBy(key))
    return lost.withColumn("__r", top).groupBy("source").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__r") <= samples, F.col(key)))).alias("sample"))


def generated_keys(rows: DataFrame, candidates: list[Column], prefix: str) -> DataFrame:
    """``rows`` with ``generated_id``: a hash of the first id that is not empty; rows without any id are left out."""
    first = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])
    return rows.withColumn("generated_id", F.concat(F.lit(prefix), F.upper(F.substring(F.md5(first), 1, 8)))).filter("generated_id is not null")
