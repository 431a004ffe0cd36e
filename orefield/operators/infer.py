"""Facts that rules derive from a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions.strings import local_name, names_match
from orefield.operators.graph import match
from orefield.operators.terms import TEXTS, Texts
from orefield.schema import ONTO, PROPERTY_TYPES, TYPE


def as_links(rows: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select("s", "p", "o", F.lit("uri").alias("o_kind"), null.alias("datatype"), null.alias("lang"))


def property_chains(triples: DataFrame, chains: DataFrame, terms: Texts = TEXTS) -> DataFrame:
    """New triples (s, r, o) for s -p-> x -q-> o, s a material; ``chains`` (first, second, inferred) is a table of rules.

    Of a graph whose s and o are numbers (``terms``), so are those of what is found; here and below.
    """
    rules = F.broadcast(chains.select(*[F.concat(F.lit(ONTO), c).alias(c) for c in ("first", "second", "inferred")]))
    left = triples.filter("o_kind = 'uri'").join(rules, F.col("p") == F.col("first")).select("s", F.col("o").alias("x"), "second", "inferred")
    materials = triples.filter((F.col("p") == TYPE) & (F.col("o") == terms.of(ONTO + "MOF"))).select("s")
    left = left.join(materials, "s", "left_semi")
    # Only the rules' predicates are read and shuffled.
    right = triples.filter("o_kind = 'uri'").select(F.col("s").alias("x"), F.col("p").alias("second"), "o").join(F.broadcast(rules.select("second").distinct()), "second", "left_semi")
    found = left.join(right, ["x", "second"]).select("s", F.col("inferred").alias("p"), "o").distinct()
    known = triples.select("s", "p", "o").join(F.broadcast(rules.select(F.col("inferred").alias("p")).distinct()), "p", "left_semi")
    return as_links(found.join(known, ["s", "p", "o"], "left_anti"))


def owned_properties(triples: DataFrame) -> DataFrame:
    """(s, node): materials and their property nodes, by links of either direction."""
    forward = match(triples, p=[f"has{t}" for t in PROPERTY_TYPES], names=("s", "node"))
    back = match(triples, p=[f"has{t}Owner" for t in PROPERTY_TYPES], names=("node", "s")).select("s", "node")
    return forward.unionByName(back).distinct()


def property_values(triples: DataFrame) -> DataFrame:
    """(s, node, name, value, unit)."""
    name = match(triples, p="hasPropertyName", names=("node", "name"))
    value = match(triples, p="hasValue", names=("node", "text")).select("node", F.col("text").try_cast("double").alias("value"))
    unit = match(triples, p="hasUnits", names=("node", "unit"))
    return owned_properties(triples).join(name, "node").join(value, "node", "left").join(unit, "node", "left").select("s", "node", "name", "value", "unit")


def capabilities_from_names(triples: DataFrame, rules: DataFrame, terms: Texts = TEXTS) -> DataFrame:
    """(s, capability, rule_id) where a property's name matches a rule's (rule_id, property, capability), unless s links to it already."""
    return _new(triples, _owners(triples, _named(triples, rules, terms)), terms)


def _named(triples: DataFrame, rules: DataFrame, terms: Texts) -> DataFrame:
    """(node, capability, rule_id)."""
    names = match(triples, p="hasPropertyName", names=("node", "name"))
    # Rules meet the different names, which are few; rows then meet them by equality.
    fits = terms.different(names, "name").join(F.broadcast(rules), names_match(F.col("text"), F.col("property"))).select("name", "capability", "rule_id")
    return names.join(F.broadcast(fits), "name").select("node", "capability", "rule_id")


def capabilities_from_functionalization(triples: DataFrame, word: str, capability: str, rule_id: int, terms: Texts = TEXTS) -> DataFrame:
    return _new(triples, _functionalized(triples, word, capability, rule_id, terms), terms)


def _functionalized(triples: DataFrame, word: str, capability: str, rule_id: int, terms: Texts) -> DataFrame:
    """(s, capability, rule_id)."""
    kinds = match(triples, p="hasFunctionalizationType", names=("f", "kind"))
    kinds = kinds.join(terms.different(kinds, "kind").filter(F.lower(local_name(F.col("text"))).contains(word)), "kind", "left_semi")
    found = match(triples, p="hasFunctionalization", names=("s", "f")).join(kinds, "f").select("s").distinct()
    return found.select("s", F.lit(capability).alias("capability"), F.lit(rule_id).alias("rule_id"))


def capabilities_from_values(triples: DataFrame, thresholds: DataFrame, terms: Texts = TEXTS) -> DataFrame:
    """(s, capability, rule_id) where a value lies in a rule's range (rule_id, property, low, high, unit, capability); a null unit fits all."""
    return _new(triples, _owners(triples, _valued(triples, thresholds, terms)), terms)


def _valued(triples: DataFrame, thresholds: DataFrame, terms: Texts) -> DataFrame:
    """(node, capability, rule_id)."""
    rules = F.broadcast(thresholds.withColumnRenamed("unit", "rule_unit"))
    names = match(triples, p="hasPropertyName", names=("node", "name"))
    rules = F.broadcast(terms.different(names, "name").join(rules, F.lower("text").contains(F.lower("property"))).drop("property", "text"))
    # Only what has a fitting name needs its value's text.
    rows = names.join(rules, "name").drop("name").join(match(triples, p="hasValue", names=("node", "value")), "node")
    rows = terms.text(rows, "value").withColumn("value", F.col("value").try_cast("double"))
    rows = rows.filter(F.col("value").between(F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf")))))
    rows = terms.text(rows.join(match(triples, p="hasUnits", names=("node", "unit")), "node", "left"), "unit")
    rows = rows.filter(F.col("rule_unit").isNull() | F.coalesce(F.col("unit").contains(F.col("rule_unit")), F.lit(True)))
    return rows.select("node", "capability", "rule_id")


def held_capabilities(triples: DataFrame, terms: Texts = TEXTS) -> DataFrame:
    """(s, capability): by the local names of the capability nodes that a subject links to, and of their classes."""
    has = match(triples, p="hasCapability", names=("s", "node"))
    nodes = has.select("node").distinct()
    kinds = match(triples, p=TYPE, names=("node", "kind")).join(nodes, "node", "left_semi")
    kinds = kinds.join(terms.different(kinds, "kind").filter(F.col("text").startswith(ONTO)), "kind").select("node", "text")
    named = terms.different(nodes, "node").unionByName(kinds).select("node", local_name(F.col("text")).alias("capability"))
    return has.join(named, "node").select("s", "capability").distinct()


def _owners(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s, capability, rule_id) of the materials that own the nodes."""
    return owned_properties(triples).join(nodes, "node").select("s", "capability", "rule_id").distinct()


def _new(triples: DataFrame, found: DataFrame, terms: Texts) -> DataFrame:
    return found.join(held_capabilities(triples, terms), ["s", "capability"], "left_anti")


def first_rule(found: DataFrame) -> DataFrame:
    """Of rules that give a node the same capability, the first counts."""
    return found.groupBy("s", "capability").agg(F.min("rule_id").alias("rule_id"))


def rule_counts(found: DataFrame) -> DataFrame:
    return first_rule(found).groupBy("rule_id", "capability").agg(F.count("*").alias("n"))


def capability_triples(found: DataFrame, terms: Texts = TEXTS) -> DataFrame:
    return as_links(terms.number(first_rule(found).select("s", F.lit(ONTO + "hasCapability").alias("p"), F.concat(F.lit(ONTO), "capability").alias("o")), "o"))


def capabilities(triples: DataFrame, name_rules: DataFrame, thresholds: DataFrame, terms: Texts = TEXTS) -> DataFrame:
    """(s, capability, rule_id) by all rules; owners and what is known already are looked up once for all of them."""
    found = _owners(triples, _named(triples, name_rules, terms).unionByName(_valued(triples, thresholds, terms)))
    return _new(triples, found.unionByName(_functionalized(triples, "amine", "DirectAirCapture", 100, terms)), terms)


def additions(triples: DataFrame, chains: DataFrame, name_rules: DataFrame, thresholds: DataFrame, terms: Texts = TEXTS) -> DataFrame:
    """The triples that chains and capabilities add to a graph, a set of triples: what is added is new, so nothing needs to be told apart again."""
    found = capabilities(triples, name_rules, thresholds, terms)
    return property_chains(triples, chains, terms).unionByName(capability_triples(found, terms))


def enrich(triples: DataFrame, chains: DataFrame, name_rules: DataFrame, thresholds: DataFrame, terms: Texts = TEXTS) -> DataFrame:
    """The graph with what rules add to it."""
    return triples.unionByName(additions(triples, chains, name_rules, thresholds, terms))
