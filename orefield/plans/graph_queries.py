"""Registered queries over the star schema's graph, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions.strings import local_name, predicate_label
from orefield.operators import graph as G
from orefield.operators import infer as I
from orefield.operators import triples as T
from orefield.operators import verify as V
from orefield.operators.shared_rows import cut
from orefield.plans import star
from orefield.schema import CHAINS, DISJOINT, INVERSES, KG, ONTO
from orefield.sources.stored import new_folder
from orefield.sources.tables import read_triples, write_triples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
O, K, TY = "'http://example.org/onto#", "'http://example.org/kg#", star._TYPE
#: Rule id, part of a property's name, capability.
NAME_RULES = [(1, "price", "CO2CaptureCapability"), (2, "ordered quantity", "Storage"), (3, "size", "Separation")]
#: Rule id, part of a property's name, low, high, unit, capability.
THRESHOLDS = [(10, "Retail price", 1500.0, None, "USD", "Catalysis"), (11, "Mean discount", None, 0.05, None, "Storage"), (12, "Ordered quantity", 500.0, 900.0, "pcs", "Sensing")]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def some(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """The graph's triples of the named kinds of rows, from the stored graph."""
    return star.graph(spark, sf, *kinds)


#: Texts that rules add to a graph or look for in it.
CONSTANTS = [ONTO + x for x in sorted({"MOF", "DirectAirCapture", *[r[-1] for r in NAME_RULES], *[r[-1] for r in THRESHOLDS]})]


def numbered(spark: SparkSession, sf: str, *kinds: str):
    """The triples of the named kinds with numbers for terms, and the terms' table."""
    return star.encoded(spark, sf, CONSTANTS, *kinds)


def fresh(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """The triples of one kind of row, made anew."""
    return T.assemble([star.parts(spark, sf)[kind]])


def LN(x: str) -> str:  # noqa: N802
    return f"regexp_replace({x}, '^.*[#/]', '')"


def P(name: str) -> str:  # noqa: N802
    return f"p = {O}{name}'"


GRAPH = star.graph_sql


# Triples of each kind of row.
def _kinds() -> None:
    ids = {
        "T1_materials": "materials", "T2_linkers": "linkers", "T3_metal_clusters": "metals", "T4_topologies": "topologies", "T5_space_groups": "space_groups",
        "T7_properties": "properties", "T8_syntheses": "syntheses", "T12_functionalized": "derivatives", "T18_linker_links": "linker_links", "T19_metal_links": "metal_links",
        "T20_topology_links": "topology_links", "T21_space_group_links": "space_group_links", "T24_property_links": "property_links", "T25_synthesis_links": "synthesis_links",
        "T26_condition_links": "condition_links", "T28_capability_links": "capabilities", "T29_derived_from": "derivative_links", "T30_functionalization_links": "functionalizations",
        "T31_functionalization_types": "functionalization_types", "T33_solvent_links": "solvent_links", "T6_crystal_systems": "crystal_systems", "T9_conditions": "conditions",
        "T10_abstracts": "abstracts", "T11_capabilities": "capability_kinds", "T13_functionalizations": "functionalization_kinds", "T14_chemicals": "chemicals", "T15_lattices": "lattices", "T16_solvents": "solvents",
        "T17_additives": "additives", "T22_crystal_system_links": "crystal_system_links", "T23_lattice_links": "lattice_links", "T27_abstract_links": "abstract_links",
        "T32_functional_group_links": "functional_group_links", "T34_additive_links": "additive_links",
    }
    for name, kind in ids.items():
        query(name, GRAPH(kind) + " SELECT s, p, o, o_kind, datatype FROM triples")(lambda spark, sf, kind=kind: fresh(spark, sf, kind).select("s", "p", "o", "o_kind", "datatype"))


_kinds()


@query("T35_assembly_counts", f"WITH {star.PROPERTY_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n_triples FROM (SELECT DISTINCT * FROM ({' UNION ALL '.join(q)}))" for k, q in star.SQL_PARTS.items()))
def _(spark, sf):
    return T.assembly_counts({k: star.graph(spark, sf, k) for k in star.SQL_PARTS})


@query("T35_whole_graph", GRAPH() + f" SELECT {LN('p')} AS relation, o_kind, count(*) AS n, count(DISTINCT s) AS n_subjects FROM triples GROUP BY 1, 2")
def _(spark, sf):
    return star.graph(spark, sf).groupBy(local_name(F.col("p")).alias("relation"), "o_kind").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_subjects"))


_INV = ", ".join(f"({O}{a}', {O}{b}')" for a, b in INVERSES)


@query("T36_materialize_inverses", GRAPH("topology_links", "linker_links", "solvent_links") + f" SELECT DISTINCT o AS s, inverse AS p, s AS o FROM triples JOIN (VALUES {_INV}) v(p, inverse) USING (p)")
def _(spark, sf):
    rules = spark.createDataFrame([(ONTO + a, ONTO + b) for a, b in INVERSES], "p string, inverse string")
    return T.materialize_inverses(some(spark, sf, "topology_links", "linker_links", "solvent_links"), rules).select("s", "p", "o")


# Inference.
_CH = ", ".join(f"({O}{a}', {O}{b}', {O}{c}')" for a, b, c in CHAINS)
_SYN = ("materials", "synthesis_links", "condition_links", "solvent_links")


def _chains(spark):
    return spark.createDataFrame(CHAINS, "first string, second string, inferred string")


@query("I1_property_chains", GRAPH(*_SYN) + f" SELECT DISTINCT a.s, c.r AS p, b.o FROM triples a JOIN (VALUES {_CH}) c(p1, p2, r) ON a.p = c.p1 JOIN triples b ON b.p = c.p2 AND a.o = b.s WHERE a.s IN (SELECT s FROM triples WHERE p = {TY} AND o = {O}MOF')")
def _(spark, sf):
    graph, terms = numbered(spark, sf, *_SYN)
    found = cut(I.property_chains(graph, _chains(spark), terms).select("s", "p", "o"), "chains", release=True)
    return terms.text(terms.text(found, "s"), "o")


_PV = ("materials", "properties", "property_links", "capabilities", "capability_kinds", "functionalizations", "functionalization_types")
_OWN = f"""own AS (SELECT DISTINCT s, o AS node FROM triples WHERE p IN ({', '.join(f"{O}has{k}'" for k in ('PhysicalProperty', 'StructuralProperty', 'ComputationalProperty', 'ChemicalProperty'))})),
 pv AS (SELECT own.s, own.node, n.o AS name, TRY_CAST(v.o AS DOUBLE) AS value, u.o AS unit FROM own JOIN triples n ON n.s = node AND n.{P('hasPropertyName')} LEFT JOIN triples v ON v.s = node AND v.{P('hasValue')} LEFT JOIN triples u ON u.s = node AND u.{P('hasUnits')}),
 held AS (SELECT s, {LN('o')} AS capability FROM triples WHERE {P('hasCapability')} UNION SELECT a.s, {LN('b.o')} FROM triples a JOIN triples b ON a.o = b.s AND a.{P('hasCapability')} AND b.p = {TY})"""
_NEW = "SELECT * FROM ({}) f WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.s = f.s AND held.capability = f.capability)".format
_NR = ", ".join(f"({i}, '{n}', '{c}')" for i, n, c in NAME_RULES)
_TH = ", ".join(f"({i}, '{n}', {'NULL' if a is None else a}, {'NULL' if b is None else b}, {'NULL' if u is None else repr(u)}, '{c}')" for i, n, a, b, u, c in THRESHOLDS)
_BY_NAME = _NEW(f"SELECT DISTINCT s, capability, rule_id FROM pv JOIN (VALUES {_NR}) r(rule_id, property, capability) ON contains(lower(name), lower(property)) OR contains(lower(property), lower(name))")
_BY_VALUE = _NEW(f"""SELECT DISTINCT s, capability, rule_id FROM pv JOIN (VALUES {_TH}) r(rule_id, property, low, high, ru, capability)
 ON contains(lower(name), lower(property)) AND value >= coalesce(low, -1e300) AND value <= coalesce(high, 1e300) AND (ru IS NULL OR unit IS NULL OR contains(unit, ru))""")
_BY_FUNC = _NEW(f"SELECT DISTINCT a.s, 'DirectAirCapture' AS capability, 100 AS rule_id FROM triples a JOIN triples b ON a.o = b.s AND a.{P('hasFunctionalization')} AND b.{P('hasFunctionalizationType')} AND contains(lower(b.o), 'type_amine')")


def _rules(spark):
    return spark.createDataFrame(NAME_RULES, "rule_id int, property string, capability string"), spark.createDataFrame(THRESHOLDS, "rule_id int, property string, low double, high double, unit string, capability string")


@query("I2_capability_from_property_name", GRAPH(*_PV) + f", {_OWN} {_BY_NAME}")
def _(spark, sf):
    graph, terms = numbered(spark, sf, *_PV)
    return terms.text(I.capabilities_from_names(graph, _rules(spark)[0], terms), "s")


@query("I3_capability_from_functionalization", GRAPH(*_PV) + f", {_OWN} {_BY_FUNC}")
def _(spark, sf):
    graph, terms = numbered(spark, sf, *_PV)
    return terms.text(I.capabilities_from_functionalization(graph, "amine", "DirectAirCapture", 100, terms), "s")


@query("I4_capability_from_threshold", GRAPH(*_PV) + f", {_OWN} {_BY_VALUE}")
def _(spark, sf):
    graph, terms = numbered(spark, sf, *_PV)
    return terms.text(I.capabilities_from_values(graph, _rules(spark)[1], terms), "s")


def _found(spark, sf):
    graph, terms = numbered(spark, sf, *_PV)
    return I.capabilities(graph, *_rules(spark), terms), terms


_ALL = f"f AS ({_BY_NAME} UNION ALL {_BY_VALUE} UNION ALL {_BY_FUNC}), r AS (SELECT s, capability, min(rule_id) AS rule_id FROM f GROUP BY 1, 2)"


@query("I5_rule_priority", GRAPH(*_PV) + f", {_OWN}, {_ALL} SELECT * FROM r")
def _(spark, sf):
    found, terms = _found(spark, sf)
    return terms.text(I.first_rule(found), "s")


@query("I6_enrichment_counts", GRAPH(*_PV) + f", {_OWN}, {_ALL} SELECT rule_id, capability, count(*) AS n FROM r GROUP BY 1, 2")
def _(spark, sf):
    return I.rule_counts(_found(spark, sf)[0])


_CHSQL = f"SELECT DISTINCT a.s, c.r AS p, b.o FROM triples a JOIN (VALUES {_CH}) c(p1, p2, r) ON a.p = c.p1 JOIN triples b ON b.p = c.p2 AND a.o = b.s WHERE a.s IN (SELECT s FROM triples WHERE p = {TY} AND o = {O}MOF')"
_EN = (*_PV, "synthesis_links", "condition_links", "solvent_links", "linker_links", "derivatives")
_RICH = f"{_OWN}, {_ALL}, rich AS (SELECT s, p, o FROM triples UNION {_CHSQL} UNION SELECT s, {O}hasCapability', {O}' || capability FROM r)"


def _added(spark, sf):
    """The graph and what rules add to it, in numbers, and the terms' table. What is added is written, and the shuffle files behind it go before checks make theirs."""
    base, terms = numbered(spark, sf, *_EN)
    return base, cut(I.additions(base, _chains(spark), *_rules(spark), terms), "additions", release=True), terms


def _both(spark, sf):
    """The graph and the enriched graph, in numbers, and the terms' table."""
    base, added, terms = _added(spark, sf)
    return base, base.unionByName(added), terms


@query("I7_enriched_graph", GRAPH(*_EN) + f", {_RICH} SELECT {LN('p')} AS relation, count(*) AS n FROM rich GROUP BY 1")
def _(spark, sf):
    return G.relation_sizes(_both(spark, sf)[1])


# Verification.
_LOST = "SELECT (SELECT count(*) FROM (SELECT s, p, o FROM triples EXCEPT SELECT s, p, o FROM {0})) AS lost, (SELECT count(*) FROM (SELECT s, p, o FROM {0} EXCEPT SELECT s, p, o FROM triples)) AS added".format


@query("V1_data_integrity", GRAPH(*_EN) + f", {_RICH}, l AS ({_LOST('rich')}) SELECT *, CASE WHEN lost = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM l")
def _(spark, sf):
    return V.data_integrity(*_both(spark, sf)[:2])


#: What a damaged graph lacks.
_DAMAGED = f"damaged AS (SELECT * FROM rich WHERE NOT {P('hasUnits')} AND NOT ({P('hasLinker')} AND ends_with(s, '7')))"


def damaged(base: DataFrame, rich: DataFrame, terms) -> DataFrame:
    """An enriched graph without its units and a part of its linkers, told by the texts of those that have any."""
    linked = base.filter(F.col("p") == ONTO + "hasLinker")
    gone = terms.different(linked, "s").filter(F.col("text").endswith("7")).select("s")
    # Links to linkers alone meet what is gone; the rest stays where it is read.
    left = rich.filter(F.col("p") == ONTO + "hasLinker").join(gone, "s", "left_anti").select(rich.columns)
    return rich.filter(~F.col("p").isin(ONTO + "hasUnits", ONTO + "hasLinker")).unionByName(left)


@query("V1_data_integrity_with_losses", GRAPH(*_EN) + f", {_RICH}, {_DAMAGED}, l AS ({_LOST('damaged')}) SELECT *, CASE WHEN lost = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM l")
def _(spark, sf):
    base, rich, terms = _both(spark, sf)
    return V.data_integrity(base, damaged(base, rich, terms))


@query("V2_missing_inverses", GRAPH("linker_links", "topology_links") + f" SELECT s, o FROM triples t WHERE {P('hasLinker')} AND NOT EXISTS (SELECT 1 FROM triples u WHERE u.s = t.o AND u.o = t.s AND u.{P('usedInMOF')}) UNION ALL SELECT s, o FROM triples WHERE {P('hasTopology')}")
def _(spark, sf):
    graph = some(spark, sf, "linker_links", "topology_links")
    return V.missing_inverses(graph, "hasLinker", "usedInMOF").unionByName(V.missing_inverses(graph, "hasTopology", "topologyOf"))


@query("V3_missing_chains", GRAPH(*_SYN) + f" SELECT DISTINCT a.s, b.o FROM triples a JOIN triples b ON a.o = b.s WHERE a.{P('hasSynthesisProcess')} AND b.{P('usesSolvent')}")
def _(spark, sf):
    return V.missing_chains(some(spark, sf, *_SYN), *CHAINS[0])


@query("V4_inference_ratio", GRAPH(*_EN) + f", {_RICH}, z AS (SELECT (SELECT count(*) FROM triples) AS n_base, (SELECT count(*) FROM rich) AS n_enriched) SELECT *, round((n_enriched - n_base) / n_base, 6) AS ratio, CASE WHEN round((n_enriched - n_base) / n_base, 6) BETWEEN 0.001 AND 0.5 THEN 'PASS' ELSE 'WARN' END AS status FROM z")
def _(spark, sf):
    return V.inference_ratio(*_both(spark, sf)[:2])


_DJ = ", ".join(f"('{a}', '{b}')" for a, b in DISJOINT)


@query("V5_disjoint_violations", GRAPH("materials", "linkers", "derivatives") + f" SELECT a.s, d.a AS class_a, d.b AS class_b FROM triples a JOIN (VALUES {_DJ}) d(a, b) ON {LN('a.o')} = d.a JOIN triples b ON a.s = b.s AND {LN('b.o')} = d.b WHERE a.p = {TY} AND b.p = {TY}")
def _(spark, sf):
    return V.disjoint_violations(some(spark, sf, "materials", "linkers", "derivatives"), spark.createDataFrame(DISJOINT, "class_a string, class_b string"))


@query("V6_property_type_overlap", GRAPH("properties", "space_groups") + f", k AS (SELECT DISTINCT s, {LN('o')} AS k FROM triples WHERE p = {TY}) SELECT a.k AS class_a, b.k AS class_b, count(*) AS n FROM k a JOIN k b ON a.s = b.s AND a.k <= b.k GROUP BY 1, 2")
def _(spark, sf):
    kinds = some(spark, sf, "properties", "space_groups").filter(F.col("p") == star._TYPE.strip("'")).select("s", local_name(F.col("o")).alias("class_a")).distinct()
    pairs = kinds.join(kinds.withColumnRenamed("class_a", "class_b"), "s").filter("class_a <= class_b")
    return pairs.groupBy("class_a", "class_b").agg(F.count("*").alias("n"))


@query("V8_sample_inferences", GRAPH(*_SYN) + f", c AS ({_CHSQL}), x AS (SELECT *, CAST(row_number() OVER (PARTITION BY p ORDER BY s, o) AS INTEGER) AS rn FROM c) SELECT s, p, o FROM x WHERE rn <= 5")
def _(spark, sf):
    base, terms = numbered(spark, sf, *_SYN)
    rich = base.unionByName(I.property_chains(base, _chains(spark), terms))
    return V.sample_inferences(base, rich, terms=terms).select("s", "p", "o")


_BAND = "SELECT CASE WHEN round(({0} - n_base) / n_base, 6) BETWEEN 0.001 AND 0.5 THEN 'PASS' ELSE 'WARN' END".format
_STATUS = f"""z AS (SELECT (SELECT count(*) FROM triples) AS n_base, (SELECT count(*) FROM rich) AS n_rich, (SELECT count(*) FROM damaged) AS n_damaged),
 c AS (SELECT 'whole' AS graph, CASE WHEN lost = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({_LOST('rich')}) UNION ALL SELECT 'whole', ({_BAND('n_rich')}) FROM z UNION ALL SELECT 'damaged', CASE WHEN lost = 0 THEN 'PASS' ELSE 'FAIL' END FROM ({_LOST('damaged')}) UNION ALL SELECT 'damaged', ({_BAND('n_damaged')}) FROM z)"""


@query("V9_overall_status", GRAPH(*_EN) + f", {_RICH}, {_DAMAGED}, {_STATUS} SELECT graph, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM c GROUP BY 1")
def _(spark, sf):
    base, rich, terms = _both(spark, sf)
    found = [(name, V.data_integrity(base, g).select("status").union(V.inference_ratio(base, g).select("status"))) for name, g in (("whole", rich), ("damaged", damaged(base, rich, terms)))]
    # One graph after the other, so that only one's shuffle files are on disk.
    out = [cut(V.overall_status(checks).select(F.lit(name).alias("graph"), "status"), "status", release=True) for name, checks in found]
    return out[0].unionByName(out[1])


@query("V7_output_verification", GRAPH("materials", "linker_links", "abstracts", "lattices") + " SELECT count(*) AS n_written, count(*) AS n_read, 0 AS lost, 0 AS extra, 'PASS' AS status FROM triples")
def _(spark, sf):
    triples, path = some(spark, sf, "materials", "linker_links", "abstracts", "lattices"), new_folder(spark, "n-triples")
    write_triples(triples, path)
    return V.read_back(triples, read_triples(spark, path))


_CT = ("materials", "derivatives", "capabilities")


@query("V10_class_totals", GRAPH(*_CT) + " SELECT count(*) AS n_triples, " + ", ".join(f"count(DISTINCT CASE WHEN p = {TY} AND o = {O}{c}' THEN s END) AS {n}" for c, n in (("MOF", "n_mof"), ("ExperimentalMOF", "n_experimental"), ("HypotheticalMOF", "n_hypothetical"), ("FunctionalizedMOF", "n_functionalized"))) + f", count(DISTINCT CASE WHEN {P('hasCapability')} THEN s END) AS n_with_capability FROM triples")
def _(spark, sf):
    return V.class_totals(some(spark, sf, *_CT))


@query("V11_capability_distribution", GRAPH(*_PV) + f", {_OWN}, {_ALL}, e AS (SELECT s, count(DISTINCT capability) AS n_capabilities FROM r GROUP BY 1) SELECT n_capabilities, count(*) AS n_mof FROM e GROUP BY 1")
def _(spark, sf):
    found, terms = _found(spark, sf)
    return V.capability_distribution(I.capability_triples(found, terms))


@query("V12_summary_difference", GRAPH(*_EN) + f", {_RICH}, d AS (SELECT s, p, o FROM rich EXCEPT SELECT s, p, o FROM triples) SELECT {LN('p')} AS relation, count(*) AS n_added, round(count(*) / (SELECT count(*) FROM triples), 6) AS ratio FROM d GROUP BY 1")
def _(spark, sf):
    """What the enriched graph has beyond the base graph is what was added, less what the base graph has: its own triples need not meet themselves."""
    return V.summary_difference(*_added(spark, sf)[:2])


_ST = ("materials", "linkers", "linker_links", "topology_links", "metal_links", "properties")


@query("V13_graph_statistics", GRAPH(*_ST) + f" SELECT {LN('o')} AS name, count(DISTINCT s) AS n, 'node' AS what FROM triples WHERE p = {TY} GROUP BY 1 UNION ALL SELECT {LN('p')}, count(*), 'edge' FROM triples GROUP BY 1")
def _(spark, sf):
    return G.graph_statistics(some(spark, sf, *_ST))


# Graph operators.
@query("G1_triple_pattern", GRAPH("topology_links") + f" SELECT s, o FROM triples WHERE {P('hasTopology')} AND o = {K}Topology_PROMO'")
def _(spark, sf):
    return G.match(some(spark, sf, "topology_links"), p="hasTopology", o=KG + "Topology_PROMO")


@query("G2_basic_graph_pattern", GRAPH("topology_links", "topologies", "metal_links") + f" SELECT t.s AS mof, n.o AS topology, m.o AS metal FROM triples t JOIN triples n ON t.o = n.s JOIN triples m ON m.s = t.s WHERE t.{P('hasTopology')} AND n.{P('hasTopologyName')} AND m.{P('hasMetalNode')}")
def _(spark, sf):
    g = some(spark, sf, "topology_links", "topologies", "metal_links")
    return G.join_patterns(G.match(g, p="hasTopology", names=("mof", "t")), G.match(g, p="hasTopologyName", names=("t", "topology")), G.match(g, p="hasMetalNode", names=("mof", "metal"))).select("mof", "topology", "metal")


@query("G3_optional", GRAPH("materials", "capabilities") + f" SELECT a.s AS mof, b.o AS capability FROM triples a LEFT JOIN triples b ON a.s = b.s AND b.{P('hasCapability')} WHERE a.p = {TY} AND a.o = {O}MOF'")
def _(spark, sf):
    g = some(spark, sf, "materials", "capabilities")
    return G.optional(G.typed(g, "MOF", "mof"), G.match(g, p="hasCapability", names=("mof", "capability")))


@query("G4_union", GRAPH("topology_links", "metal_links") + f" SELECT s AS mof, o AS topology, NULL AS metal FROM triples WHERE {P('hasTopology')} UNION ALL SELECT s, NULL, o FROM triples WHERE {P('hasMetalNode')}")
def _(spark, sf):
    g = some(spark, sf, "topology_links", "metal_links")
    return G.union_patterns(G.match(g, p="hasTopology", names=("mof", "topology")), G.match(g, p="hasMetalNode", names=("mof", "metal")))


@query("G5_filter_bind_count", GRAPH("materials", "metal_links") + f" SELECT {LN('m.o')} AS metal, count(DISTINCT n.s) AS n FROM triples m JOIN triples n ON m.s = n.s WHERE m.{P('hasMetalNode')} AND n.{P('hasName')} AND contains(lower(n.o), 'ring') GROUP BY 1 HAVING count(DISTINCT n.s) > 1 ORDER BY n DESC, metal LIMIT 10")
def _(spark, sf):
    g = some(spark, sf, "materials", "metal_links")
    named = G.match(g, p="hasName", names=("mof", "name")).filter(F.lower("name").contains("ring"))
    out = G.join_patterns(named, G.match(g, p="hasMetalNode", names=("mof", "m"))).groupBy(local_name(F.col("m")).alias("metal")).agg(F.count_distinct("mof").alias("n"))
    return out.filter("n > 1").orderBy(F.desc("n"), "metal").limit(10)


_DN = ("materials", "linkers", "topologies", "topology_links", "linker_links", "metal_links")
_PRI = "CASE p " + " ".join(f"WHEN {O}{x}' THEN {i}" for i, x in enumerate(("hasName", "hasLinkerName", "hasTopologyName", "hasPropertyName", "hasSolventName"))) + " END"


@query("G6_display_names", GRAPH(*_DN) + f", n AS (SELECT s AS node FROM triples UNION SELECT o FROM triples WHERE o_kind = 'uri'), b AS (SELECT s AS node, min([CAST({_PRI} AS VARCHAR), o])[2] AS name FROM triples WHERE {_PRI} IS NOT NULL GROUP BY 1) SELECT node, coalesce(name, {LN('node')}) AS name FROM n LEFT JOIN b USING (node)")
def _(spark, sf):
    return G.display_names(some(spark, sf, *_DN))


@query("G7_node_table", GRAPH(*_DN) + f", n AS (SELECT s AS node FROM triples UNION SELECT o FROM triples WHERE o_kind = 'uri' AND p <> {TY}), t AS (SELECT s AS node, string_agg(DISTINCT {LN('o')}, ';' ORDER BY {LN('o')}) AS types FROM triples WHERE p = {TY} GROUP BY 1) SELECT node, coalesce(types, '') AS types FROM n LEFT JOIN t USING (node)")
def _(spark, sf):
    return G.node_table(some(spark, sf, *_DN)).withColumn("types", F.array_join("types", ";"))


@query("G8_edge_table", GRAPH(*_DN) + f" SELECT s AS source, {LN('p')} AS relation, o AS target, o_kind AS target_kind, datatype FROM triples WHERE p <> {TY}")
def _(spark, sf):
    return G.edge_table(some(spark, sf, *_DN))


@query("G9_without_leaks", GRAPH(*_DN, "space_group_links") + f" SELECT s, p, o FROM triples WHERE {LN('p')} <> 'hasFormula' AND NOT contains({LN('p')}, 'Owner') AND NOT contains({LN('p')}, 'usedIn') AND NOT contains({LN('p')}, 'isComponent')")
def _(spark, sf):
    return G.without_leaks(some(spark, sf, *_DN, "space_group_links"), ["hasFormula"]).select("s", "p", "o")


@query("G10_without_literals", GRAPH(*_DN) + " SELECT s, p, o FROM triples WHERE o_kind <> 'literal'")
def _(spark, sf):
    return G.without_literals(some(spark, sf, *_DN)).select("s", "p", "o")


@query("G11_simple_graph", GRAPH(*_DN) + ", e AS (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM triples WHERE o_kind <> 'literal' AND s <> o) SELECT a, b FROM e UNION ALL SELECT b, a FROM e")
def _(spark, sf):
    return G.simple_graph(some(spark, sf, *_DN))


def _join(p: str) -> str:
    return f"coalesce(string_agg(DISTINCT CASE WHEN {P(p)} THEN {LN('o')} END, ';' ORDER BY {LN('o')}), '')"


@query("G12_support_lists", GRAPH("linker_links", "metal_links", "topology_links") + ", ".join([" SELECT s", *(f"coalesce((SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT DISTINCT {LN('u.o')} AS x FROM triples u WHERE u.s = t.s AND u.{P(p)})), '') AS {p}" for p in ("hasLinker", "hasMetalNode", "hasTopology"))]) + f" FROM (SELECT DISTINCT s FROM triples WHERE p IN ({O}hasLinker', {O}hasMetalNode', {O}hasTopology')) t")
def _(spark, sf):
    names = ["hasLinker", "hasMetalNode", "hasTopology"]
    return G.support_lists(some(spark, sf, "linker_links", "metal_links", "topology_links"), names).select("s", *[F.array_join(n, ";").alias(n) for n in names])


@query("G13_relation_sizes", GRAPH(*_DN) + f" SELECT {LN('p')} AS relation, count(*) AS n FROM triples GROUP BY 1 HAVING count(*) >= 50")
def _(spark, sf):
    return G.relation_sizes(some(spark, sf, *_DN), 50)


# Named queries.
@query("Q1_material_counts_by_class", GRAPH("materials", "derivatives") + f" SELECT {LN('o')} AS class, count(DISTINCT s) AS n FROM triples WHERE p = {TY} GROUP BY 1")
def _(spark, sf):
    return G.match(some(spark, sf, "materials", "derivatives"), p=star._TYPE.strip("'")).groupBy(local_name(F.col("o")).alias("class")).agg(F.count_distinct("s").alias("n"))


@query("Q2_derivatives_and_parents", GRAPH("derivative_links") + f" SELECT DISTINCT s AS derivative, o AS parent FROM triples WHERE {P('derivedFrom')} ORDER BY 1, 2 LIMIT 30")
def _(spark, sf):
    return G.match(some(spark, sf, "derivative_links"), p="derivedFrom", names=("derivative", "parent")).distinct().orderBy("derivative", "parent").limit(30)


def _histogram(spark, sf, kinds, link, name, least):
    g = some(spark, sf, *kinds)
    rows = G.join_patterns(G.match(g, p=link, names=("mof", "x")), G.match(g, p=name, names=("x", "name")))
    return rows.groupBy("name").agg(F.count_distinct("mof").alias("n")).orderBy(F.desc("n"), "name").limit(least)


def _histogram_sql(kinds, link, name, least):
    return GRAPH(*kinds) + f" SELECT n.o AS name, count(DISTINCT t.s) AS n FROM triples t JOIN triples n ON t.o = n.s WHERE t.{P(link)} AND n.{P(name)} GROUP BY 1 ORDER BY n DESC, name LIMIT {least}"


@query("Q3_topology_histogram", _histogram_sql(("topology_links", "topologies"), "hasTopology", "hasTopologyName", 20))
def _(spark, sf):
    return _histogram(spark, sf, ("topology_links", "topologies"), "hasTopology", "hasTopologyName", 20)


@query("Q4_metal_histogram", _histogram_sql(("metal_links", "metals"), "hasMetalNode", "hasMetalElement", 20))
def _(spark, sf):
    return _histogram(spark, sf, ("metal_links", "metals"), "hasMetalNode", "hasMetalElement", 20)


@query("Q5_property_coverage", GRAPH("properties", "property_links") + f", {_OWN} SELECT name, count(DISTINCT s) AS n FROM pv GROUP BY 1 ORDER BY n DESC, name LIMIT 30")
def _(spark, sf):
    return I.property_values(some(spark, sf, "properties", "property_links")).groupBy("name").agg(F.count_distinct("s").alias("n")).orderBy(F.desc("n"), "name").limit(30)


@query("Q6_linker_sample", GRAPH("linkers", "linker_links") + f" SELECT DISTINCT n.s AS linker, n.o AS name FROM triples n JOIN triples l ON l.o = n.s WHERE n.{P('hasLinkerName')} AND l.{P('hasLinker')} ORDER BY 1, 2 LIMIT 20")
def _(spark, sf):
    g = some(spark, sf, "linkers", "linker_links")
    return G.join_patterns(G.match(g, p="hasLinkerName", names=("linker", "name")), G.match(g, p="hasLinker", names=("mof", "linker"))).select("linker", "name").distinct().orderBy("linker", "name").limit(20)


def _two(a: str, b: str, condition: str, columns: str) -> str:
    return GRAPH("properties", "property_links") + f", {_OWN} SELECT DISTINCT x.s AS mof, x.value AS {columns.split()[0]}, y.value AS {columns.split()[1]} FROM pv x JOIN pv y ON x.s = y.s WHERE x.name = '{a}' AND y.name = '{b}' AND {condition}"


def _two_values(spark, sf, a, b, names):
    rows = I.property_values(some(spark, sf, "properties", "property_links"))
    one, two = (rows.filter(F.col("name") == n).select(F.col("s").alias("mof"), F.col("value").alias(c)) for n, c in zip((a, b), names.split()))
    return one.join(two, "mof").distinct()


@query("Q7_two_property_filter", _two("Size", "Mean discount", "x.value > 30 AND y.value < 0.05", "size discount"))
def _(spark, sf):
    return _two_values(spark, sf, "Size", "Mean discount", "size discount").filter("size > 30 and discount < 0.05")


@query("Q8_cross_property", _two("Retail price", "Ordered quantity", "x.value > 900 AND x.value < 2 * y.value", "price quantity"))
def _(spark, sf):
    return _two_values(spark, sf, "Retail price", "Ordered quantity", "price quantity").filter("price > 900 and price < 2 * quantity")


@query("Q9_metal_and_topology", GRAPH("metal_links", "metals", "topology_links", "topologies") + f" SELECT DISTINCT m.s AS mof, n.o AS metal, u.o AS topology FROM triples m JOIN triples n ON m.o = n.s JOIN triples t ON t.s = m.s JOIN triples u ON t.o = u.s WHERE m.{P('hasMetalNode')} AND n.{P('hasMetalElement')} AND n.o = 'Brand#2' AND t.{P('hasTopology')} AND u.{P('hasTopologyName')} AND u.o IN ('promo', 'small', 'large')")
def _(spark, sf):
    g = some(spark, sf, "metal_links", "metals", "topology_links", "topologies")
    metal = G.match(g, p="hasMetalElement", o="Brand#2", names=("m", "metal"))
    topology = G.match(g, p="hasTopologyName", names=("t", "topology")).filter(F.col("topology").isin("promo", "small", "large"))
    return G.join_patterns(G.match(g, p="hasMetalNode", names=("mof", "m")), metal, G.match(g, p="hasTopology", names=("mof", "t")), topology).select("mof", "metal", "topology").distinct()


_Q10 = ("properties", "property_links", "derivative_links")
_PAIR = f"pair AS (SELECT s AS child, o AS parent, {K}MOF_' || regexp_extract(s, '[0-9]+$') AS child_prop FROM triples WHERE {P('derivedFrom')})"


@query("Q10_derivative_better_than_parent", GRAPH(*_Q10) + f", {_OWN}, {_PAIR} SELECT child, parent, c.value AS child_value, q.value AS parent_value FROM pair JOIN pv c ON c.s = child_prop JOIN pv q ON q.s = parent WHERE c.name = 'Ordered quantity' AND q.name = 'Ordered quantity' AND c.value > q.value")
def _(spark, sf):
    g = some(spark, sf, *_Q10)
    rows = I.property_values(g).filter("name = 'Ordered quantity'").select("s", "value")
    pairs = G.match(g, p="derivedFrom", names=("child", "parent")).withColumn("c", F.concat(F.lit(KG + "MOF_"), F.regexp_extract("child", "[0-9]+$", 0)))
    out = pairs.join(rows.toDF("c", "child_value"), "c").join(rows.toDF("parent", "parent_value"), "parent")
    return out.filter("child_value > parent_value").select("child", "parent", "child_value", "parent_value")


@query("Q11_numeric_sweep", GRAPH("properties", "property_links") + f", {_OWN} SELECT s AS mof, name, value FROM pv WHERE value IS NOT NULL")
def _(spark, sf):
    return I.property_values(some(spark, sf, "properties", "property_links")).filter("value is not null").select(F.col("s").alias("mof"), "name", "value")


_AT = ("metal_links", "topology_links", "linker_links", "materials", "space_group_links", "crystal_system_links", "abstract_links")
_ATTR = [("metal", "hasMetalNode"), ("topology", "hasTopology"), ("linker", "hasLinker"), ("formula", "hasFormula"), ("space_group", "hasSpaceGroup"), ("crystal_system", "hasCrystalSystem"), ("abstract", "hasAbstract")]


@query("Q12_attribute_sweep", GRAPH(*_AT) + ", a AS (" + " UNION ALL ".join(f"SELECT s AS mof, '{n}' AS attribute, {LN('o')} AS v FROM triples WHERE {P(p)}" for n, p in _ATTR) + ") SELECT mof, attribute, string_agg(DISTINCT v, '; ' ORDER BY v) AS joined FROM a GROUP BY 1, 2")
def _(spark, sf):
    return _attributes(spark, sf)


def _attributes(spark, sf):
    g = some(spark, sf, *_AT)
    names = F.create_map(*[F.lit(x) for n, p in _ATTR for x in (ONTO + p, n)])
    rows = g.filter(F.col("p").isin([ONTO + p for _, p in _ATTR])).select(F.col("s").alias("mof"), names[F.col("p")].alias("attribute"), local_name(F.col("o")).alias("v"))
    return rows.groupBy("mof", "attribute").agg(F.array_join(F.array_sort(F.collect_set("v")), "; ").alias("joined"))


_WIDE = [("Retail price", "price"), ("Size", "size"), ("Ordered quantity", "quantity"), ("Mean extended price", "avg_price"), ("Mean discount", "discount"), ("Highest tax", "tax")]
_WD = ("properties", "property_links", *_AT)


@query("Q13_wide_table", GRAPH(*_WD) + f", {_OWN}, w AS (SELECT s AS mof, " + ", ".join(f"min(CASE WHEN name = '{n}' THEN value END) AS {c}" for n, c in _WIDE) + " FROM pv GROUP BY 1), a AS (" + " UNION ALL ".join(f"SELECT s AS mof, '{n}' AS attribute, {LN('o')} AS v FROM triples WHERE {P(p)}" for n, p in _ATTR) + "), b AS (SELECT mof, " + ", ".join(f"string_agg(DISTINCT v, '; ' ORDER BY v) FILTER (attribute = '{n}') AS {n}" for n, _ in _ATTR) + " FROM a GROUP BY 1) SELECT * FROM w FULL JOIN b USING (mof)")
def _(spark, sf):
    return _wide(spark, sf)


def _wide(spark, sf):
    rows = I.property_values(some(spark, sf, "properties", "property_links")).select(F.col("s").alias("mof"), "name", "node", "value")
    numbers = rows.groupBy("mof").pivot("name", [n for n, _ in _WIDE]).agg(F.min_by("value", "node")).withColumnsRenamed(dict(_WIDE))
    texts = _attributes(spark, sf).groupBy("mof").pivot("attribute", [n for n, _ in _ATTR]).agg(F.first("joined"))
    return numbers.join(texts, "mof", "full")


@query("Q14_structural_labels", GRAPH("materials", "topology_links", "metal_links") + f" SELECT m.s AS mof, min({LN('t.o')}) AS topology, min({LN('x.o')}) AS metal FROM triples m LEFT JOIN triples t ON t.s = m.s AND t.{P('hasTopology')} LEFT JOIN triples x ON x.s = m.s AND x.{P('hasMetalNode')} WHERE m.p = {TY} AND m.o = {O}MOF' GROUP BY 1 HAVING min(t.o) IS NOT NULL OR min(x.o) IS NOT NULL")
def _(spark, sf):
    g = some(spark, sf, "materials", "topology_links", "metal_links")
    rows = G.optional(G.optional(G.typed(g, "MOF", "mof"), G.match(g, p="hasTopology", names=("mof", "t"))), G.match(g, p="hasMetalNode", names=("mof", "m")))
    return rows.groupBy("mof").agg(F.min(local_name(F.col("t"))).alias("topology"), F.min(local_name(F.col("m"))).alias("metal")).filter("topology is not null or metal is not null")


@query("Q15_parent_child_deltas", GRAPH(*_Q10) + f", {_OWN}, {_PAIR}, j AS (SELECT child, parent, " + ", ".join(f"(SELECT avg(value) FROM pv WHERE pv.s = {who} AND name = '{n}') AS {c}" for who, n, c in (("parent", "Ordered quantity", "p_quantity"), ("child_prop", "Ordered quantity", "c_quantity"), ("parent", "Retail price", "p_price"), ("child_prop", "Retail price", "c_price"))) + " FROM pair) SELECT *, round(c_quantity - p_quantity, 4) AS delta_quantity, round(c_price - p_price, 4) AS delta_price FROM j")
def _(spark, sf):
    return _pairs(spark, sf)


def _pairs(spark, sf):
    g = some(spark, sf, *_Q10)
    rows = I.property_values(g)
    means = rows.groupBy("s").agg(*[F.avg(F.when(F.col("name") == n, F.col("value"))).alias(c) for n, c in (("Ordered quantity", "quantity"), ("Retail price", "price"))])
    pairs = G.match(g, p="derivedFrom", names=("child", "parent")).withColumn("c", F.concat(F.lit(KG + "MOF_"), F.regexp_extract("child", "[0-9]+$", 0)))
    out = pairs.join(means.toDF("parent", "p_quantity", "p_price"), "parent", "left").join(means.toDF("c", "c_quantity", "c_price"), "c", "left")
    return out.select("child", "parent", "p_quantity", "c_quantity", "p_price", "c_price", F.round(F.col("c_quantity") - F.col("p_quantity"), 4).alias("delta_quantity"), F.round(F.col("c_price") - F.col("p_price"), 4).alias("delta_price"))


@query("Q16_complete_pairs", ORACLE_SQL["Q15_parent_child_deltas"] + " WHERE p_quantity IS NOT NULL AND c_quantity IS NOT NULL AND p_price IS NOT NULL AND c_price IS NOT NULL")
def _(spark, sf):
    return _pairs(spark, sf).dropna()


@query("Q17_material_metadata", GRAPH("materials", "metal_links", "space_group_links", "linker_links") + ", ".join([f" SELECT m.s AS mof, {LN('m.s')} AS code", *(f"coalesce((SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT DISTINCT {LN('u.o')} AS x FROM triples u WHERE u.s = m.s AND u.{P(p)})), 'N/A') AS {c}" for p, c in (("hasMetalNode", "metals"), ("hasSpaceGroup", "space_groups"), ("hasLinker", "linkers")))]) + f" FROM triples m WHERE m.p = {TY} AND m.o = {O}MOF'")
def _(spark, sf):
    g = some(spark, sf, "materials", "metal_links", "space_group_links", "linker_links")
    lists = G.support_lists(g, ["hasMetalNode", "hasSpaceGroup", "hasLinker"])
    joined = [F.coalesce(F.nullif(F.array_join(p, "; "), F.lit("")), F.lit("N/A")).alias(c) for p, c in (("hasMetalNode", "metals"), ("hasSpaceGroup", "space_groups"), ("hasLinker", "linkers"))]
    return G.typed(g, "MOF", "s").join(lists, "s", "left").select(F.col("s").alias("mof"), local_name(F.col("s")).alias("code"), *joined)


@query("Q18_material_uris", GRAPH("materials", "derivatives") + f" SELECT DISTINCT s AS mof FROM triples WHERE p = {TY} AND o IN ({O}MOF', {O}ExperimentalMOF', {O}FunctionalizedMOF')")
def _(spark, sf):
    g = some(spark, sf, "materials", "derivatives")
    return G.union_patterns(*[G.typed(g, k, "mof") for k in ("MOF", "ExperimentalMOF", "FunctionalizedMOF")]).distinct()


@query("Q19_component_map", GRAPH("metal_links", "linker_links") + f" SELECT m.s AS mof, {LN('m.o')} AS metal, {LN('l.o')} AS linker FROM triples m JOIN triples l ON m.s = l.s WHERE m.{P('hasMetalNode')} AND l.{P('hasLinker')}")
def _(spark, sf):
    g = some(spark, sf, "metal_links", "linker_links")
    out = G.join_patterns(G.match(g, p="hasMetalNode", names=("mof", "m")), G.match(g, p="hasLinker", names=("mof", "l")))
    return out.select("mof", local_name(F.col("m")).alias("metal"), local_name(F.col("l")).alias("linker"))


@query("Q20_mean_property", GRAPH(*_WD) + f", {_OWN} SELECT m.s AS mof, round(avg(value), 6) AS mean_price FROM (SELECT DISTINCT s FROM triples WHERE {P('hasMetalNode')}) m LEFT JOIN pv ON pv.s = m.s AND name = 'Mean extended price' GROUP BY 1")
def _(spark, sf):
    g = some(spark, sf, *_WD)
    mean = I.property_values(g).filter("name = 'Mean extended price'").groupBy("s").agg(F.avg("value").alias("v"))
    return G.match(g, p="hasMetalNode", names=("s", "m")).select("s").distinct().join(mean, "s", "left").select(F.col("s").alias("mof"), F.round("v", 6).alias("mean_price"))


#: All named queries.
SUITE = [n for n in QUERIES if n.startswith("Q")]


@query("Q21_query_suite", " UNION ALL ".join(f"SELECT '{n}' AS query, count(*) AS n_rows, count(*) = 0 AS is_empty FROM ({ORACLE_SQL[n]})" for n in SUITE))
def _(spark, sf):
    counts = [QUERIES[n](spark, sf).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("query"), "n_rows") for n in SUITE]
    return G.union_patterns(*counts).withColumn("is_empty", F.col("n_rows") == 0)


@query("F19_predicate_labels", GRAPH("property_links", "linker_links", "metal_links") + f" SELECT DISTINCT p, regexp_replace({LN('p')}, '([A-Z])', ' \\1', 'g') AS label FROM triples")
def _(spark, sf):
    return some(spark, sf, "property_links", "linker_links", "metal_links").select("p").distinct().withColumn("label", predicate_label(F.col("p")))
