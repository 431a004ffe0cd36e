"""The star schema read as a graph: parts are materials, suppliers linkers, types topologies, brands metals, orders syntheses.

``PARTS`` gives the triples of each kind of row; ``GRAPH_SQL`` is the same graph as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions.strings import extract_doi, mint
from orefield.operators import terms
from orefield.operators.triples import Attribute, entity_triples, link_triples
from orefield.schema import TRIPLE_COLUMNS
from orefield.sources.stored import release, written_once

#: Key, property name, type, unit.
PROPERTIES = [
    ("price", "Retail price", "PhysicalProperty", "USD"), ("size", "Size", "StructuralProperty", "cm"), ("avg_price", "Mean extended price", "ComputationalProperty", "USD"),
    ("quantity", "Ordered quantity", "ComputationalProperty", "pcs"), ("discount", "Mean discount", "ComputationalProperty", ""), ("tax", "Highest tax", "ComputationalProperty", ""),
]
DECIMAL = "decimal(18,4)"
# Classes of capabilities; others are plain capabilities.
CAPABILITY_CLASSES = ["CO2CaptureCapability", "HydrogenStorageCapability", "MethaneStorageCapability", "PhotocatalyticCapability", "LuminescentSensingCapability", "DACCapability", "CatalysisCapability"]
#: What a type's capability is.
CAPABILITY_OF = {"ECONOMY": "CO2CaptureCapability", "STANDARD": "HydrogenStorageCapability", "SMALL": "CatalysisCapability", "MEDIUM": "DACCapability"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def properties(spark: SparkSession, sf: str) -> DataFrame:
    """part_key, name, kind, unit, key, value (a decimal of four places)."""
    part, item = table(spark, sf, "part"), table(spark, sf, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    # Means of whole cents, rounded half up: exact, whatever the order of rows.
    mean = lambda c: F.expr(f"(2 * {c} + n) div (2 * n)").alias(c)
    stats = item.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum(cents("l_extendedprice")).alias("avg_price"), F.sum(cents("l_quantity")).alias("quantity"), F.sum(cents("l_discount")).alias("discount"), F.max(cents("l_tax")).alias("tax"), F.count("*").alias("n")
    ).select("p_partkey", mean("avg_price"), "quantity", mean("discount"), "tax")
    wide = part.select("p_partkey", cents("p_retailprice").alias("price"), cents("p_size").alias("size")).join(stats, "p_partkey", "left")
    spec = {k: (n, t, u) for k, n, t, u in PROPERTIES}
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(t).alias("kind"), F.lit(u).alias("unit"), F.col(k).alias("value")) for k, (n, t, u) in spec.items()])
    rows = wide.select(F.col("p_partkey").alias("part_key"), F.explode(cells).alias("x")).select("part_key", "x.*").filter("value is not null")
    return rows.withColumn("value", F.expr("cast(value * 0.01BD AS decimal(18,4))"))


class Kinds(dict):
    """Kinds of rows, and how the triples of each are made; looking one up makes them."""

    def __getitem__(self, kind: str) -> DataFrame:
        return super().__getitem__(kind)()


def parts(spark: SparkSession, sf: str) -> Kinds:
    part, supplier, item = (table(spark, sf, t) for t in ("part", "supplier", "lineitem"))
    mof = mint("MOF", F.col("p_partkey"))
    out = {
        "materials": lambda: entity_triples(
            part, mof, ["MOF", F.when(F.col("p_size") <= 25, "ExperimentalMOF").otherwise("HypotheticalMOF")],
            [Attribute("hasName", F.col("p_name")), Attribute("isHypothetical", F.col("p_size") > 25, "boolean"), Attribute("hasFormula", F.col("p_brand"))],
        ),
        "linkers": lambda: entity_triples(supplier, mint("Linker", F.col("s_suppkey")), ["Linker"], [Attribute("hasLinkerName", F.col("s_name"))]),
        "topologies": lambda: entity_triples(part.select("p_type").distinct(), mint("Topology", F.col("p_type")), ["Topology"], [Attribute("hasTopologyName", F.lower("p_type"))]),
        "metals": lambda: entity_triples(part.select("p_brand").distinct(), mint("MetalCluster", F.col("p_brand")), ["MetalCluster"], [Attribute("hasMetalElement", F.col("p_brand"))]),
        "space_groups": lambda: entity_triples(part.select("p_size").distinct(), mint("SpaceGroup", F.col("p_size")), ["StructuralProperty"], [Attribute("hasPropertyName", F.concat(F.lit("Space group: "), F.col("p_size").cast("string")))]),
    }
    links = item.select("l_partkey", "l_suppkey").distinct()
    out["linker_links"] = lambda: link_triples(links, mint("MOF", F.col("l_partkey")), "hasLinker", mint("Linker", F.col("l_suppkey")), "usedInMOF")
    out["metal_links"] = lambda: link_triples(part, mof, "hasMetalNode", mint("MetalCluster", F.col("p_brand")), "isComponentOf")
    out["topology_links"] = lambda: link_triples(part, mof, "hasTopology", mint("Topology", F.col("p_type")))
    out["space_group_links"] = lambda: link_triples(part, mof, "hasSpaceGroup", mint("SpaceGroup", F.col("p_size")), "hasSpaceGroupOwner")
    rows = properties(spark, sf)
    node = mint("Property", F.concat_ws("_", F.col("part_key").cast("string"), "key"))
    out["properties"] = lambda: entity_triples(rows, node, [F.col("kind")], [Attribute("hasPropertyName", F.col("name")), Attribute("hasValue", F.col("value"), "decimal"), Attribute("hasUnits", F.nullif(F.col("unit"), F.lit("")))])
    out["property_links"] = lambda: link_triples(rows, mint("MOF", F.col("part_key")), F.concat(F.lit("has"), F.col("kind")), node, F.concat(F.lit("has"), F.col("kind"), F.lit("Owner")))
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    made = item.select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    synthesis = mint("Synthesis", F.col("o_orderkey"))
    out["syntheses"] = lambda: entity_triples(orders, synthesis, ["SynthesisProcess"], [Attribute("hasYield", F.col("o_totalprice").cast(DECIMAL), "decimal")])
    out["synthesis_links"] = lambda: link_triples(made, mint("MOF", F.col("l_partkey")), "hasSynthesisProcess", synthesis, "hasMOF")
    out["condition_links"] = lambda: link_triples(orders, synthesis, "hasCondition", mint("Condition", F.col("o_orderpriority")))
    solvents = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    out["solvent_links"] = lambda: link_triples(solvents, synthesis, "usesSolvent", mint("Solvent", F.col("c_nationkey")), "usedInSynthesis")
    derived = part.filter("p_partkey % 10 <> 0")
    func = mint("FuncMOF", F.concat_ws("_", (F.col("p_partkey") - F.col("p_partkey") % 10).cast("string"), F.col("p_partkey").cast("string")))
    out["derivatives"] = lambda: entity_triples(derived, func, ["MOF", "FunctionalizedMOF"], [Attribute("hasName", F.col("p_name"))])
    out["derivative_links"] = lambda: link_triples(derived, func, "derivedFrom", mint("MOF", F.col("p_partkey") - F.col("p_partkey") % 10))
    out["functionalizations"] = lambda: link_triples(derived, func, "hasFunctionalization", mint("Functionalization", F.col("p_type")))
    out["functionalization_types"] = lambda: link_triples(
        part.select("p_type").distinct(), mint("Functionalization", F.col("p_type")), "hasFunctionalizationType", F.when(F.col("p_type").isin("SMALL", "LARGE"), mint("Type", F.lit("amine"))).otherwise(mint("Type", F.lit("halogen")))
    )
    out["capabilities"] = lambda: link_triples(part.filter("p_size > 45"), mof, "hasCapability", mint("CAP", F.col("p_type")))
    return Kinds(out | more_parts(spark, sf))


def more_parts(spark: SparkSession, sf: str) -> dict[str, Callable[[], DataFrame]]:
    """Crystal systems, lattices, conditions, abstracts, capabilities, functionalizations, chemicals, solvents and additives, and their links."""
    part, orders, customer, nation, region, documents = (table(spark, sf, t) for t in ("part", "orders", "customer", "nation", "region", "documents"))
    mof, system = mint("MOF", F.col("p_partkey")), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    systems = part.select(system.alias("system")).distinct()
    decimal = lambda c: F.expr(c).cast(DECIMAL)
    lattice, types = mint("Lattice", F.col("p_partkey")), part.groupBy("p_type").agg(F.max("p_size").alias("size"))
    kind = F.when(F.col("p_type").isin(list(CAPABILITY_OF)), F.element_at(F.create_map(*[F.lit(x) for pair in CAPABILITY_OF.items() for x in pair]), F.col("p_type"))).otherwise("OtherCapability")
    functionalization = mint("Functionalization", F.col("p_type"))
    group = F.coalesce(F.when(F.length("p_type") > 5, F.col("p_type")), F.lower("p_type"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    names = [Attribute("hasChemicalName", F.col("n_name")), Attribute("hasAlternativeChemicalName", F.filter(F.array("n_name", "r_name"), lambda n: n != F.col("n_name")), many=True)]
    segments, priorities = customer.select("c_mktsegment").distinct(), orders.select("o_orderpriority").distinct()
    abstract, path = mint("Abstract", F.col("doc_id")), F.concat(F.lit("papers/10."), F.col("doc_id").cast("string"), F.lit("%2F"), F.coalesce("source", F.lit("none")))
    described = documents.join(part.select("p_partkey"), F.col("doc_id") == F.col("p_partkey"))
    ordered = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return {
        "crystal_systems": lambda: entity_triples(systems, mint("CrystalSystem", F.col("system")), ["StructuralProperty"], [Attribute("hasPropertyName", F.concat(F.lit("Crystal system: "), "system"))]),
        "crystal_system_links": lambda: link_triples(part, mof, "hasCrystalSystem", mint("CrystalSystem", system), "hasCrystalSystemOwner"),
        "lattices": lambda: entity_triples(part, lattice, ["StructuralProperty"], [Attribute("hasPropertyName", F.concat(F.lit("Lattice of "), "p_name")), Attribute("hasUnits", F.lit("angstrom")), Attribute("hasValue", decimal("cast(p_retailprice AS decimal(18,4)) * p_size"), "decimal")]),
        "lattice_links": lambda: link_triples(part, mof, "hasLatticeParameters", lattice, "hasLatticeParametersOwner"),
        "conditions": lambda: entity_triples(priorities, mint("Condition", F.col("o_orderpriority")), ["SynthesisCondition"], [Attribute("hasTemperature", decimal("substr(o_orderpriority, 1, 1)"), "decimal"), Attribute("hasReactionTime", decimal("length(o_orderpriority)"), "decimal")]),
        "abstracts": lambda: entity_triples(
            documents, abstract, ["Abstract", "Publication"],
            [Attribute("publicationTitle", F.nullif(F.substring("text", 1, 30), F.lit(""))), Attribute("publicationAbstract", F.nullif(F.col("text"), F.lit(""))), Attribute("publicationJournal", F.col("source")), Attribute("publicationDOI", extract_doi(path))],
        ),
        "abstract_links": lambda: link_triples(described, mint("MOF", F.col("p_partkey")), "hasAbstract", abstract, "describedInAbstract"),
        "capability_kinds": lambda: entity_triples(types, mint("CAP", F.col("p_type")), ["Capability", F.when(kind.isin(CAPABILITY_CLASSES), kind).otherwise("Capability")], [Attribute("hasValue", decimal("size"), "decimal")]),
        "functionalization_kinds": lambda: entity_triples(
            types, functionalization, ["Functionalization"],
            [Attribute("functionalizationMethod", F.lower("p_type")), Attribute("functionalizationDegree", decimal("size"), "decimal"), Attribute("functionalGroupName", group)],
        ),
        "functional_group_links": lambda: link_triples(types, functionalization, "usesFunctionalGroup", mint("Chemical", group)),
        "chemicals": lambda: entity_triples(places, mint("Chemical", F.col("n_nationkey")), ["Chemical"], names),
        "solvents": lambda: entity_triples(places, mint("Solvent", F.col("n_nationkey")), ["Chemical", "Solvent"], names),
        "additives": lambda: entity_triples(segments, mint("Chemical", F.col("c_mktsegment")), ["Chemical", "Additive"], [Attribute("hasChemicalName", F.lower("c_mktsegment"))]),
        "additive_links": lambda: link_triples(ordered, mint("Synthesis", F.col("o_orderkey")), "usesAdditive", mint("Chemical", F.col("c_mktsegment")), "usedAsAdditiveIn"),
    }


SOURCES = ("part", "supplier", "lineitem", "orders", "customer", "nation", "region", "documents")
#: How a stored graph's triples are read: the kind of row and the predicate are folders.
STORED = "s string, o string, o_kind string, datatype string, lang string, kind string, p string"


def graph(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """Triples of the named kinds of rows (all, without a name), read from where each kind is written once in a session, in a folder for each predicate.

    So a pattern with a predicate reads that predicate's files alone. Each kind is written as a set; no two kinds give the same triple.
    """

    def write(names: list[str], path: str) -> None:
        made, wanted = parts(spark, sf), [n.removeprefix("kind=") for n in names]
        # Large kinds one after the other, so that only one's shuffle files are on disk.
        for some in [[k for k in wanted if k not in LARGE], *[[k] for k in wanted if k in LARGE]]:
            if some:
                rows = reduce(DataFrame.unionByName, [made[k].select(F.lit(k).alias("kind"), *TRIPLE_COLUMNS) for k in some])
                rows.distinct().write.mode("append").partitionBy("kind", "p").parquet(path)
                release(spark)

    found = written_once(spark, [f"kind={k}" for k in kinds or SQL_PARTS], [f"{sf}/{t}.parquet" for t in SOURCES], write)
    roots: dict[str, list[str]] = {}
    for path in found:
        roots.setdefault(path.rsplit("/", 1)[0], []).append(path)
    read = [spark.read.schema(STORED).option("basePath", root).parquet(*paths).select(*TRIPLE_COLUMNS) for root, paths in roots.items()]
    return reduce(DataFrame.unionByName, read)


#: Kinds of rows that grow with orders and line items, or hold several triples of each part.
LARGE = ("linker_links", "properties", "property_links", "syntheses", "synthesis_links", "solvent_links", "additive_links")
NUMBERED = "s long, o long, o_kind string, datatype string, lang string, kind string, p string"


def encoded(spark: SparkSession, sf: str, constants: list[str], *kinds: str) -> tuple[DataFrame, terms.Terms]:
    """Triples of the named kinds of rows with s and o as numbers, and the table of their texts; written once in a session for the same kinds, with a folder for each kind and predicate.

    They are made from the tables, not from the stored texts: only the different texts are written, and triples are told apart by their numbers. ``constants`` are texts of rules, which need numbers too.
    """

    def write(names: list[str], path: str) -> None:
        made = parts(spark, sf)
        rows = reduce(DataFrame.unionByName, [made[k].select(F.lit(k).alias("kind"), *TRIPLE_COLUMNS) for k in kinds])
        terms.write(rows, f"{path}/{names[0]}", ["kind", "p"], constants)

    (path,) = written_once(spark, ["encoded-" + "-".join(sorted(kinds))], [f"{sf}/{t}.parquet" for t in SOURCES], write)
    return spark.read.schema(NUMBERED).parquet(f"{path}/triples").select(*TRIPLE_COLUMNS), terms.read(spark, path)


_K, _O = "'http://example.org/kg#", "'http://example.org/onto#"
_TYPE = "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'"


def _uri(kind: str, key: str) -> str:
    return f"{_K}{kind}_' || regexp_replace(CAST({key} AS VARCHAR), '[^A-Za-z0-9_\\-.]', '_', 'g')"


def _lit(rows: str, s: str, p: str, o: str, kind: str = "string") -> str:
    return f"SELECT {s} AS s, {_O}{p}' AS p, CAST({o} AS VARCHAR) AS o, 'literal' AS o_kind, 'http://www.w3.org/2001/XMLSchema#{kind}' AS datatype, CAST(NULL AS VARCHAR) AS lang FROM {rows}"


def _link(rows: str, s: str, p: str, o: str) -> str:
    p = p if p.startswith("'") else f"{_O}{p}'"
    return f"SELECT {s}, {p}, {o}, 'uri', NULL, NULL FROM {rows}"


def _is(rows: str, s: str, kind: str) -> str:
    return f"SELECT {s}, {_TYPE}, {_O}' || {kind}, 'uri', NULL, NULL FROM {rows}"


_CENTS = "CAST(round({} * 100) AS BIGINT)".format
PROPERTY_SQL = (
    f"prop AS (WITH su AS (SELECT l_partkey AS p_partkey, sum({_CENTS('l_extendedprice')}) AS avg_price, sum({_CENTS('l_quantity')}) AS quantity, sum({_CENTS('l_discount')}) AS discount, max({_CENTS('l_tax')}) AS tax, count(*) AS n FROM lineitem GROUP BY 1), "
    "st AS (SELECT p_partkey, CAST((2 * avg_price + n) // (2 * n) AS BIGINT) AS avg_price, CAST(quantity AS BIGINT) AS quantity, CAST((2 * discount + n) // (2 * n) AS BIGINT) AS discount, tax FROM su), "
    f"wd AS (SELECT p.p_partkey, {_CENTS('p_retailprice')} AS price, {_CENTS('p_size')} AS size, avg_price, quantity, discount, tax FROM part p LEFT JOIN st USING (p_partkey)) "
    + " UNION ALL ".join(f"SELECT p_partkey AS part_key, '{k}' AS key, '{n}' AS name, '{t}' AS kind, '{u}' AS unit, CAST({k} * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS value FROM wd WHERE {k} IS NOT NULL" for k, n, t, u in PROPERTIES)
    + ")"
)
_M, _F = _uri("MOF", "p_partkey"), _uri("FuncMOF", "(p_partkey - p_partkey % 10) || '_' || p_partkey")
_P, _S = _uri("Property", "part_key || '_' || key"), _uri("Synthesis", "o_orderkey")
_D = "part WHERE p_partkey % 10 <> 0"
_LS = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"
_FI = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_SO = "orders JOIN customer ON o_custkey = c_custkey"
SQL_PARTS: dict[str, list[str]] = {
    "materials": [
        _lit("part", _M, "hasName", "p_name"), _is("part", _M, "'MOF'"), _is("part", _M, "CASE WHEN p_size <= 25 THEN 'ExperimentalMOF' ELSE 'HypotheticalMOF' END"),
        _lit("part", _M, "isHypothetical", "p_size > 25", "boolean"), _lit("part", _M, "hasFormula", "p_brand"),
    ],
    "linkers": [_lit("supplier", _uri("Linker", "s_suppkey"), "hasLinkerName", "s_name"), _is("supplier", _uri("Linker", "s_suppkey"), "'Linker'")],
    "topologies": [_lit("(SELECT DISTINCT p_type FROM part)", _uri("Topology", "p_type"), "hasTopologyName", "lower(p_type)"), _is("(SELECT DISTINCT p_type FROM part)", _uri("Topology", "p_type"), "'Topology'")],
    "metals": [_lit("(SELECT DISTINCT p_brand FROM part)", _uri("MetalCluster", "p_brand"), "hasMetalElement", "p_brand"), _is("(SELECT DISTINCT p_brand FROM part)", _uri("MetalCluster", "p_brand"), "'MetalCluster'")],
    "space_groups": [_lit("(SELECT DISTINCT p_size FROM part)", _uri("SpaceGroup", "p_size"), "hasPropertyName", "'Space group: ' || p_size"), _is("(SELECT DISTINCT p_size FROM part)", _uri("SpaceGroup", "p_size"), "'StructuralProperty'")],
    "linker_links": [_link(_LS, _uri("MOF", "l_partkey"), "hasLinker", _uri("Linker", "l_suppkey")), _link(_LS, _uri("Linker", "l_suppkey"), "usedInMOF", _uri("MOF", "l_partkey"))],
    "metal_links": [_link("part", _M, "hasMetalNode", _uri("MetalCluster", "p_brand")), _link("part", _uri("MetalCluster", "p_brand"), "isComponentOf", _M)],
    "topology_links": [_link("part", _M, "hasTopology", _uri("Topology", "p_type"))],
    "space_group_links": [_link("part", _M, "hasSpaceGroup", _uri("SpaceGroup", "p_size")), _link("part", _uri("SpaceGroup", "p_size"), "hasSpaceGroupOwner", _M)],
    "properties": [_lit("prop", _P, "hasPropertyName", "name"), _is("prop", _P, "kind"), _lit("prop", _P, "hasValue", "value", "decimal"), _lit("prop WHERE unit <> ''", _P, "hasUnits", "unit")],
    "property_links": [_link("prop", _uri("MOF", "part_key"), f"{_O}has' || kind", _P), _link("prop", _P, f"{_O}has' || kind || 'Owner'", _uri("MOF", "part_key"))],
    "syntheses": [_lit("orders", _S, "hasYield", "CAST(o_totalprice AS DECIMAL(18,4))", "decimal"), _is("orders", _S, "'SynthesisProcess'")],
    "synthesis_links": [_link(_FI, _uri("MOF", "l_partkey"), "hasSynthesisProcess", _S), _link(_FI, _S, "hasMOF", _uri("MOF", "l_partkey"))],
    "condition_links": [_link("orders", _S, "hasCondition", _uri("Condition", "o_orderpriority"))],
    "solvent_links": [_link(_SO, _S, "usesSolvent", _uri("Solvent", "c_nationkey")), _link(_SO, _uri("Solvent", "c_nationkey"), "usedInSynthesis", _S)],
    "derivatives": [_lit(_D, _F, "hasName", "p_name"), _is(_D, _F, "'MOF'"), _is(_D, _F, "'FunctionalizedMOF'")],
    "derivative_links": [_link(_D, _F, "derivedFrom", _uri("MOF", "(p_partkey - p_partkey % 10)"))],
    "functionalizations": [_link(_D, _F, "hasFunctionalization", _uri("Functionalization", "p_type"))],
    "functionalization_types": [_link("(SELECT DISTINCT p_type FROM part)", _uri("Functionalization", "p_type"), "hasFunctionalizationType", "CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'http://example.org/kg#Type_amine' ELSE 'http://example.org/kg#Type_halogen' END")],
    "capabilities": [_link("part WHERE p_size > 45", _M, "hasCapability", _uri("CAP", "p_type"))],
}
_SYS = "(SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS system FROM part)"
_TYP = "(SELECT p_type, max(p_size) AS size FROM part GROUP BY 1)"
_PRIO, _SEG, _PLC = "(SELECT DISTINCT o_orderpriority FROM orders)", "(SELECT DISTINCT c_mktsegment FROM customer)", "nation JOIN region ON n_regionkey = r_regionkey"
_DOI = "'papers/10.' || doc_id || '%2F' || coalesce(source, 'none')"
_GROUP = "CASE WHEN length(p_type) > 5 THEN p_type ELSE lower(p_type) END"
_CAP = "CASE p_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CAPABILITY_OF.items()) + " ELSE 'Capability' END"
_L, _C, _A, _FN, _DP = _uri("Lattice", "p_partkey"), _uri("Condition", "o_orderpriority"), _uri("Abstract", "doc_id"), _uri("Functionalization", "p_type"), "documents JOIN part ON doc_id = p_partkey"


def _named(rows: str, s: str) -> list[str]:
    return [_lit(rows, s, "hasChemicalName", "n_name"), _lit(f"{rows} WHERE r_name <> n_name", s, "hasAlternativeChemicalName", "r_name"), _is(rows, s, "'Chemical'")]


SQL_PARTS |= {
    "crystal_systems": [_lit(_SYS, _uri("CrystalSystem", "system"), "hasPropertyName", "'Crystal system: ' || system"), _is(_SYS, _uri("CrystalSystem", "system"), "'StructuralProperty'")],
    "crystal_system_links": [_link("part", _M, "hasCrystalSystem", _uri("CrystalSystem", "lower(split_part(p_name, ' ', 1))")), _link("part", _uri("CrystalSystem", "lower(split_part(p_name, ' ', 1))"), "hasCrystalSystemOwner", _M)],
    "lattices": [
        _lit("part", _L, "hasPropertyName", "'Lattice of ' || p_name"), _lit("part", _L, "hasUnits", "'angstrom'"), _is("part", _L, "'StructuralProperty'"),
        _lit("part", _L, "hasValue", "CAST(CAST(p_retailprice AS DECIMAL(18,4)) * p_size AS DECIMAL(18,4))", "decimal"),
    ],
    "lattice_links": [_link("part", _M, "hasLatticeParameters", _L), _link("part", _L, "hasLatticeParametersOwner", _M)],
    "conditions": [_lit(_PRIO, _C, "hasTemperature", "CAST(substr(o_orderpriority, 1, 1) AS DECIMAL(18,4))", "decimal"), _lit(_PRIO, _C, "hasReactionTime", "CAST(length(o_orderpriority) AS DECIMAL(18,4))", "decimal"), _is(_PRIO, _C, "'SynthesisCondition'")],
    "abstracts": [
        _lit("documents WHERE text <> ''", _A, "publicationTitle", "substring(text, 1, 30)"), _lit("documents WHERE text <> ''", _A, "publicationAbstract", "text"), _lit("documents WHERE source IS NOT NULL", _A, "publicationJournal", "source"),
        _lit("documents", _A, "publicationDOI", f"CASE WHEN contains({_DOI}, '10.') THEN replace(substr({_DOI}, strpos({_DOI}, '10.')), '%2F', '/') ELSE {_DOI} END"), _is("documents", _A, "'Abstract'"), _is("documents", _A, "'Publication'"),
    ],
    "abstract_links": [_link(_DP, _M, "hasAbstract", _A), _link(_DP, _A, "describedInAbstract", _M)],
    "capability_kinds": [_lit(_TYP, _uri("CAP", "p_type"), "hasValue", "CAST(size AS DECIMAL(18,4))", "decimal"), _is(_TYP, _uri("CAP", "p_type"), "'Capability'"), _is(_TYP, _uri("CAP", "p_type"), f"({_CAP})")],
    "functionalization_kinds": [
        _lit(_TYP, _FN, "functionalizationMethod", "lower(p_type)"), _lit(_TYP, _FN, "functionalizationDegree", "CAST(size AS DECIMAL(18,4))", "decimal"), _lit(_TYP, _FN, "functionalGroupName", _GROUP), _is(_TYP, _FN, "'Functionalization'"),
    ],
    "functional_group_links": [_link(_TYP, _FN, "usesFunctionalGroup", _uri("Chemical", f"({_GROUP})"))],
    "chemicals": _named(_PLC, _uri("Chemical", "n_nationkey")),
    "solvents": [*_named(_PLC, _uri("Solvent", "n_nationkey")), _is(_PLC, _uri("Solvent", "n_nationkey"), "'Solvent'")],
    "additives": [_lit(_SEG, _uri("Chemical", "c_mktsegment"), "hasChemicalName", "lower(c_mktsegment)"), _is(_SEG, _uri("Chemical", "c_mktsegment"), "'Chemical'"), _is(_SEG, _uri("Chemical", "c_mktsegment"), "'Additive'")],
    "additive_links": [_link(_SO, _S, "usesAdditive", _uri("Chemical", "c_mktsegment")), _link(_SO, _uri("Chemical", "c_mktsegment"), "usedAsAdditiveIn", _S)],
}


def graph_sql(*kinds: str) -> str:
    """``WITH`` expressions that end in ``triples`` (of the named kinds, or all)."""
    some = [q for k, v in SQL_PARTS.items() if not kinds or k in kinds for q in v]
    if "s_kind" not in some[0] and not some[0].startswith("SELECT") or " AS s," not in some[0]:
        some = ["SELECT '' AS s, '' AS p, '' AS o, '' AS o_kind, '' AS datatype, '' AS lang WHERE false", *some]
    return f"WITH RECURSIVE {PROPERTY_SQL}, triples AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(some)}))"
