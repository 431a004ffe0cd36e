"""Registered queries: extraction jobs over the star schema's tables renamed to the sources' columns, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.functions.strings import crystal_system
from orefield.operators import resolve as R
from orefield.plans.star import table
from orefield.sources import extract as X

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def part(spark, sf):
    return table(spark, sf, "part")


@query("X1_materials", "SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS canonical_name, p_name || '+' || p_brand AS all_names, p_type AS topology FROM part")
def _(spark, sf):
    names = part(spark, sf).select(c("p_partkey").cast("string").alias("code"), F.concat("p_name", F.lit("<|> "), "p_brand").alias("names"))
    twice = part(spark, sf).select(c("p_partkey").cast("string").alias("code"), F.concat(F.lit("C.C MOFid-v1."), "p_type", F.lit(".cat0")).alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"))
    twice = twice.withColumn("id", F.when(c("ord") == 2, c("id")).otherwise("C.C MOFid-v1.old.cat0"))
    out = X.materials(names, twice, "code", "ord", {"topology": X.topology_of(c("id"))})
    return out.withColumn("all_names", F.array_join("all_names", "+"))


_MELT = "SELECT CAST(p_partkey AS VARCHAR) AS mof_id, 'Band gap' AS property_name, 'eV' AS units, p_retailprice AS value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'Density', 'g/cm³', CAST(p_size AS DOUBLE) FROM part WHERE p_size > 20"


@query("X2_computed_properties", _MELT)
def _(spark, sf):
    rows = part(spark, sf).select("p_partkey", c("p_retailprice").cast("string").alias("Band gap (eV)"), F.when(c("p_size") > 20, c("p_size").cast("string")).otherwise("n/a").alias("density [g/cm^3]"))
    return X.melt_properties(rows, "p_partkey", X.COMPUTED_PROPERTIES).select("mof_id", "property_name", "units", "value")


@query("X3_long_properties", "SELECT CAST(user_id AS VARCHAR) AS mof_id, event_type AS property_name, CASE WHEN event_type = 'Space group' THEN 'StructuralProperty' ELSE 'PhysicalProperty' END AS property_type, value FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").withColumns({"u": F.lit("ms"), "k": F.lit(None).cast("string")})
    return X.long_properties(rows, "user_id", "event_type", "value", "u", "k").select("mof_id", "property_name", "property_type", "value")


@query("X4_X5_dimensions_and_links", "SELECT lower(p_type) AS entity_id, arg_min(p_type, p_partkey) AS name, count(*) AS n_links FROM part GROUP BY 1")
def _(spark, sf):
    entities, links = X.dimension_and_links(part(spark, sf), "p_partkey", F.lower("p_type"), {"name": c("p_type")}, "p_partkey")
    return entities.join(links.groupBy("entity_id").agg(F.count("*").alias("n_links")), "entity_id")


@query("X6_lattices", "SELECT p_partkey AS mof_id, CAST(p_size - 10 AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM part WHERE p_size <> 10")
def _(spark, sf):
    rows = part(spark, sf).select("p_partkey", (c("p_size") - 10).cast("string").alias("a"), F.lit("nan").alias("b"), F.lit(None).cast("string").alias("c"))
    return X.lattices(rows, "p_partkey").select("mof_id", "a", "b")


@query("X7_X14_X23_topologies", "SELECT DISTINCT p_type AS topology FROM part WHERE p_type NOT IN ('PROMO')")
def _(spark, sf):
    text = F.concat(F.lit("C MOFid-v1."), F.when(c("p_type") == "PROMO", "ERROR").otherwise(c("p_type")), F.lit(".cat0"))
    return part(spark, sf).select(X.topology_of(text).alias("topology")).filter("topology is not null").distinct()


@query("X8_X12_X21_exploded_linkers", "WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT 'LINKER_' || upper(substr(md5(w), 1, 8)) AS entity_id, w AS name, count(*) AS n_links FROM t GROUP BY 1, 2")
def _(spark, sf):
    entities, links = X.exploded_entities(part(spark, sf), "p_partkey", F.split("p_name", " "), "LINKER_")
    return entities.join(links.groupBy("entity_id").agg(F.count("*").alias("n_links")), "entity_id")


@query("X9_X13_X22_metal_clusters", "SELECT 'CLUSTER_' || least(p_brand, p_type) || '_' || greatest(p_brand, p_type) AS cluster_id, count(*) AS n_links FROM part GROUP BY 1")
def _(spark, sf):
    _, links = X.metal_clusters(part(spark, sf), "p_partkey", F.array("p_type", F.lit("0"), "p_brand"))
    return links.groupBy("cluster_id").agg(F.count("*").alias("n_links"))


@query("X10_capabilities", "SELECT 'CAP_' || p_partkey || '_' || k AS capability_id, CAST(p_partkey AS VARCHAR) AS mof_id, k AS capability_type FROM (SELECT *, CASE WHEN contains(p_name, 'ring') THEN 'RingCapability' WHEN contains(p_name, 'red') THEN 'RedCapability' ELSE 'Capability' END AS k FROM part WHERE p_type <> 'PROMO')")
def _(spark, sf):
    rows = part(spark, sf).withColumn("application", F.when(c("p_type") == "PROMO", "Not Provided").otherwise(c("p_name")))
    return X.capabilities(rows, "p_partkey", "application", [("Ring", "RingCapability"), ("RED", "RedCapability")])


@query("X11_X19_union_merge", "SELECT CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_size > 20 THEN p_name || '+' || upper(p_name) ELSE upper(p_name) END AS n, CASE WHEN p_size > 20 THEN p_type ELSE lower(p_type) END AS topology FROM part")
def _(spark, sf):
    rows = part(spark, sf)
    a = rows.filter("p_size > 20").select(c("p_partkey").cast("string").alias("code"), F.array("p_name").alias("names"), c("p_type").alias("topology"), F.lit(0).alias("ord"))
    b = rows.select(c("p_partkey").cast("string").alias("code"), F.array(F.upper("p_name")).alias("names"), F.lower("p_type").alias("topology"), F.lit(1).alias("ord"))
    out = R.merge_by_key(X.union_sources(a, b), "code", "ord", ["names"], ["topology"])
    return out.select("code", F.array_join(F.array_sort("names", lambda x, y: F.when(F.lower(x) == x, -1).otherwise(1)), "+").alias("n"), "topology")


@query("X15_measured_properties", "SELECT CAST(p_partkey AS VARCHAR) AS mof_id, 'Pore limiting diameter' AS property_name, CAST(p_size % 5 AS DOUBLE) AS value FROM part WHERE p_size % 5 <> 0")
def _(spark, sf):
    rows = part(spark, sf).select("p_partkey", (c("p_size") % 5).cast("string").alias("PLD (Å)"))
    return X.melt_properties(rows, "p_partkey", X.MEASURED_PROPERTIES, zero_is_missing=True).select("mof_id", "property_name", "value")


@query("X16_X35_processes", "SELECT 'SYNTH_' || o_orderkey AS synthesis_id, o_orderpriority AS method, round(o_totalprice, 2) AS yield_percent FROM orders")
def _(spark, sf):
    return X.processes(table(spark, sf, "orders"), "o_orderkey", c("o_orderpriority"), c("o_totalprice")).select("synthesis_id", "method", F.round("yield_percent", 2).alias("yield_percent"))


@query("X17_X36_conditions", "SELECT 'COND_' || p_partkey AS condition_id, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS temperature_c, CASE WHEN p_size > 20 THEN CAST(p_size AS DOUBLE) END AS time_hours FROM part WHERE p_size > 10")
def _(spark, sf):
    t = lambda n: F.when(c("p_size") > n, F.concat(F.lit("∼"), c("p_size").cast("string"))).otherwise("unknown")
    return X.conditions(part(spark, sf), "p_partkey", t(10), t(20), F.lit(None).cast("string")).select("condition_id", "temperature_c", "time_hours")


@query("X18_abstracts", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def _(spark, sf):
    from orefield.functions.strings import clean_null

    return table(spark, sf, "documents").filter(clean_null(c("text")).isNotNull()).select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("X20_nested_properties", "SELECT event_id AS mof_id, 'Density' AS property_name, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events UNION ALL SELECT event_id, 'Unit cell volume', value FROM events")
def _(spark, sf):
    data = F.struct(F.struct(F.from_json("props", "k double")["k"].alias("value")).alias("density"), c("value").alias("volume"))
    rows = table(spark, sf, "events").select("event_id", data.alias("data"))
    return X.nested_properties(rows, c("event_id"), "data").select("mof_id", "property_name", "value")


_AM = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b, _ in X.AMINES)


@query("X26_X27_functionalized", f"SELECT p_type || '_0.16_' || p_partkey AS func_mof_id, coalesce(v.n, code) AS amine, CAST(0.16 AS DOUBLE) AS degree FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'tmen' ELSE 'zz' END AS code FROM part) p LEFT JOIN (VALUES {_AM}) v(k, n) ON v.k = p.code")
def _(spark, sf):
    code = F.when(c("p_size") % 3 == 0, "en").when(c("p_size") % 3 == 1, "tmen").otherwise("zz")
    rows = part(spark, sf).select(F.concat_ws("_", "p_type", F.lit("0.16"), c("p_partkey").cast("string")).alias("name"), c("p_type").alias("parent"), code.alias("code"))
    return X.functionalized(rows, spark.createDataFrame(X.AMINES, "a string, b string, c string")).select("func_mof_id", "amine", "degree")


@query("X28_binding_energies", "SELECT p_name AS mof_id, 'Binding Energy CO2' AS property_name, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size > 10 UNION ALL SELECT p_name, 'Binding Energy H2O', p_retailprice FROM part")
def _(spark, sf):
    energies = F.create_map(F.lit("CO2"), F.when(c("p_size") > 10, c("p_size").cast("string")).otherwise("null"), F.lit("H2O"), c("p_retailprice").cast("string"))
    return X.binding_energies(part(spark, sf).select(c("p_name").alias("name"), energies.alias("energies"))).select("mof_id", "property_name", "value")


@query("X29_parents", "SELECT DISTINCT CAST(p_partkey - p_partkey % 10 AS VARCHAR) AS parent FROM part WHERE p_partkey % 10 <> 0")
def _(spark, sf):
    return part(spark, sf).filter("p_partkey % 10 <> 0").select((c("p_partkey") - c("p_partkey") % 10).cast("string").alias("parent")).distinct()


@query("X32_text_mentions", r"SELECT DISTINCT doc_id AS mof_id, unnest(regexp_extract_all(lower(text), '\b(the|and|with)\b', 1) || regexp_extract_all(lower(text), '\b(der|die|und)\b', 1)) AS name FROM documents WHERE regexp_matches(text, '^[ -~\n]*$')")
def _(spark, sf):
    rows = table(spark, sf, "documents").filter(c("text").rlike(r"^[ -~\n]*\z"))
    return X.text_mentions(rows, "doc_id", c("text"), [r"\b(the|and|with)\b", r"\b(der|die|und)\b"])


@query("X31_X33_consolidated_linkers", "WITH t AS (SELECT p_brand AS entity_id, CASE WHEN p_size > 25 THEN 'Linker_' || p_size ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS smiles, p_type AS source, p_partkey AS ord FROM part) SELECT entity_id, coalesce(arg_min(name, ord) FILTER (NOT starts_with(name, 'Linker_')), arg_min(name, ord)) AS canonical_name, coalesce(arg_min(smiles, ord) FILTER (smiles IS NOT NULL), '') AS smiles, count(DISTINCT name) AS n_names, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM t GROUP BY 1")
def _(spark, sf):
    rows = part(spark, sf).select(c("p_brand").alias("entity_id"), F.when(c("p_size") > 25, F.concat(F.lit("Linker_"), c("p_size").cast("string"))).otherwise(c("p_name")).alias("name"), F.when(c("p_size") % 2 == 0, c("p_type")).alias("smiles"), c("p_type").alias("source"), c("p_partkey").alias("mof_id"), c("p_partkey").alias("ord"))
    entities, _ = X.consolidate(rows)
    return entities.select("entity_id", "canonical_name", "smiles", F.size("all_names").cast("long").alias("n_names"), F.array_join("data_sources", "+").alias("sources"))


@query("X34_X37_X38_merged_syntheses", "SELECT p_type || p_partkey AS code, CAST(p_size AS DOUBLE) AS temperature_c, p_size || '+' || (p_size + 1) AS solvents FROM part")
def _(spark, sf):
    rows = part(spark, sf).select(F.concat("p_type", c("p_partkey").cast("string"), F.lit("_clean")).alias("filename"), F.lit("n/a").alias("temperature_Celsius"), F.lit(None).cast("string").alias("time_h"), F.lit("5").alias("Yield_Percent"), F.concat(c("p_size").cast("string"), F.lit(".0")).alias("solvent1"), F.lit(0).alias("source_rank"))
    again = rows.withColumns({"source_rank": F.lit(1), "filename": F.replace("filename", F.lit("_clean"), F.lit("_charged_clean")), "temperature_Celsius": F.concat(F.lit("∼"), F.replace("solvent1", F.lit(".0"), F.lit(""))), "solvent2": (c("solvent1").cast("double") + 1).cast("string")})
    out = X.merge_syntheses(X.union_sources(rows, again), {"solvents": ["solvent1", "solvent2"]})
    return out.select("code", "temperature_c", F.array_join("solvents", "+").alias("solvents"))


@query("X39_X40_stability", "SELECT CASE WHEN p_size <= 20 THEN 'M' || p_partkey WHEN p_size <= 30 THEN 'K' || p_partkey ELSE 'STAB_' || upper(substr(md5(p_brand || '.' || p_type || ' x' || p_partkey), 1, 8)) END AS mof_id, CASE WHEN p_size <= 20 THEN 'mofid' WHEN p_size <= 30 THEN 'mofkey' ELSE 'new_entry' END AS match, p_retailprice AS value FROM part")
def _(spark, sf):
    mofid = F.concat("p_brand", F.lit("."), "p_type", F.lit(" x"), c("p_partkey").cast("string"))
    rows = part(spark, sf).select(mofid.alias("mofid"), c("p_partkey").cast("string").alias("mofkey"), c("p_retailprice").alias("FE_atom"), "p_size")
    known = {"mofid": rows.filter("p_size <= 20").select(c("mofid").alias("key"), F.concat(F.lit("M"), "mofkey").alias("mof_id")), "mofkey": rows.filter("p_size <= 30").select(c("mofkey").alias("key"), F.concat(F.lit("K"), "mofkey").alias("mof_id"))}
    return X.stability(rows.drop("p_size"), "FE_atom", known)[0]


@query("S6_S14_triple_lines", "SELECT p_partkey AS k, '<http://example.org/kg#MOF_' || p_partkey || '> <http://example.org/onto#hasName> \"' || p_name || '\"^^<http://www.w3.org/2001/XMLSchema#string> .' AS value FROM part")
def _(spark, sf):
    from orefield.plans.star import parts
    from orefield.sources.tables import parse_triples, triple_lines

    rows = parts(spark, sf)["materials"].filter(c("p").endswith("hasName"))
    lines = triple_lines(parse_triples(triple_lines(rows)))
    return lines.select(F.regexp_extract("value", r"MOF_(\d+)>", 1).cast("long").alias("k"), "value")


@query("S7_S8_S17_edges_within", "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey % 2 = 0 AND l_suppkey % 2 = 0")
def _(spark, sf):
    from orefield.functions.strings import mint
    from orefield.plans.star import parts
    from orefield.schema import ONTO
    from orefield.sources import tables as S

    links = S.only_relations(parts(spark, sf)["linker_links"], [ONTO + "hasLinker"])
    items = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(mint("MOF", c("p_partkey")).alias("node"), c("p_partkey").alias("id"))
    sup = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(mint("Linker", c("s_suppkey")).alias("node"), c("s_suppkey").alias("id"))
    ids = items.unionByName(sup)
    return S.edge_list(S.edges_within(links, ids.select("node")), ids)


@query("S10_vectors_from_text", "SELECT vec_id, len(embedding) AS dims, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def _(spark, sf):
    from orefield.sources.tables import from_vector_text

    rows = table(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("text"))
    return from_vector_text(rows, "vec_id", "text").select("vec_id", F.size("v").cast("long").alias("dims"), F.get("v", F.lit(0)).cast("double").alias("first"))


@query("S3_nested_objects", "SELECT CAST(event_id AS VARCHAR) AS parent, 'k' AS code, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events")
def _(spark, sf):
    from orefield.sources.tables import explode_nested

    rows = table(spark, sf, "events").select(F.concat(F.lit('{"'), c("event_id").cast("string"), F.lit('": {"k": '), "props", F.lit(', "bad": 3}}')).alias("text"))
    return explode_nested(rows, "text", "k long").select("parent", "code", c("record.k").alias("v"))


_SYM = "CASE WHEN p_size < 10 THEN 'P-1' WHEN p_size < 20 THEN 'P21/c' WHEN p_size < 40 THEN 'P6/mmm' ELSE 'Fm-3m' END"


def _symbol():
    return F.when(c("p_size") < 10, "P-1").when(c("p_size") < 20, "P21/c").when(c("p_size") < 40, "P6/mmm").otherwise("Fm-3m")


@query("X24_space_groups", f"WITH s AS (SELECT p_partkey, {_SYM} AS symbol FROM part) SELECT symbol AS entity_id, arg_min(symbol, p_partkey) AS name, count(*) AS n_links FROM s GROUP BY 1")
def _(spark, sf):
    rows = part(spark, sf).withColumn("symbol", _symbol())
    entities, links = X.dimension_and_links(rows, "p_partkey", c("symbol"), {"name": c("symbol")}, "p_partkey")
    return entities.join(links.groupBy("entity_id").agg(F.count("*").alias("n_links")), "entity_id")


@query(
    "X25_crystal_systems",
    f"WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'orthorhombic' ELSE CASE {_SYM} WHEN 'P-1' THEN 'triclinic' WHEN 'P21/c' THEN 'monoclinic' WHEN 'P6/mmm' THEN 'hexagonal' ELSE 'cubic' END END AS system FROM part) SELECT system AS entity_id, count(*) AS n_links, min(p_partkey) AS first_key FROM s GROUP BY 1",
)
def _(spark, sf):
    given = F.when(c("p_partkey") % 3 == 0, "Orthorhombic")
    rows = part(spark, sf).withColumn("system", F.coalesce(F.lower(given), crystal_system(_symbol())))
    entities, links = X.dimension_and_links(rows, "p_partkey", c("system"), {"first_key": c("p_partkey")}, "p_partkey")
    return entities.join(links.groupBy("entity_id").agg(F.count("*").alias("n_links")), "entity_id").select("entity_id", "n_links", "first_key")


_AMINE_ROWS = ", ".join(f"({i}, '{code}', '{name}', '{kind}')" for i, (code, name, kind) in enumerate(X.AMINES))


@query("X30_amine_chemicals", f"SELECT p_partkey, code, name, kind FROM part JOIN (VALUES {_AMINE_ROWS}) a(i, code, name, kind) ON p_partkey % 12 = i")
def _(spark, sf):
    amines = F.broadcast(spark.createDataFrame([(i, *row) for i, row in enumerate(X.AMINES)], "i int, code string, name string, kind string"))  # ten rows
    return part(spark, sf).select("p_partkey").join(amines, c("p_partkey") % 12 == c("i")).select("p_partkey", "code", "name", "kind")
