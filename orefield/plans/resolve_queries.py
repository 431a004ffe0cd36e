"""Registered queries: the part table as three overlapping sources that are merged, matched and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.functions.strings import clean_name
from orefield.operators import resolve as R
from orefield.plans.star import table

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


#: Source i has the parts whose key mod 3 is not i, and lacks one column each.
_SRC = """src AS (
 SELECT CAST(p_partkey AS VARCHAR) AS mof_id, 0 AS ord, p_name AS nm, NULL AS formula, p_type AS topology, 'alpha' AS source FROM part WHERE p_partkey % 3 <> 0 UNION ALL
 SELECT CAST(p_partkey AS VARCHAR), 1, upper(p_name), p_brand, NULL, 'beta' FROM part WHERE p_partkey % 3 <> 1 UNION ALL
 SELECT CAST(p_partkey AS VARCHAR), 2, p_name, p_brand || 'x', lower(p_type), 'gamma' FROM part WHERE p_partkey % 3 <> 2)"""


def sources(spark, sf):
    part = table(spark, sf, "part")
    specs = [(0, c("p_name"), F.lit(None).cast("string"), c("p_type"), "alpha"), (1, F.upper("p_name"), c("p_brand"), F.lit(None).cast("string"), "beta"), (2, c("p_name"), F.concat(c("p_brand"), F.lit("x")), F.lower("p_type"), "gamma")]
    rows = [part.filter(c("p_partkey") % 3 != i).select(c("p_partkey").cast("string").alias("mof_id"), F.lit(i).alias("ord"), n.alias("nm"), f.alias("formula"), t.alias("topology"), F.lit(s).alias("source")) for i, n, f, t, s in specs]
    return R.append(*rows)


@query("N1_merge_materials", f"WITH {_SRC} SELECT mof_id, string_agg(DISTINCT nm, ';' ORDER BY nm) AS names, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, arg_min(formula, ord) FILTER (formula IS NOT NULL) AS formula, arg_min(topology, ord) FILTER (topology IS NOT NULL) AS topology, arg_max(ord, ord) AS last_source FROM src GROUP BY 1")
def _(spark, sf):
    rows = sources(spark, sf).withColumns({"names": F.array("nm"), "sources": F.array("source"), "other_ids": F.create_map(F.lit("last"), c("ord"))})
    out = R.merge_by_key(rows, "mof_id", "ord", ["names", "sources"], ["formula", "topology"], ["other_ids"])
    return out.select("mof_id", F.array_join("names", ";").alias("names"), F.array_join("sources", ";").alias("sources"), "formula", "topology", c("other_ids")["last"].alias("last_source"))


@query("N2_first_per_key", f"WITH {_SRC}, r AS (SELECT *, row_number() OVER (PARTITION BY mof_id ORDER BY ord, nm) AS rn FROM src) SELECT mof_id, ord, nm, source FROM r WHERE rn = 1")
def _(spark, sf):
    return R.first_per_key(sources(spark, sf), "mof_id", ["ord", "nm"]).select("mof_id", "ord", "nm", "source")


@query("N3_append", f"WITH {_SRC} SELECT source, count(*) AS n, count(formula) AS n_formula FROM src GROUP BY 1")
def _(spark, sf):
    return sources(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count("formula").alias("n_formula"))


@query("N4_accumulate_relations", "SELECT 'HAS_LINKER' AS rel_type, CAST(l_partkey AS VARCHAR) AS subject_id, CAST(l_suppkey AS VARCHAR) AS object_id FROM lineitem UNION ALL SELECT 'HAS_TOPOLOGY', CAST(p_partkey AS VARCHAR), p_type FROM part")
def _(spark, sf):
    item, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    parts = {"HAS_LINKER": item.select(c("l_partkey").alias("subject_id"), c("l_suppkey").alias("object_id")), "HAS_TOPOLOGY": part.select(c("p_partkey").alias("subject_id"), c("p_type").alias("object_id"))}
    return R.accumulate_relations(parts, {"HAS_LINKER", "HAS_TOPOLOGY"})


_REL = "SELECT 'HAS_TOPOLOGY' AS rel_type, CAST(p_partkey AS VARCHAR) AS subject_id, lower(p_type) AS object_id FROM part UNION ALL SELECT 'HAS_METAL', CAST(p_partkey AS VARCHAR), p_brand FROM part UNION ALL SELECT 'DERIVED_FROM', CAST(p_partkey AS VARCHAR), CAST(p_partkey - p_partkey % 10 AS VARCHAR) FROM part WHERE p_partkey % 10 <> 0"


def _relations(spark, sf):
    key = c("p_partkey")
    return R.relations_from_keys(table(spark, sf, "part"), "p_partkey", {"HAS_TOPOLOGY": F.lower("p_type"), "HAS_METAL": c("p_brand"), "DERIVED_FROM": F.when(key % 10 != 0, key - key % 10)})


@query("N5_relations_from_keys", _REL)
def _(spark, sf):
    return _relations(spark, sf)


@query("N6_distinct_relations", f"SELECT rel_type, count(*) AS n FROM (SELECT DISTINCT * FROM ({_REL} UNION ALL {_REL})) GROUP BY 1")
def _(spark, sf):
    rows = _relations(spark, sf)
    return R.distinct_relations(rows.unionByName(rows))


@query(
    "N7_name_lookup",
    "WITH a AS (SELECT p_name AS k, max(p_partkey) AS m FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS k, max(p_partkey) AS m FROM part WHERE p_size <= 40 GROUP BY 1) "
    "SELECT p_partkey, coalesce(a.m, b.m) AS match, CASE WHEN a.m IS NOT NULL THEN 0 WHEN b.m IS NOT NULL THEN 1 END AS match_step FROM part p LEFT JOIN a ON a.k = p.p_name LEFT JOIN b ON b.k = regexp_replace(upper(p.p_name), '[^A-Z0-9]', '', 'g')",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    known = part.select(c("p_partkey").alias("id"), c("p_name").alias("known_name"), c("p_size").alias("known_size"), c("p_partkey").alias("ord"))
    keys = [(c("p_name"), F.when(c("known_size") <= 25, c("known_name"))), (clean_name(c("p_name")), F.when(c("known_size") <= 40, clean_name(c("known_name"))))]
    return R.lookup(part.select("p_partkey", "p_name"), known, keys, "id", "ord").select("p_partkey", "match", "match_step")


_IDX = "SELECT p_partkey AS mof_id, p_type AS topology, list_sort(list_distinct(list(l_suppkey % 7))) AS linkers FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2"


def _index(spark, sf):
    item, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = item.join(part, c("l_partkey") == c("p_partkey"))
    return rows.groupBy(c("p_partkey").alias("mof_id"), c("p_type").alias("topology")).agg(F.array_sort(F.collect_set(c("l_suppkey") % 7)).alias("linkers"))


@query(
    "N8_structural_match",
    f"WITH k AS ({_IDX}) SELECT r.mof_id AS row_id, min(k.mof_id) AS mof_id FROM k r JOIN k ON r.topology = k.topology AND list_has_all(r.linkers, k.linkers) WHERE len(k.linkers) >= 3 GROUP BY 1",
)
def _(spark, sf):
    rows = _index(spark, sf).toDF("row_id", "topology", "components")
    return R.structural_match(rows, _index(spark, sf).filter(F.size("linkers") >= 3))


@query("N9_structural_index", f"WITH k AS ({_IDX}) SELECT mof_id, topology, list_aggregate(list_transform(linkers, lambda x: CAST(x AS VARCHAR)), 'string_agg', '+') AS linkers FROM k")
def _(spark, sf):
    return _index(spark, sf).withColumn("linkers", F.array_join("linkers", "+"))


@query("N10_restrict_to_known", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1")
def _(spark, sf):
    known = table(spark, sf, "part").filter("p_size <= 25").select(c("p_partkey").alias("l_partkey"))
    return R.restrict({"links": table(spark, sf, "lineitem")}, "l_partkey", known)["links"].groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query(
    "N11_unresolved_links",
    "WITH l AS (SELECT l_returnflag AS source, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)), d AS (SELECT source, l_partkey, row_number() OVER (PARTITION BY source ORDER BY l_partkey) AS r FROM (SELECT DISTINCT * FROM l)) "
    "SELECT source, (SELECT count(*) FROM l WHERE l.source = d.source) AS n, string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_partkey) FILTER (r <= 10) AS sample FROM d GROUP BY 1",
)
def _(spark, sf):
    links = table(spark, sf, "lineitem").select(c("l_returnflag").alias("source"), "l_partkey")
    known = table(spark, sf, "part").filter("p_size <= 45").select(c("p_partkey").alias("l_partkey"))
    return R.unresolved(links, "l_partkey", known).withColumn("sample", F.array_join("sample", ";"))


@query("N12_generated_keys", "SELECT p_partkey, 'STAB_' || upper(substr(md5(CASE WHEN p_size > 25 THEN p_name ELSE p_brand END), 1, 8)) AS generated_id FROM part")
def _(spark, sf):
    return R.generated_keys(table(spark, sf, "part"), [F.when(c("p_size") > 25, c("p_name")).otherwise("  "), c("p_brand")], "STAB_").select("p_partkey", "generated_id")
