"""Registered queries: tables, graphs and vectors written and read again, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.functions.strings import mint
from orefield.plans import graph_queries as GQ
from orefield.plans import star
from orefield.plans.star import table
from orefield.sources import tables as S
from orefield.sources.stored import new_folder

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("S1_csv_scan", "SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS p_brand, p_retailprice FROM part")
def _(spark, sf):
    odd = F.when(c("p_size") % 6 == 0, "nan").when(c("p_size") % 3 == 0, " ").otherwise(F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    path = new_folder(spark, "csv")
    table(spark, sf, "part").select("p_partkey", "p_name", odd.alias("p_brand"), "p_retailprice").write.csv(path, header=True)
    return S.read_csv(spark, path, "p_partkey long, p_name string, p_brand string, p_retailprice double")


@query("S2_json_documents", "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size % 4 <> 0")
def _(spark, sf):
    record = F.struct(F.when(c("p_size") % 4 != 0, c("p_partkey")).alias("id"), F.struct(c("p_size").alias("size")).alias("data"))
    arrays = table(spark, sf, "part").groupBy(F.floor(c("p_partkey") / 100).alias("block")).agg(F.to_json(F.collect_list(record), {"ignoreNullFields": "false"}).alias("value"))  # a hundred records
    path = new_folder(spark, "json")
    arrays.write.partitionBy("block").text(path)
    rows = S.read_documents(spark, f"{path}/*", "id long, data struct<size: int>", ["id", "data"])
    return rows.select("id", c("data.size").alias("size"))


@query("S4_csv_tree", "SELECT o_orderkey, o_totalprice, true AS has_file FROM orders")
def _(spark, sf):
    path = new_folder(spark, "csv-tree")
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").write.partitionBy("o_orderpriority").csv(path, header=True)
    rows = S.read_csv_tree(spark, path, "o_orderkey long, o_totalprice double")
    return rows.select("o_orderkey", "o_totalprice", c("source_file").endswith(".csv").alias("has_file"))


@query("S5_csv_parts", "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, 0 AS source_rank FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 1 FROM supplier UNION ALL SELECT n_nationkey, NULL, n_regionkey, 2 FROM nation")
def _(spark, sf):
    path, parts = new_folder(spark, "csv-parts"), []
    for name, columns, schema in (("customer", ("c_custkey", "c_name", "c_acctbal"), "key long, name string, balance double"), ("supplier", ("s_suppkey", "s_name"), "key long, name string"), ("nation", ("n_nationkey", "n_regionkey"), "key long, balance double")):
        table(spark, sf, name).select(*columns).write.csv(f"{path}/{name}", header=True)
        parts.append((f"{path}/{name}", schema))
    return S.read_csv_parts(spark, parts).select("key", "name", "balance", "source_rank")


@query("S11_embedding_matrix", "SELECT 'http://example.org/kg#' || CASE WHEN vec_id % 3 = 0 THEN 'FuncMOF_' ELSE 'MOF_' END || vec_id AS uri, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id % 3 <> 2")
def _(spark, sf):
    rows, path = table(spark, sf, "embeddings"), new_folder(spark, "matrix")
    kind = F.when(c("vec_id") % 3 == 0, mint("FuncMOF", c("vec_id"))).when(c("vec_id") % 3 == 1, mint("MOF", c("vec_id"))).otherwise(mint("Linker", c("vec_id")))
    S.write_tables({"matrix": rows.select(c("vec_id").alias("id"), c("embedding").alias("v")), "ids": rows.select(kind.alias("uri"), c("vec_id").alias("id"))}, path)
    found = S.read_embedding_matrix(spark, f"{path}/kind=matrix", f"{path}/kind=ids")
    return found.select("uri", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))


@query("S13_table_sink", "SELECT 'materials' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part UNION ALL SELECT 'linkers', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT DISTINCT 'topologies', p_type, lower(p_type) FROM part")
def _(spark, sf):
    part, supplier, path = table(spark, sf, "part"), table(spark, sf, "supplier"), new_folder(spark, "entities")
    text = lambda x: c(x).cast("string").alias("id")
    found = {"materials": part.select(text("p_partkey"), c("p_name").alias("name")), "linkers": supplier.select(text("s_suppkey"), c("s_name").alias("name")), "topologies": part.select(text("p_type"), F.lower("p_type").alias("name")).distinct()}
    S.write_tables(found, path)
    return S.read_tables(spark, path, list(found))


_SK = ("materials", "topologies", "topology_links")
_NAMED = f"nm AS (SELECT node, coalesce(name, {GQ.LN('node')}) AS name FROM (SELECT s AS node FROM triples UNION SELECT o FROM triples WHERE o_kind = 'uri') LEFT JOIN (SELECT s AS node, min([CAST({GQ._PRI} AS VARCHAR), o])[2] AS name FROM triples WHERE {GQ._PRI} IS NOT NULL GROUP BY 1) USING (node))"


@query("S15_readable_edges", GQ.GRAPH(*_SK) + f", {_NAMED} SELECT a.name AS source_name, {GQ.LN('t.p')} AS relation, t.o AS value, t.o_kind AS kind, CASE WHEN t.o_kind = 'uri' THEN b.name END AS target_name FROM triples t JOIN nm a ON a.node = t.s LEFT JOIN nm b ON b.node = t.o WHERE t.p <> {GQ.TY}")
def _(spark, sf):
    path = new_folder(spark, "readable")
    S.write_readable(star.graph(spark, sf, *_SK), path)
    rows = spark.read.schema("source string, source_name string, relation string, target struct<value: string, kind: string, datatype: string, name: string>").json(f"{path}/edges")
    return rows.select("source_name", "relation", c("target.value").alias("value"), c("target.kind").alias("kind"), c("target.name").alias("target_name"))


@query("S15_readable_nodes", GQ.GRAPH(*_SK) + f", {_NAMED}, n AS (SELECT s AS node FROM triples UNION SELECT o FROM triples WHERE o_kind = 'uri' AND p <> {GQ.TY}), t AS (SELECT s AS node, string_agg(DISTINCT {GQ.LN('o')}, ';' ORDER BY {GQ.LN('o')}) AS types FROM triples WHERE p = {GQ.TY} GROUP BY 1) SELECT node, name, coalesce(types, '') AS types FROM n LEFT JOIN t USING (node) LEFT JOIN nm USING (node)")
def _(spark, sf):
    path = new_folder(spark, "readable")
    S.write_readable(star.graph(spark, sf, *_SK), path)
    return spark.read.schema("node string, name string, kind string, types array<string>").json(f"{path}/nodes").select("node", "name", F.array_join("types", ";").alias("types"))
