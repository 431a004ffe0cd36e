"""Readers and writers of tables, triples, nested documents and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefield.functions.strings import clean_null
from orefield.schema import TRIPLE_COLUMNS


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """A CSV table with a header, all text cleaned: trimmed, empty and ``nan`` null."""
    df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return df.select(*[clean_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def read_csv_tree(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All CSV files below a folder, with ``source_file``; hidden files are left out, lines that don't fit give nulls."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def read_csv_parts(spark: SparkSession, parts: list[tuple[str, str]]) -> DataFrame:
    """Files of one source whose columns differ, each with its ``source_rank``."""
    from orefield.operators.resolve import append

    return append(*[read_csv(spark, path, schema).withColumn("source_rank", F.lit(i)) for i, (path, schema) in enumerate(parts)])


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str]) -> DataFrame:
    """A JSON array of nested records; those without one of ``required`` are left out."""
    df = spark.read.json(path, schema=schema, multiLine=True)
    for column in required:
        df = df.filter(F.col(column).isNotNull())
    return df


def explode_nested(documents: DataFrame, column: str, value_schema: str) -> DataFrame:
    """(parent, code, record) of text that holds an object of objects; values that are no records are left out."""
    outer = documents.select(F.explode(F.from_json(column, "map<string,string>")).alias("parent", "inner"))
    inner = outer.select("parent", F.explode(F.from_json("inner", "map<string,string>")).alias("code", "text"))
    return inner.select("parent", "code", F.from_json("text", value_schema).alias("record"), "text").filter(F.trim("text").startswith("{")).drop("text")


#: The text of a literal reaches to the line's last quote; it may be long, so no group repeats within it.
LINE = r'^(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|".*")(?:\^\^<([^>]*)>|@(\S+))?\s*\.\s*$'


def parse_triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of N-Triples lines; other lines are left out."""
    part = lambda i: F.regexp_extract(column, LINE, i)
    bare = lambda x: F.when(x.startswith("<"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    text = F.substr(part(3), F.lit(2), F.length(part(3)) - 2)
    text = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    kind = F.when(part(3).startswith("<"), "uri").when(part(3).startswith("_:"), "bnode").otherwise("literal")
    rows = lines.filter(F.col(column).rlike(LINE))
    return rows.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(kind == "literal", text).otherwise(bare(part(3))).alias("o"), kind.alias("o_kind"), F.nullif(part(4), F.lit("")).alias("datatype"), F.nullif(part(5), F.lit("")).alias("lang"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return parse_triples(spark.read.text(path))


def triple_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line (``value``) for each triple."""
    node = lambda x: F.when(x.startswith("_:"), x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))
    text = F.replace(F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    tail = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise("")
    target = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(node(F.col("o")))
    return triples.select(F.concat_ws(" ", node(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), target, F.lit(".")).alias("value"))


def write_triples(triples: DataFrame, path: str) -> None:
    triple_lines(triples).write.mode("overwrite").text(path)


def edges_within(triples: DataFrame, keys: DataFrame) -> DataFrame:
    """Links whose two ends are among ``keys`` (node)."""
    return triples.filter("o_kind <> 'literal'").join(keys.select(F.col("node").alias("s")), "s", "left_semi").join(keys.select(F.col("node").alias("o")), "o", "left_semi").select(*TRIPLE_COLUMNS)


def only_relations(triples: DataFrame, predicates: list[str]) -> DataFrame:
    return triples.filter(F.col("p").isin(predicates))


def edge_list(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b) integer ends of links, without literals and self-loops; ``ids`` (node, id)."""
    links = triples.filter("o_kind <> 'literal' and s <> o")
    return links.join(ids.toDF("s", "a"), "s").join(ids.toDF("o", "b"), "o").select("a", "b").distinct()


def vector_columns(rows: DataFrame, vector: str, dims: int, prefix: str = "emb_") -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != vector], *[F.get(vector, F.lit(i)).alias(f"{prefix}{i}") for i in range(dims)])


def from_vector_columns(rows: DataFrame, key: str, prefix: str = "emb_") -> DataFrame:
    """(key, v) of columns emb_0, emb_1, …; of all numeric columns where none has the prefix."""
    found = sorted((c for c in rows.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix) :]))
    found = found or [f.name for f in rows.schema if f.name != key and isinstance(f.dataType, T.NumericType)]
    return rows.select(key, F.array(*found).cast("array<float>").alias("v"))


def from_vector_text(rows: DataFrame, key: str, column: str) -> DataFrame:
    return rows.select(key, F.from_json(column, "array<float>").alias("v"))


def validate_inputs(spark: SparkSession, paths: list[str]) -> None:
    """An error that lists every path that isn't there, before any job runs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    lost = [p for p in paths if not (lambda q: q.getFileSystem(conf).exists(q))(jvm.org.apache.hadoop.fs.Path(p))]
    if lost:
        raise FileNotFoundError("missing inputs: " + ", ".join(lost))




def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table in a folder of its own, named ``kind=`` and its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/kind={name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tables of one shape that ``write_tables`` wrote, with ``kind``."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/kind={n}").withColumn("kind", F.lit(n)) for n in names])


def write_readable(triples: DataFrame, path: str) -> None:
    """The graph for people, as JSON: nodes with name, kind and types, edges with the names of their ends and an object that tells its type."""
    from orefield.functions.strings import entity_type, local_name
    from orefield.operators.graph import display_names, node_table

    names = display_names(triples)
    nodes = node_table(triples).join(names, "node", "left")
    nodes.select("node", "name", entity_type(F.col("node")).alias("kind"), "types").write.mode("overwrite").json(f"{path}/nodes")
    links = triples.filter(~F.col("p").endswith("#type")).join(names.toDF("s", "source_name"), "s").join(names.toDF("o", "target_name"), "o", "left")
    target = F.struct(F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("datatype").alias("datatype"), F.when(F.col("o_kind") == "uri", F.col("target_name")).alias("name"))
    links.select(F.col("s").alias("source"), "source_name", local_name(F.col("p")).alias("relation"), target.alias("target")).write.mode("overwrite").json(f"{path}/edges")


def read_embedding_matrix(spark: SparkSession, matrix: str, ids: str, pattern: str = "^(MOF_|FuncMOF_)") -> DataFrame:
    """(uri, v) of a saved matrix (id, v) and its index (uri, id), for the nodes whose local name fits ``pattern``."""
    from orefield.functions.strings import local_name

    index = spark.read.parquet(ids).filter(local_name(F.col("uri")).rlike(pattern))
    return spark.read.parquet(matrix).join(index, "id").select("uri", "v")
