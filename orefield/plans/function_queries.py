"""Registered queries over columns of the star schema: text, id, formula and vector functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.functions import strings as S
from orefield.functions import vectors as V
from orefield.plans.star import table
from orefield.schema import KG

QUERIES, ORACLE_SQL = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def prefix_of(kind: str) -> str:
    return S.MINTED[kind]


def columns(name: str, source: str, key: str, **functions: tuple) -> None:
    """A query with one column for each function: (Spark column, SQL text)."""
    def run(spark, sf):
        return table(spark, sf, source).select(key, *[c().alias(n) for n, (c, _) in functions.items()])

    query(name, f"SELECT {key}, " + ", ".join(f"{q} AS {n}" for n, (_, q) in functions.items()) + f" FROM {source}")(run)


c = F.col
columns(
    "F1_F6_cleaning", "part", "p_partkey",
    cleaned=(lambda: S.clean_null(F.when(c("p_size") > 40, F.lit(" nan ")).when(c("p_size") < 3, F.lit("  ")).otherwise(c("p_name"))), "CASE WHEN p_size > 40 OR p_size < 3 THEN NULL ELSE trim(p_name) END"),
    names=(lambda: F.array_join(S.split_names(F.concat(c("p_name"), F.lit(" <|> "), c("p_brand"), F.lit("<|> "))), "+"), "trim(p_name) || '+' || p_brand"),
    number=(lambda: S.parse_number(F.concat(F.lit("~≥"), c("p_size").cast("string"), F.lit(".5"))), "p_size + 0.5"),
    bad_number=(lambda: S.parse_number(c("p_name")), "CAST(NULL AS DOUBLE)"),
    topology=(lambda: S.mofid_topology(F.concat(F.lit("C.C MOFid-v1."), F.when(c("p_type") == "PROMO", "UNKNOWN").otherwise(c("p_type")), F.lit(".cat0"))), "CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END"),
    stripped=(lambda: S.strip_suffixes(F.concat(c("p_type"), F.lit("_Charged_clean"))), "p_type"),
    cid=(lambda: S.norm_cid(F.concat(c("p_size").cast("string"), F.lit(".0"))), "CAST(p_size AS VARCHAR)"),
)
columns(
    "F7_F15_identifiers", "part", "p_partkey",
    property_id=(lambda: S.property_id(c("p_partkey").cast("string"), F.lit("Band gap (eV)")), "'PROP_' || p_partkey || '_Band_gap_eV'"),
    cluster=(lambda: S.cluster_key(F.array(c("p_type"), c("p_brand"), c("p_type"))), "'CLUSTER_' || least(p_type, p_brand) || '_' || greatest(p_type, p_brand)"),
    degree=(lambda: S.func_degree(F.concat(c("p_type"), F.lit("_0.16_"), c("p_size").cast("string"))), "CAST(0.16 AS DOUBLE)"),
    degree_end=(lambda: S.func_degree(F.concat(c("p_type"), F.lit("_"), c("p_size").cast("string"))), "CAST(p_size AS DOUBLE)"),
    hashed=(lambda: S.hash_id("LINKER_", c("p_name")), "'LINKER_' || upper(substr(md5(p_name), 1, 8))"),
    smiles=(lambda: S.norm_smiles(F.concat(F.lit("['"), c("p_brand"), F.lit("', 'x']"))), "p_brand"),
    plain_smiles=(lambda: S.norm_smiles(F.concat(F.lit(" "), c("p_brand"), F.lit(" "))), "p_brand"),
    clean=(lambda: S.clean_name(c("p_name")), "regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g')"),
    components=(lambda: F.array_join(S.mofid_components(F.concat(c("p_type"), F.lit(".."), c("p_brand"), F.lit("."), c("p_type"), F.lit(" MOFid"))), "+"), "p_type || '+' || p_brand"),
    doi=(lambda: S.extract_doi(F.concat(F.lit("https://doi.org/10.1021%2F"), c("p_partkey").cast("string"))), "'10.1021/' || p_partkey"),
)
columns(
    "F16_F24_uris", "part", "p_partkey",
    uri=(lambda: S.mint("MOF", c("p_brand")), "'http://example.org/kg#MOF_' || replace(p_brand, '#', '_')"),
    local=(lambda: S.local_name(S.mint("MOF", c("p_brand"))), "'MOF_' || replace(p_brand, '#', '_')"),
    kind=(lambda: S.entity_type(S.mint("FuncMOF", c("p_partkey"))), "'Functionalized'"),
    family=(lambda: S.mof_family(S.mint("FuncMOF", F.concat_ws("_", c("p_type"), c("p_size").cast("string")))), "p_type"),
    origin=(lambda: S.source_class(S.mint("MOF", F.concat(F.when(c("p_size") > 25, "qmof-").otherwise("X"), c("p_size").cast("string")))), "CASE WHEN p_size > 25 THEN 'qmof' ELSE 'CSD' END"),
    parent=(lambda: S.parent_uri(S.mint("FuncMOF", F.concat_ws("_", c("p_type"), F.lit("en")))), "'http://example.org/kg#MOF_' || p_type"),
    amine=(lambda: S.amine_code(S.mint("FuncMOF", F.concat_ws("_", c("p_type"), F.lit("en")))), "'en'"),
    bridge=(lambda: S.func_to_prop_uri(S.mint("FuncMOF", c("p_partkey"))), "'http://example.org/kg#MOF_' || p_partkey"),
    ends_with=(lambda: F.substring_index(S.mint("MOF", c("p_partkey")), "MOF_", -1), "CAST(p_partkey AS VARCHAR)"),
)
columns(
    "F17_minted_uris", "part", "p_partkey",
    **{kind: (lambda kind=kind: S.node_uri(kind, F.concat(F.when(c("p_size") > 25, f"{prefix_of(kind)}_").otherwise(""), c("p_brand"), F.lit(" "), c("p_partkey").cast("string"))), f"'http://example.org/kg#{prefix_of(kind)}_' || replace(replace(p_brand, '#', '_'), ' ', '_') || '_' || p_partkey") for kind in S.MINTED},
)
columns(
    "F35_uri_tests", "part", "p_partkey",
    starts=(lambda: S.mint("MOF", c("p_type")).startswith(KG + "MOF_S"), "starts_with('http://example.org/kg#MOF_' || p_type, 'http://example.org/kg#MOF_S')"),
    after=(lambda: F.substring_index(S.mint("MOF", c("p_type")), KG, -1), "'MOF_' || p_type"),
    holds=(lambda: F.lower(S.mint("MOF", c("p_type"))).contains("mof_s"), "contains(lower('MOF_' || p_type), 'mof_s')"),
)
columns(
    "F10_F25_F40_rules", "part", "p_partkey",
    crystal=(lambda: S.crystal_system(F.when(c("p_size") < 10, "P-1").when(c("p_size") < 20, "P21/c").when(c("p_size") < 30, "orthorhombic Pnma").when(c("p_size") < 40, "P6/mmm").otherwise("Fm-3m")),
             "CASE WHEN p_size < 10 THEN 'triclinic' WHEN p_size < 20 THEN 'monoclinic' WHEN p_size < 30 THEN 'orthorhombic' WHEN p_size < 40 THEN 'hexagonal' ELSE 'cubic' END"),
    metal=(lambda: S.primary_metal(F.concat(c("p_type"), F.lit("; Zn, Cu"))), "'Zn'"),
    tokens=(lambda: F.size(S.tokens(F.concat(c("p_type"), F.lit("; ;"), c("p_brand")))), "2"),
    fractions=(lambda: F.array_join(F.transform(S.formula_fractions(F.concat(F.lit("C2H"), c("p_size").cast("string")), ["C", "H", "O"]), lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string")), ";"),
               "CAST(round(2 / (2 + p_size), 4) AS DECIMAL(9,4)) || ';' || CAST(round(p_size / (2 + p_size), 4) AS DECIMAL(9,4)) || ';0.0000'"),
    number=(lambda: S.to_number(F.when(c("p_size") > 40, F.lit("inf")).when(c("p_size") > 30, F.lit("x")).otherwise(c("p_size").cast("string"))), "CASE WHEN p_size > 30 THEN NULL ELSE CAST(p_size AS DOUBLE) END"),
    safe=(lambda: S.safe_name(c("p_brand")), "regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g')"),
    matches=(lambda: S.names_match(c("p_name"), F.lit("RING")), "contains(lower(p_name), 'ring') OR contains('ring', lower(p_name))"),
)


_GRAMS = "list_transform(generate_series(1, greatest(length(part) - 2, 1)), lambda i: CAST('0x' || substr(md5(substr(part, i, 3)), 1, 8) AS BIGINT) % 16)"


@query(
    "F28_ngram_features",
    f"""WITH t AS (SELECT p_partkey, trim(unnest(string_split(concat_ws(';', p_name, p_brand), ';'))) AS part FROM part), g AS (SELECT p_partkey, {_GRAMS} AS grams FROM t WHERE part <> ''),
 b AS (SELECT p_partkey, bit, avg(CASE WHEN list_contains(grams, bit) THEN 1.0 ELSE 0.0 END) AS x FROM g, range(16) r(bit) GROUP BY 1, 2),
 s AS (SELECT p_partkey, string_agg(CAST(CAST(x AS DOUBLE) AS VARCHAR), ';' ORDER BY bit) AS bits FROM b GROUP BY 1)
 SELECT p_partkey, coalesce(bits, '{";".join(["0.0"] * 16)}') AS bits FROM part LEFT JOIN s USING (p_partkey)""",
)
def _(spark, sf):
    bits = S.ngram_features(F.concat_ws(";", "p_name", "p_brand"), 16)
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(bits, lambda x: x.cast("string")), ";").alias("bits"))


@query(
    "F40_collapse_rare",
    "WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rn FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN rn <= 10 THEN p_brand ELSE 'Other' END AS level FROM part JOIN k USING (p_brand)",
)
def _(spark, sf):
    from orefield.operators.features import collapse_rare

    return collapse_rare(table(spark, sf, "part"), "p_brand", 10, "level").select("p_partkey", "level")


_PAIR = "WITH p AS (SELECT a.vec_id, a.embedding AS h, b.embedding AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
_D = lambda f: f"list_sum(list_transform(list_zip(h, t), lambda x: {f}))"
_X, _Y = "CAST(x[1] AS DOUBLE)", "CAST(x[2] AS DOUBLE)"


def pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", c("embedding").alias("h")).join(e.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("t")), "vec_id")


@query(
    "F29_F32_vector_scores",
    f"{_PAIR} SELECT vec_id, round({_D(f'{_X} * {_Y}')}, 6) AS dot, round({_D(f'{_X} * {_Y}')} / sqrt({_D(f'{_X} * {_X}')} * {_D(f'{_Y} * {_Y}')}), 6) AS cosine, round(-sqrt({_D(f'({_X} - {_Y}) * ({_X} - {_Y})')}), 6) AS neg_l2, "
    f"round({_D(f'abs({_X} + {_X} - {_Y})')}, 6) AS transe, round({_D(f'{_X} * {_Y} * {_Y}')}, 6) AS distmult, round(CAST(h[1] AS DOUBLE) / sqrt({_D(f'{_X} * {_X}')}), 6) AS first_unit FROM p",
)
def _(spark, sf):
    h, t = c("h"), c("t")
    cells = {"dot": V.dot(h, t), "cosine": V.cosine(h, t), "neg_l2": V.neg_l2(h, t), "transe": V.transe_score(h, h, t), "distmult": V.distmult_score(h, t, t), "first_unit": F.get(V.l2_normalize(h), F.lit(0))}
    return pairs(spark, sf).select("vec_id", *[F.round(v, 6).alias(n) for n, v in cells.items()])


@query(
    "F33_F39_compositions",
    f"{_PAIR} SELECT vec_id, round(CAST(h[1] AS DOUBLE) - t[1], 6) AS sub, round(CAST(h[2] AS DOUBLE) * t[2], 6) AS mult, round({_D(f'{_X} * {_Y}')}, 4) AS corr_0, "
    "round(list_sum(list_transform(range(1, len(h) + 1), lambda i: CAST(h[i] AS DOUBLE) * t[(i % len(h)) + 1])), 4) AS corr_1, 3 * len(h) AS n_concat, round(CAST(h[3] AS DOUBLE) - t[3], 6) AS last_part FROM p",
)
def _(spark, sf):
    h, t = c("h"), c("t")
    corr = V.circular_correlation(h, t)
    rows = pairs(spark, sf).withColumn("corr", corr)
    at = lambda v, i: F.get(v, F.lit(i))
    both = V.concat_pair(h, t)
    return rows.select("vec_id", F.round(at(V.subtract(h, t), 0), 6).alias("sub"), F.round(at(V.multiply(h, t), 1), 6).alias("mult"), F.round(at(c("corr"), 0), 4).alias("corr_0"), F.round(at(c("corr"), 1), 4).alias("corr_1"), F.size(both).cast("long").alias("n_concat"), F.round(at(both, 130), 6).alias("last_part"))


@query("F34_vector_pooling", "SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean_1, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS mean_64, round(sum(CAST(embedding[2] AS DOUBLE)), 4) AS sum_2, round(max(CAST(embedding[3] AS DOUBLE)), 6) AS max_3 FROM embeddings GROUP BY 1")
def _(spark, sf):
    mean, total, most = (V.mean_by(table(spark, sf, "embeddings"), "label", "embedding", 64, how) for how in ("mean", "sum", "max"))
    rows = mean.join(total.select("label", c("embedding").alias("total")), "label").join(most.select("label", c("embedding").alias("most")), "label")
    at = lambda v, i, n=6: F.round(F.get(v, F.lit(i)), n)
    return rows.select("label", "n", at("embedding", 0).alias("mean_1"), at("embedding", 63).alias("mean_64"), at("total", 1, 4).alias("sum_2"), at("most", 2).alias("max_3"))
