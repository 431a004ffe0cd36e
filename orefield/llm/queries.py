"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orefield.llm.exact_dedup import exact_dedup
from orefield.llm.html_text import extract_main_text
from orefield.llm.knn_join import top_k_inner_product
from orefield.llm.language_id import predict_language
from orefield.llm.language_model import score_texts
from orefield.llm.manifest import manifest_check
from orefield.llm.mixing import mix_to_weights
from orefield.llm.ngram_join import ngram_jaccard_join
from orefield.llm.nra_search import nra_search
from orefield.llm.packing import pack_pieces, token_pieces
from orefield.llm.quality import quality_scores
from orefield.llm.rule_ledger import rule_verdicts
from orefield.llm.sharding import balanced_shards


def tokenizer_files() -> tuple[str, str]:
    """The byte-level vocabulary as a tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(_documents(spark, sf_dir), piece_file())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner_product(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(_documents(spark, sf_dir))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(token_pieces(_documents(spark, sf_dir), *tokenizer_files()))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir), *tokenizer_files())


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra_search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_check(_documents(spark, sf_dir))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdicts(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_language_id, op3_exact_dedup, op4_top_k_search, op5_source_mixing,
        op6_ngram_jaccard_join, op7_sharding, op8_packing, op9_lm_scoring, op10_html_extraction,
        op11_ranked_search, op12_merkle_manifest, op13_quality_rules,
    )
}

def _merkle_sql(levels: int = 6, fan_out: int = 16) -> str:
    """SQL for trees of at most ``fan_out`` to the power of ``levels`` leaves: a step for each level up, then one for each level down."""

    def tree(name: str, nodes: str, path: str, carried: str) -> str:
        # {name}0 has k (the tree), slot, h and n; each level's nodes are joined by the runs that they fall into
        up = [f"{name}0 AS MATERIALIZED ({nodes})"]
        for i in range(levels):
            up.append(
                f"{name}{i + 1} AS MATERIALIZED (SELECT k, slot // {fan_out} AS slot, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY slot)) END AS h, "
                f"(n + {fan_out - 1}) // {fan_out} AS n FROM {name}{i} GROUP BY k, slot // {fan_out}, n)"
            )
        down = [f"{name}p{levels} AS MATERIALIZED (SELECT t.k, 0 AS slot, t.h AS top, {carried}, {path} FROM {name}{levels} t)"]
        for i in reversed(range(levels)):
            beside = lambda sign: f"CASE WHEN x.n = 1 THEN '' ELSE coalesce((SELECT string_agg(y.h, '' ORDER BY y.slot) FROM {name}{i} y WHERE y.k = x.k AND y.slot // {fan_out} = x.slot // {fan_out} AND y.slot {sign} x.slot), '') END"
            down.append(
                f"{name}p{i} AS MATERIALIZED (SELECT x.k, x.slot, p.top, p.* EXCLUDE (k, slot, top, path), list_prepend(struct_pack(b := {beside('<')}, e := {beside('>')}, lone := x.n = 1), p.path) AS path "
                f"FROM {name}{i} x JOIN {name}p{i + 1} p ON p.k = x.k AND p.slot = x.slot // {fan_out})"
            )
        return ", ".join([*up, *down])

    def encoded(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(encoded, ['doc_id', 'source', 'lang', 'n_chars', text]))})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 of the decimal id, by its bits: DuckDB has no such function
    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
        "lambda h, x: list_reduce(list_prepend(xor(h, x), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)))"
    )
    return f"""
        WITH d AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 'v' || source END AS k, {leaf('text')} AS leaf,
                      CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS tampered FROM documents),
        a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY k) AS n FROM d),
        {tree("s", "SELECT k, slot, leaf AS h, n FROM a", "[] AS path", "0 AS unused")},
        {tree("r", f"SELECT '' AS k, row_number() OVER (ORDER BY encode(k)) - 1 AS slot, h, count(*) OVER () AS n, k AS source_key FROM s{levels}", "[] AS path", "0 AS unused")},
        q AS MATERIALIZED (SELECT r0.source_key AS k, r0.h AS subroot, rp0.top AS root, rp0.path AS above FROM r0 JOIN rp0 USING (slot)),
        f AS (SELECT a.*, q.subroot, q.root, list_filter(list_concat(p.path, q.above), lambda x: NOT x.lone) AS path FROM a JOIN sp0 p USING (k, slot) JOIN q ON q.k = a.k),
        g AS (SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(path, lambda x: x.b || x.e)), lambda x, y: x || y)) AS proof_sha256,
                     list_reduce(list_prepend(struct_pack(b := tampered, e := '', lone := true), path), lambda x, y: struct_pack(b := sha256(y.b || x.b || y.e), e := '', lone := true)).b AS folded_root FROM f)
        SELECT *, folded_root = root AS verified FROM g"""


ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)""",
    "op4_top_k_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
        r AS (SELECT doc_id AS node, doc_id AS via FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.via = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(via) AS component_id FROM r GROUP BY 1) c USING (doc_id)""",
    "op11_ranked_search": r"""
        WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM t WHERE len(w) > 0),
        g AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY 1, 2),
        v AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM g, s GROUP BY term, docs),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        p AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * docs) // terms)))) AS BIGINT) AS score
              FROM i JOIN v USING (term) JOIN g USING (term) JOIN t USING (r), s GROUP BY item_id, r, doc_id),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
        SELECT * FROM k WHERE rank <= 10""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_quality_rules": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
        x AS (SELECT r, i, w[i:i + 2] AS three FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        y AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM x) WHERE n > 1),
        z AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2]) FROM y) GROUP BY r),
        m AS (SELECT doc_id, text, w, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
                     strlen(text) - strlen(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words, len(lines) AS n_lines,
                     length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
                     len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9A-Za-z\x{80}-\x{10FFFF}]'))) AS n_marks_only
              FROM w LEFT JOIN z USING (r)),
        f AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
                     CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT) + 8 * CAST(100 * n_upper > 40 * n_letters AS BIGINT)
                     + 16 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT) + 32 * CAST(word_chars < 2 * n_words AS BIGINT) + 64 * CAST(word_chars > 14 * n_words AS BIGINT)
                     + 128 * CAST(100 * n_letters < 60 * word_chars AS BIGINT) + 256 * CAST(100 * n_marks_only > 20 * n_words AS BIGINT) AS failed_rules FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM f""",
}
