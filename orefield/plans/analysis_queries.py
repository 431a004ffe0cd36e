"""Registered queries: splits, features, metrics, concepts and rankings over the star schema, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.operators import features as X
from orefield.operators import metrics as M
from orefield.operators import rank as R
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


def share_sql(*keys: str, seed: int = 0) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


# Splits and features.
@query("L1_random_split", f"SELECT p_partkey, CASE WHEN {share_sql('p_partkey')} < 0.8 THEN 'train' WHEN {share_sql('p_partkey')} < 0.9 THEN 'val' ELSE 'test' END AS part FROM part")
def _(spark, sf):
    return X.hash_split(table(spark, sf, "part"), ["p_partkey"], {"train": 0.8, "val": 0.1, "test": 0.1}).select("p_partkey", "part")


@query("L2_stratified_split", f"SELECT p_type, count(*) AS n, sum(CASE WHEN {share_sql('p_type', 'p_partkey')} < 0.8 THEN 1 ELSE 0 END) AS n_train FROM part GROUP BY 1")
def _(spark, sf):
    return X.stratified_split(table(spark, sf, "part"), "p_type", ["p_partkey"], 0.8).groupBy("p_type").agg(F.count("*").alias("n"), F.sum(c("is_train").cast("long")).alias("n_train"))


@query("L3_family_split", f"SELECT p_partkey, {share_sql('(p_partkey // 10)')} < 0.8 AS is_train FROM part")
def _(spark, sf):
    return X.group_split(table(spark, sf, "part"), F.floor(c("p_partkey") / 10).cast("long"), 0.8).select("p_partkey", "is_train")


@query("L4_k_fold", f"SELECT p_partkey, CAST(floor({share_sql('p_partkey', seed=7)} * 5) AS INTEGER) AS fold FROM part")
def _(spark, sf):
    return X.k_fold(table(spark, sf, "part"), ["p_partkey"], 5, seed=7).select("p_partkey", "fold")


@query("L5_repeated_splits", "SELECT seed, count(*) AS n, sum(CASE WHEN CAST('0x' || substr(md5(seed || '|' || p_partkey), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 THEN 1 ELSE 0 END) AS n_train FROM part, (VALUES (1), (2), (3)) s(seed) GROUP BY 1")
def _(spark, sf):
    return X.repeated_splits(table(spark, sf, "part"), ["p_partkey"], 0.8, [1, 2, 3]).groupBy("seed").agg(F.count("*").alias("n"), F.sum(c("is_train").cast("long")).alias("n_train"))


@query("L6_median_imputation", "WITH t AS (SELECT p_partkey, CASE WHEN p_size > 30 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size FROM part) SELECT p_partkey, coalesce(size, (SELECT quantile_cont(size, 0.5) FROM t WHERE p_partkey % 5 <> 0)) AS size FROM t")
def _(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(c("p_size") <= 30, c("p_size").cast("double")).alias("size"))
    return X.impute_median(rows, ["size"], c("p_partkey") % 5 != 0)


@query("L7_standard_scaling", "SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part WHERE p_partkey % 5 <> 0)) / (SELECT stddev_pop(p_size) FROM part WHERE p_partkey % 5 <> 0), 6) AS size FROM part")
def _(spark, sf):
    rows = X.standardize(table(spark, sf, "part").select("p_partkey", c("p_size").cast("double").alias("size")), ["size"], c("p_partkey") % 5 != 0)
    return rows.withColumn("size", F.round("size", 6))


@query("L8_low_variance", "SELECT 'l_discount' AS \"column\", round(var_pop(l_discount), 6) AS variance, false AS kept FROM lineitem UNION ALL SELECT 'l_quantity', round(var_pop(l_quantity), 6), true FROM lineitem")
def _(spark, sf):
    return X.column_spread(table(spark, sf, "lineitem"), ["l_discount", "l_quantity"]).withColumn("variance", F.round("variance", 6))


@query("L9_one_hot", "SELECT p_partkey, CAST(p_type = 'PROMO' AS INTEGER) AS t_PROMO, CAST(p_type = 'SMALL' AS INTEGER) AS t_SMALL FROM part")
def _(spark, sf):
    return X.one_hot(table(spark, sf, "part"), "p_type", ["ECONOMY", "PROMO", "SMALL"], "t", drop_first=True).select("p_partkey", "t_PROMO", "t_SMALL")


@query("L12_property_coverage", "SELECT * FROM (SELECT 'text' AS \"column\", count(text) AS n FROM documents UNION ALL SELECT 'lang', count(lang) FROM documents) WHERE n >= 100")
def _(spark, sf):
    return X.coverage(table(spark, sf, "documents"), ["text", "lang"], 100)


@query("L13_rare_classes", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 8")
def _(spark, sf):
    return X.drop_rare_classes(table(spark, sf, "part"), "p_brand", 8).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("L14_label_index", "SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS \"index\" FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, sf):
    return X.label_index(table(spark, sf, "part"), "p_brand")


@query(
    "E28_stratified_sample",
    f"WITH t AS (SELECT *, {share_sql('event_id')} AS u, count(*) OVER (PARTITION BY event_type) AS n, count(*) OVER () AS al FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY u, event_id) AS r FROM t) SELECT event_id, event_type FROM r WHERE r <= greatest(20, ceil(n * 500 / al))",
)
def _(spark, sf):
    return X.stratified_sample(table(spark, sf, "events"), "event_type", ["event_id"], 500).select("event_id", "event_type")


# Metrics.
_SC = "sc AS (SELECT event_type AS g, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y, round(value) AS score FROM events)"


def scores(spark, sf):
    return table(spark, sf, "events").select(c("event_type").alias("g"), (c("user_id") % 3 == 0).cast("int").alias("y"), F.round("value").alias("score"))


@query(
    "M1_roc_auc",
    f"WITH {_SC}, r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0 AS rk FROM sc) SELECT g, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc, count(*) AS n FROM r GROUP BY 1",
)
def _(spark, sf):
    return M.roc_auc(scores(spark, sf), ["g"], 5).withColumn("auc", F.round("auc", 6))


@query(
    "M2_average_precision",
    f"WITH {_SC}, k AS (SELECT g, score, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1, 2), w AS (SELECT *, sum(p) OVER (PARTITION BY g ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY g ORDER BY score DESC) AS al FROM k) SELECT g, round(sum(p * tp / al) / sum(p), 6) AS ap FROM w GROUP BY 1",
)
def _(spark, sf):
    return M.average_precision(scores(spark, sf), ["g"]).withColumn("ap", F.round("ap", 6))


_PR = "pr AS (SELECT p_type AS g, p_partkey % 5 AS fold, CAST(p_retailprice AS DOUBLE) AS y, 900 + p_size * 2.0 + p_partkey % 100 AS pred FROM part)"


def predictions(spark, sf):
    return table(spark, sf, "part").select(c("p_type").alias("g"), (c("p_partkey") % 5).alias("fold"), c("p_retailprice").alias("y"), (900 + c("p_size") * 2.0 + c("p_partkey") % 100).alias("pred"))


_M3 = f"WITH {_PR}, m AS (SELECT g, fold, round(1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - pred) ** 2)), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae, count(*) AS n FROM pr GROUP BY 1, 2)"


def by_fold(spark, sf):
    return M.regression_metrics(predictions(spark, sf), "y", "pred", ["g", "fold"]).withColumns({k: F.round(k, 6) for k in ("r2", "rmse", "mae")})


@query("M3_regression_metrics", _M3 + " SELECT * FROM m")
def _(spark, sf):
    return by_fold(spark, sf)


@query("M4_metric_summary", _M3 + " SELECT g, round(avg(rmse), 5) AS rmse_mean, round(stddev_samp(rmse), 5) AS rmse_std, count(*) AS n FROM m GROUP BY 1")
def _(spark, sf):
    return M.summary(by_fold(spark, sf), ["g"], ["rmse"]).withColumns({k: F.round(k, 5) for k in ("rmse_mean", "rmse_std")})


_CL = "cl AS (SELECT p_type AS y, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN 'PROMO' ELSE 'SMALL' END AS prediction FROM part)"


def classes(spark, sf):
    return table(spark, sf, "part").select(c("p_type").alias("y"), F.when(c("p_size") % 3 == 0, c("p_type")).when(c("p_size") % 3 == 1, "PROMO").otherwise("SMALL").alias("prediction"))


@query("M5_accuracy", f"WITH {_CL} SELECT round(avg(CAST(y = prediction AS INTEGER)), 6) AS accuracy, round((SELECT max(n) FROM (SELECT count(*) AS n FROM cl GROUP BY y)) / count(*), 6) AS baseline FROM cl")
def _(spark, sf):
    return M.accuracy(classes(spark, sf)).withColumns({k: F.round(k, 6) for k in ("accuracy", "baseline")})


@query(
    "M6_M7_f1_scores",
    f"WITH {_CL}, k AS (SELECT y AS c FROM cl UNION SELECT prediction FROM cl), f AS (SELECT c, (SELECT count(*) FROM cl WHERE y = c) AS t, (SELECT count(*) FROM cl WHERE prediction = c) AS p, (SELECT count(*) FROM cl WHERE y = c AND prediction = c) AS tp FROM k) SELECT round(avg(2 * tp / (t + p)), 6) AS macro_f1, round(sum(2 * tp / (t + p) * t) / sum(t), 6) AS weighted_f1 FROM f",
)
def _(spark, sf):
    return M.f1_scores(classes(spark, sf)).withColumns({k: F.round(k, 6) for k in ("macro_f1", "weighted_f1")})


@query("M8_confusion", f"WITH {_CL}, t AS (SELECT y AS k FROM cl GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) SELECT y, prediction, count(*) AS n FROM cl WHERE y IN (SELECT k FROM t) AND prediction IN (SELECT k FROM t) GROUP BY 1, 2")
def _(spark, sf):
    return M.confusion(classes(spark, sf), "y", "prediction", 4)


@query("M9_best_per_target", _M3 + ", r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY r2 DESC, fold) AS rn FROM m) SELECT g, r2, fold FROM r WHERE rn = 1")
def _(spark, sf):
    return M.best_per_group(by_fold(spark, sf), ["g"], "r2", ["fold"])


@query("M10_method_summary", _M3 + ", a AS (SELECT g, max(r2) AS best_r2, round(avg(rmse), 5) AS mean_rmse FROM m GROUP BY 1), b AS (SELECT p_type AS g, count(*) AS n FROM part WHERE p_size > 48 GROUP BY 1) SELECT coalesce(a.g, b.g) AS g, best_r2, mean_rmse, n FROM a FULL JOIN b ON a.g = b.g")
def _(spark, sf):
    a = by_fold(spark, sf).groupBy("g").agg(F.max("r2").alias("best_r2"), F.round(F.avg("rmse"), 5).alias("mean_rmse"))
    b = table(spark, sf, "part").filter("p_size > 48").groupBy(c("p_type").alias("g")).agg(F.count("*").alias("n"))
    return a.join(b, "g", "full")


@query("M11_M12_source_coverage", "SELECT coalesce(lang, 'none') AS source, count(*) AS n, sum(CASE WHEN text IS NOT NULL OR source IS NOT NULL THEN 1 ELSE 0 END) AS any_text, count(n_chars) AS any_size FROM documents GROUP BY 1")
def _(spark, sf):
    return M.coverage_matrix(table(spark, sf, "documents"), F.coalesce("lang", F.lit("none")), {"any_text": ["text", "source"], "any_size": ["n_chars"]})


@query("M13_histogram", "SELECT CAST(greatest(0, least(9, floor((l_extendedprice - 1000) / 9000))) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    return M.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 1000, 91000, 10)


@query("M13_share_above", "SELECT round(avg(CAST(l_discount > 0.05 AS INTEGER)), 6) AS share FROM lineitem")
def _(spark, sf):
    return M.share_above(table(spark, sf, "lineitem"), "l_discount", 0.05).withColumn("share", F.round("share", 6))


@query("M14_target_groups", "SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'adsorption' ELSE 'other' END AS grp FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, sf):
    target = F.when(c("event_type").isin("click", "view"), F.concat(F.lit("Henry CO2 "), "event_type")).otherwise(c("event_type"))
    return table(spark, sf, "events").select("event_type").distinct().select("event_type", M.target_group(target).alias("grp"))


@query("M15_M16_top_by_mean", "SELECT l_suppkey, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS std FROM lineitem WHERE l_suppkey NOT IN (1, 2) GROUP BY 1 ORDER BY round(avg(l_discount), 6) DESC, l_suppkey LIMIT 20")
def _(spark, sf):
    rows = M.summary(table(spark, sf, "lineitem").filter("l_suppkey not in (1, 2)"), ["l_suppkey"], ["l_discount"])
    return rows.select("l_suppkey", F.round("l_discount_mean", 6).alias("mean"), F.round("l_discount_std", 6).alias("std")).orderBy(F.desc("mean"), "l_suppkey").limit(20)


# Concepts.
_C1 = "SELECT p_partkey, 'high_size' AS concept, CASE WHEN p_size >= (SELECT quantile_cont(p_size, 0.75) FROM part) THEN 1 WHEN p_size <= (SELECT quantile_cont(p_size, 0.25) FROM part) THEN 0 END AS y FROM part"


def numeric(spark, sf):
    return R.numeric_concepts(table(spark, sf, "part").select("p_partkey", c("p_size").alias("size")), "p_partkey", ["size"])


@query("C1_numeric_concepts", _C1)
def _(spark, sf):
    return numeric(spark, sf)


_C2 = "SELECT p_partkey, 'p_brand=' || k AS concept, CAST(p_brand = k AS INTEGER) AS y FROM part, (SELECT p_brand AS k FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)"


@query("C2_categorical_concepts", _C2)
def _(spark, sf):
    return R.categorical_concepts(table(spark, sf, "part"), "p_partkey", "p_brand", 8)


@query("C3_token_concepts", "WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), k AS (SELECT x FROM (SELECT p_partkey, unnest(list_distinct(w)) AS x FROM t) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) SELECT p_partkey, 'has_' || x AS concept, CAST(list_contains(w, x) AS INTEGER) AS y FROM t, k")
def _(spark, sf):
    return R.token_concepts(table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("w")), "p_partkey", "w", 10)


@query("C4_usable_concepts", f"SELECT concept, count(CASE WHEN y = 1 THEN 1 END) AS n_pos, count(CASE WHEN y = 0 THEN 1 END) AS n_neg FROM ({_C1} UNION ALL {_C2}) GROUP BY 1 HAVING count(CASE WHEN y = 1 THEN 1 END) >= 10 AND count(CASE WHEN y = 0 THEN 1 END) >= 10 AND count(y) >= 50")
def _(spark, sf):
    labels = numeric(spark, sf).unionByName(R.categorical_concepts(table(spark, sf, "part"), "p_partkey", "p_brand", 8))
    return R.usable_concepts(labels, 10, 10, 50)


@query("C10_top_concepts", "WITH e AS (SELECT event_type AS method, user_id AS concept, avg(value) AS m FROM events GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY method ORDER BY m DESC, concept) AS INTEGER) AS rank FROM e) SELECT method, concept, round(m, 6) AS m, rank FROM r WHERE rank <= 8")
def _(spark, sf):
    rows = table(spark, sf, "events").groupBy(c("event_type").alias("method"), c("user_id").alias("concept")).agg(F.avg("value").alias("m"))
    return R.top_per_group(rows, "method", [F.desc("m"), c("concept")], 8).withColumn("m", F.round("m", 6))


# Rankings.
@query("R1_property_reliability", _M3 + " SELECT g, CASE WHEN max(r2) >= 0.3 THEN max(r2) ELSE greatest(0.05, 0.2 * max(r2)) END AS reliability FROM m GROUP BY 1")
def _(spark, sf):
    return R.reliability(by_fold(spark, sf), "g", "r2")


@query("R4_topology_frequency", "SELECT p_type, count(*) / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1")
def _(spark, sf):
    return R.frequency(table(spark, sf, "part"), "p_type")


def _scale_sql(col: str, reverse: bool, src: str) -> str:
    a, b = (f"(SELECT quantile_cont({col}, {q}) FROM {src})" for q in (0.05, 0.95))
    x = f"((least(greatest({col}, {a}), {b}) - {a}) / ({b} - {a}))"
    return f"CASE WHEN {col} IS NOT NULL THEN {'1 - ' if reverse else ''}{x} END"


_CA = "ca AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CASE WHEN p_size > 40 THEN NULL ELSE p_partkey % 17 + 0.5 END AS extra FROM part)"


def candidates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", c("p_size").cast("double").alias("size"), c("p_retailprice").alias("price"), F.when(c("p_size") <= 40, c("p_partkey") % 17 + 0.5).alias("extra"))


@query("R5_robust_scale", f"WITH {_CA} SELECT p_partkey, round({_scale_sql('size', False, 'ca')}, 6) AS size, round({_scale_sql('price', True, 'ca')}, 6) AS price FROM ca")
def _(spark, sf):
    rows = R.robust_scale(candidates(spark, sf), {"size": False, "price": True})
    return rows.select("p_partkey", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"))


@query("R6_weighted_average", f"WITH {_CA} SELECT p_partkey, round(CASE WHEN extra IS NULL THEN size ELSE (size * 2 + extra) / 3 END, 6) AS value, round(CASE WHEN extra IS NULL THEN 2 / 3.0 ELSE 1 END, 6) AS confidence FROM ca")
def _(spark, sf):
    value, share = R.weighted_average({"size": 2.0, "extra": 1.0})
    return candidates(spark, sf).select("p_partkey", F.round(value, 6).alias("value"), F.round(share, 6).alias("confidence"))


_R7 = (
    f"WITH {_CA}, s AS (SELECT p_partkey, {_scale_sql('size', False, 'ca')} AS a, {_scale_sql('price', True, 'ca')} AS b, {_scale_sql('extra', False, 'ca')} AS e FROM ca), "
    "k AS (SELECT p_partkey, (a * 2 + b) / 3 AS perf_score, e AS fit_score FROM s), t AS (SELECT *, CASE WHEN fit_score IS NULL THEN perf_score ELSE (perf_score * 0.7 + fit_score * 0.3) END AS total, CASE WHEN fit_score IS NULL THEN 0.7 ELSE 1.0 END AS confidence FROM k), "
    "f AS (SELECT p_partkey, round(perf_score, 6) AS perf_score, round(fit_score, 6) AS fit_score, round(total, 6) AS total, round(confidence, 6) AS confidence, perf_score >= (SELECT quantile_cont(perf_score, 0.6) FROM k) AS perf_pass, coalesce(fit_score >= (SELECT quantile_cont(fit_score, 0.6) FROM k), false) AS fit_pass FROM t)"
)


def ranked(spark, sf):
    criteria = {"perf": {"size": (2.0, False), "price": (1.0, True)}, "fit": {"extra": (1.0, False)}}
    rows = R.multi_criteria(candidates(spark, sf), criteria, {"perf": 0.7, "fit": 0.3})
    return rows.select("p_partkey", *[F.round(x, 6).alias(x) for x in ("perf_score", "fit_score", "total", "confidence")], "perf_pass", "fit_pass")


@query("R7_multi_criteria", _R7 + " SELECT * FROM f")
def _(spark, sf):
    return ranked(spark, sf)


@query("R8_ranking", _R7 + " SELECT p_partkey, total FROM f WHERE confidence >= 0.8 ORDER BY total DESC, p_partkey LIMIT 50")
def _(spark, sf):
    return ranked(spark, sf).filter("confidence >= 0.8").orderBy(F.desc("total"), "p_partkey").limit(50).select("p_partkey", "total")


_PA = "pa AS (SELECT DISTINCT p_partkey, p_brand AS metal, l_suppkey * 10 + p_partkey % 10 AS linker, CAST(p_size AS DOUBLE) AS score FROM part JOIN lineitem ON l_partkey = p_partkey)"


def pairs(spark, sf):
    return table(spark, sf, "part").join(table(spark, sf, "lineitem"), c("p_partkey") == c("l_partkey")).select("p_partkey", c("p_brand").alias("metal"), (c("l_suppkey") * 10 + c("p_partkey") % 10).alias("linker"), c("p_size").cast("double").alias("score")).distinct()


@query("R9_component_pairs", f"WITH {_PA} SELECT metal, linker, count(*) AS n FROM pa GROUP BY 1, 2")
def _(spark, sf):
    return pairs(spark, sf).groupBy("metal", "linker").agg(F.count("*").alias("n"))


_R10 = "SELECT {0}, avg(score) AS mean_score, count(*) / (SELECT count(*) FROM pa) AS share FROM pa GROUP BY 1"


@query("R10_component_priors", f"WITH {_PA} SELECT metal, round(mean_score, 6) AS mean_score, round(share, 6) AS share FROM ({_R10.format('metal')})")
def _(spark, sf):
    rows = R.component_priors(pairs(spark, sf), "metal", "score")
    return rows.select("metal", F.round("mean_score", 6).alias("mean_score"), F.round("share", 6).alias("share"))


@query(
    "R11_unseen_pairs",
    f"WITH {_PA}, a AS ({_R10.format('metal')} ORDER BY mean_score DESC, metal LIMIT 20), b AS ({_R10.format('linker')} ORDER BY mean_score DESC, linker LIMIT 60) SELECT metal, linker, round((a.mean_score + b.mean_score) / 2, 6) AS score, round(sqrt(a.share * b.share), 8) AS plausibility FROM a, b WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.metal = a.metal AND pa.linker = b.linker)",
)
def _(spark, sf):
    rows = pairs(spark, sf)
    out = R.unseen_pairs(rows, "metal", "linker", R.component_priors(rows, "metal", "score"), R.component_priors(rows, "linker", "score"), (20, 60), 20_000)
    return out.select("metal", "linker", F.round("score", 6).alias("score"), F.round("plausibility", 8).alias("plausibility"))


@query(
    "R12_derivative_ranking",
    _R7 + " SELECT a.p_partkey, b.total AS parent_total, round(b.total + 0.25 * (a.perf_score - b.perf_score), 4) AS adjusted FROM f a JOIN f b ON b.p_partkey = a.p_partkey - a.p_partkey % 10 WHERE a.p_partkey % 10 <> 0",
)
def _(spark, sf):
    rows = ranked(spark, sf)
    parent = rows.select(c("p_partkey").alias("parent"), c("total").alias("parent_total"), c("perf_score").alias("parent_perf"))
    child = rows.filter("p_partkey % 10 <> 0").withColumn("parent", c("p_partkey") - c("p_partkey") % 10).join(parent, "parent")
    return child.select("p_partkey", "parent_total", F.round(c("parent_total") + 0.25 * (c("perf_score") - c("parent_perf")), 4).alias("adjusted"))


@query("R14_concept_evidence", "WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 20), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS rn FROM e) SELECT user_id, string_agg(event_type, ';' ORDER BY event_type) AS evidence FROM r WHERE rn <= 6 GROUP BY 1")
def _(spark, sf):
    rows = table(spark, sf, "events").filter("value > 20").groupBy("user_id").agg(F.slice(F.array_sort(F.collect_set("event_type")), 1, 6).alias("e"))
    return rows.select("user_id", F.array_join("e", ";").alias("evidence"))


_RM = "mr AS (SELECT event_type AS model, user_id % 7 AS relation, round(avg(value), 6) AS auc FROM events GROUP BY 1, 2)"
_RQ = "w AS (SELECT * FROM mr WHERE lower(model) = lower('{0}')), q AS (SELECT relation, arg_max(auc, model) AS quality FROM (SELECT * FROM w UNION ALL SELECT * FROM mr WHERE NOT EXISTS (SELECT 1 FROM w)) GROUP BY 1)".format


def model_scores(spark, sf):
    return table(spark, sf, "events").groupBy(c("event_type").alias("model"), (c("user_id") % 7).alias("relation")).agg(F.round(F.avg("value"), 6).alias("auc"))


@query("R2_relation_quality", f"WITH {_RM}, {_RQ('CLICK')} SELECT * FROM q")
def _(spark, sf):
    return R.relation_quality(model_scores(spark, sf), "CLICK")


@query("R2_relation_quality_of_all", f"WITH {_RM}, {_RQ('unknown model')} SELECT * FROM q")
def _(spark, sf):
    return R.relation_quality(model_scores(spark, sf), "unknown model")


#: Target, reliability where nothing is known.
DELTA_DEFAULTS = [("click", 0.85), ("error", 0.27), ("never seen", 0.5)]
_DM = "d AS (SELECT event_type AS target, CASE WHEN user_id % 3 = 0 THEN 'ALL' ELSE 'part' END AS \"group\", 'method ' || user_id % 5 AS method, round((avg(value) - 9) / 10, 6) AS r2 FROM events GROUP BY 1, 2, 3)"


def delta_scores(spark, sf):
    group, method = F.when(c("user_id") % 3 == 0, "ALL").otherwise("part"), F.concat(F.lit("method "), (c("user_id") % 5).cast("string"))
    return table(spark, sf, "events").groupBy(c("event_type").alias("target"), group.alias("group"), method.alias("method")).agg(F.round((F.avg("value") - 9) / 10, 6).alias("r2"))


@query("R3_delta_reliability", f"WITH {_DM}, b AS (SELECT target, max(r2) AS best FROM d WHERE \"group\" = 'ALL' GROUP BY 1), v(target, fallback) AS (VALUES " + ", ".join(f"('{t}', {x})" for t, x in DELTA_DEFAULTS) + ") SELECT v.target, CAST(CASE WHEN best IS NULL THEN fallback ELSE greatest(0.05, best) END AS DOUBLE) AS reliability FROM v LEFT JOIN b USING (target)")
def _(spark, sf):
    return R.delta_reliability(delta_scores(spark, sf), spark.createDataFrame(DELTA_DEFAULTS, "target string, default double"))


@query(
    "R13_chosen_source",
    f"WITH {_DM}, b AS (SELECT arg_max(method, (r2, method)) AS best FROM d WHERE target = 'click' AND \"group\" = 'ALL'), "
    "s AS (SELECT p_partkey, 'method 0 predictions' AS source, 1 AS n FROM part WHERE p_size > 1000 UNION ALL SELECT p_partkey, 'method 1 predictions', 2 FROM part UNION ALL SELECT p_partkey, 'method 2 predictions', 3 FROM part WHERE p_size > 20), "
    "o AS (SELECT *, CASE WHEN contains(lower(source), lower((SELECT best FROM b))) THEN 0 ELSE n END AS ord FROM s) SELECT p_partkey, source FROM o WHERE ord = (SELECT min(ord) FROM o)",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    sources = {"method 0 predictions": part.filter("p_size > 1000"), "method 1 predictions": part, "method 2 predictions": part.filter("p_size > 20")}
    return R.choose_source({k: v.select("p_partkey") for k, v in sources.items()}, delta_scores(spark, sf), "click")


_EV = (
    ", p AS (SELECT f.p_partkey, total, confidence, perf_pass AND fit_pass AS plausible, p_type FROM f JOIN part USING (p_partkey)), picks AS (SELECT * FROM p ORDER BY total DESC, p_partkey LIMIT 40), "
    "an AS (SELECT a.p_partkey, CAST(b.p_partkey AS VARCHAR) AS analog, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.total DESC, CAST(b.p_partkey AS VARCHAR)) AS rank FROM picks a JOIN p b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey), "
    "g AS (SELECT p_partkey, string_agg(analog, ';' ORDER BY rank) AS analogs FROM an WHERE rank <= 3 GROUP BY 1), su AS (SELECT l_partkey AS p_partkey, count(DISTINCT l_suppkey) AS linkers, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS tests FROM lineitem GROUP BY 1), "
    "z AS (SELECT picks.p_partkey, total, confidence, plausible, coalesce(analogs, '') AS analogs, coalesce(linkers, 0) AS linkers, coalesce(tests, 0) AS tests FROM picks LEFT JOIN g USING (p_partkey) LEFT JOIN su USING (p_partkey)) "
    "SELECT p_partkey, total, analogs, linkers, tests, coalesce(nullif(concat_ws('; ', CASE WHEN confidence < 0.9 THEN 'few measurements' END, CASE WHEN analogs = '' THEN 'no analog' END, CASE WHEN NOT plausible THEN 'fails a criterion' END, CASE WHEN linkers = 0 THEN 'no linkers' END, CASE WHEN tests = 0 THEN 'no tests' END), ''), 'none') AS risk FROM z"
)


@query("R15_evidence_records", _R7 + _EV)
def _(spark, sf):
    rows = ranked(spark, sf).withColumn("plausible", c("perf_pass") & c("fit_pass")).select("p_partkey", "total", "confidence", "plausible").join(table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey")
    picks = rows.orderBy(F.desc("total"), "p_partkey").limit(40)
    analogs = F.broadcast(picks.select("p_partkey", "p_type")).join(rows.select(c("p_partkey").alias("other"), "p_type", c("total").alias("score")), "p_type").filter("p_partkey <> other")
    support = table(spark, sf, "lineitem").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("linkers"), F.count_distinct(F.when(c("l_returnflag") == "R", c("l_orderkey"))).alias("tests"))
    out = R.evidence_records(picks.drop("p_type"), "p_partkey", analogs.select("p_partkey", c("other").cast("string").alias("analog"), "score"), support)
    return out.select("p_partkey", "total", F.array_join("analogs", ";").alias("analogs"), "linkers", "tests", "risk")


@query("R18_trace_tables", _M3 + f", {_RM}, {_RQ('CLICK')} SELECT 'property' AS kind, CAST(g AS VARCHAR) AS name, CASE WHEN max(r2) >= 0.3 THEN max(r2) ELSE greatest(0.05, 0.2 * max(r2)) END AS value FROM m GROUP BY 2 UNION ALL SELECT 'relation', CAST(relation AS VARCHAR), quality FROM q")
def _(spark, sf):
    from orefield.sources.stored import new_folder
    from orefield.sources.tables import read_tables, write_tables

    found = {"property": R.reliability(by_fold(spark, sf), "g", "r2").toDF("name", "value"), "relation": R.relation_quality(model_scores(spark, sf), "CLICK").toDF("name", "value")}
    path = new_folder(spark, "trace")
    write_tables({k: v.withColumn("name", c("name").cast("string")) for k, v in found.items()}, path)
    return read_tables(spark, path, list(found))
