"""Registered queries of ridge models from sums of products, and their SQL twins, which solve the same systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from orefield.operators import linear as L
from orefield.operators.features import hash_share
from orefield.plans.star import table

QUERIES, ORACLE_SQL = {}, {}
c = F.col
FAMILIES = {"KG": 64, "Chem": 7, "Hybrid": 71}
TARGETS = ["price", "lines", "quantity", "discount", "charge", "returned"]


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def design(spark, sf):
    """(vec_id, KG, Chem, Hybrid, targets): a row for each part with a vector; means and counts of its order lines are among the targets."""
    lines = table(spark, sf, "lineitem").groupBy(c("l_partkey").alias("vec_id")).agg(
        F.count("*").alias("lines"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("charge"), F.avg((c("l_returnflag") == "R").cast("double")).alias("returned"),
    )
    brand = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    chem = F.concat(F.array(c("p_size").cast("double"), F.length("p_name").cast("double")), F.array(*[(brand % 5 == i).cast("double") for i in range(5)]))
    part = table(spark, sf, "part").select(c("p_partkey").alias("vec_id"), chem.alias("Chem"), c("p_retailprice").alias("price"))
    vectors = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("KG"))
    return vectors.join(part, "vec_id").join(lines, "vec_id", "left").withColumn("Hybrid", F.concat("KG", "Chem"))


_SHARE = "CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT) / 4294967296.0"
_DESIGN = (
    "ln AS (SELECT l_partkey AS vec_id, CAST(count(*) AS DOUBLE) AS lines, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_extendedprice) AS charge, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS returned FROM lineitem GROUP BY 1), "
    "de AS MATERIALIZED (SELECT e.vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS KG, list_concat([CAST(p_size AS DOUBLE), CAST(length(p_name) AS DOUBLE)], list_transform(range(0, 5), lambda i: CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 5 = i THEN 1.0::DOUBLE ELSE 0 END)) AS Chem, "
    "p_retailprice AS price, lines, quantity, discount, charge, returned FROM embeddings e JOIN part ON p_partkey = e.vec_id LEFT JOIN ln USING (vec_id)), "
    "fa AS (SELECT vec_id, 'KG' AS family, KG AS x FROM de UNION ALL SELECT vec_id, 'Chem', Chem FROM de UNION ALL SELECT vec_id, 'Hybrid', list_concat(KG, Chem) FROM de), "
    "ta AS (" + " UNION ALL ".join(f"SELECT vec_id, '{t}' AS target, CAST({t} AS DOUBLE) AS y FROM de WHERE {t} IS NOT NULL" for t in TARGETS) + ")"
)


def ridge_sql(rows: str, penalties: list[float], least: int) -> str:
    """CTEs up to ``mo``, the columns of ``ridge_models``, from ``rows`` (family, target, split, slice, fold, x, y): sums of products, Gauss-Jordan steps on each system, errors from the sums."""
    cell, kinds = "family, target, split, slice", ", ".join(f"({p}::DOUBLE)" for p in penalties)
    return (
        f"zz AS MATERIALIZED (SELECT {cell}, fold, list_concat([1.0::DOUBLE], x, [y]) AS z FROM ({rows})), "
        f"gg AS MATERIALIZED (SELECT {cell}, fold, i, j, sum(a * z[j]) AS g FROM (SELECT {cell}, fold, z, i, z[i] AS a FROM zz, range(1, 300) r(i) WHERE i <= len(z)), range(1, 300) s(j) WHERE j <= len(z) GROUP BY {cell}, fold, i, j), "
        f"al AS (SELECT {cell}, i, j, sum(g) AS every, sum(CASE WHEN fold <> -1 THEN g ELSE 0 END) AS learnt FROM gg GROUP BY {cell}, i, j), "
        f"tr AS MATERIALIZED (SELECT {cell}, fold, i, j, g AS test, CASE WHEN fold = -1 THEN learnt ELSE learnt - g END AS g, every FROM gg JOIN al USING ({cell}, i, j)), "
        f"si AS MATERIALIZED (SELECT {cell}, fold, max(i) AS last, max(CASE WHEN i = 1 AND j = 1 THEN g END) AS n, max(CASE WHEN i = 1 AND j = 1 THEN test END) AS n_test, max(CASE WHEN i = 1 AND j = 1 THEN every END) AS n_all FROM tr GROUP BY {cell}, fold), "
        f"me AS (SELECT {cell}, fold, j, g / n AS mean FROM tr JOIN si USING ({cell}, fold) WHERE i = 1 AND n >= 2), "
        f"sd AS MATERIALIZED (SELECT {cell}, fold, j, mean, CASE WHEN sqrt(greatest(g / n - mean * mean, 0)) > 1e-9 * greatest(abs(mean), 1) AND j > 1 AND j < last THEN sqrt(greatest(g / n - mean * mean, 0)) ELSE 1 END AS sd "
        f"FROM me JOIN tr USING ({cell}, fold, j) JOIN si USING ({cell}, fold) WHERE tr.i = me.j), "
        f"sy AS MATERIALIZED (SELECT {cell}, fold, penalty, tr.i, list((g - n * a.mean * b.mean) / (a.sd * b.sd) + CASE WHEN tr.i = tr.j THEN penalty ELSE 0 END ORDER BY tr.j) AS v FROM tr JOIN si USING ({cell}, fold) JOIN sd a USING ({cell}, fold) JOIN sd b USING ({cell}, fold), (VALUES {kinds}) p(penalty) "
        f"WHERE a.j = tr.i AND b.j = tr.j AND tr.i > 1 AND tr.i < last AND tr.j > 1 AND n_all >= {least} GROUP BY {cell}, fold, penalty, tr.i), "
        f"m0 AS (SELECT {cell}, fold, penalty, list(v ORDER BY i) AS m FROM sy GROUP BY {cell}, fold, penalty), "
        f"gj AS (SELECT *, 0 AS k FROM m0 UNION ALL SELECT {cell}, fold, penalty, list_transform(m, lambda v, i: CASE WHEN i = k + 1 THEN list_transform(v, lambda x: x / top[k + 1]) ELSE list_transform(list_zip(v, top), lambda x: x[1] - x[2] * v[k + 1] / top[k + 1]) END), k + 1 "
        f"FROM (SELECT *, m[k + 1] AS top FROM gj WHERE k < len(m))), "
        f"we AS (SELECT {cell}, fold, penalty, unnest(range(2, len(m) + 2)) AS i, unnest(list_transform(m, lambda v: v[len(v)])) AS w FROM gj WHERE k = len(m)), "
        f"wr AS MATERIALIZED (SELECT {cell}, fold, penalty, i, w / sd AS w, w / sd * mean AS part FROM we JOIN sd USING ({cell}, fold) WHERE sd.j = we.i), "
        f"be AS MATERIALIZED (SELECT {cell}, fold, penalty, i, w FROM wr UNION ALL SELECT {cell}, fold, penalty, 1, any_value(sd.mean) - sum(part) FROM wr JOIN si USING ({cell}, fold) JOIN sd USING ({cell}, fold) WHERE sd.j = last GROUP BY {cell}, fold, penalty "
        f"UNION ALL SELECT DISTINCT {cell}, fold, penalty, last, -1.0 FROM wr JOIN si USING ({cell}, fold)), "
        f"er AS (SELECT {cell}, fold, a.penalty, greatest(sum(a.w * b.w * test), 0) AS lost FROM be a JOIN tr USING ({cell}, fold, i) JOIN (SELECT {cell}, fold, i AS j, penalty, w FROM be) b USING ({cell}, fold, j) WHERE a.penalty = b.penalty GROUP BY {cell}, fold, a.penalty), "
        f"yy AS (SELECT {cell}, fold, max(CASE WHEN i = last AND j = last THEN test END) - max(CASE WHEN i = 1 AND j = last THEN test END) * max(CASE WHEN i = 1 AND j = last THEN test END) / any_value(n_test) AS spread, max(CASE WHEN i = last AND j = last THEN test END) AS yy FROM tr JOIN si USING ({cell}, fold) GROUP BY {cell}, fold), "
        f"mo AS (SELECT {cell}, fold, penalty, CAST(n AS BIGINT) AS n_train, CAST(n_test AS BIGINT) AS n_test, CASE WHEN spread > 1e-12 * greatest(yy, 1e-300) THEN 1 - lost / spread END AS r2, sqrt(lost / n_test) AS rmse FROM er JOIN si USING ({cell}, fold) JOIN yy USING ({cell}, fold))"
    )


def _rows_sql(fold: str, split: str = "'0'") -> str:
    return f"SELECT family, target, {split} AS split, 'ALL' AS slice, {fold} AS fold, x, y FROM fa JOIN ta USING (vec_id)"


_KEY = "CAST(vec_id AS VARCHAR)"
_FIVE = f"CAST(floor({_SHARE.format(seed=0, key=_KEY)} * 5) AS INTEGER)"


def five_folds(spark, sf, penalties, least=40):
    rows = design(spark, sf).withColumn("split0", F.floor(hash_share("vec_id") * 5).cast("int"))
    return L.ridge_models(L.fold_grams(rows, FAMILIES, TARGETS, ["split0"]), penalties, least)


@query("L19_L24_property_regression", f"WITH RECURSIVE {_DESIGN}, {ridge_sql(_rows_sql(_FIVE), [1.0], 40)} SELECT family, target, fold, n_train, n_test, round(r2, 6) AS r2, round(rmse, 6) AS rmse FROM mo")
def _(spark, sf):
    """Every numeric target by every feature family, in five folds."""
    return five_folds(spark, sf, [1.0]).select("family", "target", "fold", "n_train", "n_test", F.round("r2", 6).alias("r2"), F.round("rmse", 6).alias("rmse"))


_GRID = [0.1, 1.0, 10.0, 100.0, 1000.0]
_BEST = "SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(mean_r2, 9) DESC, penalty) AS place FROM (SELECT {by}, penalty, avg(r2) AS mean_r2, count(r2) AS folds FROM mo WHERE {when} GROUP BY {by}, penalty)"


@query("L22_grid_search", f"WITH RECURSIVE {_DESIGN}, {ridge_sql(_rows_sql(_FIVE), _GRID, 40)} SELECT family, target, penalty, round(mean_r2, 6) AS mean_r2, folds FROM ({_BEST.format(by='family, target', when='true')}) WHERE place = 1")
def _(spark, sf):
    """For each family and target the penalty of the best mean R2 over five folds."""
    return L.best_penalty(five_folds(spark, sf, _GRID), ["family", "target"]).withColumn("mean_r2", F.round("mean_r2", 6))


_SEEDS = [0, 1, 2]
_SPLITS = " UNION ALL ".join(_rows_sql(f"CASE WHEN {_SHARE.format(seed=s, key=_KEY)} < 0.8 THEN 0 ELSE -1 END", f"'split{s}'") for s in _SEEDS)


@query(
    "L25_best_configuration",
    f"WITH RECURSIVE {_DESIGN}, {ridge_sql(_SPLITS, [1.0, 100.0], 40)}, av AS (SELECT target, family, penalty, avg(r2) AS r2_mean, stddev_samp(r2) AS r2_std, count(*) AS splits FROM mo WHERE fold = -1 GROUP BY 1, 2, 3) "
    "SELECT target, family, penalty, round(r2_mean, 6) AS r2_mean, round(r2_std, 6) AS r2_std, splits FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(r2_mean, 9) DESC, family, penalty) AS place FROM av) WHERE place = 1",
)
def _(spark, sf):
    """For each target the family and penalty of the best mean R2 over three random splits of four to one."""
    rows = design(spark, sf).withColumns({f"split{s}": F.when(hash_share("vec_id", seed=s) < 0.8, 0).otherwise(L.HELD_OUT) for s in _SEEDS})
    models = L.ridge_models(L.fold_grams(rows, FAMILIES, TARGETS, [f"split{s}" for s in _SEEDS]), [1.0, 100.0], 40).filter(c("fold") == L.HELD_OUT)
    means = models.groupBy("target", "family", "penalty").agg(F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_std"), F.count("*").alias("splits"))
    best = F.min_by(F.struct("family", "penalty", "r2_mean", "r2_std", "splits"), F.struct(-F.round("r2_mean", 9), c("family"), c("penalty")))
    return means.groupBy("target").agg(best.alias("best")).select("target", "best.family", "best.penalty", F.round("best.r2_mean", 6).alias("r2_mean"), F.round("best.r2_std", 6).alias("r2_std"), "best.splits")


_DELTA = {"KG": 48, "Chem": 7, "Hybrid": 55}


def delta_design(spark, sf):
    """Parts as derivatives of the part whose key ends in 0: vectors of parent, child and their difference, the parent's chemistry, and the changes of two values; a slice for each kind of derivative."""
    rows = design(spark, sf).select("vec_id", F.slice("KG", 1, 16).alias("v"), "Chem", "charge", "quantity")
    child = rows.filter("vec_id % 10 <> 0").select((c("vec_id") - c("vec_id") % 10).alias("parent"), c("vec_id").alias("child"), c("v").alias("vc"), c("charge").alias("c1"), c("quantity").alias("c2"))
    parent = rows.filter("vec_id % 10 = 0").select(c("vec_id").alias("parent"), c("v").alias("vp"), "Chem", c("charge").alias("p1"), c("quantity").alias("p2"))
    rows = child.join(parent, "parent").withColumns({"KG": F.concat("vp", "vc", F.zip_with("vc", "vp", lambda x, y: x - y)), "delta_charge": c("c1") - c("p1"), "delta_quantity": c("c2") - c("p2")})
    return rows.withColumns({"Hybrid": F.concat("KG", "Chem"), "slices": F.array(F.lit("ALL"), F.concat(F.lit("A"), (c("child") % 10).cast("string"))), "split0": F.floor(hash_share("child") * 5).cast("int")})


_PAIRS = (
    "pa AS MATERIALIZED (SELECT a.vec_id AS child, list_concat(list_concat(b.KG[1:16], a.KG[1:16]), list_transform(list_zip(a.KG[1:16], b.KG[1:16]), lambda x: x[1] - x[2])) AS KG, b.Chem, a.charge - b.charge AS delta_charge, a.quantity - b.quantity AS delta_quantity "
    "FROM de a JOIN de b ON b.vec_id = a.vec_id - a.vec_id % 10 WHERE a.vec_id % 10 <> 0), pf AS (SELECT child, 'KG' AS family, KG AS x FROM pa UNION ALL SELECT child, 'Chem', Chem FROM pa UNION ALL SELECT child, 'Hybrid', list_concat(KG, Chem) FROM pa), "
    "pt AS (SELECT child, 'delta_charge' AS target, delta_charge AS y FROM pa WHERE delta_charge IS NOT NULL UNION ALL SELECT child, 'delta_quantity', delta_quantity FROM pa WHERE delta_quantity IS NOT NULL), "
    "ps AS (SELECT child, 'ALL' AS slice FROM pa UNION ALL SELECT child, 'A' || child % 10 FROM pa)"
)
_PAIR_ROWS = f"SELECT family, target, 'split0' AS split, slice, CAST(floor({_SHARE.format(seed=0, key='CAST(child AS VARCHAR)')} * 5) AS INTEGER) AS fold, x, y FROM pf JOIN pt USING (child) JOIN ps USING (child)"


@query("L26_delta_regression", f"WITH RECURSIVE {_DESIGN}, {_PAIRS}, {ridge_sql(_PAIR_ROWS, [1.0], 20)} SELECT family, target, slice, fold, n_train, n_test, round(r2, 5) AS r2, round(rmse, 5) AS rmse FROM mo")
def _(spark, sf):
    """Changes between a part and its derivatives, over all pairs and over each kind of derivative with at least 20 of them, in five folds."""
    grams = L.fold_grams(delta_design(spark, sf), _DELTA, ["delta_charge", "delta_quantity"], ["split0"], c("slices"))
    return L.ridge_models(grams, [1.0], 20).select("family", "target", "slice", "fold", "n_train", "n_test", F.round("r2", 5).alias("r2"), F.round("rmse", 5).alias("rmse"))


_GROUP = "CAST(vec_id // 10 AS VARCHAR)"
_GROUPED = f"CASE WHEN {_SHARE.format(seed=0, key=_GROUP)} < 0.8 THEN CAST(floor({_SHARE.format(seed=1, key=_GROUP)} * 5) AS INTEGER) ELSE -1 END"


@query(
    "L28_family_predictions",
    f"WITH RECURSIVE {_DESIGN}, {ridge_sql(_rows_sql(_GROUPED), _GRID, 40)}, bp AS ({_BEST.format(by='family, target', when='fold <> -1')}), "
    f"bw AS (SELECT family, target, penalty, i, w FROM be JOIN (SELECT family, target, penalty FROM bp WHERE place = 1) USING (family, target, penalty) WHERE fold = -1), "
    f"rw AS (SELECT family, target, vec_id, y, list_concat([1.0::DOUBLE], x) AS x FROM fa JOIN ta USING (vec_id) WHERE {_GROUPED} = -1) "
    "SELECT vec_id, family, target, penalty, round(any_value(y), 5) AS y, round(sum(w * x[i]), 5) AS prediction FROM rw JOIN bw USING (family, target) WHERE i <= len(x) GROUP BY vec_id, family, target, penalty",
)
def _(spark, sf):
    """Predictions for rows of held-out families by the model whose penalty was best in five folds of the other families."""
    group = F.floor(c("vec_id") / 10)
    rows = design(spark, sf).withColumn("split0", F.when(hash_share(group) < 0.8, F.floor(hash_share(group, seed=1) * 5).cast("int")).otherwise(L.HELD_OUT))
    models = L.ridge_models(L.fold_grams(rows, FAMILIES, TARGETS, ["split0"]), _GRID, 40)
    best = L.best_penalty(models.filter(c("fold") != L.HELD_OUT), ["family", "target"]).select("family", "target", "penalty")
    final = models.filter(c("fold") == L.HELD_OUT).join(best, ["family", "target", "penalty"]).select("family", "target", "weights", "penalty")
    out = L.predictions(rows.filter(c("split0") == L.HELD_OUT), final, FAMILIES, TARGETS, ["vec_id"]).join(F.broadcast(best), ["family", "target"])  # a row per family and target
    return out.select("vec_id", "family", "target", "penalty", F.round("y", 5).alias("y"), F.round("prediction", 5).alias("prediction"))
