"""Registered queries that fit models or compose vectors; without a SQL twin, invariants check their results."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from orefield.operators import embed as E
from orefield.operators import learn as L
from orefield.operators import metrics as M
from orefield.operators import probes as P
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


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def feature_vectors(spark, sf):
    return vectors(spark, sf).select("vec_id", array_to_vector("embedding").alias("features"))


def part_features(spark, sf):
    """Of the parts that have a vector."""
    rows = table(spark, sf, "part").select(c("p_partkey").alias("vec_id"), "p_size", "p_retailprice", "p_brand", F.concat(F.lit("C"), c("p_size").cast("string"), F.lit("H2O")).alias("formula"), "p_name")
    return L.chemical_features(rows, "vec_id", ["p_size", "p_retailprice"], {"p_brand": 5}, "formula", ["C", "H", "O"], "p_name", 16, vectors(spark, sf))


@query("L10_L11_feature_families")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = L.families(feature_vectors(spark, sf), part_features(spark, sf), "vec_id")["Hybrid"]
    return rows.select("vec_id", F.size(vector_to_array("features")).alias("width"))


def links(spark, sf):
    """(positives, negatives): all part-supplier links between rows with vectors, and one false supplier for each."""
    v, item = vectors(spark, sf).select("vec_id"), table(spark, sf, "lineitem")
    true = item.select(c("l_partkey").alias("h"), c("l_suppkey").alias("t")).distinct().join(v.toDF("h"), "h", "left_semi").join(v.toDF("t"), "t", "left_semi")
    n = table(spark, sf, "supplier").count()
    false = E.uniform_negatives(true.withColumn("r", F.lit(0)), n, side="tail").select("h", "t").distinct().join(true, ["h", "t"], "left_anti").join(v.toDF("t"), "t", "left_semi")
    return true, false.select("h", "t")


def _classified(name: str):
    return lambda spark, sf: L.link_classification(*links(spark, sf), vectors(spark, sf), "vec_id", "embedding", [name])


for _id, _model in {"L15_L23_link_classification": "logistic", "L16_L23_link_forest": "forest", "L17_L23_link_boosted": "boosted", "L18_L23_link_perceptron": "perceptron"}.items():
    query(_id)(_classified(_model))


def _regressed(name: str):
    def run(spark, sf):
        targets = table(spark, sf, "part").select(c("p_partkey").alias("vec_id"), "p_retailprice", "p_size")
        found = L.families(feature_vectors(spark, sf), part_features(spark, sf), "vec_id")
        return L.property_regression({"Hybrid": found["Hybrid"]}, targets, "vec_id", ["p_retailprice", "p_size"], [name])

    return run


for _id, _model in {"L20_forest_regression": "forest", "L21_boosted_regression": "boosted"}.items():
    query(_id)(_regressed(_model))


def _imputed(spark, sf):
    labels = vectors(spark, sf).select("vec_id", c("label").cast("string").alias("label_name"))
    return L.label_imputation(feature_vectors(spark, sf), labels, "vec_id", "label_name")


@query("L27_label_imputation")
def _(spark, sf):
    """Accuracy of the forest and of the training rows' most frequent class, on the same held-out rows."""
    rows = _imputed(spark, sf)
    return rows.agg(F.avg((c("y") == c("prediction")).cast("int")).alias("accuracy"), F.avg((c("y") == c("majority")).cast("int")).alias("baseline"), F.count("*").alias("n"))


@query("L27_imputation_by_class")
def _(spark, sf):
    """For each class its held-out rows, how many the forest and the baseline find, and how often the forest says it."""
    return M.class_table(_imputed(spark, sf), {"forest": "prediction", "baseline": "majority"})


@query("L22_L28_family_grid_search")
def _(spark, sf):
    from orefield.operators.features import hash_share

    rows = feature_vectors(spark, sf).join(table(spark, sf, "part").select(c("p_partkey").alias("vec_id"), c("p_retailprice").alias("label")), "vec_id")
    family = F.floor(c("vec_id") / 10)
    rows = rows.withColumns({"fold": F.floor(hash_share(family, seed=1) * 5).cast("int"), "is_train": hash_share(family) < 0.8})
    model = L.grid_search(rows.filter("is_train"), "fold", [3, 5], [10])
    return model.transform(rows.filter("not is_train")).select("vec_id", "label", "prediction")


def _probes(spark, sf):
    """Probes of every label against the rest, on the vectors and on those drawn halfway to their brand's mean, in three splits."""
    v = vectors(spark, sf)
    labels = R.categorical_concepts(v.withColumn("kind", c("label").cast("string")), "vec_id", "kind", 10)
    brand = table(spark, sf, "part").select(c("p_partkey").alias("vec_id"), "p_brand")
    mean = E.component_vectors(brand, v, "vec_id", "p_brand", "embedding", 64, 1).select("p_brand", c("embedding").alias("m"))
    drawn = v.join(brand, "vec_id").join(F.broadcast(mean), "p_brand").select("vec_id", F.zip_with("embedding", "m", lambda x, y: (x + y) / 2).alias("embedding"))  # a row per brand
    return P.logistic_probes({"own": v.select("vec_id", "embedding"), "brand": drawn}, labels, "vec_id", "embedding")


@query("C5_probe_table")
def _(spark, sf):
    return P.probe_summary(_probes(spark, sf))


@query("C5_C8_concept_probes")
def _(spark, sf):
    """The five vectors that point most along and against each concept's direction of the first split."""
    probes = _probes(spark, sf).filter("method = 'own' and seed = 0").select("concept", "direction")
    return L.alignment(vectors(spark, sf), probes, "vec_id", "embedding", 5)


@query("C7_cross_method_cosine")
def _(spark, sf):
    return P.cross_method_cosines(_probes(spark, sf)).withColumn("cosine", F.round("cosine", 6))


@query("C9_projected_directions")
def _(spark, sf):
    from orefield.functions import vectors as V

    v = vectors(spark, sf)
    means = V.mean_by(v, "label", "embedding", 64).select(c("label").cast("string").alias("concept"), c("embedding").alias("direction"))
    places = v.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return L.projected_directions(v, "vec_id", "embedding", places, means)


_KIND = "concat_ws('-', p_type, CAST(p_partkey % 40 AS VARCHAR))"
_MEAN = "SELECT {0} AS k, i, avg(CAST(embedding[i] AS DOUBLE)) AS x, count(*) AS n FROM part JOIN embeddings ON vec_id = p_partkey, range(1, 65) r(i) GROUP BY 1, 2 HAVING count(*) >= {1}".format
_FIRST = "{0}.k IN (SELECT k FROM (SELECT DISTINCT k, n FROM {0}) ORDER BY n DESC, k LIMIT 100)".format


@query(
    "R17_hypothetical_pairs",
    f"""WITH a AS ({_MEAN('p_brand', 5)}), b AS ({_MEAN(_KIND, 1)}), g AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) WHERE label = 0 GROUP BY 1),
 p AS (SELECT a.k AS p_brand, b.k AS kind, round(sum((a.x + b.x) / 2 * g.x) / sqrt(sum((a.x + b.x) / 2 * (a.x + b.x) / 2) * sum(g.x * g.x)), 6) AS score FROM a JOIN b USING (i) JOIN g USING (i) WHERE {_FIRST('a')} AND {_FIRST('b')} GROUP BY 1, 2)
 SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.p_brand = p.p_brand AND {_KIND} = p.kind) ORDER BY score DESC, p_brand, kind LIMIT 5000""",
)
def _(spark, sf):
    """Component pairs never seen together, of the hundred most frequent of either, by the cosine of their mean vectors to a class's mean."""
    from orefield.functions import vectors as V

    v = vectors(spark, sf)
    links = table(spark, sf, "part").select(c("p_partkey").alias("vec_id"), "p_brand", F.concat_ws("-", "p_type", (c("p_partkey") % 40).cast("string")).alias("kind"))
    first = lambda rows, key, name: rows.orderBy(F.desc("n"), key).limit(100).select(key, c("embedding").alias(name))
    a = first(E.component_vectors(links, v, "vec_id", "p_brand", "embedding", 64, 5), "p_brand", "va")
    b = first(E.component_vectors(links, v, "vec_id", "kind", "embedding", 64, 1), "kind", "vb")
    goal = V.mean_by(v.filter("label = 0"), "label", "embedding", 64).select(c("embedding").alias("goal"))
    pairs = a.crossJoin(F.broadcast(b)).join(links.select("p_brand", "kind").distinct(), ["p_brand", "kind"], "left_anti").crossJoin(F.broadcast(goal))  # at most 100 x 100 pairs
    composed = F.transform(V.add(c("va"), c("vb")), lambda x: x / 2)
    return pairs.select("p_brand", "kind", F.round(V.cosine(composed, c("goal")), 6).alias("score")).orderBy(F.desc("score"), "p_brand", "kind").limit(5000)
