"""Models of MLlib over feature families, splits and folds; each fit is a Spark job over all training rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.functions import strings as S
from orefield.operators import metrics as M
from orefield.operators.features import collapse_rare, hash_share
from orefield.operators.shared_rows import cut

CLASSIFIERS: dict[str, Callable[[], Estimator]] = {
    "logistic": lambda: LogisticRegression(maxIter=50, weightCol="weight"),
    "forest": lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=1, weightCol="weight"),
    "boosted": lambda: GBTClassifier(maxIter=20, maxDepth=4, seed=1, weightCol="weight"),
}
REGRESSORS: dict[str, Callable[[], Estimator]] = {
    "ridge": lambda: LinearRegression(elasticNetParam=0.0, regParam=1.0), "forest": lambda: RandomForestRegressor(numTrees=50, maxDepth=8, seed=1), "boosted": lambda: GBTRegressor(maxIter=20, maxDepth=4, seed=1),
}


def perceptron(n_features: int, n_classes: int, hidden: int = 64) -> Estimator:
    return MultilayerPerceptronClassifier(layers=[n_features, hidden, n_classes], maxIter=50, seed=1)


def classifier(name: str, n_features: int, n_classes: int = 2) -> Estimator:
    """A model by name: logistic, forest, boosted (two classes) or perceptron."""
    return perceptron(n_features, n_classes) if name == "perceptron" else CLASSIFIERS[name]()


def balanced_weights(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Each row's weight: all rows over classes times rows of its class."""
    n = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(n.crossJoin(total)), label).withColumn(name, F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")  # a row per class


def chemical_features(rows: DataFrame, key: str, numbers: list[str], levels: dict[str, int], formula: str, elements: list[str], smiles: str, n_bits: int = 32, only: DataFrame | None = None) -> DataFrame:
    """(key, features): numbers, one-hot frequent levels, element shares of a formula and hashed n-grams of SMILES, in one vector.

    With ``only`` (key), the features of these keys alone; levels are those that are frequent in all of ``rows``.
    """
    out, parts = rows, [F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers])]
    for column, k in levels.items():
        out = collapse_rare(out, column, k, f"__{column}")
        top = [r[0] for r in rows.groupBy(column).count().orderBy(F.desc("count"), column).limit(k).select(column).collect()]  # k levels
        parts.append(F.array(*[(F.col(f"__{column}") == x).cast("double") if x is not None else F.lit(0.0) for x in [*top, "Other"]]))
    if only is not None:
        out = out.join(only.select(key), key, "left_semi")
    parts += [S.formula_fractions(F.coalesce(formula, F.lit("")), elements), S.ngram_features(F.coalesce(smiles, F.lit("")), n_bits)]
    return out.select(key, array_to_vector(F.transform(F.concat(*parts), lambda x: F.coalesce(x, F.lit(0.0)))).alias("features"))


def families(graph: DataFrame, chemical: DataFrame, key: str) -> dict[str, DataFrame]:
    """(key, features) of vectors, of chemistry, and of both joined."""
    both = graph.join(chemical.withColumnRenamed("features", "chem"), key)
    joined = both.select(key, array_to_vector(F.concat(vector_to_array("features"), vector_to_array("chem"))).alias("features"))
    return {"KG": graph, "Chem": chemical, "Hybrid": joined}


def prepared(rows: DataFrame, columns: list[str], train: DataFrame) -> DataFrame:
    """``features`` from numeric columns: medians and scales of the training rows."""
    names = [f"__i_{c}" for c in columns]
    filled = Imputer(strategy="median", inputCols=columns, outputCols=names).fit(train)
    assembled = VectorAssembler(inputCols=names, outputCol="__raw")
    scaler = StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True).fit(assembled.transform(filled.transform(train)))
    return scaler.transform(assembled.transform(filled.transform(rows))).drop(*names, "__raw")


def link_classification(positives: DataFrame, negatives: DataFrame, vectors: DataFrame, key: str, vector: str, models: list[str] = ("logistic",), seed: int = 0) -> DataFrame:
    """(model, auc, n) on held-out pairs (h, t): features h, t and their difference; each model is fitted on all training pairs."""
    from orefield.functions.vectors import concat_pair

    pairs = positives.select("h", "t", F.lit(1).alias("y")).unionByName(negatives.select("h", "t", F.lit(0).alias("y")))
    v = vectors.select(key, vector)
    rows = pairs.join(v.toDF("h", "vh"), "h").join(v.toDF("t", "vt"), "t")
    features = array_to_vector(F.transform(concat_pair(F.transform("vh", lambda x: x.cast("double")), F.transform("vt", lambda x: x.cast("double"))), lambda x: x))
    rows = rows.select("y", F.col("y").cast("double").alias("label"), features.alias("features"), F.lit(1.0).alias("weight"), (hash_share("h", "t", "y", seed=seed) < 0.8).alias("is_train"))
    out, first = [], vectors.select(F.size(vector)).first()
    for name in models:
        model = classifier(name, 3 * first[0]).setLabelCol("label").setFeaturesCol("features").fit(rows.filter("is_train"))
        scored = model.transform(rows.filter("not is_train")).select("y", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        out.append(M.roc_auc(scored).select(F.lit(name).alias("model"), "auc", "n"))
    return reduce(DataFrame.unionByName, out)


def property_regression(features: dict[str, DataFrame], targets: DataFrame, key: str, names: list[str], models: list[str] = ("ridge",), seeds: list[int] = (0,)) -> DataFrame:
    """(family, target, model, seed, r2, rmse, mae, n) on held-out rows.

    A family's features and targets are written once: a fit makes many passes over its rows, and none of them computes features or joins again.
    """
    out = []
    for family, rows in features.items():
        joined = rows.join(targets.select(key, *[F.col(target).cast("double").alias(f"__y{i}") for i, target in enumerate(names)]), key)
        written = cut(joined.select(key, "features", *[f"__y{i}" for i in range(len(names))]), "features")
        for i, target in enumerate(names):
            known = written.select(key, "features", F.col(f"__y{i}").alias("label")).filter("label is not null")
            for seed in seeds:
                split = known.withColumn("is_train", hash_share(key, seed=seed) < 0.8)
                for name in models:
                    model = REGRESSORS[name]().setLabelCol("label").setFeaturesCol("features").fit(split.filter("is_train"))
                    scored = M.regression_metrics(model.transform(split.filter("not is_train")), "label", "prediction")
                    out.append(scored.select(F.lit(family).alias("family"), F.lit(target).alias("target"), F.lit(name).alias("model"), F.lit(seed).alias("seed"), "r2", "rmse", "mae", "n"))
    return reduce(DataFrame.unionByName, out)


def delta_regression(pairs: DataFrame, features: DataFrame, key: str, delta: str, model: str = "ridge", folds: int = 5) -> DataFrame:
    """(fold, r2, rmse, mae, n) of a difference between child and parent, from both their vectors and their difference."""
    from orefield.functions.vectors import concat_pair

    v = features.select(key, vector_to_array("features").alias("v"))
    rows = pairs.join(v.toDF("parent", "vp"), "parent").join(v.toDF("child", "vc"), "child").filter(F.col(delta).isNotNull())
    rows = rows.select("parent", "child", F.col(delta).cast("double").alias("label"), array_to_vector(concat_pair(F.col("vp"), F.col("vc"))).alias("features"), F.floor(hash_share("parent") * folds).cast("int").alias("fold"))
    out = []
    for fold in range(folds):
        train, test = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        fitted = REGRESSORS[model]().setLabelCol("label").setFeaturesCol("features").fit(train)
        out.append(M.regression_metrics(fitted.transform(test), "label", "prediction").withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, out)


def label_imputation(features: DataFrame, labels: DataFrame, key: str, label: str, least: int = 10) -> DataFrame:
    """(name, y, prediction, majority) of held-out rows for a class that structure gives, by a forest over classes with enough rows; ``majority`` is the training rows' most frequent class."""
    from pyspark.ml.feature import StringIndexer

    from orefield.operators.features import drop_rare_classes

    rows = drop_rare_classes(features.join(labels.select(key, label).filter(F.col(label).isNotNull()), key), label, least)
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    rows = balanced_weights(index.transform(rows), "label").withColumn("is_train", hash_share(label, key) < 0.8)
    model = CLASSIFIERS["forest"]().setLabelCol("label").setFeaturesCol("features").fit(rows.filter("is_train"))
    often = rows.filter("is_train").groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
    return model.transform(rows.filter("not is_train")).select(F.col(label).alias("name"), F.col("label").alias("y"), "prediction", F.lit(often).alias("majority"))


def grid_search(train: DataFrame, fold: str, depths: list[int] = (4, 8), trees: list[int] = (20, 50)) -> Estimator:
    """The forest of best R2 over folds that a column names, so that a family never stands on both sides."""
    forest = RandomForestRegressor(labelCol="label", featuresCol="features", seed=1)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees)).build()
    n = train.agg(F.max(fold)).first()[0] + 1
    return CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="r2"), numFolds=n, foldCol=fold).fit(train)


def alignment(vectors: DataFrame, directions: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(concept, key, cosine, side): the ``k`` vectors that point most along each direction, and the ``k`` that point most against it."""
    from orefield.functions.vectors import cosine
    from orefield.operators.rank import top_per_group

    scored = vectors.select(key, vector).crossJoin(F.broadcast(directions.select("concept", "direction"))).select("concept", key, cosine(F.col(vector), F.col("direction")).alias("cosine"))  # a row per concept
    best = top_per_group(scored, "concept", [F.desc("cosine"), F.col(key)], k).withColumn("side", F.lit("top"))
    return best.unionByName(top_per_group(scored, "concept", [F.asc("cosine"), F.col(key)], k).withColumn("side", F.lit("bottom"))).select("concept", key, "cosine", "side")


def projected_directions(vectors: DataFrame, key: str, vector: str, coordinates: DataFrame, directions: DataFrame) -> DataFrame:
    """(concept, x, y): directions carried to given two-dimensional coordinates (key, x, y) by least squares."""
    from orefield.functions.vectors import dot

    rows = vectors.select(key, array_to_vector(vector).alias("features")).join(coordinates, key)
    fits = {c: LinearRegression(fitIntercept=False, regParam=1e-6, labelCol=c, featuresCol="features").fit(rows).coefficients for c in ("x", "y")}
    return directions.select("concept", *[dot(F.col("direction"), F.array(*[F.lit(float(v)) for v in w])).alias(c) for c, w in fits.items()])
