"""Exact metrics of predictions and rankings, by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.sources.stored import new_folder


def running(counts: DataFrame, by: list[str], order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """``counts`` with ``sum_``column: the sum of each column up to and with a row, within its group, by ``order``.

    Without groups the rows are dealt into ranges of ``order``, written so that the ranges stay, and each range begins with the totals
    of those before it: no task sees all rows.
    """
    way = F.desc(order) if descending else F.asc(order)
    own = by
    if not by:
        path = new_folder(counts.sparkSession, "ranges")
        counts.repartitionByRange(way).withColumn("__range", F.spark_partition_id()).write.parquet(path)
        counts, own = counts.sparkSession.read.parquet(path), ["__range"]
    up_to = Window.partitionBy(*own).orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumns({f"sum_{c}": F.sum(c).over(up_to) for c in columns})
    if by:
        return out
    totals = counts.groupBy("__range").agg(*[F.sum(c).alias(c) for c in columns])  # a row per range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in columns])
    out = out.join(F.broadcast(totals), "__range").withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.col(f"__before_{c}") for c in columns})
    return out.drop("__range", *[f"__before_{c}" for c in columns])


def roc_auc(scores: DataFrame, by: list[str] = (), least: int = 0) -> DataFrame:
    """``by``, auc, n of rows with y (0/1) and score; tied scores count as half.

    Rows are first counted by score, so what is ranked grows with distinct scores. A group of one class has no auc.
    """
    by = list(by)
    counts = scores.filter("y is not null and score is not null").groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranked = running(counts, by, "score", ["neg"]).withColumn("below", F.col("sum_neg") - F.col("neg"))
    out = ranked.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("area"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    out = out.filter((F.col("n_pos") + F.col("n_neg") >= least) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    return out.select(*by, (F.col("area") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), (F.col("n_pos") + F.col("n_neg")).alias("n"))


def average_precision(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    by = list(by)
    counts = scores.filter("y is not null and score is not null").groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    seen = running(counts, by, "score", ["pos", "n"], descending=True)
    return seen.groupBy(*by).agg((F.sum(F.col("pos") * F.col("sum_pos") / F.col("sum_n")) / F.sum("pos")).alias("ap"))


def hits_at(scores: DataFrame, by: list[str], ks: tuple[int, ...]) -> DataFrame:
    """``by`` and hits_k: how many rows of y = 1 are among the k best scores of their group, ties by their first place.

    The k-th best score of a group is found first, among its best rows alone, so rows are not ranked as a whole.
    """
    rows = scores.filter("y is not null and score is not null")
    counts = rows.groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score")))).filter(F.col("place") <= max(ks))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    best = best.withColumn("before", before)
    found = best.groupBy(*by).agg(*[F.sum(F.when(F.col("before") < k, F.col("pos")).otherwise(0)).alias(f"hits_{k}") for k in ks])
    return found


def regression_metrics(rows: DataFrame, y: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """``by``, r2, rmse, mae, n."""
    e = F.col(y) - F.col(prediction)
    rows = rows.filter(F.col(y).isNotNull() & F.col(prediction).isNotNull())
    out = rows.groupBy(*by).agg(F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(y) * F.count("*")).alias("sst"), F.count("*").alias("n"))
    return out.select(*by, F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", "n")


def summary(metrics: DataFrame, by: list[str], columns: list[str], population: bool = False) -> DataFrame:
    """Mean and deviation of each metric over folds or seeds."""
    spread = F.stddev_pop if population else F.stddev_samp
    return metrics.groupBy(*by).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), spread(c).alias(f"{c}_std"))], F.count("*").alias("n"))


def accuracy(rows: DataFrame, y: str = "y", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """``by``, accuracy, and that of always saying the most frequent class."""
    by = list(by)
    classes = rows.groupBy(*by, y).agg(F.count("*").alias("n"), F.count_if(F.col(y) == F.col(prediction)).alias("hits"))
    return classes.groupBy(*by).agg((F.sum("hits") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("baseline"))


def class_table(rows: DataFrame, models: dict[str, str], name: str = "name", y: str = "y") -> DataFrame:
    """(name, n, and for each model found_ and said_): a class's rows, how many of them each model's column names rightly, and how often it names the class; models are scored on the same rows in one pass."""
    marks = [F.struct(F.col(y).alias("c"), F.col(name).alias("name"), F.lit(1).alias("n"), *[x for m, p in models.items() for x in ((F.col(p) == F.col(y)).cast("int").alias(f"found_{m}"), F.lit(0).alias(f"said_{m}"))])]
    for m, p in models.items():
        marks.append(F.struct(F.col(p).alias("c"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("n"), *[x for k in models for x in (F.lit(0).alias(f"found_{k}"), F.lit(int(k == m)).alias(f"said_{k}"))]))
    each = rows.select(F.inline(F.array(*marks))).groupBy("c").agg(F.max("name").alias("name"), *[F.sum(x).alias(x) for x in ("n", *(f"{k}_{m}" for m in models for k in ("found", "said")))])
    return each.filter("n > 0").drop("c")


def f1_scores(rows: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """One row: macro and class-weighted F1."""
    marks = rows.select(F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(y) == F.col(prediction)).cast("int").alias("tp")), F.struct(F.col(prediction).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("m")).select("m.*")
    each = marks.groupBy("c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp")).withColumn("f1", 2 * F.col("tp") / (F.col("t") + F.col("p")))
    return each.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("t")) / F.sum("t")).alias("weighted_f1"))


def confusion(rows: DataFrame, y: str, prediction: str, top: int = 10) -> DataFrame:
    """(y, prediction, n) over the ``top`` most frequent classes (ties: the smaller)."""
    keep = rows.groupBy(F.col(y).alias("k")).count().orderBy(F.desc("count"), "k").limit(top).select("k")
    out = rows.join(F.broadcast(keep), F.col(y) == F.col("k"), "left_semi").join(F.broadcast(keep), F.col(prediction) == F.col("k"), "left_semi")
    return out.groupBy(F.col(y).alias("y"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def best_per_group(metrics: DataFrame, by: list[str], metric: str, others: list[str]) -> DataFrame:
    """The row of the highest metric in each group; ties go to the smaller of the other columns."""
    best = F.min(F.struct((-F.col(metric)).alias("__m"), *others))
    return metrics.filter(F.col(metric).isNotNull()).groupBy(*by).agg(best.alias("x")).select(*by, (-F.col("x.__m")).alias(metric), *[F.col(f"x.{o}").alias(o) for o in others])


def coverage_matrix(rows: DataFrame, source: Column, families: dict[str, list[str]]) -> DataFrame:
    """(source, n, one count per family of columns): rows with any value in the family."""
    return rows.groupBy(source.alias("source")).agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()).alias(name) for name, cols in families.items()])


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins from ``low`` to ``high``; values beyond fall into the outer bins."""
    at = F.floor((F.col(column) - low) / ((high - low) / bins)).cast("int")
    return rows.filter(F.col(column).isNotNull()).groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).alias("bin")).agg(F.count("*").alias("n"))


def share_above(rows: DataFrame, column: str, threshold: float) -> DataFrame:
    return rows.agg(F.avg((F.col(column) > threshold).cast("int")).alias("share"))


def target_group(target: Column) -> Column:
    t = F.lower(target)
    gas = t.contains("co2") | t.contains("h2o")
    return F.when((t.contains("binding") | t.contains("henry") | t.contains("widom")) & gas, "adsorption").otherwise("other")
