"""Ranking of candidates by several weighted criteria, and concept labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_concepts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, concept, y): 1 at or above the upper quartile, 0 at or below the lower one, null between and for nulls."""
    limits = rows.agg(*[x for c in columns for x in (F.expr(f"percentile({c}, 0.25)").alias(f"__l_{c}"), F.expr(f"percentile({c}, 0.75)").alias(f"__h_{c}"))])
    wide = rows.crossJoin(F.broadcast(limits))  # one row
    cells = F.array(*[F.struct(F.lit(f"high_{c}").alias("concept"), F.when(F.col(c) >= F.col(f"__h_{c}"), 1).when(F.col(c) <= F.col(f"__l_{c}"), 0).alias("y")) for c in columns])
    return wide.select(key, F.explode(cells).alias("x")).select(key, "x.*")


def categorical_concepts(rows: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(key, concept, y): each of the ``k`` most frequent levels against the rest; null where the column is empty."""
    top = rows.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(k).agg(F.array_sort(F.collect_list(column)).alias("__levels"))
    wide = rows.select(key, column).crossJoin(F.broadcast(top))  # one row
    return wide.select(key, F.explode("__levels").alias("level"), column).select(key, F.concat(F.lit(f"{column}="), "level").alias("concept"), (F.col(column) == F.col("level")).cast("int").alias("y"))


def token_concepts(rows: DataFrame, key: str, tokens: str, k: int) -> DataFrame:
    """(key, concept, y): whether a row's array of tokens holds each of the ``k`` most frequent ones."""
    top = rows.select(F.explode(F.array_distinct(tokens)).alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(k).agg(F.array_sort(F.collect_list("t")).alias("__top"))
    wide = rows.select(key, tokens).crossJoin(F.broadcast(top))  # one row
    return wide.select(key, F.explode("__top").alias("t"), tokens).select(key, F.concat(F.lit("has_"), "t").alias("concept"), F.array_contains(F.col(tokens), F.col("t")).cast("int").alias("y"))


def usable_concepts(labels: DataFrame, least_pos: int = 80, least_neg: int = 80, least: int = 200) -> DataFrame:
    """(concept, n_pos, n_neg) of concepts with enough labels of both kinds."""
    n = labels.groupBy("concept").agg(F.count(F.when(F.col("y") == 1, 1)).alias("n_pos"), F.count(F.when(F.col("y") == 0, 1)).alias("n_neg"))
    return n.filter((F.col("n_pos") >= least_pos) & (F.col("n_neg") >= least_neg) & (F.col("n_pos") + F.col("n_neg") >= least))


def reliability(metrics: DataFrame, by: str, r2: str, floor: float = 0.05) -> DataFrame:
    """(by, reliability): the best R2 if at least 0.3, else a fifth of it but no less than ``floor``."""
    best = metrics.groupBy(by).agg(F.max(r2).alias("best"))
    return best.select(by, F.when(F.col("best") >= 0.3, F.col("best")).otherwise(F.greatest(F.lit(floor), 0.2 * F.col("best"))).alias("reliability"))


def frequency(rows: DataFrame, column: str) -> DataFrame:
    """(column, share): each level's share among rows that have one."""
    n = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select(column, (F.col("n") / F.col("all")).alias("share"))  # one row


def robust_scale(rows: DataFrame, columns: dict[str, bool], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Columns clipped to two quantiles and brought to 0..1, reversed where the value is True; null where the quantiles meet."""
    limits = rows.agg(*[x for c in columns for x in (F.expr(f"percentile({c}, {low})").alias(f"__l_{c}"), F.expr(f"percentile({c}, {high})").alias(f"__h_{c}"))])
    wide, out = rows.crossJoin(F.broadcast(limits)), {}  # one row
    for c, reverse in columns.items():
        a, b = F.col(f"__l_{c}"), F.col(f"__h_{c}")
        x = (F.least(F.greatest(F.col(c), a), b) - a) / (b - a)
        out[c] = F.when(F.col(c).isNotNull() & (b > a), 1 - x if reverse else x)
    return wide.withColumns(out).drop(*[f"__{k}_{c}" for c in columns for k in "lh"])


def weighted_average(weights: dict[str, float]) -> tuple[Column, Column]:
    """(average of the columns that are not null, share of the weights that they carry)."""
    total = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()])
    value = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()])
    return F.when(total > 0, value / total), total / sum(weights.values())


def multi_criteria(rows: DataFrame, criteria: dict[str, dict[str, tuple[float, bool]]], weights: dict[str, float], quantile: float = 0.6) -> DataFrame:
    """``rows`` with a score for each criterion, their total, the confidence, and whether each score reaches its quantile.

    ``criteria``: name -> {column: (weight, whether small is good)}.
    """
    scaled = robust_scale(rows, {c: reverse for cells in criteria.values() for c, (_, reverse) in cells.items()})
    scores = {name: weighted_average({c: w for c, (w, _) in cells.items()}) for name, cells in criteria.items()}
    scaled = scaled.withColumns({f"{name}_score": s for name, (s, _) in scores.items()} | {f"{name}_weight": w for name, (_, w) in scores.items()})
    total, _ = weighted_average({f"{n}_score": w for n, w in weights.items()})
    confidence = reduce(lambda a, b: a + b, [F.col(f"{n}_weight") * w for n, w in weights.items()]) / sum(weights.values())
    scaled = scaled.withColumns({"total": total, "confidence": confidence}).drop(*[f"{n}_weight" for n in criteria])
    limits = scaled.agg(*[F.expr(f"percentile({n}_score, {quantile})").alias(f"__q_{n}") for n in criteria])
    flagged = scaled.crossJoin(F.broadcast(limits))  # one row
    return flagged.withColumns({f"{n}_pass": F.coalesce(F.col(f"{n}_score") >= F.col(f"__q_{n}"), F.lit(False)) for n in criteria}).drop(*[f"__q_{n}" for n in criteria])


def component_priors(pairs: DataFrame, component: str, score: str) -> DataFrame:
    """(component, mean_score, share): mean score of what holds it, and its share of all pairs."""
    n = pairs.groupBy(component).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select(component, "mean_score", (F.col("n") / F.col("all")).alias("share"))  # one row


def unseen_pairs(pairs: DataFrame, left: str, right: str, left_priors: DataFrame, right_priors: DataFrame, top: tuple[int, int], most: int) -> DataFrame:
    """The ``most`` best pairs of the ``top`` components of either side that never occur together."""
    a = left_priors.orderBy(F.desc("mean_score"), left).limit(top[0]).select(left, F.col("mean_score").alias("a_score"), F.col("share").alias("a_share"))
    b = right_priors.orderBy(F.desc("mean_score"), right).limit(top[1]).select(right, F.col("mean_score").alias("b_score"), F.col("share").alias("b_share"))
    both = a.crossJoin(F.broadcast(b)).join(pairs.select(left, right).distinct(), [left, right], "left_anti")  # at most top[0] x top[1] rows
    scored = both.select(left, right, ((F.col("a_score") + F.col("b_score")) / 2).alias("score"), F.sqrt(F.col("a_share") * F.col("b_share")).alias("plausibility"))
    return scored.orderBy(F.desc("score"), left, right).limit(most)


def top_per_group(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def relation_quality(metrics: DataFrame, model: str) -> DataFrame:
    """(relation, quality): a model's score of each relation; of all models where it has none, the last model's by name."""
    wanted = metrics.filter(F.lower("model") == model.lower())
    n = wanted.agg(F.count("*").alias("__n"))
    rows = metrics.crossJoin(F.broadcast(n)).filter((F.col("__n") == 0) | (F.lower("model") == model.lower()))  # one row
    return rows.groupBy("relation").agg(F.max_by("auc", "model").alias("quality"))


def delta_reliability(metrics: DataFrame, defaults: DataFrame, group: str = "ALL", floor: float = 0.05) -> DataFrame:
    """(target, reliability): the best R2 of each target over all of a group, no less than ``floor``; its default where there is none. ``defaults`` (target, default)."""
    best = metrics.filter(F.col("group") == group).groupBy("target").agg(F.max("r2").alias("best"))
    return defaults.join(best, "target", "left").select("target", F.when(F.col("best").isNull(), F.col("default")).otherwise(F.greatest("best", F.lit(floor))).alias("reliability"))


def choose_source(sources: dict[str, DataFrame], metrics: DataFrame, target: str, group: str = "ALL") -> DataFrame:
    """The rows of one source, with ``source``: of the one whose name holds the best method's, if it has rows; else of the first that has some."""
    rows = reduce(DataFrame.unionByName, [df.withColumns({"source": F.lit(name), "__order": F.lit(i + 1)}) for i, (name, df) in enumerate(sources.items())])
    best = metrics.filter((F.col("target") == target) & (F.col("group") == group)).agg(F.max_by("method", F.struct("r2", "method")).alias("__best"))
    rows = rows.crossJoin(F.broadcast(best)).withColumn("__order", F.when(F.lower("source").contains(F.lower("__best")), 0).otherwise(F.col("__order")))  # one row
    return rows.join(F.broadcast(rows.agg(F.min("__order").alias("__order"))), "__order").drop("__order", "__best")


def evidence_records(picks: DataFrame, key: str, analogs: DataFrame, support: DataFrame, most: int = 3) -> DataFrame:
    """``picks`` with the names of their best analogs, counts of what supports them, and their risks in words.

    ``analogs`` (key, analog, score), ``support`` (key and counts, none of them null); a pick needs ``confidence`` and ``plausible``.
    """
    best = top_per_group(analogs, key, [F.desc("score"), F.col("analog")], most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "analog"))).alias("found"))
    best = best.select(key, F.transform("found", lambda x: x["analog"]).alias("analogs"))
    counts = [c for c in support.columns if c != key]
    out = picks.join(best, key, "left").join(support, key, "left").withColumns({"analogs": F.coalesce("analogs", F.array().cast("array<string>")), **{c: F.coalesce(F.col(c), F.lit(0)) for c in counts}})
    risks = [F.when(F.col("confidence") < 0.9, "few measurements"), F.when(F.size("analogs") == 0, "no analog"), F.when(~F.col("plausible"), "fails a criterion"), *[F.when(F.col(c) == 0, f"no {c}") for c in counts]]
    return out.withColumn("risk", F.coalesce(F.nullif(F.concat_ws("; ", *risks), F.lit("")), F.lit("none")))
