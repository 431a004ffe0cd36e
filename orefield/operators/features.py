"""Splits, imputation, scaling and encodings whose results don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_share(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from the md5 of the keys and a seed."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_split(df: DataFrame, keys: list[str], shares: dict[str, float], seed: int = 0, name: str = "part") -> DataFrame:
    """A part for each row by a hash of its keys; ``shares`` sum to 1."""
    x, out, at = hash_share(*keys, seed=seed), None, 0.0
    for part, share in list(shares.items())[:-1]:
        at += share
        out = (F if out is None else out).when(x < at, part)
    return df.withColumn(name, out.otherwise(list(shares)[-1]))


def stratified_split(df: DataFrame, label: str, keys: list[str], share: float, seed: int = 0) -> DataFrame:
    """``is_train``: about ``share`` of every class, by a hash that is drawn anew for each class."""
    return df.withColumn("is_train", hash_share(label, *keys, seed=seed) < share)


def group_split(df: DataFrame, group: Column, share: float, seed: int = 0) -> DataFrame:
    """``is_train`` is the same for all rows of a group."""
    return df.withColumn("is_train", hash_share(group, seed=seed) < share)


def k_fold(df: DataFrame, keys: list[str], k: int, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.floor(hash_share(*keys, seed=seed) * k).cast("int"))


def repeated_splits(df: DataFrame, keys: list[str], share: float, seeds: list[int]) -> DataFrame:
    """Each row once for each seed, with the part that the seed gives it."""
    rows = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    text = F.concat_ws("|", F.col("seed").cast("string"), *[F.col(k).cast("string") for k in keys])
    return rows.withColumn("is_train", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32) < share)


def impute_median(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Nulls become the exact median of the training rows."""
    medians = df.filter(train).agg(*[F.expr(f"percentile({c}, 0.5)").alias(f"__{c}") for c in columns])
    out = df.crossJoin(F.broadcast(medians))  # one row
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def standardize(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less the training mean, over the training population deviation."""
    stats = df.filter(train).agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).drop(*[f"__{k}_{c}" for c in columns for k in "ms"])


def column_spread(df: DataFrame, columns: list[str], least: float = 0.1) -> DataFrame:
    """(column, variance, kept) of each numeric column."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "variance").withColumn("kept", F.coalesce(F.col("variance") > least, F.lit(False)))


def collapse_rare(df: DataFrame, column: str, k: int, name: str, other: str = "Other") -> DataFrame:
    """The ``k`` most frequent levels keep their name (ties: the smaller); all others become ``other``."""
    top = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(k).select(column, F.lit(True).alias("__top"))
    return df.join(F.broadcast(top), column, "left").withColumn(name, F.when(F.col("__top"), F.col(column)).otherwise(other)).drop("__top")


def one_hot(df: DataFrame, column: str, levels: list[str], prefix: str, drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each level; a null counts as UNK."""
    value = F.coalesce(column, F.lit("UNK"))
    return df.withColumns({f"{prefix}_{x}": (value == x).cast("int") for x in levels[int(drop_first) :]})


def coverage(df: DataFrame, columns: list[str], least: int = 0) -> DataFrame:
    """(column, n) for columns with at least ``least`` values."""
    return df.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "column", "n").filter(F.col("n") >= least)


def drop_rare_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    keep = df.groupBy(label).count().filter(F.col("count") >= least).select(label)
    return df.join(keep, label, "left_semi")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """(label, index): classes in alphabetical order; one row per class."""
    classes = df.select(label).distinct()
    return classes.withColumn("index", F.row_number().over(Window.orderBy(label)) - 1)


def stratified_sample(df: DataFrame, label: str, keys: list[str], total: int, floor: int = 20) -> DataFrame:
    """About ``total`` rows, shared by class size, of each class at least ``floor`` or all of it; chosen by hash."""
    sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
    n = sizes.agg(F.sum("__n").alias("__all"))
    want = F.greatest(F.lit(floor), F.ceil(F.col("__n") * total / F.col("__all")))
    rows = df.join(F.broadcast(sizes.crossJoin(n)), label).withColumn("__u", hash_share(*keys))
    # A margin before ranking keeps a large class out of one task.
    some = rows.filter(F.col("__u") * F.col("__n") <= 2 * want + 50)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__u", *keys))
    return some.withColumn("__r", rank).filter(F.col("__r") <= want).drop("__r", "__u", "__n", "__all")
