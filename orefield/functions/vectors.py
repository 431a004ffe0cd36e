"""Column functions for arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, least: float = 1e-8) -> Column:
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > least, dot(a, b) / n).otherwise(0.0)


def neg_cosine(a: Column, b: Column) -> Column:
    return -cosine(a, b)


def neg_l2(a: Column, b: Column) -> Column:
    return -l2_distance(a, b)


def l1_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def circular_correlation(a: Column, b: Column) -> Column:
    n = F.size(a)
    at = F.sequence(F.lit(0), n - 1)
    return F.transform(at, lambda k: total(F.transform(at, lambda i: F.get(a, i).cast("double") * F.get(b, F.pmod(i + k, n)).cast("double"))))


def transe_score(h: Column, r: Column, t: Column, norm_order: int = 1) -> Column:
    """Distance of the translated head from the tail."""
    return (l1_distance if norm_order == 1 else l2_distance)(add(h, r), t)


def distmult_score(h: Column, r: Column, t: Column) -> Column:
    return dot(multiply(h, r), t)


def concat_pair(h: Column, t: Column) -> Column:
    """h, t and their difference in one array."""
    return F.concat(h, t, subtract(h, t))


def mean_by(df, key: str, vector: str, dims: int, how: str = "mean"):
    """One vector for each key: the mean, sum or maximum of its rows' vectors, element by element, in one partial aggregation."""
    fold = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    return df.groupBy(key).agg(F.array(*[fold(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dims)]).alias(vector), F.count("*").alias("n"))
