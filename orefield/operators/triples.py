"""Rows of entity and relation tables as triples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.schema import ONTO, TRIPLE_COLUMNS, TYPE, XSD



def _null() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Attribute:
    """A predicate and where its objects come from; ``many`` for an array column, each of whose entries is one."""

    predicate: str
    value: Column
    datatype: str = "string"
    many: bool = False


def entity_triples(rows: DataFrame, subject: Column, types: list[Column | str], attributes: list[Attribute] = ()) -> DataFrame:
    """Type triples and attribute triples of every row, in one pass over it; null objects give none."""
    def cell(p: Column, o: Column, kind: str, datatype: Column) -> Column:
        return F.struct(subject.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("datatype"), _null().alias("lang"))

    cells = [F.array(*[cell(F.lit(TYPE), F.lit(ONTO + t) if isinstance(t, str) else F.concat(F.lit(ONTO), t), "uri", _null()) for t in types])]
    for a in attributes:
        predicate, datatype = F.lit(ONTO + a.predicate), F.lit(XSD + a.datatype)
        make = lambda v: cell(predicate, v.cast("string"), "literal", datatype)  # noqa: B023, E731
        cells.append(F.transform(a.value, make) if a.many else F.array(make(a.value)))
    cells = [F.coalesce(c, F.array().cast("array<struct<s:string,p:string,o:string,o_kind:string,datatype:string,lang:string>>")) for c in cells]
    return rows.select(F.explode(F.concat(*cells)).alias("t")).select("t.*").filter("s is not null and o is not null")


def link_triples(rows: DataFrame, subject: Column, predicate: Column | str, target: Column, inverse: Column | str | None = None) -> DataFrame:
    """A link of every row, and its inverse if there is one; a null end gives none."""
    term = lambda p: F.lit(ONTO + p) if isinstance(p, str) else F.concat(F.lit(ONTO), p)
    tail = (F.lit("uri").alias("o_kind"), _null().alias("datatype"), _null().alias("lang"))
    out = rows.select(subject.alias("s"), term(predicate).alias("p"), target.alias("o"), *tail)
    if inverse is not None:
        out = out.unionByName(rows.select(target.alias("s"), term(inverse).alias("p"), subject.alias("o"), *tail))
    return out.filter("s is not null and p is not null and o is not null")


def assemble(parts: list[DataFrame]) -> DataFrame:
    """One graph: the set of all triples."""
    return reduce(DataFrame.unionByName, parts).select(*TRIPLE_COLUMNS).distinct()


def assembly_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """How many triples each kind of row gives."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind")) for kind, df in parts.items()]).groupBy("kind").agg(F.count("*").alias("n_triples"))


def materialize_inverses(triples: DataFrame, inverses: DataFrame) -> DataFrame:
    """The inverse of each link whose predicate has one; ``inverses`` (p, inverse) is a table of rules."""
    links = triples.filter("o_kind = 'uri'").join(F.broadcast(inverses), "p")
    return links.select(F.col("o").alias("s"), F.col("inverse").alias("p"), F.col("s").alias("o"), "o_kind", "datatype", "lang").distinct()
