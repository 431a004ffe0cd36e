"""Tables cut to the shared folder, and joins of rows with their groups that no large group holds up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.sources.stored import new_folder
from orefield.sources.stored import release as release_files


def cut(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what follows starts from files, not from its plan.

    With ``release``, the JVM is asked to collect garbage, so that Spark drops the shuffle files behind what is written and the driver's heap doesn't grow from job to job.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    if release:
        release_files(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int, parts: int = 1024) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has a row per ``key``, all of them, written before, with ``size`` rows each of ``total``.

    Groups of more than one of ``parts`` of all rows, of which there are fewer than ``parts``, go to every task; the rest is shuffled.
    """
    large = F.col(size) * parts > total
    held = rows.join(F.broadcast(groups.filter(large).withColumn("__held", F.lit(True))), key, "left")
    small = held.filter("__held is null").select(rows.columns).join(groups.filter(~large), key)
    return held.filter("__held").drop("__held").unionByName(small)
