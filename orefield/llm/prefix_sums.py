"""Global prefix sums over sorted rows from the totals of partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from orefield.llm.shared import cut


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sizes and counts of rows before each row within its partition."""
    bytes_before = rows_before = 0
    for batch in batches:
        size = batch.column("size").to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        place = np.arange(rows_before, rows_before + len(size))
        more = [pa.array(bytes_before + total - size, pa.int64()), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "start", "place"])
        bytes_before += int(total[-1]) if len(total) else 0
        rows_before += len(size)


def global_prefix(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with the sum of ``size`` (long) and the number of rows before each in the given order; and the whole sum.

    Rows are range-partitioned, so a key that many rows share is cut where ``order`` goes on to tell them
    apart; each task sums its own rows, and the driver sees one total per partition.
    """
    spark = rows.sparkSession
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = StructType([*rows.schema.fields]).add("start", LongType()).add("place", LongType())
    rows = cut(rows.mapInArrow(_running, schema), "running-sums")
    parts = sorted(map(tuple, rows.groupBy("part").agg(F.sum("size"), F.count("*")).collect()))
    before = np.cumsum([[0, 0], *([s, n] for _, s, n in parts)], axis=0)
    schema = StructType().add("part", IntegerType()).add("size_before", LongType()).add("rows_before", LongType())
    offsets = spark.createDataFrame([(p, int(b[0]), int(b[1])) for (p, _, _), b in zip(parts, before)], schema)
    rows = rows.join(F.broadcast(offsets), "part")
    rows = rows.withColumns({"start": F.col("start") + F.col("size_before"), "place": F.col("place") + F.col("rows_before")})
    return rows.drop("part", "size_before", "rows_before"), int(before[-1][0])
