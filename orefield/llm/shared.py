"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of texts that travel to and from Python together.
BATCH_ROWS = 1000
#: Folders that scopes of scratch tables have written, by scope; the scope that is open now.
_scratch: dict[str, list[str]] = {}
_open: list[str] = []
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-orefield-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Let at most BATCH_ROWS rows at a time go to Python, unless the session names a smaller number.

    Texts and their ids take kilobytes a row: Spark's ten thousand rows fill tens of megabytes for each task, several times over on either side.
    """
    if not 0 < int(spark.conf.get(_ARROW)) <= BATCH_ROWS:
        spark.conf.set(_ARROW, str(BATCH_ROWS))


def cut(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    What is read back no longer depends on the rows' order, on partition numbers or on
    executors that computed them, so generated ids stay fixed. With ``release``, Spark is told that it may drop
    the shuffle files behind ``df`` now; it finds out by garbage collection, which may otherwise come late.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _scratch.setdefault(_open[-1], []).append(path)
    df.write.parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, scope: str) -> None:
    """Delete the tables that ``cut`` wrote in earlier scopes of this name."""
    for path in _scratch.pop(scope, []):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, scope: str) -> Iterator[None]:
    """Within it, ``cut`` notes what it writes, and the next scope of the same name deletes that.

    For steps whose result is written before the next one begins, so that a row of steps takes no more disk than one.
    """
    drop_scratch(spark, scope)
    _open.append(scope)
    try:
        yield
    finally:
        _open.pop()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` is called so (in capitals or not)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, written, with a number of its own for each row in a new column, and that column's name; shuffle files of what came before may go."""
    row = free_name(df, "__row")
    return cut(df.withColumn(row, F.monotonically_increasing_id()), "numbered", release=True), row


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, n_rows: int, parts: int = 1024) -> DataFrame:
    """``rows``, each with the columns of its group, or nulls where it has none; ``groups`` has a row per group, written before, with ``size_col`` rows each.

    Groups that hold more than one of ``parts`` of all rows, of which there are fewer than ``parts``, are sent to every task; only
    rows of smaller groups are shuffled by their keys. So no task meets more of one key than its share.
    """
    large = F.col(size_col) * parts > n_rows
    held = F.broadcast(groups.filter(large).withColumn("__held", F.lit(True)))
    marked = rows.join(held, keys, "left")
    small = marked.filter("__held is null").select(rows.columns).join(groups.filter(~large), keys, "left")
    return marked.filter("__held").drop("__held").unionByName(small)
