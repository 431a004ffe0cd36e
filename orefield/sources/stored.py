"""Tables written once in a session, to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple, str] = {}


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


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Ask the JVM to collect garbage, so that Spark drops the shuffle files behind what has been written."""
    spark.sparkContext._jvm.System.gc()


def delete(df: DataFrame) -> None:
    """Delete the files that ``df`` reads, all in one folder of the shared one; it must not be used afterwards."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def state(spark: SparkSession, paths: list[str]) -> tuple:
    """Lengths and times of the files at ``paths``: it changes when one of them is written anew."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    out = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        out += [(path, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in at.getFileSystem(conf).listStatus(at)]
    return tuple(sorted(out))


def written_once(spark: SparkSession, names: list[str], inputs: list[str], write: Callable[[list[str], str], None]) -> list[str]:
    """A folder for each name, filled for these inputs in this session.

    ``write`` is called with the names that have none yet, or whose inputs have changed since, and a new folder, in which it fills one named for each.
    """
    now = state(spark, inputs)
    keys = {name: (spark.sparkContext.applicationId, name, now) for name in names}
    if missing := [name for name in names if keys[name] not in _written]:
        path = new_folder(spark, "stored")
        write(missing, path)
        _written.update({keys[name]: f"{path}/{name}" for name in missing})
    return [_written[keys[name]] for name in names]
