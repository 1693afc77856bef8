"""Tables between steps, written to the folder that a cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files behind a part of a table that is dealt anew.
PART_BYTES = 4 << 20


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, one of our own, but on this machine alone: on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


def staged(df: DataFrame) -> DataFrame:
    """df as a checkpoint: later steps neither compute it again nor carry its plan, and lost executors take nothing with them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, with a folder for each value of the columns `by`: smaller than a checkpoint, and released() can remove it."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def released(*tables: DataFrame) -> None:
    """Removes the files of tables from written() that nothing reads any more."""
    for table in tables:
        for at in {re.match("(.*/table-[0-9a-f]{32})/", file)[1] for file in table.inputFiles()}:
            path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The size of the files that df is read from; 0 where it isn't read from files."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, df.inputFiles()))


def dealt(df: DataFrame, *by: str, part_bytes: int | None = None) -> DataFrame:
    """df by hash of its columns `by`, in parts that don't grow with its input files: larger tables make more of them. Later steps by these columns, or by more, shuffle it no further."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // (part_bytes or PART_BYTES)))
    return df.repartition(parts, *by)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, wherever Spark's paths lead."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
