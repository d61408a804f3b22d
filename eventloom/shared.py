"""Tables in the folder that driver and executors share: they cut lineage and survive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="eventloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that one task sorts, groups or pairs.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``keys``, so that a task gets ``TASK_ROWS`` however many there are.

    Spark's own sizes are those of compressed blocks: 64 MB of pairs of ids are ten million rows, whose sorts and hash tables
    take gigabytes. A few tasks' worth is left to Spark, which deals it to the cores there are.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(*keys) if n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, *keys)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that later jobs do not compute it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def counted_write(df: DataFrame, name: str, **measures) -> tuple[DataFrame, dict]:
    """``written`` with aggregates of the rows, taken while they are written and not by a job of their own."""
    seen = Observation()
    out = written(df.observe(seen, *(c.alias(k) for k, c in measures.items())), name)
    return out, seen.get


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(df.written_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
