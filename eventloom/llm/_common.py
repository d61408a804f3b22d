"""What the operators of this subpackage share: tables in the shared folder, and bounded labelled samples."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without that setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="eventloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(df.written_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def tidy(run):
    """``run`` for ``mapInArrow``, giving freed memory back to the system at the end of a task: workers are kept for later tasks,
    and a C library keeps what they freed."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """``doc_id, y``: one label of each id, the smallest where rows contradict each other."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(name).cast("int")).alias("y")).where("y is not null")


def labelled_texts(documents: DataFrame, chosen: DataFrame) -> tuple[list, list]:
    """Texts and labels of the ``chosen`` ids in the order of ids, for the driver. An id on several rows gives one text, the
    smallest, so there are no more than ``chosen`` has."""
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "y").toArrow()
    return rows["text"].to_pylist(), rows["y"].to_numpy()


def stratified_sample(rows: DataFrame, key: str, label: str, per_class: int, seed: int = 7, total: int | None = None) -> DataFrame:
    """At most about ``per_class`` rows of each value of ``label``, chosen by a hash of ``key``, so every run takes the same.

    One pass counts the classes, another keeps the rows whose hash falls below their class's share (a tenth more than
    asked for). ``total`` bounds the rows of all classes together: with more classes each gives fewer, at least about one.
    Shares are joined, so any number of classes will do. Rows with a null key or label are left out.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    counts = materialize(rows.groupBy(label).count(), "classes")
    wanted = per_class if total is None else max(1, min(per_class, total // max(1, counts.count())))
    grid = 1 << 30
    share = F.least(F.lit(grid), (F.lit(grid * 1.1 * wanted) / F.col("count")).cast("long") + 1)
    shares = counts.select(F.col(label), share.alias("__share"))
    near = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(grid))
    # Beyond the largest share of any class no row is taken: most rows end here, before the join.
    most = shares.agg(F.max("__share")).first()[0]
    return rows.where(near < F.lit(most or 0)).join(shares, label).where(near < F.col("__share")).select(*rows.columns)
