"""Object storage: tasks write each row's bytes to an object of its own, named by its content.

An object stands at ``root/domain/xx/<sha-256><extension>``, xx being the first two digits. A name says what the object holds, so
a task that is run again, or twice at a time, writes the same objects and equal contents share one. Where files can be seen half
written, bytes go to a hidden name first and are moved. Objects are read and written by Arrow's file systems (local, HDFS, S3,
GCS) inside tasks; nothing passes through the driver.

Defined cases: a null content gives no object and a null address; an empty one gives an empty object. A domain that is null, empty
or has odd characters goes to a folder of a cleaned name. Reading an address that is not there gives null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import written

# Extensions by content type; any other gives .bin.
EXTENSIONS = {"text/plain": ".txt", "text/markdown": ".md", "text/html": ".html", "application/json": ".json", "application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg"}
#: How many objects a task asks about at once.
ASK = 500


def address(root: str, content: Column, content_type: Column, domain: Column) -> Column:
    """Where an object of that content stands."""
    name = F.sha2(content, 256)
    kind = F.trim(F.element_at(F.split(content_type, ";"), 1))
    extension = F.coalesce(*(F.when(kind == k, e) for k, e in EXTENSIONS.items()), F.lit(".bin"))
    folder = F.regexp_replace(F.coalesce(domain, F.lit("")), r"[^\p{L}\p{N}_-]", "_")
    folder = F.when(folder == "", "_").otherwise(folder)
    return F.concat(F.lit(root.rstrip("/") + "/"), folder, F.lit("/"), F.substring(name, 1, 2), F.lit("/"), name, extension)


def opened(uri: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(uri)[0]


def path_of(uri: str) -> str:
    """The path of an address inside its file system."""
    head, found, rest = uri.partition("://")
    if not found:
        return uri.removeprefix("file:")
    return rest if head in ("s3", "gs", "s3a") else "/" + rest.partition("/")[2]


def place(store: fs.FileSystem, path: str, data) -> bool:
    """Write an object unless it is there in full. Returns whether it was written."""
    there = store.get_file_info(path)
    if there.type == fs.FileType.File and there.size == len(data):
        return False
    folder, name = path.rsplit("/", 1)
    whole = store.type_name not in ("local", "hdfs")  # object stores show an object once it is complete
    at = path if whole else f"{folder}/.{name}.{uuid.uuid4().hex}"
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(at) as out:
        out.write(data)
    if not whole:
        try:
            store.move(at, path)
        except OSError:  # another attempt was first, in a store whose moves do not replace
            if store.get_file_info(path).size != len(data):
                raise
            store.delete_file(at)
    return True


def in_tasks(rows: DataFrame, run: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` without ``drop`` and with the columns that ``run`` makes of each batch."""
    keep = [f for f in rows.schema if f.name not in drop]
    schema = StructType([*keep, *StructType.fromDDL(added)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = run(b)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), *made.values()], names=[*(f.name for f in keep), *made])

    return rows.mapInArrow(whole, schema)


def put(rows: DataFrame, root: str, content: str = "content", content_type: str = "content_type", domain: str = "domain") -> DataFrame:
    """Writes the objects, now and once; returns ``rows`` with ``storage_uri, size`` in the place of the content.

    The receipts are a table of the shared folder, so reading them writes nothing again.
    """
    data = F.col(content).cast("binary")
    named = rows.withColumn(content, data).withColumn("storage_uri", F.when(data.isNotNull(), address(root, data, F.col(content_type), F.col(domain))))

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        sizes = []
        for uri, value in zip(b.column("storage_uri"), b.column(content), strict=True):
            if value.is_valid:
                place(store(), path_of(uri.as_py()), value.as_buffer())
            sizes.append(value.as_buffer().size if value.is_valid else None)
        return {"size": pa.array(sizes, pa.int64())}

    store = one_store(root)
    return written(in_tasks(named, run, "size long", (content,)), "receipts")


def one_store(root: str) -> Callable[[], fs.FileSystem]:
    """The file system of ``root``, opened by whoever asks first in a task."""
    held: list[fs.FileSystem] = []

    def get() -> fs.FileSystem:
        if not held:
            held.append(opened(root))
        return held[0]

    return get


def read_batch(store: fs.FileSystem, uris: list[str | None], root: str | None) -> Iterator[bytes | None]:
    for uri in uris:
        found = None
        for at in [uri, moved_to(uri, root)] if uri and root else [uri]:
            if at and store.get_file_info(path_of(at)).type == fs.FileType.File:
                with store.open_input_stream(path_of(at)) as f:
                    found = f.read()
                break
        yield found


def moved_to(uri: str, root: str) -> str:
    """The same object below another root: its last three steps are its key."""
    return "/".join([root.rstrip("/"), *uri.split("/")[-3:]])


def get(rows: DataFrame, root: str, uri: str = "storage_uri", column: str = "content") -> DataFrame:
    """``rows`` with the bytes of their objects. An address written elsewhere is looked up below ``root`` by its key.

    An object's bytes have to fit a task; the objects of a batch are given on a few at a time.
    """
    store, keep = one_store(root), list(rows.schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, held, size = 0, [], 0
            for k, data in enumerate(read_batch(store(), b.column(uri).to_pylist(), root)):
                held.append(data)
                size += len(data or b"")
                if size > 32_000_000 or k == len(b) - 1:
                    part = b.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(held, pa.binary())], names=[*(f.name for f in keep), column])
                    first, held, size = k + 1, [], 0

    return rows.mapInArrow(whole, StructType([*keep, *StructType.fromDDL(f"{column} binary")]))


def stat(rows: DataFrame, root: str, uri: str = "storage_uri") -> DataFrame:
    """``rows`` with ``exists, object_size, modified`` of their objects, a few hundred asked about at once."""
    store = one_store(root)

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        uris = b.column(uri).to_pylist()
        known = [u for u in uris if u]
        infos = {}
        for k in range(0, len(known), ASK):
            part = known[k : k + ASK]
            infos.update(zip(part, store().get_file_info([path_of(u) for u in part]), strict=True))
        found = [i if (i := infos.get(u)) is not None and i.type == fs.FileType.File else None for u in uris]
        return {"exists": pa.array([i is not None for i in found]), "object_size": pa.array([i and i.size for i in found], pa.int64()), "modified": pa.array([i and i.mtime for i in found], pa.timestamp("us", "UTC"))}

    return in_tasks(rows, run, "exists boolean, object_size long, modified timestamp")


def age(at: Column) -> Column:
    """Seconds since ``modified``."""
    return F.unix_micros(F.current_timestamp()) / 1e6 - F.unix_micros(at) / 1e6


def move(rows: DataFrame, root: str, to: str, uri: str = "storage_uri") -> DataFrame:
    """Moves the objects below ``to``, in the same file system, now and once; returns ``rows`` with the new addresses.

    An attempt that follows a lost one finds part of its objects moved and goes on with the rest. What is neither at the old
    address nor at the new one gets a null address.
    """
    store = one_store(root)
    distinct = rows.select(uri).where(F.col(uri).isNotNull()).distinct()

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for old in b.column(uri).to_pylist():
            new = moved_to(old, to)
            if store().get_file_info(path_of(old)).type == fs.FileType.File and old != new:
                store().create_dir(path_of(new).rsplit("/", 1)[0], recursive=True)
                store().move(path_of(old), path_of(new))
            out.append(new if store().get_file_info(path_of(new)).type == fs.FileType.File else None)
        return {"_new": pa.array(out, pa.string())}

    moved = written(in_tasks(distinct, run, "_new string"), "moved")
    return rows.join(moved, uri, "left").withColumn(uri, F.col("_new")).select(*rows.columns)


def sweep(spark: SparkSession, root: str, older_than: float) -> int:
    """Deletes what lost tasks left under hidden names more than ``older_than`` seconds ago; returns how many. A task a folder."""
    top = opened(root)
    domains = [i.base_name for i in top.get_file_info(fs.FileSelector(path_of(root))) if i.type == fs.FileType.Directory]
    if not domains:
        return 0
    parts = spark.createDataFrame([(d,) for d in domains], "domain string").join(spark.range(256).select(F.format_string("%02x", "id").alias("part")))
    store = one_store(root)

    def run(b: pa.RecordBatch) -> dict[str, pa.Array]:
        import time

        gone = []
        for d, p in zip(b.column("domain").to_pylist(), b.column("part").to_pylist(), strict=True):
            infos = store().get_file_info(fs.FileSelector(f"{path_of(root).rstrip('/')}/{d}/{p}", allow_not_found=True))
            old = [i.path for i in infos if i.base_name.startswith(".") and i.mtime is not None and time.time() - i.mtime.timestamp() > older_than]
            for path in old:
                store().delete_file(path)
            gone.append(len(old))
        return {"gone": pa.array(gone, pa.int64())}

    return in_tasks(parts.repartition(F.col("domain"), F.col("part")), run, "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]
