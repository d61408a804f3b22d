"""Objects: round trips, equal contents, tasks that die half way, moves, what lost tasks leave behind."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from eventloom.sources import objects as O

DOCUMENTS = [(1, b"alpha", "text/plain", "d"), (2, b"alpha", "text/plain", "d"), (3, b"", "application/json; charset=utf-8", "a/b c"), (4, None, "text/plain", "d"), (5, b"\x00\xff" * 70_000, None, None), (6, "ä中".encode(), "x/y", "")]
SCHEMA = "id long, content binary, content_type string, domain string"


def test_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/objects"
    rows = spark.createDataFrame(DOCUMENTS, SCHEMA)
    receipts = O.put(rows, root)
    back = {r["id"]: bytes(r["content"]) if r["content"] is not None else None for r in O.get(receipts, root).collect()}
    assert back == {i: c for i, c, *_ in DOCUMENTS}
    at = {r["id"]: r["storage_uri"] for r in receipts.collect()}
    assert at[1] == at[2] and at[4] is None and at[3].startswith(f"{root}/a_b_c/") and at[3].endswith(".json") and "/_/" in at[5] and at[5].endswith(".bin")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert len(before) == 4
    O.put(rows, root)  # the same again writes nothing
    assert {p: p.stat().st_mtime_ns for p in before} == before
    stat = {r["id"]: (r["exists"], r["object_size"]) for r in O.stat(receipts.union(spark.createDataFrame([(9, "text/plain", "d", f"{root}/d/00/none.txt", 3)], receipts.schema)), root).collect()}
    assert stat == {1: (True, 5), 2: (True, 5), 3: (True, 0), 4: (False, None), 5: (True, 140_000), 6: (True, 5), 9: (False, None)}
    assert O.stat(receipts, root).where(F.col("exists") & ~O.age(F.col("modified")).between(-5, 600)).count() == 0
    assert O.put(rows.limit(0), root).count() == 0


def test_moves_and_addresses_of_another_root(spark, tmp_path):
    root, to = f"file://{tmp_path}/objects", f"file://{tmp_path}/archive"
    receipts = O.put(spark.createDataFrame(DOCUMENTS, SCHEMA), root)
    moved = O.move(receipts, root, to)
    got = {r["id"]: (r["storage_uri"], r["content"]) for r in O.get(moved, to).collect()}
    assert all(c is None if u is None else u.startswith(to) and bytes(c) == dict((i, d) for i, d, *_ in DOCUMENTS)[k] for k, (u, c) in got.items()) and len(got) == 6
    assert O.stat(receipts, root).where("exists").count() == 0
    assert O.get(receipts, to).where("content is not null").count() == 5  # old addresses are found by their keys
    assert {r["storage_uri"] for r in O.move(receipts, root, to).collect()} == {u for u, _ in got.values()}  # once more: all there


def test_sweep(spark, tmp_path):
    root = f"file://{tmp_path}/objects"
    assert not os.path.exists(tmp_path / "objects") and O.put(spark.createDataFrame(DOCUMENTS, SCHEMA), root).count() == 6
    left = tmp_path / "objects" / "d" / "00"
    left.mkdir(exist_ok=True)
    for name in (".old.1", ".new.1"):
        (left / name).write_bytes(b"x")
    os.utime(left / ".old.1", (1, 1))
    assert O.sweep(spark, root, 3600) == 1 and not (left / ".old.1").exists() and (left / ".new.1").exists()


KILLED = """
import os, sys
from pyspark.sql import SparkSession, functions as F
from eventloom.sources import objects as O
at = sys.argv[1]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").config("spark.checkpoint.dir", f"file://{at}/shared").getOrCreate()
rows = spark.range(200).repartition(2).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"), F.lit("text/plain").alias("content_type"), F.lit("d").alias("domain"))
honest = O.place
def place(store, path, data):
    wrote = honest(store, path, data)
    try:
        open(at + "/written", "a").write("x")
        if os.path.getsize(at + "/written") == 60:
            open(at + "/died", "x").close()
            os._exit(1)
    except FileExistsError:
        pass
    return wrote
O.place = place
receipts = O.put(rows, f"file://{at}/objects")
back = O.get(receipts, f"file://{at}/objects")
print("GOOD", receipts.count(), back.where(F.col("content").cast("string") == F.concat(F.lit("text "), F.col("id").cast("string"))).count())
"""


def test_a_task_that_dies_half_way(tmp_path):
    """The worker is killed after it wrote part of its objects; the task runs again, and every object is there once."""
    script = tmp_path / "killed.py"
    # The replaced function has to travel to the workers with the closure, so the module is sent by value.
    script.write_text(KILLED.replace("honest = O.place", "from pyspark import cloudpickle\ncloudpickle.register_pickle_by_value(O)\nhonest = O.place"))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, str(script), str(tmp_path)], capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": root}, check=False)
    assert "GOOD 200 200" in run.stdout, run.stderr[-2000:]
    assert (tmp_path / "died").exists()
    assert sum(1 for p in (tmp_path / "objects").rglob("*.txt") if not p.name.startswith(".")) == 200
