"""Portable archives: one folder of JSON lines per table with a header line, a manifest, and merge or restore on import."""

from __future__ import annotations

import json
import tarfile
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.codec import source_hash
from ..graph import KEYS, SCHEMAS, EventGraph
from ..operators.trees import import_waves
from ..shared import shared_root

VERSION = "1.0"
# Where each table stands in an archive.
PLACES = {"entities": "db", "events": "db", "groups": "db", "content_store": "db", "participated_in": "db/edges", "event_member_of": "db/edges", "event_sequential_next": "db/edges", "entity_connection": "db/derived", "event_jaccard_connected": "db/derived", "train_run": "db/derived", "community_assignment": "db/derived", "build_file_manifest": "db", "build_segment_manifest": "db", "context_groups": "db/plan", "event_template_groups": "db/plan", "plan_nodes": "db/plan", "plan_direction_nodes": "db/plan", "context_edges": "db/plan", "entity_alias": "db/edges"}


def write_table(df: DataFrame, root: str, name: str) -> int:
    """JSON lines in parallel files, a ``$header`` line with the columns in one more. Returns the rows, counted as they are written."""
    at, seen = f"{root}/{PLACES[name]}/{name}.jsonl", Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("ignoreNullFields", False).json(at)
    header = json.dumps({"$header": {"table": name, "columns": df.columns}})
    df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(at)
    return seen.get["n"]


def read_table(spark: SparkSession, root: str, name: str, defaults: dict | None = None) -> DataFrame:
    """A table of an archive under its declared schema. Columns the archive lacks get their default, extra ones are left out,
    nested objects stay JSON text, and the header line is passed over."""
    want = StructType.fromDDL(SCHEMAS[name])
    lines = spark.read.text(f"{root}/{PLACES[name]}/{name}.jsonl").where(~F.startswith("value", F.lit('{"$header"')) & (F.trim("value") != ""))
    row = F.from_json("value", StructType([f for f in want if f.name != "deprecated"]), {"mode": "PERMISSIVE"})
    out = lines.select("value", row.alias("r"))
    cols = []
    for f in want:
        c = F.get_json_object("value", "$.deprecated") if f.name == "deprecated" else F.col(f"r.{f.name}")
        if f.name == "deprecated":
            c = F.lower(c).isin("1", "t", "true", "yes")
        cols.append((F.coalesce(c, F.lit(defaults[f.name])) if defaults and f.name in defaults else c).alias(f.name))
    return out.select(*cols)


#: Edge tables, and the kind of node in each of their ends.
ENDS = {
    "participated_in": {"entity_id": "entity", "event_id": "event"}, "event_member_of": {"event_id": "event", "group_id": "group"}, "event_sequential_next": {"prev_id": "event", "next_id": "event"},
    "entity_connection": {"a_id": "entity", "b_id": "entity"}, "event_jaccard_connected": {"a_id": "event", "b_id": "event"}, "entity_alias": {"entity_id_a": "entity", "entity_id_b": "entity"},
}


def of_domain(g: EventGraph, domain: str) -> EventGraph:
    """Everything of a domain: its nodes and manifests, edges with both ends among the nodes, assignments and context edges
    of them, and the runs of the domain together with all runs that its assignments name."""
    have = lambda *names: [n for n in names if n in g.tables]
    out = {n: g.tables[n].where(F.col("domain") == domain) for n in have("entities", "events", "groups", "content_store", "build_file_manifest", "build_segment_manifest", "context_groups", "event_template_groups", "plan_nodes", "plan_direction_nodes")}
    node = lambda table: (out[table] if table in out else getattr(g, table).where("false")).select("id")
    ids = {kind: node(table) for kind, table in (("entity", "entities"), ("event", "events"), ("group", "groups"), ("context", "context_groups"), ("plan", "plan_nodes"), ("direction", "plan_direction_nodes"))}
    for n in have(*ENDS):
        df = g.tables[n]
        for column, kind in ENDS[n].items():
            df = df.join(ids[kind].withColumnRenamed("id", column), column, "left_semi")
        out[n] = df.select(*g.tables[n].columns)
    for n in have("community_assignment"):
        of = [g.tables[n].where(F.col("node_kind") == kind).join(ids[kind].withColumnRenamed("id", "node_id"), "node_id", "left_semi").select(*g.tables[n].columns) for kind in ("entity", "event")]
        out[n] = of[0].union(of[1])
    for n in have("context_edges"):
        kind = F.trim("source_kind")
        of = [g.tables[n].where(kind == code).join(ids[k].withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(*g.tables[n].columns) for code, k in (("EVT", "event"), ("CG", "context"), ("PLN", "plan"), ("DIR", "direction"))]
        out[n] = of[0].union(of[1]).union(of[2]).union(of[3])
    for n in have("train_run"):
        named = out["community_assignment"].select(F.col("run_id").alias("id")).distinct().withColumn("_named", F.lit(True)) if "community_assignment" in out else g.train_run.where("false").select("id", F.lit(True).alias("_named"))
        out[n] = g.tables[n].join(named, "id", "left").where((F.col("domain") == domain) | F.coalesce("_named", F.lit(False))).select(*g.tables[n].columns)
    return EventGraph(g.spark, out)


def export(g: EventGraph, domain: str, root: str) -> dict:
    """Write a domain's archive; the manifest with row counts and source hash comes last."""
    part = of_domain(g, domain)
    counts = {name: write_table(df, root, name) for name, df in part.tables.items()}
    manifest = {"version": VERSION, "domain": domain, "row_counts": counts, "source_hash": source_hash(part.events.select("id"), part.entities.select("id")).first()[0]}
    g.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest.json")
    return manifest


def read_manifest(spark: SparkSession, root: str) -> dict:
    manifest = json.loads(spark.read.text(f"{root}/manifest.json").first()[0])
    if manifest["version"].split(".")[0] != VERSION.split(".")[0]:
        raise ValueError(f"archive version {manifest['version']} can't be read")
    return manifest


def merge(stored: DataFrame, new: DataFrame, keys: list[str], strategy: str = "skip") -> DataFrame:
    """``skip`` keeps stored rows, ``overwrite`` prefers new ones, ``fail`` raises on a common key."""
    if strategy == "overwrite":
        return new.dropDuplicates(keys).unionByName(stored.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
    if strategy == "fail" and not stored.join(new.select(*keys).distinct(), keys, "left_semi").isEmpty():
        raise ValueError("the archive has keys that are stored already")
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def dry_run(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``would_insert, would_skip``: key probes only."""
    there = stored.select(*keys).distinct().withColumn("_there", F.lit(True))
    return new.select(*keys).distinct().join(there, keys, "left").agg(F.count_if(F.col("_there").isNull()).alias("would_insert"), F.count_if("_there").alias("would_skip"))


def import_archive(g: EventGraph, root: str, strategy: str = "skip", mode: str = "merge", confirm_replace: bool = False) -> EventGraph:
    """Merge an archive into ``g``, or restore it: then ``g`` must be empty or ``confirm_replace`` given."""
    manifest = read_manifest(g.spark, root)
    names = list(manifest["row_counts"])
    if mode == "restore":
        if not confirm_replace and any(not getattr(g, n).isEmpty() for n in ("entities", "events", "groups") if n in g.tables):
            raise ValueError("the target is not empty")
        return EventGraph(g.spark, {n: read_table(g.spark, root, n, {"visibility": "public"}) for n in names})
    return g.with_tables(**{n: merge(getattr(g, n), read_table(g.spark, root, n, {"visibility": "public"}), KEYS[n], strategy) for n in names})


def in_parent_order(g: EventGraph, root: str, name: str) -> DataFrame:
    """An archive's rows of a tree table (``groups``, ``context_groups``) with ``wave`` and ``problem``.

    Spark writes a table at once. A store that checks parents row by row takes the waves one after the other: a wave's parents
    are stored or in an earlier one. Rows on cycles, with parents that are nowhere, or below such, have a problem instead.
    """
    return import_waves(getattr(g, name).select("id"), read_table(g.spark, root, name, {"visibility": "public"}))


def pack_tar(folder: str, to: str) -> None:
    """A local archive folder as one reproducible tar.gz; a step of the driver, for exchange of small domains."""
    def plain(info: tarfile.TarInfo) -> tarfile.TarInfo:
        info.mtime = 0
        return info

    with tarfile.open(to, "w:gz") as tar:
        for p in sorted(Path(folder).rglob("*")):
            if p.is_file() and not p.name.startswith((".", "_")):
                tar.add(p, p.relative_to(folder), filter=plain)


def unpack_tar(path: str, folder: str | None = None) -> str:
    folder = folder or tempfile.mkdtemp(prefix="archive-")
    with tarfile.open(path) as tar:
        tar.extractall(folder, filter="data")
    return folder
