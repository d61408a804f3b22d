"""Ingest documents (manifest JSON), staging tables and the content and connector registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits and allowed sources of an ingest manifest.
SOURCES = ["claude", "chatgpt", "cursor", "manual", "import", "api", "other"]
MOST_ITEMS, MOST_CONTENT, MOST_SUMMARY, MOST_BYTES = 2000, 50_000, 500, 5_000_000
INGEST_SCHEMA = "schema STRING, complete BOOLEAN, source STRING, working_folder STRING, tag STRING, prev_event_id STRING, domain STRING, file_path STRING, items ARRAY<STRUCT<content: STRING, summary: STRING, entities: ARRAY<STRUCT<name: STRING, type: STRING>>, tag: STRING, timestamp: STRING>>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INGEST_SCHEMA).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def manifest_errors(schema_tag: str, sources: list[str] | None = None) -> Column:
    """All errors of a manifest row, in order; empty if it may be loaded. One bad item refuses the whole manifest."""
    items = F.coalesce("items", F.expr("cast(array() as array<struct<content: string, summary: string, entities: array<struct<name: string, type: string>>, tag: string, timestamp: string>>)"))
    say = lambda bad, text: F.when(bad, F.lit(text))
    total = F.aggregate(items, F.lit(0).cast("bigint"), lambda s, i: s + F.octet_length(F.coalesce(i["content"], F.lit(""))))
    return F.array_compact(F.array(
        say(~F.col("schema").eqNullSafe(schema_tag), "schema"), say(~F.coalesce("complete", F.lit(False)), "incomplete"),
        say(~F.coalesce(F.col("source").isin(sources or SOURCES), F.lit(False)), "source"), say(F.size(items) == 0, "no items"), say(F.size(items) > MOST_ITEMS, "too many items"),
        say(F.exists(items, lambda i: F.trim(F.coalesce(i["content"], F.lit(""))) == ""), "empty content"), say(F.exists(items, lambda i: F.length(i["content"]) > MOST_CONTENT), "content too long"),
        say(F.exists(items, lambda i: F.length(i["summary"]) > MOST_SUMMARY), "summary too long"), say(total > MOST_BYTES, "manifest too large"),
    ))


def manifest_items(manifests: DataFrame) -> DataFrame:
    """A row per item of sound manifests, with its place."""
    from ..functions.text import event_id, normalise_timestamp

    rows = manifests.select("domain", "working_folder", "tag", F.posexplode("items").alias("order_index", "i"))
    return rows.select(event_id(F.col("domain"), F.col("working_folder"), F.col("i.content")).alias("event_id"), "domain", F.coalesce("i.summary", F.substring("i.content", 1, MOST_SUMMARY)).alias("summary"), F.col("i.content").alias("content"), F.col("i.entities").alias("entities"), F.coalesce("i.tag", "tag").alias("tag"), F.try_to_timestamp(normalise_timestamp(F.col("i.timestamp"))).cast("timestamp_ntz").alias("at"), F.col("order_index").cast("bigint").alias("order_index"))


def stage(df: DataFrame, path: str) -> None:
    """Append produced events; a table per kind, partitioned by domain."""
    df.write.mode("append").partitionBy("domain").parquet(path)


def staged_to_load(staged: DataFrame, segments: DataFrame) -> DataFrame:
    """Staged rows whose segment is active and produced, matched by key or else by index."""
    ready = segments.where("status = 'active' and stage_state = 'produced'")
    by_key = staged.join(ready.select("file_path", "segment_key").distinct(), ["file_path", "segment_key"], "left_semi")
    by_index = staged.join(ready.select("file_path", "segment_index").distinct(), ["file_path", "segment_index"], "left_semi")
    return by_key.unionByName(by_index).dropDuplicates(["file_path", "segment_index", "segment_key"])


def save_content(store: DataFrame, new: DataFrame) -> DataFrame:
    return store.unionByName(new.dropDuplicates(["content_id"]).join(store.select("content_id"), "content_id", "left_anti"), allowMissingColumns=True)


def mark_orphans(store: DataFrame, vector_ids: DataFrame) -> DataFrame:
    """Set ``orphan`` in the metadata of the contents whose vector is gone."""
    gone = vector_ids.toDF("vector_id").distinct().withColumn("_gone", F.lit(True))
    meta = F.map_concat(F.coalesce(F.from_json("inline_meta", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("orphan"), F.lit("true")))
    return store.join(gone, "vector_id", "left").withColumn("inline_meta", F.when(F.col("_gone"), F.to_json(meta)).otherwise(F.col("inline_meta"))).drop("_gone")


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modified, content`` of stored objects, by Spark's binary reader: any file system."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_connector(spark: SparkSession, kind: str, options: dict[str, str], path: str | None = None) -> DataFrame:
    """A registered source as a DataFrame: files by format, databases by JDBC."""
    if kind == "database":
        missing = {"url", "dbtable"} - set(options)
        if missing:
            raise ValueError(f"missing: {sorted(missing)}")
        return spark.read.format("jdbc").options(**options).load()
    if kind == "filesystem":
        if not path:
            raise ValueError("missing: path")
        return spark.read.format(options.get("format", "text")).options(**{k: v for k, v in options.items() if k != "format"}).load(path)
    raise ValueError(f"no reader for {kind}: register a Python data source with spark.dataSource.register")
