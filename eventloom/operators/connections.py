"""Why search hits belong together: reason tags from eight channels, each a constant number of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import EventGraph
from .traversal import induced_subgraph, threads


def connection_tags(g: EventGraph, hits: DataFrame, communities: DataFrame | None = None, similar: float = 0.8) -> DataFrame:
    """``id, tags`` (joined by commas, in order) for hits (``id``, optionally ``embedding``)."""
    ids = hits.select("id").distinct()
    found = []

    def tag(df: DataFrame, text) -> None:
        found.append(df.select("id", (F.lit(text) if isinstance(text, str) else text).alias("tag")))

    tag(threads(g.event_sequential_next, ids), "contents-chain")
    jac = induced_subgraph(g.event_jaccard_connected, ids)
    tag(jac.select(F.explode(F.array("a_id", "b_id")).alias("id")), "closed-jaccard")
    part = g.participated_in.select(F.col("event_id").alias("id"), "entity_id").distinct().join(ids, "id", "left_semi")
    spanning = part.groupBy("entity_id").agg(F.count("*").alias("n")).where("n >= 2").select("entity_id")
    tag(part.join(spanning, "entity_id", "left_semi"), "spanning-entity")
    edges = induced_subgraph(g.entity_connection, part.select("entity_id").distinct())
    other = edges.join(part.toDF("ia", "a_id"), "a_id").join(part.toDF("ib", "b_id"), "b_id").where("ia <> ib")
    tag(other.select(F.explode(F.array("ia", "ib")).alias("id")), "co-occurrence")
    member = g.event_member_of.select(F.col("event_id").alias("id"), "group_id").distinct().join(ids, "id", "left_semi")
    common = member.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2").select("group_id")
    tag(member.join(common, "group_id", "left_semi"), "shared-category")
    context = g.context_edges.where("rel = 'belongs_to'").select(F.col("source_id").cast(ids.schema["id"].dataType).alias("id"), "target_id").join(ids, "id", "left_semi")
    held = context.groupBy("target_id").agg(F.count_distinct("id").alias("n")).where("n >= 2").select("target_id")
    tag(context.join(held, "target_id", "left_semi"), "shared-context")
    if communities is not None:
        c = communities.join(ids, "id", "left_semi")
        several = c.groupBy("community").agg(F.count("*").alias("n")).where("n >= 2").select("community")
        tag(c.join(several, "community", "left_semi"), F.concat(F.lit("shared-cluster-"), F.col("community").cast("string")))
    if "embedding" in hits.columns:
        from ..functions.vectors import cosine

        a, b = hits.select("id", "embedding").toDF("ia", "va"), hits.select("id", "embedding").toDF("ib", "vb")
        near = a.join(b, a["ia"] < b["ib"]).where(cosine(F.col("va"), F.col("vb")) >= similar)  # hits are one page of a search
        tag(near.select(F.explode(F.array("ia", "ib")).alias("id")), "similar-embedding")
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return ids.join(every.distinct(), "id", "left").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def spanning_entities(g: EventGraph, hits: DataFrame, most: int = 10) -> DataFrame:
    """Entities of at least two hits, most spanning first."""
    part = g.participated_in.join(hits.select(F.col("id").alias("event_id")).distinct(), "event_id", "left_semi")
    return part.groupBy("entity_id").agg(F.count_distinct("event_id").alias("n")).where("n >= 2").orderBy(F.desc("n"), "entity_id").limit(most)


def neighbours_of_hits(g: EventGraph, hits: DataFrame, most: int = 3) -> DataFrame:
    """The best Jaccard neighbours of each hit."""
    score = F.greatest("entity_jaccard", "group_jaccard")
    e = g.event_jaccard_connected
    both = e.select(F.col("a_id").alias("id"), F.col("b_id").alias("neighbour"), score.alias("score")).union(e.select("b_id", "a_id", score)).join(hits.select("id").distinct(), "id", "left_semi")
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour"))).where(F.col("_r") <= most).drop("_r")
