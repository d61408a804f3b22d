"""Context groups and plans: writes of groups and their typed edges, member counts with stages, load promotion, vector backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import EventGraph
from .traversal import descend

# Kinds of nodes in context edges, and the greatest member count of each stage but the last.
EVENT, CONTEXT = "EVT", "CG "
STAGES, LAST_STAGE = {"seed": 4, "sprout": 9, "established": 19}, "core"
EDGE = ["source_id", "source_kind", "target_id", "target_kind", "rel"]


def stage_of(members: Column) -> Column:
    out = F.lit(LAST_STAGE)
    for stage, most in reversed(STAGES.items()):
        out = F.when(members <= most, stage).otherwise(out)
    return out


def put_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Create rows, or set the columns that ``rows`` (one row per ``id``) has where it is not null; all others stay."""
    given = [c for c in rows.columns if c != "id"]
    new = rows.select("id", *(F.col(c).alias(f"_{c}") for c in given))
    both = table.join(new, "id", "full_outer")
    value = lambda f: F.coalesce(F.col(f"_{f.name}").cast(f.dataType), F.col(f.name)) if f.name in given else F.col(f.name)
    return both.select(*(value(f).alias(f.name) for f in table.schema))


def put_groups(g: EventGraph, rows: DataFrame) -> EventGraph:
    return g.with_tables(context_groups=put_rows(g.context_groups, rows))


def link(g: EventGraph, edges: DataFrame) -> EventGraph:
    """Add typed edges; an edge that is there already takes the new ``order_index`` if one is given."""
    stored, new = g.context_edges, edges.dropDuplicates(EDGE)
    fresh = new.select(*EDGE, (F.col("order_index") if "order_index" in new.columns else F.lit(None)).cast("long").alias("_order"))
    both = stored.join(fresh, EDGE, "full_outer")
    return g.with_tables(context_edges=both.select(*EDGE, F.coalesce("_order", "order_index").alias("order_index")))


def delete_groups(g: EventGraph, ids: DataFrame) -> EventGraph:
    """Delete groups and every edge that begins or ends at one; children of a deleted group become roots."""
    gone = ids.toDF("_gone").distinct()
    groups = g.context_groups.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    orphan = groups.join(gone, F.col("parent_id") == F.col("_gone"), "left").withColumn("parent_id", F.when(F.col("_gone").isNull(), F.col("parent_id"))).drop("_gone")
    edges = g.context_edges
    for end in ("source", "target"):
        hit = (F.col(f"{end}_id") == F.col("_gone")) & (F.trim(f"{end}_kind") == CONTEXT.strip())
        edges = edges.join(gone, hit, "left_anti")
    return g.with_tables(context_groups=orphan, context_edges=edges)


def member_counts(g: EventGraph) -> DataFrame:
    """``id, own, total, stage``: events of a group, of it and all groups below, and the stage by that total.

    An event counts once a group, and in the total once a subtree.
    """
    belongs = g.context_edges.where((F.col("rel") == "belongs_to") & (F.trim("target_kind") == CONTEXT.strip()) & (F.trim("source_kind") == EVENT))
    member = belongs.select(F.col("target_id").alias("id"), F.col("source_id").alias("event_id")).distinct()
    own = member.groupBy("id").agg(F.count("*").alias("own"))
    below = descend(g.context_groups, g.context_groups.select("id"))
    total = member.join(below.select("id", "root"), "id").groupBy(F.col("root").alias("id")).agg(F.count_distinct("event_id").alias("total"))
    out = g.context_groups.select("id").join(own, "id", "left").join(total, "id", "left")
    return out.select("id", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("total", F.lit(0)).alias("total")).withColumn("stage", stage_of(F.col("total")))


def refresh_stages(g: EventGraph) -> EventGraph:
    return put_groups(g, member_counts(g).select("id", "stage"))


def children(g: EventGraph, group_id) -> DataFrame:
    return g.context_groups.where(F.col("parent_id") == group_id).orderBy(F.asc_nulls_first("order_index"), "id")


def contexts_of(g: EventGraph, event_ids: DataFrame) -> DataFrame:
    """``event_id`` and the columns of each group that it belongs to."""
    belongs = g.context_edges.where((F.col("rel") == "belongs_to") & (F.trim("target_kind") == CONTEXT.strip()))
    pairs = belongs.select(F.col("source_id").alias("event_id"), F.col("target_id").alias("id")).join(event_ids.toDF("event_id").distinct(), "event_id", "left_semi").distinct()
    return pairs.join(g.context_groups, "id")


def promote_loaded(segments: DataFrame, files: DataFrame, loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (``domain, file_path, segment_key`` in ``loaded``) become loaded, and with them the active files that have no
    active segment left to load."""
    key = ["domain", "file_path", "segment_key"]
    hit = loaded.select(*key).distinct().withColumn("_loaded", F.lit(True))
    segments = segments.join(hit, key, "left").withColumn("stage_state", F.when(F.col("_loaded") & (F.col("status") == "active"), "loaded").otherwise(F.col("stage_state"))).drop("_loaded")
    waiting = segments.where("status = 'active' and stage_state <> 'loaded'").select("domain", "file_path").distinct().withColumn("_waits", F.lit(True))
    touched = hit.select("domain", "file_path").distinct().withColumn("_touched", F.lit(True))
    files = files.join(waiting, ["domain", "file_path"], "left").join(touched, ["domain", "file_path"], "left")
    done = F.col("_touched") & F.col("_waits").isNull() & (F.col("status") == "active")
    return segments, files.withColumn("stage_state", F.when(done, "loaded").otherwise(F.col("stage_state"))).drop("_waits", "_touched")


def backfill_vectors(rows: DataFrame, embed, text: Column, column: str = "embedding") -> DataFrame:
    """``rows`` with missing vectors made from ``text`` by ``embed``, a pandas UDF; rows with a vector or without text stay."""
    lacks = F.col(column).isNull() & text.isNotNull() & (F.trim(text) != "")
    made = rows.where(lacks).withColumn(column, embed(text))
    return rows.where(~lacks).unionByName(made)
