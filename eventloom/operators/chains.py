"""Plans, directions and event templates: nodes that follow each other, their stages, and chains that close up when nodes go.

Nodes are rows of ``plan_nodes`` (kind ``PLN``), ``plan_direction_nodes`` (``DIR``), ``event_template_groups`` (``ETG``) and
``context_groups`` (``CG ``); ``context_edges`` holds what links them: ``plan_next`` from a node to the next, ``plan_from`` from an
event to the node it gave rise to, ``realized_as`` from a node to the event it became, ``belongs_to`` from an event to a template.
All operators take batches: a batch of stages, links or removals is a few joins, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EventGraph
from ..shared import counted_write, discard, written
from . import trees
from .contexts import CONTEXT, EVENT, link, put_rows

# Kinds of nodes, and the stages of a plan that is not at its end.
PLAN, DIRECTION, TEMPLATE = "PLN", "DIR", "ETG"
OPEN_STAGES = ["draft", "planned", "active"]
TABLES = {PLAN: "plan_nodes", DIRECTION: "plan_direction_nodes", TEMPLATE: "event_template_groups", CONTEXT: "context_groups"}


def put_nodes(g: EventGraph, kind: str, rows: DataFrame) -> EventGraph:
    """Create nodes of a kind, or set the columns that ``rows`` (one row per ``id``) has where it is not null."""
    return g.with_tables(**{TABLES[kind]: put_rows(getattr(g, TABLES[kind]), rows)})


def link_next(g: EventGraph, kind: str, pairs: DataFrame) -> EventGraph:
    """``source_id, target_id`` and, if given, ``order_index``: a link that is there takes the new order."""
    return link(g, pairs.withColumns({"source_kind": F.lit(kind), "target_kind": F.lit(kind), "rel": F.lit("plan_next")}))


def link_from(g: EventGraph, kind: str, pairs: DataFrame) -> EventGraph:
    """``event_id, id``: the node came of the event."""
    rows = pairs.select(F.col("event_id").alias("source_id"), F.lit(EVENT).alias("source_kind"), F.col("id").alias("target_id"), F.lit(kind).alias("target_kind"), F.lit("plan_from").alias("rel"))
    return link(g, rows)


def link_template(g: EventGraph, rows: DataFrame) -> EventGraph:
    """``event_id, id, order_index``: the event's place in a template."""
    at = rows.select(F.col("event_id").alias("source_id"), F.lit(EVENT).alias("source_kind"), F.col("id").alias("target_id"), F.lit(TEMPLATE).alias("target_kind"), F.lit("belongs_to").alias("rel"), "order_index")
    return link(g, at)


def settle(g: EventGraph, kind: str, changes: DataFrame) -> EventGraph:
    """Apply changes ``id, stage`` and, where given, ``realized_event_id`` and ``abandon_reason``, in the order of ``seq``.

    A node ends with the last value of each column that is not null, the greatest of several at one ``seq``; nulls change
    nothing, unknown ids no row. Every event named, not only the last, gives an edge ``realized_as``; empty names give none.
    """
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    for c in ("realized_event_id", "abandon_reason"):
        if c not in changes.columns:
            changes = changes.withColumn(c, F.lit(None).cast("string"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(seq.alias("seq"), F.col(c).alias("value"))))["value"]
    stage = "plan_stage" if kind == CONTEXT else "stage"
    end = changes.where("id is not null").groupBy("id").agg(last("stage").alias(stage), last("realized_event_id").alias("realized_event_id"), last("abandon_reason").alias("abandon_reason"))
    table = getattr(g, TABLES[kind])
    known = end.join(table.select("id"), "id", "left_semi")
    known = known.select([c for c in known.columns if c in table.columns])  # context groups tell their events by edges alone
    became = changes.where("id is not null and realized_event_id <> ''").select(F.col("id").alias("source_id"), F.lit(kind).alias("source_kind"), F.col("realized_event_id").alias("target_id"), F.lit(EVENT).alias("target_kind"), F.lit("realized_as").alias("rel"))
    return link(put_nodes(g, kind, known), became)


def splice(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``src, dst, order_index`` once the nodes ``gone`` are taken out: who led into a run of them leads to what follows the run.

    Runs are jumped over by doubling: each round a removed node learns the survivors behind it, or the nodes twice as far, so a
    run of any length takes a logarithm of rounds. A link keeps the order of the edge it began with, the least of several.
    Runs that end nowhere, or go round, lead nowhere; a node isn't linked with itself.
    """
    out = written(gone.toDF("id").distinct(), "gone")
    flag = lambda end: out.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
    known = edges.where("src is not null and dst is not null").select("src", "dst", "order_index")
    marked = written(known.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left").select("src", "dst", "order_index", F.coalesce("_src", F.lit(False)).alias("from_gone"), F.coalesce("_dst", F.lit(False)).alias("to_gone")), "marked")
    done = [marked.where("not from_gone and not to_gone").select("src", "dst", "order_index")]
    waits = marked.where("not from_gone and to_gone").select("src", "dst", "order_index")
    hops = marked.where("from_gone").select(F.col("src").alias("id"), F.col("dst").alias("to"), F.col("to_gone").alias("on")).distinct()
    removed, span, old = out.count(), 1, []
    while span <= 2 * removed:
        led, seen = counted_write(waits.join(hops, waits["dst"] == hops["id"]).groupBy("src", "to", "on").agg(F.min("order_index").alias("order_index")), "led", on=F.count_if("on"))
        done.append(led.where("not on").select("src", F.col("to").alias("dst"), "order_index"))
        if not seen["on"]:
            break
        waits = led.where("on").select("src", F.col("to").alias("dst"), "order_index")
        ahead = hops.toDF("to", "_to", "_on")
        further = written(hops.where("not on").union(hops.where("on").join(ahead, "to").select("id", F.col("_to"), F.col("_on"))).distinct(), "hops")
        for df in old:
            discard(df)
        hops, old, span = further, [further], 2 * span
    whole = done[0]
    for df in done[1:]:
        whole = whole.union(df)
    return whole.where(~F.col("src").eqNullSafe(F.col("dst"))).groupBy("src", "dst").agg(F.min("order_index").alias("order_index"))


def remove_nodes(g: EventGraph, kind: str, ids: DataFrame) -> EventGraph:
    """Take nodes out: chains close over them, other edges at them go, and nodes below them become roots.

    Removing a template leaves the plan nodes made from it without one. Nodes keep their ``order_index``: gaps do not matter.
    """
    gone = ids.toDF("_gone").distinct()
    forget = lambda df, c: df.join(gone, F.col(c) == F.col("_gone"), "left").withColumn(c, F.when(F.col("_gone").isNull(), F.col(c))).drop("_gone")
    table = getattr(g, TABLES[kind])
    left = table.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    tables = {TABLES[kind]: forget(left, "parent_id").select(*table.columns) if "parent_id" in table.columns else left}
    if kind == TEMPLATE and "plan_nodes" in g.tables:
        tables["plan_nodes"] = forget(g.plan_nodes, "etg_id").select(*g.plan_nodes.columns)
    edges = g.context_edges
    node = lambda end: F.struct(F.trim(f"{end}_kind").alias("kind"), F.col(f"{end}_id").alias("id"))
    chain = edges.where("rel = 'plan_next'").select(node("source").alias("src"), node("target").alias("dst"), "order_index")
    spliced = splice(chain, gone.select(F.struct(F.lit(kind.strip()).alias("kind"), F.col("_gone").alias("id")).alias("id")))
    full = lambda c: F.rpad(c, 3, " ")
    other = edges.where("rel <> 'plan_next'")
    for end in ("source", "target"):
        other = other.join(gone, (F.col(f"{end}_id") == F.col("_gone")) & (F.trim(f"{end}_kind") == kind.strip()), "left_anti")
    closed = spliced.select(F.col("src.id").alias("source_id"), full("src.kind").alias("source_kind"), F.col("dst.id").alias("target_id"), full("dst.kind").alias("target_kind"), F.lit("plan_next").alias("rel"), "order_index")
    return g.with_tables(context_edges=other.unionByName(closed), **tables)


def chains(g: EventGraph, kind: str) -> DataFrame:
    """``id, head, place, state`` of every node of a kind along ``plan_next``, in one go for all chains.

    A node alone is its own head. Where several lead into a node the smallest counts; nodes on a circle, or behind one, have no
    head and no place (``state``).
    """
    nexts = g.context_edges.where((F.col("rel") == "plan_next") & (F.trim("source_kind") == kind.strip()) & (F.trim("target_kind") == kind.strip()))
    nodes = getattr(g, TABLES[kind]).select("id", F.lit(None).cast("string").alias("parent_id"))
    at = trees.places(nodes.union(nexts.select(F.col("target_id"), F.col("source_id"))))
    return at.join(nodes.select("id"), "id", "left_semi").select("id", F.col("root").alias("head"), F.col("level").alias("place"), "state")


def of_plan(g: EventGraph, kind: str, plan_id) -> DataFrame:
    """A plan's nodes in order; nodes without a place come first."""
    return getattr(g, TABLES[kind]).where(F.col("plan_id") == plan_id).orderBy(F.asc_nulls_first("order_index"), "id")


def plan_tree(g: EventGraph, plan_id) -> DataFrame:
    """``id, root, level, state`` of a plan's nodes below each other by ``parent_id``."""
    return trees.places(g.plan_nodes.where(F.col("plan_id") == plan_id).select("id", "parent_id"))


def active_plans(g: EventGraph, domain: str, limit: int = 50) -> DataFrame:
    """``plan_id, first_created, node_count`` of plans with nodes that are not at their end, counting those, newest first."""
    rows = g.plan_nodes.where((F.col("domain") == domain) & F.col("stage").isin(OPEN_STAGES))
    return rows.groupBy("plan_id").agg(F.min("created_at").alias("first_created"), F.count("*").alias("node_count")).orderBy(F.desc("first_created"), "plan_id").limit(limit)


def templates(g: EventGraph, domain: str) -> DataFrame:
    return g.event_template_groups.where(F.col("domain") == domain).orderBy(F.desc("confidence"), F.desc("created_at"), "id")


def template_events(g: EventGraph, ids: DataFrame) -> DataFrame:
    """``template_id, place`` and the event's columns, of all templates ``ids``; order by place, then the event's own order."""
    belongs = g.context_edges.where((F.col("rel") == "belongs_to") & (F.col("target_kind") == TEMPLATE))
    pairs = belongs.join(ids.toDF("target_id").distinct(), "target_id", "left_semi").select(F.col("target_id").alias("template_id"), F.col("order_index").alias("place"), F.col("source_id").alias("id"))
    return pairs.join(g.events, "id")


def plan_seeds(g: EventGraph, domain: str) -> DataFrame:
    """Context groups that begin a plan, oldest first."""
    return g.context_groups.where((F.col("cluster_source") == "plan") & (F.col("order_index") == 0) & (F.col("domain") == domain)).orderBy("created_at", "id")


def abandoned_plans(g: EventGraph, domain: str, limit: int = 10) -> DataFrame:
    """Context groups of plans that were given up, newest first."""
    return g.context_groups.where((F.col("cluster_source") == "plan") & (F.col("plan_stage") == "abandoned") & (F.col("domain") == domain)).orderBy(F.desc("created_at"), "id").limit(limit)


def template_contexts(g: EventGraph, domain: str) -> DataFrame:
    """Context groups made from templates, those with most instances first."""
    return g.context_groups.where((F.col("cluster_source") == "template") & (F.col("domain") == domain)).orderBy(F.desc("instance_count"), "id")
