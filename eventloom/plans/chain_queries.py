"""Queries of plans and templates: orders are plan nodes, a customer's orders a plan, market segments templates; and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EventGraph
from ..operators import chains as H
from ..operators import traversal as T
from .bridge import order_graph, table
from .registry import query

#: Orders in the order of their customer's, with their place.
NODES = ", pn as (select o_orderkey as id, o_custkey, o_orderstatus as domain, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as place from orders)"
STAGE = "case when o_orderpriority like '1%' then 'active' when o_orderpriority like '2%' then 'draft' when o_orderpriority like '3%' then 'planned' else 'realized' end"


def plan_graph(spark, sf) -> EventGraph:
    """Each order is a plan node that leads to its customer's next order."""
    g, o = order_graph(spark, sf), table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    nodes = o.select(key.alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("plan_id"), F.col("o_orderstatus").alias("domain"), F.expr(STAGE).alias("stage"), F.col("o_orderdate").alias("created_at"))
    plans = H.put_nodes(EventGraph(spark), H.PLAN, nodes)
    nexts = g.event_sequential_next.select(F.col("prev_id").cast("string").alias("source_id"), F.col("next_id").cast("string").alias("target_id"), F.col("prev_id").alias("order_index"))
    return H.link_next(plans, H.PLAN, nexts)


def as_number(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query(NODES + """, s as (select id, lead(id) over (partition by o_custkey order by place) as target_id from pn where domain <> 'F')
select id as source_id, target_id, id as order_index from s where target_id is not null""")
def plan_splice(spark, sf):
    """All finished orders are taken out of their plans; chains close over runs of them."""
    g = plan_graph(spark, sf)
    g = H.remove_nodes(g, H.PLAN, g.plan_nodes.where("domain = 'F'").select("id"))
    return as_number(g.context_edges.where("rel = 'plan_next'").select("source_id", "target_id", "order_index"), "source_id", "target_id")


@query(NODES + "select id, min(id) filter (where place = 0) over (partition by o_custkey) as head, place, 'tree' as state from pn")
def plan_places(spark, sf):
    """Head and place of every node of every plan."""
    return as_number(H.chains(plan_graph(spark, sf), H.PLAN), "id", "head")


@query(f""", ch as (select l_orderkey as id, l_linenumber as n, case l_returnflag when 'R' then 'abandoned' when 'A' then 'realized' else 'active' end as stage,
  case when l_returnflag = 'A' then cast(l_suppkey as varchar) end as became, case when l_returnflag = 'R' then l_linestatus end as reason from lineitem),
last as (select id, (max({{'n': n, 'v': stage}})).v as stage, (max({{'n': n, 'v': became}}) filter (where became is not null)).v as became, (max({{'n': n, 'v': reason}}) filter (where reason is not null)).v as reason, count(distinct became) as events from ch group by 1)
select o_orderkey as id, coalesce(stage, {STAGE}) as stage, became as realized_event_id, reason as abandon_reason, coalesce(events, 0) as events from orders left join last on id = o_orderkey""")
def plan_settle(spark, sf):
    """Lines of an order change its stage one after the other; events it became are kept as edges."""
    line = table(spark, sf, "lineitem")
    flag = lambda v, c: F.when(F.col("l_returnflag") == v, F.col(c).cast("string"))
    stage = F.when(F.col("l_returnflag") == "R", "abandoned").when(F.col("l_returnflag") == "A", "realized").otherwise("active")
    changes = line.select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").alias("seq"), stage.alias("stage"), flag("A", "l_suppkey").alias("realized_event_id"), flag("R", "l_linestatus").alias("abandon_reason"))
    g = H.settle(plan_graph(spark, sf), H.PLAN, changes)
    became = g.context_edges.where("rel = 'realized_as'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("events"))
    return as_number(g.plan_nodes.join(became, "id", "left").select("id", "stage", "realized_event_id", "abandon_reason", F.coalesce("events", F.lit(0)).alias("events")), "id")


@query(f"select 'c' || o_custkey as plan_id, min(o_orderdate) as first_created, count(*) as node_count from orders where o_orderstatus = 'O' and {STAGE} <> 'realized' group by o_custkey order by 2 desc, 1 limit 50")
def active_plans(spark, sf):
    out = H.active_plans(plan_graph(spark, sf), "O")
    return out.withColumn("first_created", F.col("first_created").cast("timestamp_ntz"))


@query("select substr(group_id, 2) as template_id, event_id % 500 as place, event_id as id, summary from mo join ev on id = event_id where kind = 'refers' and group_id <> (select max(group_id) from mo where kind = 'refers')")
def template_events(spark, sf):
    """Events of all templates but the last, with their places; a link given twice takes the later place."""
    g = order_graph(spark, sf)
    text = g.events.select(F.col("id").cast("string"), "domain", "summary", "order_index")
    refers = g.event_member_of.where("kind = 'refers'").select(F.col("event_id").cast("string").alias("event_id"), F.expr("substring(group_id, 2)").alias("id"), (F.col("event_id") % 500).alias("order_index"))
    names = refers.select("id").distinct()
    h = H.put_nodes(EventGraph(spark, {"events": text}), H.TEMPLATE, names.withColumn("domain", F.lit("d")))
    h = H.link_template(H.link_template(h, refers.withColumn("order_index", F.lit(-1))), refers)
    asked = H.templates(h, "d").select("id").join(names.agg(F.max("id").alias("id")), "id", "left_anti")
    return as_number(H.template_events(h, asked).select("template_id", "place", "id", "summary"), "id")


#: Every relation from either end, as text keys.
ALL_EDGES = """, one as (select 'entity:' || entity_id as s, 'event:' || event_id as d from pi union all select 'event:' || event_id, 'group:' || group_id from mo union all select 'event:' || prev_id, 'event:' || next_id from nx
  union all select 'group:' || id, 'group:' || parent_id from grp where parent_id is not null union all select 'entity:' || a_id, 'entity:' || b_id from conn),
st as (select s, d from one union select d, s from one),
ends as (select 'event:' || min(e.id) as a, 'event:' || max(e.id) as b from ev e where exists (select 1 from pi where event_id = e.id)),
w1 as (select [a, st.d] as path, st.d as here, b from ends join st on s = a), w2 as (select list_append(path, st.d) as path, st.d as here, b from w1 join st on s = here where here <> b),
w3 as (select list_append(path, st.d) as path, st.d as here, b from w2 join st on s = here where here <> b and st.d = b),
hit as (select path from w1 where here = b union all select path from w2 where here = b union all select path from w3), best as (select path from hit where len(path) = (select min(len(path)) from hit)) """


@query(ALL_EDGES + "select cast(len(path) - 1 as int) as hops, array_to_string(path, '>') as path, (select count(*) from best) as ways from best order by best.path limit 10")
def paths_shortest(spark, sf):
    """The first ten shortest paths between the first and the last order that have parts, over all relations, and their number."""
    g = order_graph(spark, sf)
    ids = g.events.join(g.participated_in.select(F.col("event_id").alias("id")), "id", "left_semi").agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    return T.shortest_paths(T.typed_edges(g), (ids["a"], "event"), (ids["b"], "event")).withColumn("ways", F.col("ways").cast("long"))
