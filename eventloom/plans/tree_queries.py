"""Queries of deep trees: every order hangs on another, in chains thousands deep, binary trees, or cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees
from .bridge import table
from .registry import query


def orders(spark, sf, parent):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(parent).alias("parent_id"))


RANKED = "with o as (select o_orderkey as id, row_number() over (order by o_orderkey) as k, o_orderkey = min(o_orderkey) over () or not exists (select 1 from orders p where p.o_orderkey = orders.o_orderkey - 1) as head, cast(round(o_totalprice * 100) as bigint) as cents from orders), b as (select *, sum(case when head then 1 else 0 end) over (order by k) as chain from o) "


@query(RANKED + "select id, min(id) over (partition by chain) as root, row_number() over (partition by chain order by id) - 1 as level, 'tree' as state from b", prelude=False)
def deep_levels(spark, sf):
    """Each order hangs on the one numbered before it: one chain as deep as the table, or as many as there are gaps."""
    return trees.places(orders(spark, sf, "o_orderkey - 1"))


@query(RANKED + "select id, cast(sum(cents) over (partition by chain order by id desc) as bigint) as cents, cast(count(*) over (partition by chain order by id desc) as bigint) as nodes from b", prelude=False)
def deep_totals(spark, sf):
    """What hangs on each order of the chain: price and number, itself included."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.lit(1).cast("long").alias("nodes"))
    return trees.subtree_totals(orders(spark, sf, "o_orderkey - 1"), o, ["cents", "nodes"])


@query("""with recursive o as (select o_orderkey as id, case when o_orderkey > 1 then o_orderkey // 2 end as up, cast(round(o_totalprice * 100) as bigint) as cents from orders),
t as (select id, id as top from o union all select t.id, o.up from t join o on o.id = t.top join o p on p.id = o.up)
select top as id, cast(sum(cents) as bigint) as cents from t join o using (id) group by 1""", prelude=False)
def wide_totals(spark, sf):
    """A binary tree of all orders: price of each subtree."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return trees.subtree_totals(orders(spark, sf, "case when o_orderkey > 1 then o_orderkey div 2 end"), o, ["cents"])


@query("""select state, count(*) as n from (select case when o_orderkey % 100 = 0 or lag(o_orderkey) over (order by o_orderkey) is null and o_orderkey % 100 > 3 then 'tree' when o_orderkey % 100 <= 3 then 'cycle' else 'below cycle' end as state
from orders where o_orderkey < (select max(o_orderkey) // 100 * 100 from orders) and o_orderkey >= 100) group by 1""", prelude=False)
def tree_cycles(spark, sf):
    """Of every hundred orders three form a cycle and the rest hangs on it; the hundredth is alone. Whole hundreds are taken."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    o = o.crossJoin(o.agg((F.expr("max(id) div 100") * 100).alias("top"))).where("id < top and id >= 100")
    up = F.expr("case id % 100 when 0 then null when 3 then id - 2 when 1 then id + 1 when 2 then id + 1 when 4 then id - 3 else id - 1 end")
    return trees.places(o.select("id", up.alias("parent_id"))).groupBy("state").agg(F.count("*").alias("n"))
