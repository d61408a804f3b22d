"""Graph tables derived from the driver's tables, as lazy plans and as the same definitions in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import EventGraph
from ..shared import dealt

#: The graph in DuckDB SQL: common table expressions that oracle queries start with.
PRELUDE = """
with ev as (
  select o_orderkey as id, o_orderstatus as domain, o_orderpriority || ' order ' || o_orderkey as summary, o_orderkey % 500 as vector_id,
         case when o_orderkey % 41 = 0 then null else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') end as "timestamp", o_orderkey as order_index,
         o_orderkey % 97 = 0 as deprecated, round(o_totalprice / 1000000, 6) as influence_score, o_orderdate as created_at
  from orders),
ent as (
  select p_partkey as id, 'Part#' || p_partkey as name, p_name as title, p_brand as type, p_brand as domain,
         case when p_partkey % 50 = 0 then 'stopword' end as user_tag, p_partkey % 101 = 0 as deprecated, p_partkey as age
  from part),
pi as (select distinct l_partkey as entity_id, l_orderkey as event_id from lineitem),
grp as (
  select 'r' || r_regionkey as id, r_name as name, cast(null as varchar) as parent_id, 'geo' as domain, 'build' as source, 'system' as type from region
  union all select 'n' || n_nationkey, n_name, 'r' || n_regionkey, 'geo', 'autotag', 'system' from nation
  union all select distinct 's' || c_mktsegment, c_mktsegment, cast(null as varchar), 'geo', 'forced', 'user' from customer),
mo as (
  select o_orderkey as event_id, 'n' || c_nationkey as group_id, 'contains' as kind from orders join customer on o_custkey = c_custkey
  union all select o_orderkey, 's' || c_mktsegment, 'refers' from orders join customer on o_custkey = c_custkey),
nx as (
  select * from (select o_orderkey as prev_id, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as next_id from orders) where next_id is not null),
evl as (select * from ev where not deprecated),
few as (select event_id from pi group by event_id having count(*) between 2 and 49),
conn as (
  select a.entity_id as a_id, b.entity_id as b_id, count(*) as event_count
  from pi a join pi b on a.event_id = b.event_id and a.entity_id < b.entity_id where a.event_id in (select event_id from few) group by 1, 2)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_graph(spark: SparkSession, sf_dir: str) -> EventGraph:
    """Orders are events, parts entities, regions, nations and market segments tags; a customer's orders follow each other."""
    t = lambda name: table(spark, sf_dir, name)
    o = t("orders")
    events = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("domain"), F.concat("o_orderpriority", F.lit(" order "), F.col("o_orderkey").cast("string")).alias("summary"), (F.col("o_orderkey") % 500).alias("vector_id"),
        F.when(F.col("o_orderkey") % 41 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"), F.col("o_orderkey").alias("order_index"), (F.col("o_orderkey") % 97 == 0).alias("deprecated"),
        F.round(F.col("o_totalprice") / 1000000, 6).alias("influence_score"), F.col("o_orderdate").alias("created_at"),
    )
    entities = t("part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("Part#"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("title"), F.col("p_brand").alias("type"), F.col("p_brand").alias("domain"),
        F.when(F.col("p_partkey") % 50 == 0, "stopword").alias("user_tag"), (F.col("p_partkey") % 101 == 0).alias("deprecated"), F.col("p_partkey").alias("created_at"),
    )
    lines = t("lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("event_id"))
    part = dealt(lines, lines.count(), "event_id").distinct()
    tag = lambda i, n, p, s, k: (i.alias("id"), n.alias("name"), p.cast("string").alias("parent_id"), F.lit("geo").alias("domain"), F.lit(s).alias("source"), F.lit(k).alias("type"), F.lit(False).alias("deprecated"))
    groups = t("region").select(*tag(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.col("r_name"), F.lit(None), "build", "system"))
    groups = groups.union(t("nation").select(*tag(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "autotag", "system")))
    groups = groups.union(t("customer").select("c_mktsegment").distinct().select(*tag(F.concat(F.lit("s"), F.col("c_mktsegment")), F.col("c_mktsegment"), F.lit(None), "forced", "user")))
    placed = o.select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    member = placed.select(F.col("o_orderkey").alias("event_id"), F.explode(F.array(F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("group_id"), F.lit("contains").alias("kind")), F.struct(F.concat(F.lit("s"), F.col("c_mktsegment")).alias("group_id"), F.lit("refers").alias("kind")))).alias("m")).select("event_id", "m.group_id", "m.kind")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nxt = o.select(F.col("o_orderkey").alias("prev_id"), F.lead("o_orderkey").over(w).alias("next_id"), F.lit("thread").alias("source")).where("next_id is not null")
    from ..operators.analytics import cooccurrence_edges

    return EventGraph(spark, {"events": events, "entities": entities, "participated_in": part, "groups": groups, "event_member_of": member, "event_sequential_next": nxt, "entity_connection": cooccurrence_edges(part)})


def vector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream events with a vector: ``id, user_id, event_type, ts, label, embedding``."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return e.join(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "ts"), "id")
