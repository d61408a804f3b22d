"""Queries over lookups, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as L
from .bridge import order_graph as graph
from .bridge import table
from .registry import query

EVENT = "id, summary, order_index"


def page(df):
    return df.select("id", "summary", "order_index", "total")


@query("select id, summary, domain from ev where id = 7")
def event_point(spark, sf):
    return L.point(graph(spark, sf).events, "id", 7).select("id", "summary", "domain")


@query("select id, name, type from ent where id = 5")
def entity_point(spark, sf):
    return L.point(graph(spark, sf).entities, "id", 5).select("id", "name", "type")


@query("select vec_id as id, label from embeddings where vec_id in (1, 3, 5, 8)", prelude=False)
def vector_batch(spark, sf):
    ids = spark.createDataFrame([(1,), (3,), (5,), (8,)], "id long")
    return L.pick(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), "id", ids).select("id", "label")


@query("select id, name, (select count(*) from ent where not deprecated) as total from ent where not deprecated order by age desc, id desc limit 50 offset 50")
def entity_list_page(spark, sf):
    return L.page_of(graph(spark, sf).live("entities"), [F.desc("created_at"), F.desc("id")], 2, 50).select("id", "name", "total")


@query("select id, name, parent_id from grp")
def group_list(spark, sf):
    return graph(spark, sf).groups.orderBy(F.asc_nulls_first("parent_id"), "id").select("id", "name", "parent_id")


@query("""select id, summary, order_index, (select count(*) from evl where domain = 'O') as total from evl where domain = 'O'
order by "timestamp" desc nulls last, id desc limit 20 offset 20""")
def timeline_page(spark, sf):
    return page(L.timeline(graph(spark, sf), "O", page=2, size=20))


@query("select id from evl where domain = 'F'")
def event_ids(spark, sf):
    return graph(spark, sf).live("events").where("domain = 'F'").orderBy("order_index").select("id")


@query("""select id, summary, order_index, (select count(*) from evl join pi on id = event_id where entity_id = 3) as total
from evl join pi on id = event_id where entity_id = 3 order by order_index desc, id desc limit 10""")
def entity_events_page(spark, sf):
    return page(L.events_of_entity(graph(spark, sf), 3, 1, 10))


@query("""select id, summary, order_index, (select count(*) from evl join mo on id = event_id where group_id = 'n3') as total
from evl join mo on id = event_id where group_id = 'n3' order by order_index desc, id desc limit 25 offset 25""")
def tag_events_page(spark, sf):
    return page(L.events_of_tag(graph(spark, sf), "n3", 2, 25))


@query("""select e.id, e.summary from evl e join pi a on a.event_id = e.id and a.entity_id = (select min(a_id) from conn) join pi b on b.event_id = e.id
and b.entity_id = (select min(b_id) from conn where a_id = (select min(a_id) from conn)) order by e."timestamp" desc nulls last, e.order_index desc limit 50""")
def pair_shared_events(spark, sf):
    g = graph(spark, sf)
    a, b = g.entity_connection.agg(F.min(F.struct("a_id", "b_id")).alias("p")).select("p.a_id", "p.b_id").first()
    return L.shared_events(g, a, b).select("id", "summary")


@query("""select w.id as event_id, (select string_agg(cast(entity_id as varchar), ',' order by entity_id) from pi where event_id = w.id) as entities,
(select string_agg(group_id, ',' order by group_id) from mo where event_id = w.id) as tags from ev w""")
def event_context(spark, sf):
    g = graph(spark, sf)
    return L.event_context(g, g.events.select(F.col("id").alias("event_id")))


@query("select e.id as event_id, (select min(prev_id) from nx where next_id = e.id) as prev_event, (select min(next_id) from nx where prev_id = e.id) as next_event from ev e")
def event_adjacent(spark, sf):
    g = graph(spark, sf)
    return L.adjacent(g, g.events.select(F.col("id").alias("event_id")))


@query("""select conv_id * 1000 + turn as event_id, coalesce(nullif(case when turn % 3 = 0 then trim(text) else '' end, ''), substr(text, 1, 200), '') as summary from conversations""", prelude=False)
def event_detail_summary(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), L.display_summary(F.when(F.col("turn") % 3 == 0, F.trim("text")).otherwise(F.lit("")), F.lit(None).cast("string"), F.col("text")).alias("summary"))


@query("select id, name from ent where not deprecated and contains(lower(name), 't#1') order by length(name), name, id limit 20")
def entity_search(spark, sf):
    return L.search_names(graph(spark, sf).entities, "T#1", limit=20, by_length=True).select("id", "name")


@query("select id, name from grp where contains(lower(name), 'an') order by length(name), name, id limit 5")
def tag_search(spark, sf):
    return L.search_names(graph(spark, sf).groups, "an", limit=5, by_length=True).select("id", "name")


@query("""(select 'entity' as kind, cast(id as varchar) as id, name from ent where not deprecated and domain = 'Brand#13' and coalesce(user_tag, '') <> 'stopword' and contains(lower(name), '1') order by length(name), name, id limit 20)""")
def autocomplete_entities(spark, sf):
    return L.autocomplete(graph(spark, sf), "Brand#13", "1", without_stopwords=True).where("kind = 'entity'").select("kind", F.col("id").cast("string").alias("id"), "name")


@query("select id, name from grp where domain = 'geo' and ends_with(name, 'A') order by name, id limit 1")
def group_by_suffix(spark, sf):
    return L.group_by_path(graph(spark, sf), "A", "geo").select("id", "name")


@query("select id, name from ent where name in ('Part#1', 'Part#2', 'nothing')")
def exact_names(spark, sf):
    return L.by_exact_name(graph(spark, sf).entities, ["Part#1", "Part#2", "nothing"]).select("id", "name")


@query("""select id, summary from evl where contains(lower(summary), 'urgent') order by coalesce("timestamp", strftime(created_at, '%Y-%m-%dT%H:%M:%S')) desc, id desc limit 50""")
def summary_mentions(spark, sf):
    return L.summary_mentions(graph(spark, sf), "URGENT").select("id", "summary")


FILTER_SQL = """select id from evl e where coalesce("timestamp", strftime(created_at, '%Y-%m-%dT%H:%M:%S')) between '1995-01-01' and '1997-12-31T00:00:00'
and exists (select 1 from mo where event_id = e.id and group_id = 'sBUILDING') and (select count(distinct entity_id) from pi where event_id = e.id and entity_id in (1, 2, 3, 4, 5, 6, 7, 8)) """


@query(FILTER_SQL + ">= 1")
def composite_event_filter_or(spark, sf):
    return L.event_filter(graph(spark, sf), start="1995-01-01", end="1997-12-31T00:00:00", tag="sBUILDING", entity_ids=list(range(1, 9)), match="or").select("id")


@query("""select e.id from evl e where (select count(distinct entity_id) from pi where event_id = e.id and entity_id in ((select min(a_id) from conn), (select min(b_id) from conn where a_id = (select min(a_id) from conn)))) = 2""")
def composite_event_filter_and(spark, sf):
    g = graph(spark, sf)
    a, b = g.entity_connection.agg(F.min(F.struct("a_id", "b_id")).alias("p")).select("p.a_id", "p.b_id").first()
    return L.event_filter(g, entity_ids=[a, b]).select("id")


@query("select id from ev where domain = 'P' union select id from ev join mo on id = event_id where domain = 'O' and group_id = 'n1'")
def search_scope(spark, sf):
    g = graph(spark, sf)
    return L.scope(g.events, [("P", None), ("O", "n1")], g.event_member_of).select("id")


@query("select id from ev where false")
def search_scope_empty(spark, sf):
    return L.scope(graph(spark, sf).events, []).select("id")


@query("select id from ev where id % 3 = 0 or id % 7 = 0 or (id % 3 = 2 and id % 5 = 0)")
def visible_rows(spark, sf):
    e = graph(spark, sf).events.withColumns({"visibility": F.when(F.col("id") % 3 == 0, "public").when(F.col("id") % 3 == 1, "private").otherwise("shared"), "owner_id": F.when(F.col("id") % 7 == 0, "u"), "share_group_id": F.when(F.col("id") % 5 == 0, "team")})
    return L.visible_to(e, "u", ["team"]).select("id")


@query("""select s.doc_id as event_id, s.file_path, s.segment_key from (select doc_id % 100 as doc_id, 'f' || doc_id % 10 as file_path, 'k' || doc_id as segment_key, row_number() over (partition by doc_id % 100 order by doc_id desc) as r
from documents where doc_id % 10 <> 3) s where r = 1""", prelude=False)
def manifest_evidence(spark, sf):
    d = table(spark, sf, "documents")
    seg = d.select(F.col("doc_id").alias("id"), F.lit("d").alias("domain"), F.concat(F.lit("f"), (F.col("doc_id") % 10).cast("string")).alias("file_path"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("segment_key"), (F.col("doc_id") % 100).alias("event_id"))
    files = seg.select("domain", "file_path").distinct().withColumn("status", F.when(F.col("file_path") == "f3", "superseded").otherwise("active"))
    return L.manifest_evidence(seg, files)


@query("""select a_id, b_id, event_count from conn where a_id in (select id from ent where domain = 'Brand#13' and not deprecated) and b_id in (select id from ent where domain = 'Brand#13' and not deprecated)""")
def domain_edges(spark, sf):
    return L.live_edges(graph(spark, sf), "Brand#13")


@query("select prev_id, next_id from nx where prev_id in (select id from evl where domain = 'O')")
def sequential_pairs(spark, sf):
    return L.sequential_pairs(graph(spark, sf), "O")


@query("""select id from ev where id in (select event_id from pi where entity_id = 11) order by "timestamp" nulls last, order_index, id limit 50""")
def temporal_flow_entity(spark, sf):
    return L.temporal_flow(graph(spark, sf), entity_id=11).select("id")


@query("""select id from ev where domain = 'O' and "timestamp" is not null and cast("timestamp" as timestamp) >= timestamp '1998-08-01' - interval 60 day order by "timestamp", order_index, id limit 200""")
def temporal_flow_last_days(spark, sf):
    return L.temporal_flow(graph(spark, sf), domain="O", days=60, as_of="1998-08-01", limit=200).select("id")


@query("""select entity_id, entity_name, event_id, rank from (select c.id as entity_id, c.name as entity_name, e.id as event_id, cast(row_number() over (partition by c.id order by influence_score desc, order_index desc, e.id desc) as int) as rank
from (select * from ent where not deprecated and contains(lower(name), 'part#1') order by name, id limit 5) c join pi on entity_id = c.id join evl e on e.id = event_id) where rank <= 20""")
def entity_lookup(spark, sf):
    return L.entity_lookup(graph(spark, sf), "part#1").select("entity_id", "entity_name", "event_id", "rank")


@query("""select 'f' || k % 40 as file_path, 's' || k as segment_key, max(id) filter (where st = 'active') as event_id, max(id) filter (where st = 'superseded') as old_event_id
from (select doc_id as id, doc_id % 300 as k, case when doc_id >= 300 then 'active' else 'superseded' end as st from documents) group by k
having count(*) filter (where st = 'active') > 0 and count(*) filter (where st = 'superseded') > 0 order by event_id desc limit 50""", prelude=False)
def review_candidates(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 300
    seg = d.select(F.col("doc_id").alias("id"), F.lit("d").alias("domain"), F.concat(F.lit("f"), (k % 40).cast("string")).alias("file_path"), F.concat(F.lit("s"), k.cast("string")).alias("segment_key"), F.when(F.col("doc_id") >= 300, "active").otherwise("superseded").alias("status"), F.col("doc_id").alias("event_id"))
    g = graph(spark, sf).with_tables(build_segment_manifest=seg, events=d.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("double").alias("influence_score")))
    return L.review_candidates(g).select("file_path", "segment_key", "event_id", "old_event_id")


@query("""select o_orderkey, o.k, o_orderdate, price from (select o_orderkey, o_custkey % 20 as k, o_orderdate from orders) o
asof left join (select o_custkey % 20 as k, o_orderdate as fitted, max(o_totalprice) as price from orders group by 1, 2) p on p.k = o.k and o.o_orderdate >= p.fitted""", prelude=False)
def asof_price(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.col("o_custkey") % 20)
    price = o.groupBy("k", F.col("o_orderdate").alias("fitted")).agg(F.max("o_totalprice").alias("price"))
    return L.as_of_join(o, price, ["k"], "o_orderdate", "fitted", "price", "o_orderkey")


@query("select id, row_number() over (order by id) - 1 as place from ev")
def context_events(spark, sf):
    g = graph(spark, sf)
    from pyspark.sql import Window

    edges = g.events.select(F.col("id").alias("source_id"), F.lit("EVT").alias("source_kind"), F.lit("c1").alias("target_id"), F.lit("CG ").alias("target_kind"), F.lit("belongs_to").alias("rel"), (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("order_index"))
    return L.context_events(g.with_tables(context_edges=edges), "c1").select("id", "place")
