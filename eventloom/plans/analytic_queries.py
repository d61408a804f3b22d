"""Queries over aggregations, windows, vectors, communities and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import analytics as A
from ..operators import community as C
from ..operators import connections, lookup
from ..operators import traversal as T
from ..operators import vector_search as V
from .bridge import order_graph as graph
from .bridge import table, vector_events
from ..shared import written
from .registry import query

WHEN = "strftime(ts, '%Y-%m')"


@query("select i.id as entity_id, count(event_id) as n_events from (values (1), (2), (3), (999999999)) i(id) left join pi on entity_id = i.id group by 1")
def entity_event_counts(spark, sf):
    return A.event_counts(graph(spark, sf), spark.createDataFrame([(1,), (2,), (3,), (999999999,)], "id long"))


@query("select 'entities' as kind, count(*) as n from ent union all select 'events', count(*) from ev union all select 'groups', count(*) from grp union all select 'context_groups', 0")
def store_statistics(spark, sf):
    return A.statistics(graph(spark, sf))


@query("select id, name, n_events from (select e.id, e.name, count(event_id) as n_events from ent e left join pi on entity_id = e.id where not deprecated group by 1, 2) where n_events between 25 and 45 order by n_events desc, name, id limit 50")
def entity_count_range(spark, sf):
    return A.entities_by_count(graph(spark, sf), "part", 25, 45)


@query("select entity_id, count(distinct event_id) as n from pi where event_id in (select event_id from pi join evl on event_id = id where entity_id = 4) and entity_id <> 4 group by 1 order by 2 desc, 1 limit 50")
def cooccurrence_live(spark, sf):
    return A.cooccurring(graph(spark, sf), [4])


@query("select a_id, b_id, event_count from conn")
def cooccurrence_edges(spark, sf):
    return graph(spark, sf).entity_connection


JACCARD = """, p2 as (select pi.* from pi join evl on event_id = id where entity_id not in (select id from ent where user_tag = 'stopword')),
p3 as (select * from p2 where entity_id in (select entity_id from p2 group by 1 having count(*) <= {cap})), sz as (select event_id, count(*) as n from p3 group by 1),
ej as (select a.event_id as a_id, b.event_id as b_id, count(*) as i from p3 a join p3 b on a.entity_id = b.entity_id and a.event_id < b.event_id group by 1, 2) """

#: The same of all keys, however many events they have.
JACCARD_WHOLE = """, p3 as (select pi.* from pi join evl on event_id = id where entity_id not in (select id from ent where user_tag = 'stopword')), sz as (select event_id, count(*) as n from p3 group by 1),
ej as (select a.event_id as a_id, b.event_id as b_id, count(*) as i from p3 a join p3 b on a.entity_id = b.entity_id and a.event_id < b.event_id group by 1, 2) """


def jaccard(spark, sf, cap):
    g = graph(spark, sf)
    out = A.jaccard_edges(g, entity_cap=cap)
    return out.select("a_id", "b_id", F.round("entity_jaccard", 6).alias("entity_jaccard"), "entity_intersection")


JACCARD_TAIL = """select a_id, b_id, round(i / (x.n + y.n - i), 6) as entity_jaccard, i as entity_intersection from ej join sz x on x.event_id = a_id join sz y on y.event_id = b_id"""


@query(JACCARD.format(cap=200) + JACCARD_TAIL)
def jaccard_batch(spark, sf):
    return jaccard(spark, sf, 200)


@query(JACCARD.format(cap=28) + JACCARD_TAIL)
def jaccard_capped(spark, sf):
    return jaccard(spark, sf, 28)


@query(JACCARD.format(cap=200) + JACCARD_TAIL + " where a_id = 1 or b_id = 1 or a_id = 5 or b_id = 5")
def jaccard_incremental(spark, sf):
    g = graph(spark, sf)
    out = A.jaccard_edges(g, only=spark.createDataFrame([(1,), (5,)], "event_id long"))
    return out.select("a_id", "b_id", F.round("entity_jaccard", 6).alias("entity_jaccard"), "entity_intersection")


@query(JACCARD_WHOLE + """, tg as (select o_orderkey as event_id, 'c' || o_custkey as group_id from orders union all select o_orderkey, 'y' || o_custkey || '-' || year(o_orderdate) from orders),
t2 as (select tg.* from tg join evl on event_id = id), tz as (select event_id, count(*) as n from t2 group by 1),
tj as (select a.event_id as a_id, b.event_id as b_id, count(*) as gi from t2 a join t2 b on a.group_id = b.group_id and a.event_id < b.event_id group by 1, 2),
e as (select a_id, b_id, i / (x.n + y.n - i) as ej, i as ei from ej join sz x on x.event_id = a_id join sz y on y.event_id = b_id),
t as (select a_id, b_id, gi / (x.n + y.n - gi) as gj, gi from tj join tz x on x.event_id = a_id join tz y on y.event_id = b_id)
select a_id, b_id, round(coalesce(ej, 0), 6) as entity_jaccard, round(coalesce(gj, 0), 6) as group_jaccard, coalesce(ei, 0) as entity_intersection, coalesce(gi, 0) as group_intersection
from e full outer join t using (a_id, b_id) where ei > 0 or (gj >= 0.3 and gi >= 2)""")
def jaccard_both_channels(spark, sf):
    """Orders linked by their parts, by tags of their customer and its years, or by both."""
    g = graph(spark, sf)
    o = table(spark, sf, "orders")
    key = F.col("o_custkey").cast("string")
    tags = F.array(F.concat(F.lit("c"), key), F.concat(F.lit("y"), key, F.lit("-"), F.year("o_orderdate").cast("string")))
    out = A.jaccard_edges(g.with_tables(event_member_of=o.select(F.col("o_orderkey").alias("event_id"), F.explode(tags).alias("group_id"))), entity_cap=None, group_cap=None)
    return out.withColumn("entity_jaccard", F.round("entity_jaccard", 6)).withColumn("group_jaccard", F.round("group_jaccard", 6))


@query(""", t as (select event_id, group_id from mo join evl on event_id = id), n as (select event_id, count(*) as n from t group by 1)
select a.event_id as a_id, b.event_id as b_id, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) as group_jaccard, count(*) as group_intersection
from t a join t b on a.group_id = b.group_id and a.event_id < b.event_id join n x on x.event_id = a.event_id join n y on y.event_id = b.event_id where a.event_id in (1, 5) or b.event_id in (1, 5) group by 1, 2 having count(*) >= 2""")
def jaccard_group_trigger(spark, sf):
    """The tag side alone, without a cap, for two changed events against all others."""
    g = graph(spark, sf)
    g = g.with_tables(participated_in=g.participated_in.where("false"))
    out = A.jaccard_edges(g, group_cap=None, only=spark.createDataFrame([(1,), (5,)], "event_id long"))
    return out.select("a_id", "b_id", F.round("group_jaccard", 6).alias("group_jaccard"), "group_intersection")


@query(JACCARD.format(cap=200) + "select case when a_id = 1 then b_id else a_id end as neighbour, round(i / (x.n + y.n - i), 6) as score from ej join sz x on x.event_id = a_id join sz y on y.event_id = b_id where a_id = 1 or b_id = 1 order by i / (x.n + y.n - i) desc, 1 limit 20")
def jaccard_neighbors(spark, sf):
    """By their parts alone."""
    g = graph(spark, sf)
    e = A.jaccard_edges(g.with_tables(event_member_of=g.event_member_of.where("false")), only=spark.createDataFrame([(1,)], "event_id long"))
    return A.jaccard_neighbours(e, 1).select("neighbour", F.round("score", 6).alias("score"))


@query("select entity_id, cast(sum(event_count) as bigint) as weight from (select a_id as entity_id, event_count from conn union all select b_id, event_count from conn) group by 1 order by 2 desc, 1 limit 5")
def domain_summary_hubs(spark, sf):
    return A.hub_sums(graph(spark, sf))


@query("select count(*) as n_events, min(created_at) as first_at, max(created_at) as last_at, (select count(*) from ent where domain = 'O') as n_entities, (select count(*) from grp where domain = 'O') as n_tags from evl where domain = 'O'")
def domain_summary(spark, sf):
    return A.domain_summary(graph(spark, sf), "O")


@query("select event_id, count(*) as n_entities from pi join evl on event_id = id where domain = 'F' group by 1 order by 2 desc, 1 limit 5")
def fullest_events(spark, sf):
    return A.fullest_events(graph(spark, sf), "F")


@query("""select entity_id, name, n_events, round(100 * n_events / (select count(*) from evl), 2) as df_pct, n_roots, coalesce(user_tag, '') = 'stopword' as is_stopword from (
select entity_id, count(distinct event_id) as n_events, count(distinct coalesce(g.parent_id, g.id)) as n_roots from pi join evl on event_id = evl.id join mo using (event_id) join grp g on g.id = group_id group by 1) join ent on ent.id = entity_id order by n_events desc, entity_id limit 50""")
def hub_candidates(spark, sf):
    g = graph(spark, sf)
    return A.hub_candidates(g, T.root_map(g.groups))


@query("select id as group_id, name, count(distinct event_id) as n_events from grp left join mo on group_id = id where source in ('forced', 'autotag') group by 1, 2 order by 3 desc, 1 limit 200")
def scope_tag_counts(spark, sf):
    return A.scope_tags(graph(spark, sf), with_qc=True)


@query("select p.entity_id, name, (select count(distinct event_id) from pi join evl on event_id = id where entity_id = p.entity_id) as influence from pi p join ent on id = p.entity_id where p.event_id = 3")
def event_participants_influence(spark, sf):
    return A.participants(graph(spark, sf), 3)


@query(", l as (select id from evl order by order_index desc, id desc limit 100) select a.entity_id as a_id, b.entity_id as b_id, count(*) as event_count from pi a join pi b on a.event_id = b.event_id and a.entity_id < b.entity_id where a.event_id in (select id from l) group by 1, 2 order by 3 desc, 1, 2 limit 20")
def recent_pairs(spark, sf):
    return A.recent_pairs(graph(spark, sf))


@query("select (coalesce(max(order_index), -1) + 1) as next_index, max(id) as last_event from ev where domain = 'P'")
def next_order_index(spark, sf):
    return A.next_order_index(graph(spark, sf), "P")


@query("select case when n <= 4 then 'seed' when n <= 9 then 'sprout' when n <= 19 then 'established' else 'core' end as stage, count(*) as n from (select o_custkey, count(*) as n from orders group by 1) group by 1", prelude=False)
def context_stage_counts(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.groupBy(A.stage_of(F.col("n")).alias("stage")).agg(F.count("*").alias("n"))


@query("select count(*) filter (where embedding is null) as events_missing, (select count(*) from part) as entities_missing from events left join embeddings on vec_id = event_id", prelude=False)
def missing_vectors(spark, sf):
    e = table(spark, sf, "events").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding"), "event_id", "left").withColumn("summary", F.col("event_type"))
    g = graph(spark, sf)
    return A.missing_vectors(g.with_tables(events=e, entities=g.entities.withColumn("embedding", F.lit(None).cast("array<float>"))))


@query(f"select user_id, {WHEN} as month, count(*) as n, count(*) filter (where event_type = 'purchase') as n_failed from events group by 1, 2", prelude=False)
def monthly_usage(spark, sf):
    return A.monthly_usage(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "purchase")


@query("select event_id, user_id, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as delta from events", prelude=False)
def lag_drift(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return A.deltas(e, "user_id", "at", "value").select("event_id", "user_id", F.round("delta", 6).alias("delta"))


@query("""select user_id, gap_days from (select user_id, round((epoch_us(ts) - epoch_us(lag(ts) over w)) / 86400e6, 1) as gap_days, row_number() over (partition by user_id order by ts desc) as r from events window w as (partition by user_id order by ts)) where r = 1 and gap_days is not null
order by gap_days desc, user_id limit 20""", prelude=False)
def returning_entities(spark, sf):
    return A.returning(table(spark, sf, "events"), "user_id", "ts")


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1", prelude=False)
def latest_per_key(spark, sf):
    return lookup.newest_per_key(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("select * from (select conv_id * 1000 + turn as prev_id, lead(conv_id * 1000 + turn) over (partition by conv_id order by turn) as next_id, 'thread' as source from conversations) where next_id is not null", prelude=False)
def sequential_edges(spark, sf):
    c = table(spark, sf, "conversations").withColumn("node", F.col("conv_id") * 1000 + F.col("turn"))
    return A.chain_edges(c, "conv_id", ["turn"], "node")


@query("""select doc_id, case when r > 1 then base || '#' || (r - 1) else base end as segment_key from (select doc_id, base, row_number() over (partition by doc_id % 20, base order by doc_id) as r from (
select doc_id, case when doc_id % 3 = 0 then 'H' || doc_id % 5 when doc_id % 3 = 1 then 'slide_' || doc_id % 7 else 'segment_' || doc_id end as base from documents))""", prelude=False)
def segment_key_dedup(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    seg = d.select("doc_id", (i % 20).alias("file_path"), F.when(i % 3 == 0, F.concat(F.lit("H"), (i % 5).cast("string"))).alias("heading"), F.when(i % 3 == 1, i % 7).alias("slide"), F.lit(None).cast("int").alias("page"), i.alias("segment_index"))
    return A.segment_keys(seg).select("doc_id", "segment_key")


# Vectors.

Q = "(select cast(embedding as double[]) from embeddings where vec_id = 0)"
SCORE = f"list_cosine_similarity(cast(embedding as double[]), {Q})"


def probe(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


@query(f"select vec_id as id, round({SCORE}, 6) as score from embeddings order by {SCORE} desc, vec_id limit 10", prelude=False)
def knn_events(spark, sf):
    return V.knn(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), probe(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(f"select vec_id as id, round({SCORE}, 6) as score from embeddings where label in (1, 2) order by {SCORE} desc, vec_id limit 10", prelude=False)
def knn_scoped(spark, sf):
    return V.knn(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id").where("label in (1, 2)"), probe(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(f"select vec_id as id, round({SCORE}, 6) as score from embeddings where {SCORE} >= 0.2 order by {SCORE} desc, vec_id limit 30", prelude=False)
def knn_threshold(spark, sf):
    return V.knn(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id"), probe(spark, sf), 30, 0.2).select("id", F.round("score", 6).alias("score"))


@query("""select query_id, id, round(s, 6) as score from (select q.vec_id as query_id, e.vec_id as id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as s,
row_number() over (partition by q.vec_id order by list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) desc, e.vec_id) as r from embeddings q, embeddings e where q.vec_id < 40) where r <= 5""", prelude=False)
def knn_batch(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return V.knn_many(e, e.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 5).select("query_id", "id", F.round("score", 6).alias("score"))


HYBRID = f""", c as ((select 'event' as kind, cast(vec_id as varchar) as id, {SCORE} as s from embeddings where label < 5 order by s desc, vec_id limit 11)
union all (select 'entity', cast(vec_id as varchar), {SCORE} as s from embeddings where label >= 5 order by s desc, vec_id limit 11)), r as (select *, row_number() over (order by s desc, kind, id) as rank from c) """


def halves(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return e.where("label < 5"), e.where("label >= 5")


@query(HYBRID + "select kind, id, round(s, 6) as score, rank, coalesce((select max(s) from r where rank > 20) >= 0.8 * (select min(s) from r where rank <= 20), false) as more_available from r where rank <= 20")
def hybrid_search(spark, sf):
    return V.hybrid(*halves(spark, sf), probe(spark, sf)).withColumn("score", F.round("score", 6))


@query(HYBRID + "select kind, id, round(s, 6) as score, rank, cast(11 as bigint) as next_start from r where rank between 3 and 10")
def search_window(spark, sf):
    return V.search_window(*halves(spark, sf), probe(spark, sf), 3, 8, "hybrid").withColumn("score", F.round("score", 6))


MEANS = """with x as (select user_id as k, generate_subscripts(embedding, 1) as pos, cast(unnest(embedding) as double) as v from embeddings join events on event_id = vec_id),
m as (select k, pos, avg(v) as m, count(*) as n from x group by 1, 2), c as (select k, sqrt(sum(m * m)) as coherence, max(n) as n from m group by 1) """


@query(MEANS + "select k as user_id, n, round(coherence, 6) as coherence from c where coherence > 0", prelude=False)
def centroid_coherence(spark, sf):
    return A.centroids(vector_events(spark, sf), "user_id").select("user_id", "n", F.round("coherence", 6).alias("coherence"))


@query(MEANS + "select m.k as user_id, cast(pos - 1 as int) as pos, round(m / coherence, 6) as x from m join c on m.k = c.k where coherence > 0", prelude=False)
def entity_centroid(spark, sf):
    return A.centroids(vector_events(spark, sf), "user_id").select("user_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(MEANS.replace("user_id as k", "label as k") + "select k as label, cast(pos - 1 as int) as pos, round(m, 6) as x from m", prelude=False)
def segment_centroid(spark, sf):
    return A.mean_vectors(table(spark, sf, "embeddings"), "label").select("label", F.posexplode("mean").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""select vec_id as id, round(1 - s, 6) as score, case when 1 - s >= 0.7 then 'high' when 1 - s >= 0.4 then 'medium' when 1 - s >= 0.2 then 'low' else 'aligned' end as band from (select vec_id, """ + SCORE + " as s from embeddings)", prelude=False)
def tension(spark, sf):
    e = table(spark, sf, "embeddings")
    from ..functions.vectors import literal_vector

    return e.select(F.col("vec_id").alias("id"), V.tension(F.col("embedding"), literal_vector(probe(spark, sf))).alias("t")).select("id", F.round("t.score", 6).alias("score"), "t.band")


@query("select id, name from ent order by age desc, id desc limit 10")
def newest_entities(spark, sf):
    return V.newest(graph(spark, sf).entities).select("id", "name")


@query("select id, null::double as score, (select count(*) from pi where event_id = evl.id) as n_entities from evl where domain = 'O' order by order_index desc, id desc limit 20")
def filtered_recent(spark, sf):
    g = graph(spark, sf)
    return V.filtered_search(g, lookup.event_filter(g, domain="O"))


# Graph.

@query(""", recursive_edges as (select a_id as s, b_id as d from conn union all select b_id, a_id from conn), h1 as (select distinct d from recursive_edges where s = 1 and d <> 1),
h2 as (select distinct d from recursive_edges where s in (select d from h1) and d <> 1 and d not in (select d from h1)) select d as id, 1 as depth from h1 union all select d, 2 from h2""")
def khop(spark, sf):
    return T.k_hop(graph(spark, sf).entity_connection, spark.createDataFrame([(1,)], "id long"), 2)


@query("""select id as dst, kind as dst_kind, rel, 1 as hop from (select cast(entity_id as varchar) as id, 'entity' as kind, 'participated_in' as rel from pi where event_id = 3 union all select group_id, 'group', 'event_member_of' from mo where event_id = 3
union all select cast(next_id as varchar), 'event', 'event_sequential_next' from nx where prev_id = 3 union all select cast(prev_id as varchar), 'event', 'event_sequential_next' from nx where next_id = 3)""")
def neighbors_typed(spark, sf):
    g = graph(spark, sf)
    return T.neighbours(T.typed_edges(g.with_tables(entity_connection=g.entity_connection.where("false"))), 3, "event").select("dst", "dst_kind", "rel", "hop")


@query("""select 2 as hops, 'entity:' || a.entity_id || '>event:' || a.event_id || '>entity:' || b.entity_id as path from pi a join pi b using (event_id)
where a.entity_id = (select min(a_id) from conn) and b.entity_id = (select min(b_id) from conn where a_id = (select min(a_id) from conn)) order by path limit 10""")
def paths_2hop(spark, sf):
    g = graph(spark, sf)
    a, b = g.entity_connection.agg(F.min(F.struct("a_id", "b_id")).alias("p")).select("p.a_id", "p.b_id").first()
    edges = T.typed_edges(g.with_tables(entity_connection=g.entity_connection.where("false"))).where("rel = 'participated_in'")
    return T.paths(edges, (a, "entity"), (b, "entity"), 2)


@query("select case when a_id = 2 then b_id else a_id end as neighbour, event_count as weight from conn where a_id = 2 or b_id = 2 order by 2 desc, 1 limit 30")
def ego_graph(spark, sf):
    return T.ego_ranked(graph(spark, sf), 2)


@query(", n as (select 1 as id union select b_id from conn where a_id = 1 union select a_id from conn where b_id = 1) select a_id, b_id, event_count from conn where a_id in (select id from n) and b_id in (select id from n)")
def ego_subgraph(spark, sf):
    return T.ego_subgraph(graph(spark, sf), 1)


@query("select distinct event_id from mo where group_id in (select id from grp where id = 'r1' or parent_id = 'r1')")
def tag_subtree_events(spark, sf):
    return T.subtree_events(graph(spark, sf), "r1")


@query("select distinct entity_id from pi where event_id in (select event_id from mo where group_id in (select id from grp where id = 'r2' or parent_id = 'r2'))")
def tag_subtree_entities(spark, sf):
    return T.subtree_entities(graph(spark, sf), "r2")


@query("select id, cast(case when parent_id is null then 0 else 1 end as int) as level from grp")
def tag_levels(spark, sf):
    return T.tree_levels(graph(spark, sf).groups)


@query("select id, coalesce(parent_id, id) as root from grp")
def tag_roots(spark, sf):
    return T.root_map(graph(spark, sf).groups)


@query("select id, cast(case when id = 'n5' then 0 else 1 end as int) as distance from grp where id = 'n5' or id = (select parent_id from grp where id = 'n5')")
def tag_ancestors(spark, sf):
    return T.ancestors(graph(spark, sf).groups, "n5")


@query("select id, cast(row_number() over (order by o_orderdate, id) - 1 as int) as place from (select o_orderkey as id, o_orderdate from orders where o_custkey = (select o_custkey from orders where o_orderkey = (select min(prev_id) from nx))) where (o_orderdate, id) >= ((select o_orderdate from orders where o_orderkey = (select min(prev_id) from nx)), (select min(prev_id) from nx))")
def plan_chain(spark, sf):
    g = graph(spark, sf)
    return T.chain(g.event_sequential_next, g.event_sequential_next.agg(F.min("prev_id")).first()[0], "prev_id", "next_id")


@query("select p_partkey as id, (p_partkey % 16) as canonical from part where p_partkey >= 16", prelude=False)
def alias_resolution(spark, sf):
    p = table(spark, sf, "part").where("p_partkey >= 16")
    return T.resolve_aliases(p.select(F.col("p_partkey").alias("entity_id_a"), F.when(F.col("p_partkey") < 32, F.col("p_partkey") % 16).otherwise(16 + F.col("p_partkey") % 16).alias("entity_id_b")))


@query(""", s as (select conv_id * 1000 + turn as id, conv_id, turn, turn - row_number() over (partition by conv_id order by turn) as island from conversations where turn % 4 <> 3),
c as (select *, count(*) over (partition by conv_id, island) as n, min(id) over (partition by conv_id, island) as thread from s) select id, thread from c where n >= 2""")
def threads(spark, sf):
    c = table(spark, sf, "conversations").withColumn("node", F.col("conv_id") * 1000 + F.col("turn"))
    return T.threads(A.chain_edges(c, "conv_id", ["turn"], "node"), c.where("turn % 4 <> 3").select("node"))


@query(", d as (select entity_id, count(*) as n from pi group by 1), k as (select id from ent where not deprecated and user_tag is null) select a_id, b_id, round(event_count / (x.n + y.n - event_count), 6) as weight from conn join d x on x.entity_id = a_id join d y on y.entity_id = b_id where a_id in (select id from k) and b_id in (select id from k)")
def entity_weights(spark, sf):
    return T.entity_graph(graph(spark, sf)).select("a_id", "b_id", F.round("weight", 6).alias("weight"))


@query("select o_orderkey as id, min(o_orderkey) over (partition by o_custkey) as component from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) > 1)", prelude=False)
def components(spark, sf):
    """Orders linked by the next order of their customer: a customer's orders are one component."""
    return T.components(graph(spark, sf).event_sequential_next.select(F.col("prev_id").alias("a_id"), F.col("next_id").alias("b_id")))


@query(""", e as (select a_id, b_id, event_count as w from conn), m as (select sum(w) as m from e),
win as (select x.domain as c, sum(w) as w from e join ent x on x.id = a_id join ent y on y.id = b_id where x.domain = y.domain group by 1),
deg as (select domain as c, sum(w) as d from (select a_id as id, w from e union all select b_id, w from e) join ent using (id) group by 1)
select round(sum(coalesce(win.w, 0) / m - pow(d / (2 * m), 2)), 6) as modularity from deg left join win using (c), m""")
def modularity_given_labels(spark, sf):
    """Modularity of the parts' co-occurrence under their brands."""
    g = graph(spark, sf)
    edges = g.entity_connection.select("a_id", "b_id", F.col("event_count").cast("double").alias("weight"))
    return C.modularity(edges, g.entities.select("id", F.col("domain").alias("community"))).select(F.round("modularity", 6).alias("modularity"))


def strong_pairs(spark, sf):
    g = graph(spark, sf)
    return T.entity_graph(g.with_tables(entity_connection=g.entity_connection.where("event_count >= 2")))


@query()
def leiden_events(spark, sf):
    return C.cluster(strong_pairs(spark, sf))


@query(""", k as (select id from ent where not deprecated and user_tag is null), e as (select a_id, b_id from conn where event_count >= 2 and a_id in (select id from k) and b_id in (select id from k))
select (select count(*) from (select a_id from e union select b_id from e)) as nodes, true as beats_single_nodes, true as beats_one_community""")
def leiden_quality(spark, sf):
    """All nodes have a community, and modularity is above that of single nodes and of one community for all, which is 0."""
    edges = written(strong_pairs(spark, sf), "pairs")
    label = written(C.cluster(edges), "communities")
    alone = C.modularity(edges, label.select("id", F.col("id").alias("community"))).toDF("alone")
    return C.modularity(edges, label).crossJoin(alone).crossJoin(label.agg(F.count("*").alias("nodes"))).select("nodes", (F.col("modularity") > F.col("alone")).alias("beats_single_nodes"), (F.col("modularity") > 0).alias("beats_one_community"))


# Communities given by the vectors' labels, tags by event type.

def labelled(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("community"))


def tagged_graph(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("group_id"))
    groups = e.select("group_id").distinct().select(F.col("group_id").alias("id"), F.col("group_id").alias("name"), F.lit("forced").alias("source"), F.lit(False).alias("deprecated"))
    return graph(spark, sf).with_tables(event_member_of=e, groups=groups)


@query("select count(*) as n_communities, cast(sum(n) as bigint) as members, max(n) as largest, min(n) as smallest, round(avg(n), 2) as mean_size, median(n) as median_size, count(*) filter (where n = 1) as singletons, round(max(n) / sum(n), 4) as largest_share from (select label, count(*) as n from embeddings group by 1)", prelude=False)
def community_sizes(spark, sf):
    return C.size_stats(labelled(spark, sf))


@query("select label as community, event_type as group_id, event_type as name, 'forced' as source, count(*) as n from embeddings join events on event_id = vec_id group by 1, 2", prelude=False)
def community_tag_crosstab(spark, sf):
    return C.crosstab(labelled(spark, sf), tagged_graph(spark, sf))


@query("""with t as (select label as c, event_type as g, count(*) as n from embeddings join events on event_id = vec_id group by 1, 2), s as (select sum(n) as t from t), x as (select c, sum(n) as n from t group by 1), y as (select g, sum(n) as n from t group by 1),
v as (select (select sum(t.n / s.t * ln(t.n * s.t / (x.n * y.n))) from t join x using (c) join y using (g), s) as i, (select -sum(n / t * ln(n / t)) from x, s) as hc, (select -sum(n / t * ln(n / t)) from y, s) as ht)
select round(2 * i / (hc + ht), 4) as nmi, round(1 - 2 * i / (hc + ht), 4) as residual, round(greatest(hc - i, 0), 4) as h_c_given_t from v""", prelude=False)
def nmi(spark, sf):
    return C.mutual_information(C.crosstab(labelled(spark, sf), tagged_graph(spark, sf)))


@query("""with t as (select label as c, event_type as g, count(*) as n from embeddings join events on event_id = vec_id group by 1, 2), s as (select c, sum(n) as t from t group by 1),
r as (select *, row_number() over (partition by c order by n desc, g) as r from t), d as (select c, round(max(case when r = 1 then n end) / any_value(t), 4) as f, round(coalesce(max(case when r = 2 then n end), 0) / any_value(t), 4) as s from r join s using (c) group by 1)
select c as community, 'cross_label_bridge' as mode, s as score from d where s >= 0.15 union all select c, 'label_anomaly', round(1 - f, 4) from d where 1 - f >= 0.3""", prelude=False)
def residual_modes(spark, sf):
    a = labelled(spark, sf)
    return C.residuals(a, C.crosstab(a, tagged_graph(spark, sf)))


@query()
def explore_hints(spark, sf):
    a = labelled(spark, sf)
    return C.hints(a, C.crosstab(a, tagged_graph(spark, sf)), 0.1)


@query("select community, size, rank, id from (select label as community, count(*) over (partition by label) as size, row_number() over (partition by label order by ts desc, vec_id desc) as rank, vec_id as id from embeddings join events on event_id = vec_id) where rank <= 3", prelude=False)
def community_samples(spark, sf):
    e = vector_events(spark, sf).select("id", F.col("event_type").alias("summary"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("ts").alias("created_at"))
    return C.samples(labelled(spark, sf), e)


@query("select label as community, count(*) as size, string_agg(cast(vec_id as varchar), ',' order by vec_id) filter (where r <= 8) as top_members from (select label, vec_id, row_number() over (partition by label order by vec_id) as r from embeddings) group by 1", prelude=False)
def community_members(spark, sf):
    g = graph(spark, sf)
    return C.members(labelled(spark, sf), g.with_tables(participated_in=g.participated_in.where("false")))


@query("""select id, string_agg(tag, ',' order by tag) as tags from (select distinct h.id, tag from (select vec_id as id, label from embeddings where vec_id < 12) h join (
select id, 'shared-category' as tag from (select event_id as id, count(*) over (partition by event_type) as n from events where event_id < 12) where n >= 2
union all select id, 'shared-cluster-' || label from (select vec_id as id, label, count(*) over (partition by label) as n from embeddings where vec_id < 12) where n >= 2) t using (id)) group by 1""", prelude=False)
def connection_map_tags(spark, sf):
    g = tagged_graph(spark, sf)
    none = {n: getattr(g, n).where("false") for n in ("participated_in", "entity_connection", "event_sequential_next")}
    hits = spark.range(12).toDF("id")
    none["event_jaccard_connected"] = none["entity_connection"].select("a_id", "b_id")
    return connections.connection_tags(g.with_tables(**none), hits, labelled(spark, sf)).where("tags <> ''")
