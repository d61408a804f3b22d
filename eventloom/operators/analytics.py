"""Aggregations and windows: counts, co-occurrence, set similarity, centroids, hubs, usage and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import source_axis
from ..functions.vectors import norm
from ..graph import EventGraph
from ..shared import counted_write, dealt, written
from .lookup import event_filter, newest_per_key


def event_counts(g: EventGraph, ids: DataFrame) -> DataFrame:
    """Events per requested entity, zero where there are none."""
    wanted = ids.toDF("entity_id").distinct()
    n = g.participated_in.join(wanted, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("n_events"))
    return wanted.join(n, "entity_id", "left").select("entity_id", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def statistics(g: EventGraph) -> DataFrame:
    """Rows per kind, deleted ones included."""
    one = lambda name: getattr(g, name).agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return one("entities").union(one("events")).union(one("groups")).union(one("context_groups"))


def entities_by_count(g: EventGraph, q: str = "", least: int = 0, most: int | None = None, limit: int = 50, without_stopwords: bool = False) -> DataFrame:
    e = g.live("entities").where(F.contains(F.lower("name"), F.lit(q.lower())))
    if without_stopwords:
        e = e.where(F.coalesce("user_tag", F.lit("")) != "stopword")
    n = g.participated_in.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    out = e.select("id", "name").join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_events")).where(F.col("n_events") >= least)
    return (out if most is None else out.where(F.col("n_events") <= most)).orderBy(F.desc("n_events"), "name", "id").limit(limit)


def cooccurring(g: EventGraph, entity_ids: list, events: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Entities in the live events that hold all of ``entity_ids``, these excluded: ``entity_id, n``."""
    events = event_filter(g, entity_ids=entity_ids) if events is None else events
    rows = g.participated_in.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").where(~F.col("entity_id").isin(entity_ids))
    return rows.groupBy("entity_id").agg(F.count_distinct("event_id").alias("n")).orderBy(F.desc("n"), "entity_id").limit(limit)


def event_pairs(participation: DataFrame, least: int = 2, below: int = 50, rows: int | None = None) -> DataFrame:
    """``a_id, b_id`` for each event of ``least`` to ``below - 1`` entities and each pair of them.

    Events are counted first, so an event of very many entities is never gathered; of the others, at most ``below`` ids
    form one array and pairs are made row by row. Where the number of ``rows`` is known, they are dealt by event once for
    all of that, in tasks of a fixed size.
    """
    part = participation.select("event_id", "entity_id")
    part = (part if rows is None else dealt(part, rows, "event_id")).distinct()
    few = part.groupBy("event_id").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") < below)).select("event_id")
    whole = part.join(few, "event_id", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_list("entity_id")).alias("all"))
    return each_two(whole).select(F.col("x").alias("a_id"), F.col("y").alias("b_id"))


def each_two(whole: DataFrame) -> DataFrame:
    """``x, y`` for each two elements of the arrays ``all``, in their order."""
    first = whole.select("all", F.posexplode("all").alias("at", "x"))
    return first.select("x", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("y"))


def cooccurrence_edges(participation: DataFrame, least: int = 2, below: int = 50, rows: int | None = None) -> DataFrame:
    """``a_id, b_id, event_count`` over events of ``least`` to ``below - 1`` entities; counts combine map-side."""
    return event_pairs(participation, least, below, rows).groupBy("a_id", "b_id").agg(F.count("*").alias("event_count"))


def add_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Accumulate: stored counts plus those of new events."""
    return stored.unionByName(new).groupBy("a_id", "b_id").agg(F.sum("event_count").alias("event_count"))


def degree_capped(edges: DataFrame, key: str, cap: int | None) -> DataFrame:
    """Edges of keys with at most ``cap`` of them: what hubs link says little. The window splits no key: a key over the cap is only counted."""
    if cap is None:
        return edges
    keep = edges.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") <= cap).select(key)
    return edges.join(keep, key, "left_semi")


#: An event of up to ``WIDE`` keys takes its whole set along; a key of more than ``HUB`` events is paired block by block.
WIDE, HUB = 64, 4_000


def counted_overlaps(members: DataFrame, key: str, cap: int | None, candidates: DataFrame) -> DataFrame:
    """``a, b, inter, uni`` of the event pairs with one of ``candidates`` (event_id) that share a ``key``: pairs are shuffled to be counted."""
    found = written(members.select("event_id", key).distinct(), "members")
    n = found.count()
    kept = degree_capped(dealt(found, n, key), key, cap)
    size = kept.groupBy("event_id").agg(F.count("*").alias("size"))
    kept = written(dealt(kept, n, "event_id").join(size, "event_id").select("event_id", key, "size"), "sized")
    end = lambda df, c: df.select(F.col("event_id").alias(c), key, F.col("size").alias(f"n{c}"))
    pairs = end(kept.join(candidates, "event_id", "left_semi"), "x").join(end(kept, "y"), key).where("x <> y")
    flip = lambda x, y: F.when(F.col("x") < F.col("y"), F.col(x)).otherwise(F.col(y))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), key, flip("nx", "ny").alias("na"), flip("ny", "nx").alias("nb")).distinct()
    inter = pairs.groupBy("a", "b").agg(F.count("*").alias("inter"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    return inter.select("a", "b", "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("uni"))


def mask(keys: str) -> Column:
    """64 bits that tell most sets without a common key apart, which spares looking at the sets."""
    return F.expr(f"aggregate({keys}, 0L, (m, k) -> m | shiftleft(1L, cast(pmod(xxhash64(k), 64) as int)))")


def pairs_of_key(rows: DataFrame, n: int, hubs: DataFrame | None, order: str) -> DataFrame:
    """Each two of ``rows`` (e, key and more) of one key, ``a.e < b.e``, as columns ``a_*`` and ``b_*``.

    The rows of a hub (``hubs``: key, cells) lie in blocks, and every two blocks are a key of their own, so no task gets the square of a hub.
    """
    on = ["key"]
    ends = [rows, rows]
    if hubs is not None:
        rows = rows.join(F.broadcast(hubs), "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        block, every = F.pmod(F.xxhash64(order), "cells").cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
        ends = [rows.withColumn("i", block).withColumn("j", every), rows.withColumn("j", block).withColumn("i", every)]
        on, ends = ["key", "i", "j"], [e.drop("cells") for e in ends]
    a, b = (dealt(e, n, *on).select(*on, *(F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in (*on, "cells"))) for e, side in zip(ends, "ab", strict=True))
    return a.join(b, on).where(F.col(f"a_{order}") < F.col(f"b_{order}"))


def linked_sets(channels: dict[str, tuple[DataFrame, str, int | None]]) -> tuple[DataFrame | None, list[str]]:
    """``a, b`` and ``inter_c, uni_c`` of each channel c that has members, for all event pairs that share a key in any channel, and those channels.

    ``channels`` has ``members, key, cap``; members over the cap leave candidates and set sizes alike. Events meet at their keys and
    bring their sets along, as those below and above the key, so a pair is told and its overlap counted where it meets at its
    first common key, and no pair is ever shuffled. Pairs with an event of more than ``WIDE`` keys are counted instead.
    """
    sets, rows, wide, hubs = None, {}, False, {}
    for c, (members, key, cap) in channels.items():
        found, seen = counted_write(members.select("event_id", F.col(key).alias("key")).distinct(), "members", n=F.count("*"))
        n = seen["n"]
        by_event = dealt(degree_capped(dealt(found, n, "key"), "key", cap), n, "event_id")
        size = by_event.groupBy("event_id").agg(F.count("*").alias("n"))
        small = F.collect_list(F.when(F.col("n") <= WIDE, F.col("key")))  # of a wide event nothing is gathered
        own, seen = counted_write(by_event.join(size, "event_id").groupBy("event_id", "n").agg(F.sort_array(small).alias("keys")), "sets", n=F.sum("n"), most=F.max("n"))
        if not seen["n"]:
            continue
        rows[c], wide = seen["n"], wide or seen["most"] > WIDE
        if cap is None or cap > HUB:
            hub = written(found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("key", F.ceil(F.col("n") / HUB).cast("int").alias("cells")), "hubs")
            hubs[c] = None if hub.isEmpty() else hub
        own = own.select(F.col("event_id").alias("e"), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}"))
        sets = own if sets is None else sets.join(own, "e", "full_outer")
    if not rows:
        return None, []
    if len(rows) > 1:
        sets = written(sets.select("e", *(f for c in rows for f in (F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}"), F.coalesce(f"keys_{c}", F.array().cast(sets.schema[f"keys_{c}"].dataType)).alias(f"keys_{c}")))), "sets")
    whole = sets.where(" and ".join(f"n_{c} <= {WIDE}" for c in rows)) if wide else sets
    out = None
    for k, c in enumerate(rows):
        done, later = list(rows)[:k], list(rows)[k + 1 :]
        at = whole.select("e", *(f"n_{d}" for d in rows), *(f"keys_{d}" for d in (*done, *later)), f"keys_{c}", F.posexplode(f"keys_{c}").alias("at", "key"))
        at = at.withColumn("below", F.slice(f"keys_{c}", F.lit(1), F.col("at"))).withColumn("above", F.slice(f"keys_{c}", F.col("at") + 2, F.size(f"keys_{c}"))).drop("at", f"keys_{c}")
        sides = ["below", "above", *(f"keys_{d}" for d in (*done, *later))]
        met = pairs_of_key(at.select("*", *(mask(x).alias(f"mask_{x}") for x in sides)), rows[c], hubs.get(c), "e")
        apart = lambda x: F.col(f"a_mask_{x}").bitwiseAND(F.col(f"b_mask_{x}")) == 0
        for none in ("below", *(f"keys_{d}" for d in done)):  # it has not been met before
            met = met.where(apart(none) | ~F.arrays_overlap(f"a_{none}", f"b_{none}"))
        common = lambda x: F.when(apart(x), 0).otherwise(F.size(F.array_intersect(f"a_{x}", f"b_{x}")))
        inter = {d: F.lit(0) if d in done else 1 + common("above") if d == c else common(f"keys_{d}") for d in rows}
        one = met.select(F.col("a_e").alias("a"), F.col("b_e").alias("b"), *(inter[d].cast("long").alias(f"inter_{d}") for d in rows), *((F.col(f"a_n_{d}") + F.col(f"b_n_{d}")).alias(f"sum_{d}") for d in rows))
        one = one.select("a", "b", *(f for d in rows for f in (f"inter_{d}", (F.col(f"sum_{d}") - F.col(f"inter_{d}")).alias(f"uni_{d}"))))
        out = one if out is None else out.unionByName(one)
    if wide:
        ids = written(sets.where(" or ".join(f"n_{c} > {WIDE}" for c in rows)).select(F.col("e").alias("event_id")), "wide")
        counted = None
        for c in rows:
            members, key, cap = channels[c]
            one = counted_overlaps(members, key, cap, ids).select("a", "b", F.col("inter").alias(f"inter_{c}"), F.col("uni").alias(f"uni_{c}"))
            counted = one if counted is None else counted.join(one, ["a", "b"], "full_outer")
        out = out.unionByName(counted.na.fill(0, [f"{x}_{c}" for c in rows for x in ("inter", "uni")]))
    return out, list(rows)


def set_overlaps(members: DataFrame, key: str, cap: int | None, candidates: DataFrame | None = None) -> DataFrame:
    """``a, b, inter, uni`` of all event pairs that share a ``key``, or of those with one of ``candidates``; members over the cap leave candidates and set sizes alike."""
    if candidates is not None:
        return counted_overlaps(members, key, cap, candidates)
    out, _ = linked_sets({"s": (members, key, cap)})
    if out is None:
        kind = members.schema["event_id"].dataType.simpleString()
        return members.sparkSession.createDataFrame([], f"a {kind}, b {kind}, inter long, uni long")
    return out.select("a", "b", F.col("inter_s").alias("inter"), F.col("uni_s").alias("uni"))


def similar(part: DataFrame, tags: DataFrame, entity_cap: int | None, group_cap: int | None, theta_group: float, least_group: int, only: DataFrame | None = None) -> DataFrame:
    """Similarity edges of events by the entities and the groups that they hold."""
    if only is None:
        both, found = linked_sets({"e": (part, "entity_id", entity_cap), "t": (tags, "group_id", group_cap)})
        kind = part.schema["event_id"].dataType.simpleString()
        both = part.sparkSession.createDataFrame([], f"a {kind}, b {kind}") if both is None else both
        shared = lambda c: F.col(f"inter_{c}") if c in found else F.lit(0).cast("long")
        share = lambda c: F.when(F.col(f"inter_{c}") > 0, F.col(f"inter_{c}") / F.col(f"uni_{c}")) if c in found else F.lit(None).cast("double")
        both = both.select("a", "b", shared("e").alias("ei"), share("e").alias("ej"), shared("t").alias("gi"), share("t").alias("gj"))
    else:
        e = set_overlaps(part, "entity_id", entity_cap, only).select("a", "b", F.col("inter").alias("ei"), (F.col("inter") / F.col("uni")).alias("ej"))
        t = set_overlaps(tags, "group_id", group_cap, only).select("a", "b", F.col("inter").alias("gi"), (F.col("inter") / F.col("uni")).alias("gj"))
        both = e.join(t, ["a", "b"], "full_outer")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    out = both.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), zero("ej", 0.0).alias("entity_jaccard"), zero("gj", 0.0).alias("group_jaccard"), zero("ei", 0).alias("entity_intersection"), zero("gi", 0).alias("group_intersection"))
    return out.where((F.col("entity_jaccard") > 0) | ((F.col("group_jaccard") >= theta_group) & (F.col("group_intersection") >= least_group)))


def jaccard_edges(g: EventGraph, domain: str | None = None, theta_group: float = 0.3, least_group: int = 2, entity_cap: int | None = 200, group_cap: int | None = 200, stop_groups: list | None = None, only: DataFrame | None = None) -> DataFrame:
    """``a_id, b_id, entity_jaccard, group_jaccard, entity_intersection, group_intersection`` of linked live events.

    A pair is stored if its entity Jaccard is over 0, or its tag Jaccard reaches ``theta_group`` with ``least_group``
    common tags. ``only`` (``event_id``) restricts to pairs that touch those events: the incremental form, same formula.
    """
    live = g.live("events") if domain is None else g.live("events").where(F.col("domain") == domain)
    ids = live.select(F.col("id").alias("event_id"))
    stop = g.entities.where(F.col("user_tag") == "stopword").select(F.col("id").alias("entity_id"))
    part = g.participated_in.join(ids, "event_id", "left_semi").join(stop, "entity_id", "left_anti")
    tags = g.event_member_of.join(ids, "event_id", "left_semi")
    if stop_groups:
        tags = tags.where(~F.col("group_id").isin(stop_groups))
    return similar(part, tags, entity_cap, group_cap, theta_group, least_group, only)


def jaccard_neighbours(edges: DataFrame, event_id, limit: int = 20) -> DataFrame:
    score = F.greatest("entity_jaccard", "group_jaccard")
    both = edges.where(F.col("a_id") == event_id).select(F.col("b_id").alias("neighbour"), score.alias("score")).union(edges.where(F.col("b_id") == event_id).select("a_id", score))
    return both.orderBy(F.desc("score"), "neighbour").limit(limit)


def hub_sums(g: EventGraph, top: int = 5) -> DataFrame:
    """Entities by the sum of their co-occurrence counts, both ends of an edge counted once each."""
    e = g.entity_connection
    both = e.select(F.col("a_id").alias("entity_id"), "event_count").union(e.select("b_id", "event_count"))
    return both.groupBy("entity_id").agg(F.sum("event_count").alias("weight")).orderBy(F.desc("weight"), "entity_id").limit(top)


def domain_summary(g: EventGraph, domain: str) -> DataFrame:
    """One row: live events and entities, tags, first and last creation."""
    of = lambda name: g.live(name).where(F.col("domain") == domain)
    span = of("events").agg(F.count("*").alias("n_events"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return span.crossJoin(of("entities").agg(F.count("*").alias("n_entities"))).crossJoin(of("groups").agg(F.count("*").alias("n_tags")))


def fullest_events(g: EventGraph, domain: str, top: int = 5) -> DataFrame:
    ids = g.live("events").where(F.col("domain") == domain).select(F.col("id").alias("event_id"))
    return g.participated_in.join(ids, "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("n_entities")).orderBy(F.desc("n_entities"), "event_id").limit(top)


def hub_candidates(g: EventGraph, roots: DataFrame, top: int = 50) -> DataFrame:
    """Entities by event count with their share of all live events, root areas reached, and whether they are stopwords."""
    live = g.live("events").select(F.col("id").alias("event_id"))
    total = live.agg(F.count("*").alias("total"))
    part = g.participated_in.join(live, "event_id", "left_semi")
    n = part.groupBy("entity_id").agg(F.count_distinct("event_id").alias("n_events"))
    area = part.join(g.event_member_of, "event_id").join(roots.toDF("group_id", "root"), "group_id").groupBy("entity_id").agg(F.count_distinct("root").alias("n_roots"))
    out = n.join(area, "entity_id", "left").join(g.entities.select(F.col("id").alias("entity_id"), "name", "user_tag"), "entity_id").crossJoin(total)
    return out.select("entity_id", "name", "n_events", F.round(100 * F.col("n_events") / F.col("total"), 2).alias("df_pct"), F.coalesce("n_roots", F.lit(0)).alias("n_roots"), (F.coalesce("user_tag", F.lit("")) == "stopword").alias("is_stopword")).orderBy(F.desc("n_events"), "entity_id").limit(top)


def scope_tags(g: EventGraph, with_qc: bool = False, top: int = 200) -> DataFrame:
    """Tags whose source may be explored, by distinct events, empty ones included."""
    roles = ["discovery", "qc"] if with_qc else ["discovery"]
    tags = g.live("groups").where(source_axis(F.col("source"))["role"].isin(roles)).select(F.col("id").alias("group_id"), "name")
    n = g.event_member_of.groupBy("group_id").agg(F.count_distinct("event_id").alias("n"))
    return tags.join(n, "group_id", "left").select("group_id", "name", F.coalesce("n", F.lit(0)).alias("n_events")).orderBy(F.desc("n_events"), "group_id").limit(top)


def participants(g: EventGraph, event_id, events: DataFrame | None = None) -> DataFrame:
    """An event's entities and in how many of ``events`` (live ones by default) each takes part."""
    mine = g.participated_in.where(F.col("event_id") == event_id).select("entity_id").distinct()
    ids = (g.live("events") if events is None else events).select(F.col("id").alias("event_id"))
    n = g.participated_in.join(mine, "entity_id", "left_semi").join(ids, "event_id", "left_semi").groupBy("entity_id").agg(F.count_distinct("event_id").alias("n"))
    names = g.entities.select(F.col("id").alias("entity_id"), "name")
    return mine.join(n, "entity_id", "left").join(names, "entity_id", "left").select("entity_id", "name", F.coalesce("n", F.lit(0)).alias("influence")).orderBy(F.desc("influence"), "name")


def recent_pairs(g: EventGraph, latest: int = 100, top: int = 20) -> DataFrame:
    """Entity pairs of the ``latest`` live events, by how many of these they share."""
    last = g.live("events").orderBy(F.desc_nulls_last("order_index"), F.desc("id")).limit(latest).select(F.col("id").alias("event_id"))
    return cooccurrence_edges(g.participated_in.join(last, "event_id", "left_semi")).orderBy(F.desc("event_count"), "a_id", "b_id").limit(top)


def mean_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``key, mean, n`` by a grouped mean per component: partial sums combine map-side, so a key's vectors never meet."""
    parts = rows.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("n"))


def centroids(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """``key, centroid, coherence, n``: unit mean and its length before; no row where that is zero."""
    m = mean_vectors(rows, key, vector).withColumn("coherence", norm(F.col("mean"))).where("coherence > 0")
    return m.select(key, F.transform("mean", lambda x: x / F.col("coherence")).alias("centroid"), "coherence", "n")


def stale_centroids(g: EventGraph, meta: DataFrame) -> DataFrame:
    """Entities whose stored centroid refers to another number of events than there are now."""
    n = g.participated_in.groupBy("entity_id").agg(F.count("*").alias("n"))
    return n.join(meta.select("entity_id", "ref_event_count"), "entity_id", "left").where("ref_event_count is null or ref_event_count <> n").select("entity_id")


def stage_of(events: Column) -> Column:
    return F.when(events <= 4, "seed").when(events <= 9, "sprout").when(events <= 19, "established").otherwise("core")


def missing_vectors(g: EventGraph) -> DataFrame:
    e = g.events.agg(F.count_if(F.col("embedding").isNull() & (F.trim("summary") != "")).alias("events_missing"))
    return e.crossJoin(g.entities.agg(F.count_if(F.col("embedding").isNull()).alias("entities_missing")))


def next_order_index(g: EventGraph, domain: str) -> DataFrame:
    of = g.events.where(F.col("domain") == domain)
    return of.agg((F.coalesce(F.max("order_index"), F.lit(-1)) + 1).alias("next_index"), F.max_by("id", F.struct("order_index", "id")).alias("last_event"))


def monthly_usage(rows: DataFrame, owner: str, at: str, failed: Column) -> DataFrame:
    return rows.groupBy(owner, F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"))


def deltas(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row with the change since the key's row before."""
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(at)))


def returning(rows: DataFrame, key: str, at: str, top: int = 20) -> DataFrame:
    """Keys by the gap in days (1 decimal) between their last two times."""
    w = Window.partitionBy(key).orderBy(at)
    seen = rows.select(key, at, F.lag(at).over(w).alias("before"))
    last = newest_per_key(seen, [key], [F.desc(at), F.desc_nulls_last("before")]).where("before is not null")
    gap = F.round((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 86400e6, 1)
    return last.select(key, gap.alias("gap_days")).orderBy(F.desc("gap_days"), key).limit(top)


def chain_edges(rows: DataFrame, thread: str, order: list[str], node: str, source: str = "thread") -> DataFrame:
    """``prev_id, next_id, source`` of consecutive rows of a thread."""
    w = Window.partitionBy(thread).orderBy(*order)
    return rows.select(F.col(node).alias("prev_id"), F.lead(node).over(w).alias("next_id"), F.lit(source).alias("source")).where("next_id is not null")


def segment_keys(segments: DataFrame) -> DataFrame:
    """Adds ``segment_key``: heading, else ``slide_n``, ``page_n`` or ``segment_index``; repeats in a file get ``#1``, ``#2``."""
    heading = F.when(F.trim("heading") != "", F.trim("heading"))
    base = F.coalesce(heading, F.concat(F.lit("slide_"), F.col("slide").cast("string")), F.concat(F.lit("page_"), F.col("page").cast("string")), F.concat(F.lit("segment_"), F.col("segment_index").cast("string")))
    with_base = segments.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy("file_path", "_base").orderBy("segment_index")) - 1
    return with_base.withColumn("segment_key", F.when(n > 0, F.concat("_base", F.lit("#"), n.cast("string"))).otherwise(F.col("_base"))).drop("_base")
