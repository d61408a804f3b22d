"""Scans, filters and joins: point lookups, pages, searches, contexts and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import EventGraph


def is_live(deprecated: Column | str = "deprecated") -> Column:
    c = F.col(deprecated) if isinstance(deprecated, str) else deprecated
    return ~F.coalesce(c, F.lit(False))


def clamp_top_k(k: int | None) -> int:
    return max(1, min(50, 10 if k is None else int(k)))


def clamp_depth(depth: int | None) -> int:
    return max(0, min(3, 1 if depth is None else int(depth)))


def point(df: DataFrame, key: str, value) -> DataFrame:
    """Row by key; the equality reaches the scan as a pushed filter."""
    return df.where(F.col(key) == F.lit(value))


def pick(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among ``ids`` (its only column). AQE broadcasts the ids if they turn out small."""
    return df.join(ids.toDF(key).distinct(), key, "left_semi")


def page_of(df: DataFrame, order: list[Column], page: int = 1, size: int = 50) -> DataFrame:
    """One page, ordered, with the ``total`` of all pages. ``order`` must end in a unique column."""
    total = df.agg(F.count("*").alias("total"))
    page, size = max(1, page), max(1, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(total)


def scope(df: DataFrame, targets: list[tuple[str, str | None]] | None, member_of: DataFrame | None = None, event_id: str = "id") -> DataFrame:
    """Rows within (domain, tag) targets. None: everything. An empty list resolves to nothing: it fails closed."""
    if targets is None:
        return df
    if not targets:
        return df.where(F.lit(False))
    whole = [d for d, tag in targets if tag is None]
    keep = df.where(F.col("domain").isin(whole)) if whole else None
    for domain, tag in targets:
        if tag is not None:
            of_tag = member_of.where(F.col("group_id") == tag).select(F.col("event_id").alias(event_id)).distinct()
            part = df.where(F.col("domain") == domain).join(of_tag, event_id, "left_semi")
            keep = part if keep is None else keep.unionByName(part)
    return keep.dropDuplicates([event_id])


def visible_to(df: DataFrame, user: str, share_groups: list[str]) -> DataFrame:
    """Public rows, the user's own, and those shared with one of the user's groups."""
    return df.where((F.coalesce("visibility", F.lit("public")) == "public") | (F.col("owner_id") == user) | ((F.col("visibility") == "shared") & F.col("share_group_id").isin(share_groups)))


def vectors(df: DataFrame, domain: str | None = None) -> DataFrame:
    """Live rows that have a vector."""
    out = df.where(F.col("embedding").isNotNull() & is_live())
    return out if domain is None else out.where(F.col("domain") == domain)


def collection_stats(g: EventGraph) -> DataFrame:
    return g.events.agg(F.count("embedding").alias("event_vectors")).crossJoin(g.entities.agg(F.count("embedding").alias("entity_vectors")))


def timeline(g: EventGraph, domain: str, order_by: str = "timestamp", page: int = 1, size: int = 50) -> DataFrame:
    column = order_by if order_by in ("timestamp", "created_at", "order_index", "influence_score") else "timestamp"
    return page_of(g.live("events").where(F.col("domain") == domain), [F.desc_nulls_last(column), F.desc("id")], page, size)


def events_of_entity(g: EventGraph, entity_id, page: int = 1, size: int = 50, include_deleted: bool = False) -> DataFrame:
    edges = g.participated_in.where(F.col("entity_id") == entity_id).select(F.col("event_id").alias("id")).distinct()
    events = g.events if include_deleted else g.live("events")
    return page_of(events.join(edges, "id", "left_semi"), [F.desc_nulls_last("order_index"), F.desc("id")], page, size)


def events_of_tag(g: EventGraph, group_id, page: int = 1, size: int = 50, include_deleted: bool = False) -> DataFrame:
    """Direct members only."""
    edges = g.event_member_of.where(F.col("group_id") == group_id).select(F.col("event_id").alias("id")).distinct()
    events = g.events if include_deleted else g.live("events")
    return page_of(events.join(edges, "id", "left_semi"), [F.desc_nulls_last("order_index"), F.desc("id")], page, size)


def shared_events(g: EventGraph, a, b, limit: int = 50) -> DataFrame:
    of = lambda x: g.participated_in.where(F.col("entity_id") == x).select(F.col("event_id").alias("id")).distinct()
    return g.live("events").join(of(a), "id", "left_semi").join(of(b), "id", "left_semi").orderBy(F.desc_nulls_last("timestamp"), F.desc_nulls_last("order_index"), F.desc("id")).limit(limit)


def event_context(g: EventGraph, events: DataFrame) -> DataFrame:
    """Entity and tag ids of each of ``events`` (``event_id``), comma-joined in order, in two grouped joins."""
    wanted = events.select("event_id").distinct()
    entities = g.participated_in.join(wanted, "event_id", "left_semi").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("entities"))
    tags = g.event_member_of.join(wanted, "event_id", "left_semi").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("group_id")), ",").alias("tags"))
    return wanted.join(entities, "event_id", "left").join(tags, "event_id", "left")


def adjacent(g: EventGraph, events: DataFrame) -> DataFrame:
    """Previous and next existing event of each ``event_id``; the smallest where there are several."""
    there = g.events.select(F.col("id").alias("other"))
    edges = g.event_sequential_next
    before = edges.select(F.col("next_id").alias("event_id"), F.col("prev_id").alias("other")).join(there, "other", "left_semi").groupBy("event_id").agg(F.min("other").alias("prev_event"))
    after = edges.select(F.col("prev_id").alias("event_id"), F.col("next_id").alias("other")).join(there, "other", "left_semi").groupBy("event_id").agg(F.min("other").alias("next_event"))
    return events.select("event_id").join(before, "event_id", "left").join(after, "event_id", "left")


def display_summary(summary: Column, inline_meta: Column, content: Column, width: int = 200) -> Column:
    """An event's summary, or the one in its content's metadata, or the start of its content, or nothing."""
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(full(summary), full(F.get_json_object(inline_meta, "$.event_summary")), full(F.substring(content, 1, width)), F.lit(""))


def event_detail(g: EventGraph, events: DataFrame) -> DataFrame:
    wanted = events.select(F.col("event_id").alias("id")).distinct()
    rows = g.events.join(wanted, "id", "left_semi").join(g.content_store.select("vector_id", "inline_meta"), "vector_id", "left")
    shown = rows.select(F.col("id").alias("event_id"), display_summary(F.col("summary"), F.col("inline_meta"), F.get_json_object("inline_meta", "$.content")).alias("summary"))
    return shown.join(event_context(g, events), "event_id", "left").join(adjacent(g, events), "event_id", "left")


def event_filter(g: EventGraph, domain: str | None = None, start=None, end=None, tag=None, entity_ids: list | None = None, match: str = "and") -> DataFrame:
    """Live events by domain, time range (inclusive, creation time where there is none), tag and entities (all or any)."""
    out = g.live("events")
    when = F.coalesce(F.col("timestamp"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    if start is not None:
        out = out.where(when >= F.lit(start))
    if end is not None:
        out = out.where(when <= F.lit(end))
    if tag is not None:
        out = out.join(g.event_member_of.where(F.col("group_id") == tag).select(F.col("event_id").alias("id")).distinct(), "id", "left_semi")
    if entity_ids:
        hits = g.participated_in.where(F.col("entity_id").isin(entity_ids)).groupBy(F.col("event_id").alias("id")).agg(F.count_distinct("entity_id").alias("n"))
        out = out.join(hits.where(F.col("n") == len(set(entity_ids))) if match == "and" else hits, "id", "left_semi")
    return out


def search_names(df: DataFrame, q: str, domain: str | None = None, limit: int = 5, live: bool = True, by_length: bool = False) -> DataFrame:
    """Rows whose name contains ``q`` in any case. No wildcard has a meaning. Order: (length,) name, id."""
    out = df.where(F.contains(F.lower("name"), F.lit(q.lower())))
    if live:
        out = out.where(is_live())
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    return out.orderBy(*([F.length("name")] if by_length else []), "name", "id").limit(limit)


def autocomplete(g: EventGraph, domain: str, q: str, limit: int = 20, without_stopwords: bool = False) -> DataFrame:
    entities = g.entities if not without_stopwords else g.entities.where(F.coalesce("user_tag", F.lit("")) != "stopword")
    both = [search_names(df, q, domain, limit, by_length=True).select(F.lit(kind).alias("kind"), "id", "name") for kind, df in (("entity", entities), ("tag", g.groups))]
    return both[0].unionByName(both[1])


def group_by_path(g: EventGraph, suffix: str, domain: str) -> DataFrame:
    return g.groups.where((F.col("domain") == domain) & F.col("name").endswith(suffix)).orderBy("name", "id").limit(1)


def by_exact_name(df: DataFrame, names: list[str], domain: str | None = None) -> DataFrame:
    out = df.where(F.col("name").isin(names))
    return out if domain is None else out.where(F.col("domain") == domain)


def summary_mentions(g: EventGraph, name: str, domain: str | None = None, limit: int = 50) -> DataFrame:
    out = g.live("events").where(F.contains(F.lower("summary"), F.lit(name.lower())))
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    return out.orderBy(F.desc_nulls_last(F.coalesce(F.col("timestamp"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))), F.desc("id")).limit(limit)


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(at)).where("_at = 1").drop("_at")


def manifest_evidence(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Per event the newest segment of an active file: ``event_id, file_path, segment_key``."""
    active = files.where("status = 'active'").select("domain", "file_path").distinct()
    return newest_per_key(segments.where("event_id is not null").join(active, ["domain", "file_path"], "left_semi"), ["event_id"], [F.desc("id")]).select("event_id", "file_path", "segment_key")


def live_edges(g: EventGraph, domain: str) -> DataFrame:
    """Co-occurrence edges with both ends live and in the domain, most frequent first."""
    ids = g.live("entities").where(F.col("domain") == domain).select("id")
    a, b = ids.withColumnRenamed("id", "a_id"), ids.withColumnRenamed("id", "b_id")
    return g.entity_connection.join(a, "a_id", "left_semi").join(b, "b_id", "left_semi").orderBy(F.desc("event_count"), "a_id", "b_id").select("a_id", "b_id", "event_count")


def sequential_pairs(g: EventGraph, domain: str) -> DataFrame:
    return g.event_sequential_next.join(g.live("events").where(F.col("domain") == domain).select(F.col("id").alias("prev_id")), "prev_id", "left_semi").select("prev_id", "next_id")


def jaccard_pairs(g: EventGraph, domain: str) -> DataFrame:
    ids = g.live("events").where(F.col("domain") == domain).select("id")
    score = F.greatest(F.coalesce("entity_jaccard", F.lit(0.0)), F.coalesce("group_jaccard", F.lit(0.0)))
    return g.event_jaccard_connected.join(ids.withColumnRenamed("id", "a_id"), "a_id", "left_semi").join(ids.withColumnRenamed("id", "b_id"), "b_id", "left_semi").select("a_id", "b_id", score.alias("score"))


def temporal_flow(g: EventGraph, entity_id=None, domain: str | None = None, group_id=None, days: int | None = None, as_of: str | None = None, limit: int = 50) -> DataFrame:
    """Events of an entity, or of a domain (and tag), oldest first; ``days`` counts back from ``as_of``. Events without a time come last."""
    out = g.events
    if entity_id is not None:
        out = out.join(g.participated_in.where(F.col("entity_id") == entity_id).select(F.col("event_id").alias("id")).distinct(), "id", "left_semi")
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    if group_id is not None:
        out = out.join(g.event_member_of.where(F.col("group_id") == group_id).select(F.col("event_id").alias("id")).distinct(), "id", "left_semi")
    if days is not None:
        out = out.where(F.try_to_timestamp("timestamp") >= F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))
    return out.orderBy(F.asc_nulls_last("timestamp"), "order_index", "id").limit(max(1, min(200, limit)))


def entity_lookup(g: EventGraph, q: str, limit: int = 20, candidates: int = 5) -> DataFrame:
    """Up to five entities whose name contains ``q``, each with its ``limit`` most influential live events."""
    found = search_names(g.entities, q, limit=candidates).select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
    events = g.live("events").select(F.col("id").alias("event_id"), "summary", "influence_score", "order_index")
    rows = g.participated_in.select("entity_id", "event_id").distinct().join(found, "entity_id").join(events, "event_id")
    at = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("influence_score"), F.desc_nulls_last("order_index"), F.desc("event_id"))
    return rows.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= limit)


def context_events(g: EventGraph, context_id) -> DataFrame:
    """Events that belong to a context or template group, in their order. Kinds are compared without padding."""
    edges = g.context_edges.where((F.trim("target_kind") == "CG") & (F.col("target_id") == context_id) & (F.col("rel") == "belongs_to"))
    return g.events.join(edges.select(F.col("source_id").alias("id"), F.col("order_index").alias("place")), "id").orderBy("place", "id")


def review_candidates(g: EventGraph, limit: int = 50) -> DataFrame:
    """Segments (domain, file, key) that have an active and a superseded version, with the influence of the active event."""
    both = g.build_segment_manifest.groupBy("domain", "file_path", "segment_key").agg(
        F.max(F.when(F.col("status") == "active", F.struct("id", "event_id"))).alias("now"), F.max(F.when(F.col("status") == "superseded", F.struct("id", "event_id"))).alias("then")
    ).where("now is not null and then is not null")
    score = g.events.select(F.col("id").alias("event_id"), "influence_score")
    rows = both.select("domain", "file_path", "segment_key", F.col("now.event_id").alias("event_id"), F.col("then.event_id").alias("old_event_id")).join(score, "event_id", "left")
    return rows.orderBy(F.desc_nulls_last("influence_score"), "domain", "file_path", "segment_key").limit(limit)


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, exact_id: str) -> DataFrame:
    """For each left row the right ``value`` of the same key with the latest time not after its own.

    Both sides are stacked and one window carries the last value forward, so the work is a sort by (key, time): no row
    meets more than one other, whatever the history's length. ``exact_id`` identifies left rows.
    """
    l = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.col(exact_id).alias("_id"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema[exact_id].dataType).alias("_id"), F.col(value).alias("_v"))
    at = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn("_last", F.last("_v", ignorenulls=True).over(at)).where("_side = 1").select(F.col("_id").alias(exact_id), *on, F.col("_t").alias(left_time), F.col("_last").alias(value))
