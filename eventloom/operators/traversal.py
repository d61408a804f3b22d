"""Graph and tree operators: hops, typed neighbours, paths, subtrees, levels, chains, aliases, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import EventGraph
from ..shared import counted_write, dealt, discard, written
from . import trees

HOP_CAP = 1000


def undirected(edges: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    return edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(edges.select(F.col(b), F.col(a)))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``id, depth`` of all nodes within ``hops`` (1 to 5) of ``seeds``, each once at its least depth; seeds excluded.

    A frontier join per hop. The edges are written once, from either end, however they are made; a hop reads them and joins only
    new nodes again.
    """
    out = written(undirected(edges), "edges")
    frontier = seeds.toDF("id").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max(1, min(5, hops)) + 1):
        frontier = out.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = written(frontier, "frontier")
        seen = seen.union(frontier.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def typed_edges(g: EventGraph) -> DataFrame:
    """One directed edge list of all relations: ``src, src_kind, dst, dst_kind, rel, direction``. Ids become strings."""
    s = lambda c: F.col(c).cast("string")
    def both(df, a, ak, b, bk, rel):
        one = df.select(s(a).alias("src"), F.lit(ak).alias("src_kind"), s(b).alias("dst"), F.lit(bk).alias("dst_kind"), F.lit(rel).alias("rel"), F.lit("out").alias("direction"))
        two = df.select(s(b).alias("src"), F.lit(bk).alias("src_kind"), s(a).alias("dst"), F.lit(ak).alias("dst_kind"), F.lit(rel).alias("rel"), F.lit("in").alias("direction"))
        return one.union(two)

    parts = [
        both(g.participated_in, "entity_id", "entity", "event_id", "event", "participated_in"),
        both(g.entity_connection, "a_id", "entity", "b_id", "entity", "entity_connection"),
        both(g.event_member_of, "event_id", "event", "group_id", "group", "event_member_of"),
        both(g.event_sequential_next, "prev_id", "event", "next_id", "event", "event_sequential_next"),
        both(g.event_jaccard_connected, "a_id", "event", "b_id", "event", "event_jaccard_connected"),
        both(g.groups.where("parent_id is not null"), "id", "group", "parent_id", "group", "group_parent"),
    ]
    for rel in ("belongs_to", "plan_from", "plan_next"):
        df = g.context_edges.where(F.col("rel") == rel)
        one = df.select(s("source_id"), F.trim("source_kind"), s("target_id"), F.trim("target_kind"), F.lit(rel), F.lit("out"))
        parts += [one, df.select(s("target_id"), F.trim("target_kind"), s("source_id"), F.trim("source_kind"), F.lit(rel), F.lit("in"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def neighbours(edges: DataFrame, node_id, node_kind: str, rel: str = "all", hops: int = 1, per_hop: int = 200, cap: int = HOP_CAP) -> DataFrame:
    """``dst, dst_kind, rel, direction, hop`` of the nodes within ``hops`` (at most 3) by typed edges, first relation by name.

    The caps are part of the operator: a node expands ``per_hop`` edges, ordered by relation and id, and ``cap`` nodes
    are returned, nearest first; ``truncated`` tells whether there were more.
    """
    spark = edges.sparkSession
    edges = edges if rel == "all" else edges.where(F.col("rel") == rel)
    frontier = spark.createDataFrame([(str(node_id), node_kind)], "dst string, dst_kind string")
    seen = frontier.select("dst", "dst_kind", F.lit("").alias("rel"), F.lit("").alias("direction"), F.lit(0).alias("hop"))
    first = Window.partitionBy("src", "src_kind").orderBy("rel", "dst", "dst_kind", "direction")
    one = Window.partitionBy("dst", "dst_kind").orderBy("rel", "direction")
    for hop in range(1, max(1, min(3, hops)) + 1):
        at = frontier.select(F.col("dst").alias("src"), F.col("dst_kind").alias("src_kind"))
        step = edges.join(at, ["src", "src_kind"]).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_hop)
        step = step.withColumn("_m", F.row_number().over(one)).where("_m = 1").select("dst", "dst_kind", "rel", "direction").join(seen, ["dst", "dst_kind"], "left_anti")
        frontier = step.select("dst", "dst_kind")
        seen = seen.union(step.withColumn("hop", F.lit(hop)))
    found = seen.where("hop > 0")
    more = found.agg((F.count("*") > cap).alias("truncated"))
    return found.orderBy("hop", "rel", "dst", "dst_kind").limit(cap).crossJoin(more)


def paths(edges: DataFrame, a: tuple, b: tuple, max_hops: int = 3, limit: int = 10) -> DataFrame:
    """Shortest paths first, up to ``limit``: ``hops, path`` (node ids joined by ``>``). Two frontiers meet in the middle."""
    spark = edges.sparkSession
    step = edges.select(F.concat_ws(":", "src_kind", "src").alias("s"), F.concat_ws(":", "dst_kind", "dst").alias("d")).distinct()
    key = lambda n: f"{n[1]}:{n[0]}"
    max_hops = max(1, min(3, max_hops))
    from_a = [spark.createDataFrame([(key(a), [key(a)])], "at string, path array<string>")]
    from_b = [spark.createDataFrame([(key(b), [key(b)])], "at string, path array<string>")]
    grow = lambda f: f.join(step, f["at"] == step["s"]).where(~F.array_contains("path", F.col("d"))).select(F.col("d").alias("at"), F.concat("path", F.array("d")).alias("path"))
    while len(from_a) + len(from_b) - 2 < max_hops:
        side = from_a if len(from_a) <= len(from_b) else from_b
        side.append(grow(side[-1]))
    out = None
    for i, fa in enumerate(from_a):
        for j, fb in enumerate(from_b):
            if i + j and (j == 0 or i == len(from_a) - 1):
                met = fa.select("at", F.col("path").alias("pa")).join(fb.select("at", F.col("path").alias("pb")), "at").where(F.size(F.array_intersect("pa", "pb")) == 1)
                path = F.concat("pa", F.slice(F.reverse("pb"), F.lit(2), F.greatest(F.size("pb") - 1, F.lit(0))))
                one = met.select(F.lit(i + j).alias("hops"), F.array_join(path, ">").alias("path"))
                out = one if out is None else out.union(one)
    return out.distinct().orderBy("hops", "path").limit(limit)


def shortest_paths(edges: DataFrame, a: tuple, b: tuple, max_hops: int = 3, limit: int = 10) -> DataFrame:
    """``hops, path, ways``: the first ``limit`` of the shortest directed paths from ``a`` to ``b`` (``id, kind``), by their nodes
    in order, and how many there are of that length. Empty if ``max_hops`` do not suffice; from a node to itself takes none.

    Levels grow from the end with the smaller frontier until they meet. Of them only nodes on a shortest path are kept, layer
    by layer, and the ways on to ``b`` are summed backwards. A level keeps the edges it grew by, so ``edges`` are gone through once a
    level and never sorted; links of paths are found among those. Every node kept leads to ``b``, so at no step are more than ``limit``
    beginnings needed: paths are spelled out for what is returned, not for what exists.
    """
    spark = edges.sparkSession
    key = lambda n: f"{n[1]}:{n[0]}"
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    every = keep(edges.select("src_kind", "src", "dst_kind", "dst"), "steps")
    step = every.select(F.concat_ws(":", "src_kind", "src").alias("s"), F.concat_ws(":", "dst_kind", "dst").alias("d")).where("s <> d")
    grew: list[list[DataFrame]] = [[], []]
    levels = [[spark.createDataFrame([(key(n),)], "at string")] for n in (a, b)]
    seen, sizes = [levels[0][0], levels[1][0]], [1, 1]
    met = levels[0][0].join(levels[1][0], "at")
    total = int(key(a) != key(b))
    while total and total <= max_hops and all(sizes):
        side = int(sizes[1] < sizes[0])
        near, far = ("s", "d") if side == 0 else ("d", "s")
        grown = step.join(levels[side][-1].withColumnRenamed("at", near), near, "left_semi").join(seen[side].withColumnRenamed("at", far), far, "left_anti")
        grew[side].append(keep(grown.select("s", "d").distinct(), "grew"))
        levels[side].append(keep(grew[side][-1].select(F.col(far).alias("at")).distinct(), "level"))
        seen[side] = seen[side].union(levels[side][-1])
        sizes[side] = levels[side][-1].count()
        met = keep(levels[0][-1].join(levels[1][-1], "at"), "met")
        if not met.isEmpty():
            break
        total += 1
    if total and (total > max_hops or not all(sizes)):
        for df in made:
            discard(df)
        return spark.createDataFrame([], "hops int, path string, ways decimal(38,0)")
    half = len(levels[0]) - 1
    layers = {half: met}
    hop = lambda t: grew[0][t] if t < half else grew[1][total - t - 1]
    for t in range(half - 1, -1, -1):
        into = hop(t).join(layers[t + 1].withColumnRenamed("at", "d"), "d", "left_semi").select(F.col("s").alias("at"))
        layers[t] = keep(levels[0][t].join(into, "at", "left_semi"), "layer")
    for t in range(half + 1, total + 1):
        out_of = hop(t - 1).join(layers[t - 1].withColumnRenamed("at", "s"), "s", "left_semi").select(F.col("d").alias("at"))
        layers[t] = keep(levels[1][total - t].join(out_of, "at", "left_semi"), "layer")
    links = [keep(hop(t).join(layers[t].withColumnRenamed("at", "s"), "s", "left_semi").join(layers[t + 1].withColumnRenamed("at", "d"), "d", "left_semi").select("s", "d"), "links") for t in range(total)]
    ways = layers[total].select("at", F.lit(1).cast("decimal(38,0)").alias("ways"))
    for link in reversed(links):
        ways = keep(link.join(ways, link["d"] == ways["at"]).groupBy("s").agg(F.sum("ways").cast("decimal(38,0)").alias("ways")).select(F.col("s").alias("at"), "ways"), "ways")
    begun = layers[0].select("at", F.array("at").alias("path"))
    for link in links:
        begun = link.join(begun, link["s"] == begun["at"]).select(F.col("d").alias("at"), F.concat("path", F.array("d")).alias("path")).orderBy("path").limit(limit)
    out = written(begun.crossJoin(ways.select("ways")).orderBy("path").limit(limit).select(F.lit(total).alias("hops"), F.array_join("path", ">").alias("path"), "ways"), "paths")
    for df in made:
        discard(df)
    return out


def descend(groups: DataFrame, seeds: DataFrame, depth: int = 20) -> DataFrame:
    """``id, root, depth`` of each seed and everything below it by ``parent_id``. Cycles end where they began."""
    tree = groups.select("id", F.col("parent_id").alias("at"))
    frontier = seeds.select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.array("id").alias("trail"))
    out = frontier
    for k in range(1, depth + 1):
        frontier = frontier.select(F.col("id").alias("at"), "root", "trail").join(tree, "at").where(~F.array_contains("trail", F.col("id"))).select("id", "root", F.lit(k).alias("depth"), F.concat("trail", F.array("id")).alias("trail"))
        frontier = written(frontier, "frontier")
        if frontier.isEmpty():
            break
        out = out.union(frontier)
    return out.drop("trail")


def subtree_events(g: EventGraph, id_or_name, depth: int | None = None) -> DataFrame:
    """Distinct events of the tags with that id or name, or with the ids of a table, and of all tags below, down to ``depth`` if it is given."""
    if isinstance(id_or_name, DataFrame):
        seeds = g.groups.join(id_or_name.toDF("id"), "id", "left_semi").select("id")
    else:
        seeds = g.groups.where((F.col("id") == F.lit(id_or_name)) | (F.col("name") == F.lit(id_or_name))).select("id")
    within = trees.below(g.groups, seeds) if depth is None else descend(g.groups, seeds, depth)
    return g.event_member_of.join(within.select(F.col("id").alias("group_id")).distinct(), "group_id", "left_semi").select("event_id").distinct()


def subtree_entities(g: EventGraph, id_or_name, depth: int | None = None) -> DataFrame:
    return g.participated_in.join(subtree_events(g, id_or_name, depth), "event_id", "left_semi").select("entity_id").distinct()


def check_reparent(groups: DataFrame, group_id, new_parent) -> None:
    """Raises ValueError if ``new_parent`` is the group itself or lies below it."""
    within = trees.below(groups, groups.where(F.col("id") == group_id).select("id"))
    if group_id == new_parent or not within.where(F.col("id") == new_parent).isEmpty():
        raise ValueError(f"{new_parent} is {group_id} or below it")


def move_group(groups: DataFrame, group_id, new_parent) -> DataFrame:
    if new_parent is not None:
        check_reparent(groups, group_id, new_parent)
    moved = groups.withColumn("parent_id", F.when(F.col("id") == group_id, F.lit(new_parent)).otherwise(F.col("parent_id")))
    return moved.drop("level").join(tree_levels(moved), "id", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def tree_levels(groups: DataFrame) -> DataFrame:
    """``id, level``: 0 at roots and wherever the parent is in another domain, or a cycle leads to no root."""
    g = groups.select("id", "parent_id", "domain")
    parent = g.select(F.col("id").alias("parent_id"), F.col("domain").alias("parent_domain"))
    inside = g.join(parent, "parent_id", "left").select("id", F.when(F.col("domain") == F.col("parent_domain"), F.col("parent_id")).alias("parent_id"))
    return trees.places(inside).select("id", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def root_map(groups: DataFrame) -> DataFrame:
    """``id, root``: the topmost ancestor; groups on a cycle or below one are their own."""
    return trees.places(groups).select("id", F.coalesce("root", "id").alias("root"))


def ancestors(groups: DataFrame, group_id, depth: int = 10) -> DataFrame:
    """``id, distance`` from a group upwards, itself first."""
    at = groups.where(F.col("id") == group_id).select("id", "parent_id", F.lit(0).alias("distance"))
    out = at
    for k in range(1, depth):
        at = groups.select("id", F.col("parent_id").alias("_p")).join(at.select(F.col("parent_id").alias("id")), "id").select("id", F.col("_p").alias("parent_id"), F.lit(k).alias("distance"))
        out = out.union(at)
    return out.groupBy("id").agg(F.min("distance").alias("distance"))


def chain(edges: DataFrame, start, src: str = "source_id", dst: str = "target_id", depth: int = 100) -> DataFrame:
    """``id, place`` along single next edges from ``start``, at most ``depth`` deep; the smallest next where there are several.

    Pointer doubling: after j rounds every node knows its node 2^j ahead, so seven joins reach a hundred places. Each
    doubling is written, so it reads the one before and not the edges again.
    """
    reach = written(edges.groupBy(F.col(src).alias("id")).agg(F.min(dst).alias("to")), "reach")
    found = edges.sparkSession.createDataFrame([(start, 0)], f"id {edges.schema[src].dataType.simpleString()}, place int")
    span = 1
    while span <= depth:
        found = written(found.union(found.join(reach, "id").select(F.col("to").alias("id"), (F.col("place") + span).alias("place"))), "found")
        span *= 2
        if span <= depth:
            further = written(reach.select("id", F.col("to").alias("mid")).join(reach.select(F.col("id").alias("mid"), "to"), "mid").select("id", "to"), "reach")
            discard(reach)
            reach = further
    return found.where(F.col("place") <= depth).groupBy("id").agg(F.min("place").alias("place"))


def resolve_aliases(alias: DataFrame, rounds: int = 64) -> DataFrame:
    """``id, canonical`` for alias pairs ``a -> b``: pointer jumping to the end of each chain, of any length.

    Of several targets of an id the smallest counts. A cycle stands for its smallest id, for its own members and for all that
    lead into it: beside the pointer travels the least id met, and once the pointers of all ids that have not ended have gone round
    their cycles, the least id met from where a pointer stands is that of the cycle.
    """
    to = written(alias.groupBy(F.col("entity_id_a").alias("id")).agg(F.min("entity_id_b").alias("at")).select("id", "at", F.col("at").alias("least")), "alias")
    n = to.count()
    span = 1
    for _ in range(rounds):
        ahead = to.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("least").alias("met"))
        jumped = written(to.join(ahead, "at", "left").select("id", F.coalesce("further", "at").alias("at"), F.least("least", F.coalesce("met", "least")).alias("least"), F.col("further").isNotNull().alias("open")), "alias")
        discard(to)
        to, span = jumped, span * 2
        if span > 2 * n or to.where("open").isEmpty():
            break
    # Whoever still stands on an id with a target stands on a cycle; that id has met all of its cycle by now.
    cycle = to.select(F.col("id").alias("at"), F.col("least").alias("in_cycle"))
    return to.join(cycle, "at", "left").select("id", F.coalesce("in_cycle", "at").alias("canonical"))


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.toDF("id").distinct()
    return edges.join(n.withColumnRenamed("id", "a_id"), "a_id", "left_semi").join(n.withColumnRenamed("id", "b_id"), "b_id", "left_semi")


def ego_subgraph(g: EventGraph, entity_id, hops: int = 1) -> DataFrame:
    """All co-occurrence edges among an entity and its neighbours within ``hops``."""
    centre = g.participated_in.where(F.col("entity_id") == entity_id).select(F.col("entity_id").alias("id")).distinct()
    around = k_hop(g.entity_connection, centre, hops).select("id").union(centre)
    return induced_subgraph(g.entity_connection, around)


def ego_ranked(g: EventGraph, entity_id, most: int = 30) -> DataFrame:
    """The heaviest neighbours of an entity: ``neighbour, weight``."""
    e = g.entity_connection
    both = e.where(F.col("a_id") == entity_id).select(F.col("b_id").alias("neighbour"), F.col("event_count").alias("weight")).union(e.where(F.col("b_id") == entity_id).select("a_id", "event_count"))
    return both.orderBy(F.desc("weight"), "neighbour").limit(most)


def entity_graph(g: EventGraph, domain: str | None = None, without_stopwords: bool = True, scope_ids: DataFrame | None = None) -> DataFrame:
    """``a_id, b_id, weight`` with weight = count / (degree_a + degree_b - count); degrees count all events of an entity."""
    e = g.entity_connection
    keep = g.live("entities")
    if domain is not None:
        keep = keep.where(F.col("domain") == domain)
    if without_stopwords:
        keep = keep.where(F.coalesce("user_tag", F.lit("")) != "stopword")
    ids = keep.select("id") if scope_ids is None else keep.select("id").join(scope_ids.toDF("id").distinct(), "id", "left_semi")
    e = induced_subgraph(e, ids)
    degree = g.participated_in.groupBy("entity_id").agg(F.count("*").alias("degree"))
    out = e.join(degree.toDF("a_id", "da"), "a_id", "left").join(degree.toDF("b_id", "db"), "b_id", "left")
    weight = F.col("event_count") / F.greatest(F.coalesce("da", "event_count") + F.coalesce("db", "event_count") - F.col("event_count"), F.lit(1))
    return out.select("a_id", "b_id", weight.alias("weight"))


def event_graph(g: EventGraph, theta: float = 0.4, scope_ids: DataFrame | None = None) -> DataFrame:
    e = g.event_jaccard_connected.where(F.col("entity_jaccard") >= theta)
    ids = g.live("events").select("id") if scope_ids is None else scope_ids.toDF("id").distinct()
    return induced_subgraph(e, ids).select("a_id", "b_id", F.col("entity_jaccard").alias("weight"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``id, component`` (its smallest id) of every node of ``edges`` (``a_id, b_id``), by contraction.

    In a round each node hooks on the neighbour that a hash of node and round puts lowest, if that is below itself, and then on
    where that one hooks; edges go over to what their ends hook on, and a node takes the least id of those that hook on it. So
    each round leaves a fraction of the edges, and all rounds together move a few times the edges there were. Labels come
    back down the same way. Raises where edges are left after ``rounds``.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links, seen = counted_write(edges.where("a_id <> b_id").select(*ends("a_id", "b_id")), "links", n=F.count("*"))
    nodes, levels = None, []
    for k in range(rounds):
        n = seen["n"]
        if not n:
            break
        place = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("id"))
        low = dealt(undirected(links, "a", "b"), 2 * n, "src").groupBy("src").agg(F.min(place("dst")).alias("low"))
        hooks, count = counted_write(low.select(F.col("src").alias("id"), F.when(F.col("low") < place("src"), F.col("low.id")).otherwise(F.col("src")).alias("to")), "hooks", n=F.count("*"))
        ahead = hooks.select(F.col("id").alias("to"), F.col("to").alias("_to"))
        far = dealt(hooks, count["n"], "to").join(dealt(ahead, count["n"], "to"), "to").select("id", F.col("_to").alias("to"))
        if nodes is None:  # every node has edges still
            level = written(far.select("id", F.col("id").alias("least"), "to"), "level")
        else:
            level = written(nodes.join(far, "id", "left").select("id", "least", "to"), "level")
        levels.append(level)
        hooked = level.where("to is not null")
        new = dealt(links, n, "a").join(hooked.select(F.col("id").alias("a"), F.col("to").alias("_a")), "a")
        new = dealt(new, n, "b").join(hooked.select(F.col("id").alias("b"), F.col("to").alias("_b")), "b").where("_a <> _b").select(*ends("_a", "_b")).distinct()
        left, seen = counted_write(new, "links", n=F.count("*"))
        nodes = written(dealt(hooked, count["n"], "to").groupBy(F.col("to").alias("id")).agg(F.min("least").alias("least")), "nodes")
        discard(links)
        discard(hooks)
        links = left
    else:
        if seen["n"]:
            raise RuntimeError(f"components still grow after {rounds} rounds")
    if nodes is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component"))
    label = nodes.toDF("to", "component")
    for level in reversed(levels):
        found = level.where("to is not null").join(label, "to").select("id", "component")
        if level is not levels[0]:  # of the first no node is alone
            found = written(found.union(level.where("to is null").select("id", "least")), "label")
        label = found.toDF("to", "component")
    return label.toDF("id", "component")


def threads(next_edges: DataFrame, hits: DataFrame) -> DataFrame:
    """Chains of at least two hits along next edges: ``id, thread``."""
    ids = hits.toDF("id").distinct()
    inside = next_edges.select(F.col("prev_id").alias("a_id"), F.col("next_id").alias("b_id"))
    return components(induced_subgraph(inside, ids)).withColumnRenamed("component", "thread")
