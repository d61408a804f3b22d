"""Filter interaction audit by long-form window evaluation (operator 13).

Five filters are judged on every whole text; a document's failures are the bits of a mask, A lowest. Documents are counted
into cells of part and mask. Cells are then unpivoted against every step of every order of the filters: a running bit-or
over the steps before tells what a cell has failed already, conditional sums give each step's counts, and a window over
a filter's rows of all orders gives its total removals. Only the first half of the work grows with the documents; the
long form has 600 rows a cell, and there are at most 32 cells a part.

A document fails E if a smaller id has the same text. Documents are grouped by (text digest, part, labels) before the
smallest id of a text is joined to them, so a text that a third of all rows share is a few grouped rows.

Defined cases: a null text is an empty text, which fails A only, and E beside other empty texts; a null source is part
''. Rows that repeat an id and its text count each, and none of them makes another fail E; a row without id has no smaller
one and makes nobody fail. An id with several labels has a label if any of its rows has it. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_mask(text: Column) -> Column:
    """Bits of the failures A to D of a text."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    fails = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.length(F.regexp_replace(body, "[^A-Z]+", "")) > 2 * F.length(body),
        body.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by their part and failures A to E."""
    text = F.coalesce("text", F.lit(""))
    docs = materialize(documents.select(F.col("doc_id").alias("id"), F.sha2(text, 256).alias("digest"), F.coalesce("source", F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask4")), "masks")
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("is_toxic"))
    known = docs.where("id is not null").join(told, "id", "left").select("id", "digest", "part", "mask4", F.coalesce("is_good", F.lit(0)).alias("is_good"), F.coalesce("is_toxic", F.lit(0)).alias("is_toxic"))
    per_id = known.groupBy("id", "digest", "part", "mask4", "is_good", "is_toxic").agg(F.count("*").alias("n"))
    nameless = docs.where("id is null").groupBy("id", "digest", "part", "mask4").agg(F.count("*").alias("n"))
    per_id = per_id.unionByName(nameless.withColumns({"is_good": F.lit(0), "is_toxic": F.lit(0)}))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    alike = materialize(per_id.groupBy("digest", "part", "mask4", "is_good", "is_toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first), "alike")
    least = alike.groupBy("digest").agg(F.min("first.id").alias("least"))
    held = alike.join(least, "digest").withColumn("passes", F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask4").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("mask4") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))))
    rows = held.select("part", "is_good", "is_toxic", both.alias("x")).select("part", "x.mask", "x.n", "is_good", "is_toxic").where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_good")).alias("good"), F.sum(F.col("n") * F.col("is_toxic")).alias("toxic"))


def interactions(counted: DataFrame) -> DataFrame:
    """``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of the cells."""
    steps = F.posexplode(F.split("filter_order", "")).alias("at", "filter")
    long = counted.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).select("*", steps).withColumn("step", F.col("at") + 1)
    bit = F.expr("shiftleft(1, ascii(filter) - ascii('A'))")
    long = long.withColumn("own", F.col("mask").bitwiseAND(bit))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    fails, fresh = F.col("own") != 0, F.col("earlier") == 0
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0)).cast("long")
    per_step = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & fresh).alias("kept"), total(fails & fresh).alias("removed"), total(fails & ~fresh).alias("redundant"), total(fails & (F.col("mask") == F.col("own"))).alias("unique_fails"),
        total(fails & fresh, "good").alias("good_lost"), total(fails & fresh, "toxic").alias("toxic_lost"),
    )
    return per_step.select("part", "filter_order", "step", "filter", *MEASURES, F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(materialize(cells(documents, labels), "cells"))


#: The same counts in DuckDB, by plain sets of failed letters.
SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), e as (
  select *, min(doc_id) over (partition by text) as least from d
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1
), m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 'C' else '' end || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when doc_id > least then 'E' else '' end as failed
  from e left join l using (doc_id)
), c as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, cast(step as int) as step, filter_order[step] as filter, filter_order[1:step - 1] as earlier from o, range(1, 6) t(step)),
j as (
  select part, filter_order, step, filter, n, good, toxic, failed, contains(failed, filter) as fails, translate(failed, earlier, '') = failed as fresh from c, s
), g as (
  select part, filter_order, step, filter, cast(sum(case when fresh and not fails then n else 0 end) as bigint) as kept, cast(sum(case when fresh and fails then n else 0 end) as bigint) as removed,
    cast(sum(case when fails and not fresh then n else 0 end) as bigint) as redundant, cast(sum(case when failed = filter then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when fresh and fails then good else 0 end) as bigint) as good_lost, cast(sum(case when fresh and fails then toxic else 0 end) as bigint) as toxic_lost
  from j group by 1, 2, 3, 4
)
select *, cast(sum(removed) over (partition by part, filter) as bigint) as shapley from g
"""
