"""Queries of the persisted vector index: every hundredth id is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector_index as vi
from ..shared import shared_path
from .bridge import table
from .registry import query

NEAREST = """with s as (select q.vec_id as query_id, e.vec_id as id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as s from embeddings q, embeddings e where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by s desc, id) as rank from s) """


def asked(e):
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(NEAREST + "select query_id, cast(rank as int) as rank, id, round(s, 6) as score from r where rank <= 10", prelude=False)
def knn_index(spark, sf):
    """Exact search of a query block by bounds."""
    e = table(spark, sf, "embeddings")
    index = vi.build(e, shared_path(spark, "index"), "vec_id")
    return vi.search_many(index, asked(e), 10).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(NEAREST + "select query_id, cast(rank as int) as rank, id, round(s, 6) as score from (select query_id, id, s, row_number() over (partition by query_id order by s desc, id) as rank from s where id % 7 <> 3) where rank <= 10", prelude=False)
def knn_index_changes(spark, sf):
    """An index of half the rows that the other half joins, then a seventh leaves; some rows are inserted twice."""
    e = table(spark, sf, "embeddings")
    index = vi.build(e.where("vec_id % 2 = 0"), shared_path(spark, "index"), "vec_id")
    vi.insert(index, e.where("vec_id % 2 = 1"), "vec_id")
    vi.remove(index, e.where("vec_id % 7 = 3 or vec_id % 11 = 1").select("vec_id"))
    vi.insert(index, e.where("vec_id % 11 = 1 and vec_id % 7 <> 3"), "vec_id")
    return vi.search_many(index, asked(e), 10).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(NEAREST + "select count(*) as n_true, true as reached from r where rank <= 10", prelude=False)
def knn_index_recall(spark, sf):
    """Probes limited to what a sample needs for nine neighbours in ten: how many true ones there are, and whether it got there."""
    e = table(spark, sf, "embeddings")
    index = vi.build(e, shared_path(spark, "index"), "vec_id")
    exact = vi.search_many(index, asked(e), 10).select("query_id", "id")
    few = vi.search_many(index, asked(e), 10, probes=vi.probes_for(index, 0.95)).select("query_id", "id", F.lit(1).alias("found"))
    return exact.join(few, ["query_id", "id"], "left").agg(F.count("*").alias("n_true"), (F.count("found") >= 0.9 * F.count("*")).alias("reached"))


@query("""select lang, count(*) filter (text is not null and trim(text) <> '' and text not like 'A%') as made, count(*) filter (trim(text) like 'A%' and text like 'A%') as failed, count(*) filter (text is null or trim(text) = '') as blank from documents group by 1""", prelude=False)
def backfill_isolated(spark, sf):
    """Vectors for all documents by a function that fails for whole batches in which a text begins with an A."""
    from ..operators.backfill import backfill

    def embed(texts):
        if any(t.startswith("A") for t in texts):
            raise ValueError("no text may begin with an A")
        return [[float(len(t))] for t in texts]

    rows = table(spark, sf, "documents").select("doc_id", "lang", "text", F.lit(None).cast("array<float>").alias("embedding"))
    out, failed = backfill(rows, embed, F.col("text"), "doc_id", batch=16)
    n = out.join(failed.withColumnRenamed("id", "doc_id"), "doc_id", "left").groupBy("lang")
    return n.agg(F.count("embedding").alias("made"), F.count("error").alias("failed"), F.count_if(F.col("embedding").isNull() & F.col("error").isNull()).alias("blank"))
