"""The corpus pipeline: toxicity, near duplicates, secrets, source mix, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import hilbert_pack, jaccard_join, secret_scan, temperature_mix, toxicity_mil
from eventloom.llm._common import materialize
from eventloom.llm.queries import held_out, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from labelled rows outside the held-out fifth. Null texts stay."""
    model = toxicity_mil.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return toxicity_mil.flag_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of its smallest id, and of several texts of that id the one of smallest hash. Rows
    without words all stay. Rows without id are linked by their texts; one stays where no other row of its group has an id."""
    rows = materialize(jaccard_join.jaccard_components(docs).where("group is not null"), "groups")
    same = rows.groupBy("group", "doc_id", "body").agg(F.count("*").alias("rows"))
    best = same.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body", "rows")).alias("x"))
    kept = materialize(best.select(F.col("x.doc_id").alias("kept_id"), F.col("x.body").alias("kept_body"), F.col("x.rows").alias("kept_rows")), "kept")
    chosen = lambda rows: docs.join(kept.where(rows), (F.xxhash64(docs["text"]) == kept["kept_body"]) & docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    wordless = ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    return chosen("kept_rows = 1").unionByName(chosen("kept_rows > 1").dropDuplicates(["doc_id", "text"])).unionByName(docs.where(wordless))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts: by <SECRET>, or <EXAMPLE> where several sources share them."""
    return secret_scan.redact(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens with sources as even as they can be when no document is repeated: the largest sources give.
    Documents without words leave, as they hold no tokens to draw."""
    drawn = temperature_mix.mix_sources(docs, repetition=1.0, budget_share=0.9).select(F.col("row").alias("__row"))
    return docs.join(drawn, F.xxhash64("doc_id", "text") == F.col("__row"), "left_semi")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", cut_secrets), ("mix", mix), ("pack", pack)]

#: The classifier, the similarity join and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
