"""Queries of object storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import shared_path
from ..sources import objects
from .bridge import table
from .registry import query


@query("select doc_id, octet_length(encode(text)) as size, sha256(text) as digest, text is not null as moved from documents", prelude=False)
def object_roundtrip(spark, sf):
    """Every document is written to an object, moved to another root and read back from there."""
    here, there = shared_path(spark, "objects"), shared_path(spark, "objects")
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.lit("text/plain").alias("content_type"), F.coalesce(F.col("lang"), F.lit("none")).alias("domain"))
    moved = objects.move(objects.put(rows, here), here, there)
    back = objects.get(moved, there)
    return back.select("doc_id", "size", F.sha2("content", 256).alias("digest"), F.coalesce(F.startswith("storage_uri", F.lit(there)), F.lit(False)).alias("moved"))
