"""Codecs of the exchange format: booleans, timestamps, bytes, nested values, vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_bool(token: Column) -> Column:
    """0/1, f/t, false/true, no/yes in any case; null stays null; anything else raises."""
    t = F.lower(F.trim(token.cast("string")))
    wrong = F.raise_error(F.concat(F.lit("not a boolean: "), t))
    return F.when(token.isNull(), None).when(t.isin("1", "t", "true", "yes"), True).when(t.isin("0", "f", "false", "no", ""), False).otherwise(wrong)


def encode_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def encode_bytes(data: Column) -> Column:
    return F.concat(F.lit("base64:"), F.base64(data))


def decode_bytes(text: Column) -> Column:
    return F.when(text.startswith("base64:"), F.unbase64(text.substr(F.lit(8), F.length(text)))).otherwise(text.cast("binary"))


def encode_nested(value: Column) -> Column:
    return F.to_json(value)


def decode_vector_text(text: Column) -> Column:
    """``[1,2.5]`` to floats."""
    return F.from_json(text, "array<float>")


def decode_vector_blob():
    """A pandas UDF from little-endian float32 bytes to floats."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def decode(blob: pd.Series) -> pd.Series:
        return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return decode


def source_hash(event_ids, entity_ids):
    """One row, ``source_hash``: a digest of both id sets that no task has to see whole.

    Ids fall into 4096 buckets by their own hash; each bucket's sorted ids, a line each, are digested, and the sorted
    bucket digests of events, ``---`` and those of entities give the result.
    """
    def digests(df, kind: str):
        ids = df.select(F.col("id").cast("string").alias("id"))
        each = ids.groupBy(F.substring(F.sha2("id", 256), 1, 3).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("digest"))
        return each.agg(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", F.lit(":"), "digest"))), "\n").alias(kind))  # 4096 lines at most

    return digests(event_ids, "e").crossJoin(digests(entity_ids, "n")).select(F.sha2(F.concat("e", F.lit("\n---\n"), "n"), 256).alias("source_hash"))
