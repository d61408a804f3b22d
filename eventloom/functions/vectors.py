"""Vector expressions in double precision, JVM-side."""

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(F.try_divide(dot(a, b), size))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def literal_vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def register_sql(spark: SparkSession) -> None:
    """``vec_distance_cosine(a, b)`` and ``vec_norm(a)`` for SQL, as expressions without Python."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + x * x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_distance_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1 - try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))")


def deterministic_embedding(width: int = 64, seed: int = 0):
    """A pandas UDF that embeds text by a seeded normal draw of unit length, for tests; empty text gives zeros."""
    import hashlib

    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return np.zeros(width, np.float32)
            key = int.from_bytes(hashlib.blake2b(f"{seed}:{t}".encode(), digest_size=8).digest(), "little")
            v = np.random.Generator(np.random.PCG64(key)).standard_normal(width)
            return (v / np.linalg.norm(v)).astype(np.float32)

        return text.map(one)

    return embed


def fingerprint_problems(stored_width: int | None, stored_model: str | None, width: int, model: str) -> list[str]:
    """Why vectors of ``model`` can't join a store; empty if they can."""
    problems = []
    if stored_width is not None and stored_width != width:
        problems.append(f"width {width}, store has {stored_width}")
    if stored_model and stored_model != model:
        problems.append(f"model {model}, store has {stored_model}")
    return problems
