"""Vectors for rows that lack one, by a function that may fail: what fails is set aside with its error, everything else is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written


def isolated(texts: list[str], embed_batch: Callable[[list[str]], list], width: int | None, tries: int) -> list[tuple[list | None, str | None]]:
    """A vector or an error for each text. A batch that fails is halved until the rows that fail stand alone, so one bad row costs
    a logarithm of calls and its neighbours nothing; a row alone is tried ``tries`` times."""
    for attempt in range(tries if len(texts) == 1 else 1):
        try:
            made = list(embed_batch(texts))
            if len(made) != len(texts):
                raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
            break
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
    else:
        if len(texts) == 1:
            return [(None, error)]
        half = len(texts) // 2
        return isolated(texts[:half], embed_batch, width, tries) + isolated(texts[half:], embed_batch, width, tries)
    out: list[tuple[list | None, str | None]] = []
    for v in made:
        v = None if v is None else [float(x) for x in v]
        wrong = "no vector" if not v else f"length {len(v)} and not {width}" if width and len(v) != width else None
        out.append((None if wrong else v, wrong))
    return out


def embedded(rows: DataFrame, embed_batch: Callable[[list[str]], list], text: Column, id_column: str = "id", width: int | None = None, batch: int = 64, tries: int = 2) -> DataFrame:
    """``id, embedding, error`` of every row: either a vector or why there is none."""
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), batch):
                some = b.slice(lo, batch)
                done = isolated(some.column(1).to_pylist(), embed_batch, width, tries)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([v for v, _ in done], pa.list_(pa.float32())), pa.array([e for _, e in done], pa.string())], names=["id", "embedding", "error"])

    return rows.select(F.col(id_column).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>, error string")


def backfill(rows: DataFrame, embed_batch: Callable[[list[str]], list], text: Column, id_column: str = "id", column: str = "embedding", width: int | None = None, batch: int = 64, tries: int = 2) -> tuple[DataFrame, DataFrame]:
    """``rows`` with missing vectors filled in, and ``id, error`` of those that failed, which stay without.

    Rows that have a vector, or no text but white space, are left alone. Ids are distinct. Results are written once, so the
    function is not called again by whoever reads them; a task that is lost calls it again for its own rows only.
    """
    lacks = F.col(column).isNull() & F.coalesce(F.trim(text) != "", F.lit(False)) & F.col(id_column).isNotNull()
    made = written(embedded(rows.where(lacks), embed_batch, text, id_column, width, batch, tries), "vectors")
    good = made.where("error is null").select(F.col("id").alias(id_column), F.col("embedding").alias("_made"))
    out = rows.join(good, id_column, "left").withColumn(column, F.coalesce(column, "_made")).select(*rows.columns)
    return out, made.where("error is not null").select("id", "error")
