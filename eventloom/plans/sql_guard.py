"""Read-only SQL: one SELECT or WITH statement over registered views, a row limit on the plan, and an audit row."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EventGraph

ROW_LIMIT = 10_000
AUDIT = "sql STRING, status STRING, error_class STRING, error_detail STRING, row_count BIGINT, duration_ms BIGINT, at TIMESTAMP"
# Words that may not stand outside a literal.
FORBIDDEN = ["insert", "update", "delete", "merge", "drop", "create", "alter", "truncate", "replace", "grant", "revoke", "set", "reset", "add", "cache", "uncache", "refresh", "use", "call", "load", "msck", "analyze"]


def stripped(sql: str) -> str:
    """The statement without comments, its literals and quoted names emptied, so that what they hold is not misread."""
    out, i = [], 0
    while i < len(sql):
        c = sql[i]
        if c in "'\"`":
            j = i + 1
            while j < len(sql) and sql[j] != c:
                j += 2 if sql[j] == "\\" else 1
            out.append(c + c)
            i = j + 1
        elif sql.startswith("--", i):
            i = sql.find("\n", i) if "\n" in sql[i:] else len(sql)
        elif sql.startswith("/*", i):
            i = sql.find("*/", i) + 2 if "*/" in sql[i:] else len(sql)
        else:
            out.append(c)
            i += 1
    return "".join(out).strip()


def check(sql: str) -> None:
    """Raises ValueError unless ``sql`` is a single statement that only reads."""
    text = stripped(sql).rstrip(";").strip()
    words = text.lower().replace("(", " ").replace(")", " ").split()
    if not words:
        raise ValueError("empty statement")
    if ";" in text:
        raise ValueError("more than one statement")
    if words[0] not in ("select", "with"):
        raise ValueError("only SELECT and WITH are allowed")
    for w in words:
        if w in FORBIDDEN:
            raise ValueError(f"not allowed: {w}")


def register(g: EventGraph) -> None:
    for name, df in g.tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, limit: int = ROW_LIMIT) -> DataFrame:
    check(sql)
    return spark.sql(sql.strip().rstrip(";")).limit(max(1, min(ROW_LIMIT, limit)))


def explain(spark: SparkSession, sql: str) -> DataFrame:
    check(sql)
    return spark.sql(f"EXPLAIN FORMATTED {sql.strip().rstrip(';')}")


def audited(spark: SparkSession, sql: str, audit_path: str, limit: int = ROW_LIMIT) -> list:
    """Run and return rows; success and failure alike are appended to the audit table."""
    began, status, error, rows = time.time(), "ok", None, []
    try:
        rows = query(spark, sql, limit).collect()  # at most ROW_LIMIT rows
        return rows
    except Exception as e:
        status, error = "error", e
        raise
    finally:
        row = (sql, status, type(error).__name__ if error else None, str(error)[:500] if error else None, len(rows), int(1000 * (time.time() - began)))
        spark.createDataFrame([row], "sql STRING, status STRING, error_class STRING, error_detail STRING, row_count BIGINT, duration_ms BIGINT").withColumn("at", F.current_timestamp()).write.mode("append").parquet(audit_path)


def describe(spark: SparkSession, g: EventGraph) -> DataFrame:
    """``table_name, column_name, data_type`` of the graph's tables."""
    rows = [(n, f.name, f.dataType.simpleString()) for n, df in g.tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
