"""Secret scans with corpus-wide ownership frequency (operator 4), DataFrame functions only.

Every whole text is scanned for the base kinds (``assign``, ``access``, ``hex``) and for candidates of the kind
``owned``: further runs of 20 or more token characters with both letters and digits. Hashes of all candidate values are
aggregated by distinct repositories and owners. A value seen with at most ``max_owners`` owners, and in at most
``max_repositories`` repositories, is an owner-specific, live-looking credential; one that is copied more widely is an example. Base spans always stay and are labelled;
``owned`` spans are added only where the value is owner-specific, so widely copied look-alikes are left alone.

Positions come from splitting a text at its matches: pieces and matches alternate, so their lengths add up to code
point offsets without a Python function.

Defined cases: null and empty texts have no spans (``base_sha256`` is that of the empty string). A null repository or
owner counts as one of its own. Repeated rows each keep their spans; they count once for the ownership.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

# The kinds and their patterns.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OWNED = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"


def found(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Array of (kind, start, end, value) of the leftmost non-overlapping matches, in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.split(text, pattern, -1)
    walk = F.aggregate(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("piece"), whole.alias("whole"), value.alias("value")),
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint, value: string>>)").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["piece"]) + F.length(m["whole"])).cast("long").alias("at"),
            F.concat(acc["spans"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + F.length(m["piece"])).cast("long").alias("start"), (acc["at"] + F.length(m["piece"]) + F.length(m["whole"])).cast("long").alias("end"), m["value"].alias("value")))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(pattern), walk).otherwise(F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint, value: string>>)"))


def candidates(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows' ``base`` spans and ``more``: ``owned`` candidates that touch no base span."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(F.filter(found(t, "assign", ASSIGN, 2), lambda m: F.length(m["value"]) >= 6), found(t, "access", ACCESS), found(t, "hex", HEX))
    return documents.withColumn("base", base).withColumn("more", F.filter(found(t, "owned", OWNED), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind in the order of ``KINDS``, comma-joined."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(documents: DataFrame, repository: Column, owner: Column, max_owners: int = 1, max_repositories: int = 8, rows_per_salt: int = 20_000) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, text_hash, base, added, live, example``.

    ``base`` and ``added`` are arrays of (kind, start, end, value); ``live`` and ``example`` split all of them by
    ownership. Only rows with candidates enter the exchange; their hashes are counted per owner and repository with
    partial aggregation first, and in the join back a value of many occurrences has a salt for every ``rows_per_salt`` of
    them, so a credential in a third of all rows is no hot key.
    """
    scanned = candidates(documents.select("doc_id", "text", repository.alias("repository"), owner.alias("owner")))
    scanned = scanned.select("doc_id", F.xxhash64("text").alias("text_hash"), "repository", "owner", "base", "more")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")
    value = scanned.select("row", "repository", "owner", F.explode(F.concat("base", "more")).alias("span")).withColumn("hash", F.unhex(F.sha2("span.value", 256)))
    ownership = (
        value.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"))
    )
    ownership = materialize(ownership.withColumn("salts", F.ceil(F.col("occurrences") / rows_per_salt).cast("int")), "ownership")
    spread = ownership.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    hot = ownership.where("salts > 1").select("hash", "salts")  # at most one value for every rows_per_salt candidates
    salted = value.join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int"))
    judged = salted.join(spread, ["hash", "salt"])
    alone = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(alone & (F.col("span.kind") == "owned"), F.col("span"))).alias("added"),
        F.collect_list(F.when(alone, F.col("span"))).alias("live"),
        F.collect_list(F.when(~alone & (F.col("span.kind") != "owned"), F.col("span"))).alias("example"),
    )
    none = F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint, value: string>>)")
    return scanned.join(per_row, "row", "left").select("doc_id", "text_hash", "base", *(F.coalesce(c, none).alias(c) for c in ("added", "live", "example")))


def digest(found_rows: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found_rows.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size("example").cast("long").alias("n_example"),
    )


def redact(documents: DataFrame, repository: Column, owner: Column, max_owners: int = 1) -> DataFrame:
    """``documents``, all columns and rows, with found secrets cut out of ``text``: ``<SECRET>`` for live-looking
    credentials, ``<EXAMPLE>`` for widely copied ones; ``n_chars``, where there is one, is counted anew.

    Spans that touch are cut as one, live if any of them is. Texts without a secret are left as they are. Judgements
    are matched to rows by id and text hash, so repeated rows and ids stay apart.
    """
    names = documents.columns
    judged = scan_secrets(documents, repository, owner, max_owners)
    spans = F.concat(F.transform("live", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("live"))), F.transform("example", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("live"))))
    cuts = judged.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.sort_array(spans).alias("__spans")).where(F.size("__spans") > 0).dropDuplicates(["__id", "__hash"])
    merged = F.aggregate("__spans", F.expr("cast(array() as array<struct<start: bigint, end: bigint, live: boolean>>)"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), (F.element_at(acc, -1)["live"] | s["live"]).alias("live"))))).otherwise(F.concat(acc, F.array(s))))
    text = F.col("text")
    clean = F.aggregate(
        merged,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.when(s["live"], "<SECRET>").otherwise("<EXAMPLE>")).alias("out")),
        lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))),
    )
    joined = documents.join(cuts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    new = F.when(F.col("__spans").isNotNull(), clean).otherwise(text)
    out = joined.withColumn("__text", new)
    return out.select(*(F.col("__text").alias("text") if c == "text" else F.when(F.col("__spans").isNotNull(), F.length("__text").cast(documents.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in names))
