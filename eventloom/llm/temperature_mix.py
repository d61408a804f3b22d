"""Mixing sources to target weights by temperature (operator 3).

Source weights are ``share ** a / sum(share ** a)`` with token shares and one exponent ``a`` in [0, 1]. Lowering ``a``
flattens the mix: the entropy and the repetition of the smallest source grow. ``a`` is found by bisection, four halvings
a job: every job sums the two power sums at fifteen inner exponents over the per-source table, and only those sums
reach the driver. The largest ``a`` whose entropy reaches ``entropy`` (a share of its maximum) is taken or, with
``repetition``, the smallest whose most repeated source is passed at most that many times.

Weights are then realised as budgeted block permutations. A source with budget ``b`` and ``t`` tokens is emitted in
whole permutations (hash order, a new one each epoch) and the part of one more that fits ``b``; no document is cut.
Positions in that part come from two prefix sums, over hash buckets and within one, so a source that holds a third of
all rows is no single task. An emission's place within its source's budget, a fraction, gives its ``block``: every
block holds the sources in the target proportions.

Defined cases: documents of null or empty text have no tokens and are never emitted; a null source is a source of its
own. An empty table, or one without tokens, gives no rows. Repeated rows are separate documents. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

HALVINGS = 4
#: Epochs that one row lists at a time.
RUN = 4096


def token_count(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def exponent_for(sources: DataFrame, budget: float, entropy: float | None = None, repetition: float | None = None, rounds: int = 7) -> tuple[float, float]:
    """The exponent and the power sum that normalises it. ``sources`` has ``tokens`` and ``share``."""
    n, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    lo, hi = 0.0, 1.0
    log_share = F.log("share")

    def measures(exponents: list[float]) -> list[tuple[float, float]]:
        sums = sources.agg(*(x for a in exponents for x in (F.sum(F.exp(a * log_share)), F.sum(F.exp(a * log_share) * log_share), F.max(F.exp((a - 1) * log_share))))).first()
        out = []
        for k, a in enumerate(exponents):
            z, zl, top = sums[3 * k : 3 * k + 3]
            out.append((math.log(z) - a * zl / z, top / z * budget / total))
        return out

    def fits(m: tuple[float, float]) -> bool:
        """Whether the exponent may stay where it is or go up (entropy) or down (repetition)."""
        return m[0] >= entropy * math.log(n) - 1e-12 if entropy is not None else m[1] > repetition + 1e-12

    ends = measures([lo, hi])
    if fits(ends[1]):
        lo = hi  # the natural shares do already, or no exponent does
    elif not fits(ends[0]):
        hi = lo
    else:
        for _ in range(rounds):
            steps = 1 << HALVINGS
            inner = [lo + (hi - lo) * k / steps for k in range(1, steps)]
            good = sum(fits(m) for m in measures(inner))
            lo, hi = lo + (hi - lo) * good / steps, lo + (hi - lo) * (good + 1) / steps
    a = round(hi if repetition is not None and entropy is None else lo, 9)
    return a, sources.agg(F.sum(F.exp(a * log_share))).first()[0]


def source_weights(documents: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = None, budget_share: float = 1.0) -> DataFrame:
    """A row per source with tokens: ``source, tokens, documents, share, weight, budget, epochs, rest``. One limit must be given."""
    if (entropy is None) == (repetition is None):
        raise ValueError("give entropy or repetition")
    per = documents.select("source", token_count(F.col("text")).alias("tokens")).where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    per = materialize(per, "sources")
    total = per.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return per.select("source", "tokens", "documents", *(F.lit(0.0).alias(c) for c in ("share", "weight")), *(F.lit(0).cast("long").alias(c) for c in ("budget", "epochs", "rest")))
    per = per.withColumn("share", F.col("tokens") / F.lit(total))
    spend = budget if budget is not None else int(total * budget_share)
    a, z = exponent_for(per, spend, entropy, repetition)
    out = per.withColumn("weight", F.round(F.exp(F.lit(a) * F.log("share")) / F.lit(z), 12))
    out = out.withColumn("budget", F.floor(F.col("weight") * F.lit(spend)).cast("long"))
    # The exponent is rounded: a budget within that of whole epochs is whole epochs, so a document at their end is not lost.
    whole = F.round(F.col("budget") / F.col("tokens")).cast("long") * F.col("tokens")
    close = (whole > 0) & (F.abs(whole - F.col("budget")) <= F.greatest(F.lit(1.0), F.col("tokens") * 1e-6))
    out = out.withColumn("budget", F.when(close, whole).otherwise(F.col("budget")))
    return out.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("long")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def mix_sources(documents: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = None, budget_share: float = 1.0, blocks: int = 64, seed: int = 17, rows_per_bucket: int = 5_000) -> DataFrame:
    """Emissions: ``row, doc_id, source, tokens, epoch, block, place, weight``; ``place`` (0 to 1) orders the whole mix.

    ``row`` is a hash of id and text, equal for repeated rows.
    """
    weights = materialize(source_weights(documents, budget, entropy, repetition, budget_share), "weights")
    if weights.isEmpty():
        rows = documents.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "source", token_count(F.col("text")).alias("tokens")).where("false")
        return rows.select("*", F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("int").alias("block"), F.lit(0.0).alias("place"), F.lit(0.0).alias("weight"))
    dim = weights.select(F.col("source").alias("s"), "weight", "budget", "epochs", "rest", F.col("tokens").alias("all_tokens"), F.greatest(F.lit(1), F.ceil(F.col("documents") / rows_per_bucket)).alias("buckets"))
    rows = documents.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "source", token_count(F.col("text")).alias("tokens")).where("tokens > 0")
    rows = rows.join(dim, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # Epochs are listed in runs, so no array grows with them: a small source may be passed millions of times.
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("epochs") / RUN))))
    runs = runs.withColumn("epoch", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("epochs"), F.col("run") * RUN + (RUN - 1))))).drop("run")
    each = materialize(runs.withColumn("draw", F.shiftrightunsigned(F.xxhash64("row", "epoch", F.lit(seed)), 1)).withColumn("bucket", F.pmod(F.shiftrightunsigned("draw", 20), F.col("buckets"))).where("epoch < epochs or rest > 0"), "mix")
    bucket = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("source", "epoch", "bucket").agg(F.sum("tokens").alias("in_bucket")).select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(bucket), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "epoch", "bucket").orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("upto", F.sum("tokens").over(within)).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("upto", F.col("upto") + F.col("before")).where((F.col("epoch") < F.col("epochs")) | (F.col("upto") <= F.col("rest")))
    place = F.least(F.lit(1.0), (F.col("epoch") * F.col("all_tokens") + F.col("upto") - F.col("tokens") / 2) / F.greatest(F.col("budget"), F.lit(1)))
    return placed.withColumn("place", place).select("row", "doc_id", "source", "tokens", "epoch", F.least(F.floor(F.col("place") * blocks), F.lit(blocks - 1)).cast("int").alias("block"), "place", "weight")
