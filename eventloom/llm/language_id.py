"""Language identification (operator 5): averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's vector is the mean of the embeddings of its hashed 2-, 3- and 4-byte subwords (lower case, everything that is
not a letter or digit counts as one space). Temperature and the rejection threshold are fitted on a fifth of the sample
that training leaves out. At prediction the two linear layers are multiplied out, so a subword costs one table row.

Defined cases: ``und`` with score 0 for null texts and texts without letters; a text too short for a subword gets the
classes' bias alone. ``rejected`` marks scores below the calibrated threshold; the prediction stays. Without labelled
rows every prediction is ``und``. Repeated rows are each predicted; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stratified_sample
from .textfeat import LOWER, WORD, gram_hashes, slices

BUCKETS, WIDTH, GRAMS = 1 << 14, 16, (2, 3, 4)
FOLDED = np.where(WORD, LOWER, np.uint8(32)).astype(np.uint8)


@dataclass
class LanguageModel:
    classes: list[str]
    table: np.ndarray  # BUCKETS x classes
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw = FOLDED[raw]
    for n in GRAMS:
        h, row = gram_hashes(raw, at, n)
        yield (h & np.uint64(BUCKETS - 1)).astype(np.int64), row


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sparse_rows(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    rows = []
    for i, j, raw, at in slices(pa.array(texts, pa.large_string()), 500_000, 256):
        count = np.zeros((j - i) * BUCKETS, np.int64)
        for bucket, row in subwords(raw, at):
            count += np.bincount(row * BUCKETS + bucket, minlength=len(count))
        for c in count.reshape(j - i, BUCKETS):
            on = np.flatnonzero(c)
            rows.append((on.astype(np.int32), (c[on] / max(1, c.sum())).astype(np.float32)))
    return rows


def train(texts: list[str], langs: list[str], epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 11) -> LanguageModel:
    classes = sorted(set(langs))
    if not classes:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    x, y = sparse_rows(texts), np.searchsorted(classes, langs)
    order = rng.permutation(len(x))
    held, used = (order[: len(x) // 5], order[len(x) // 5 :]) if len(x) >= 50 else (order, order)
    e = (rng.standard_normal((BUCKETS, WIDTH)) / np.sqrt(WIDTH)).astype(np.float32)
    w, bias = np.zeros((WIDTH, len(classes)), np.float32), np.zeros(len(classes), np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        d = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows):
            d[k, x[r][0]] = x[r][1]
        return d

    steps = max(1, epochs * -(-len(used) // batch))
    done = 0
    for _ in range(epochs):
        used = rng.permutation(used)
        for k in range(0, len(used), batch):
            rows = used[k : k + batch]
            d = dense(rows)
            hidden = d @ e
            g = softmax(hidden @ w + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            step = rate * (1 - done / steps)
            back = g @ w.T
            w -= 20 * step * (hidden.T @ g)
            bias -= step * g.sum(axis=0)
            on = np.flatnonzero(d.any(axis=0))
            e[on] -= 20 * step * (d[:, on].T @ back)
            done += 1
    z = np.concatenate([dense(held[k : k + 64]) @ e @ w + bias for k in range(0, len(held), 64)])
    scales = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in scales]
    t = float(scales[int(np.argmin(loss))])
    p = softmax(z / t)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    return LanguageModel(classes, (e @ w / t).astype(np.float32), bias / t, t, float(np.quantile(right, 0.005)) if len(right) else 0.0)


def fit(documents: DataFrame, learn_from, per_class: int = 800, total: int = 50_000) -> LanguageModel:
    """Learn from at most about ``per_class`` whole texts of each language, and ``total`` of all together (the documented
    bounds), where ``learn_from`` holds. With more languages each gives fewer texts; none is left out."""
    known = documents.select("doc_id", "text", "lang").where(learn_from & F.col("text").isNotNull())
    chosen = stratified_sample(known, "doc_id", "lang", per_class, total=total)
    one = chosen.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x"))  # an id on several rows counts once
    rows = one.orderBy("doc_id").select("x.text", "x.lang").toArrow()
    return train(rows["text"].to_pylist(), rows["lang"].to_pylist())


def predict_batch(column: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    n, k = len(column), len(model.classes)
    letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not k:
        return ["und"] * n, np.zeros(n)
    total, seen = np.zeros((n, k)), np.zeros(n)
    for i, j, raw, at in slices(column, 1_000_000):
        for bucket, row in subwords(raw, at):
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                total[i + row[first]] += np.add.reduceat(model.table[bucket], first, axis=0, dtype=np.float64)
                seen[i:j] += np.bincount(row, minlength=j - i)
    p = softmax(total / np.maximum(seen, 1)[:, None] + model.bias)
    best = p.argmax(axis=1)
    return [model.classes[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, p.max(axis=1), 0.0)


def predict_language(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (calibrated probability) and ``rejected``, from the whole text alone."""
    given = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a number a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict_batch(b.column(1), given.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(score < given.value.reject_below)], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
