"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences. A sentence's logit is a bias plus the weights of its hashed lower-case words and their stems; the
document's score is the noisy-or of its sentences, ``1 - prod(1 - p_sentence)``. Only documents have labels: the
gradient of the document's loss is shared out among its sentences, so the model finds the offending ones itself.
Sentences end at ``. ! ?`` and line ends.

Defined cases: null and empty texts, and texts without words, score 0. A null label or id is never learned from.
Without labelled rows every score is 0; with one class only, every score is that class. Repeated rows are each
scored; extra columns pass through ``flag_toxic`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import labelled_texts, one_label, stratified_sample, tidy
from .textfeat import LOWER, WORD, mix, slices, span_hashes, word_spans

BUCKETS = 1 << 17
#: Beside its whole form a word is known by its first bytes, so inflected forms share weight.
STEMS = (4, 5)
SENTENCE = np.ones(256, bool)
SENTENCE[[10, 33, 46, 63]] = False
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def bags(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bucket and sentence of each word and stem; first and end byte and row of each sentence."""
    raw = LOWER[raw]
    s0, s1 = word_spans(raw, at, SENTENCE)
    w0, w1 = word_spans(raw, at, WORD)
    sentence = np.searchsorted(s0, w0, "right") - 1
    features = [span_hashes(raw, w0, w1)]
    for n in STEMS:
        features.append(mix(span_hashes(raw, w0, np.minimum(w1, w0 + n)) + np.uint64(n)))
    bucket = (np.stack(features, axis=1).ravel() & np.uint64(BUCKETS - 1)).astype(np.int64)
    return bucket, np.repeat(sentence, len(features)), s0, s1, np.searchsorted(at, s0, "right") - 1


def moved(by: int, found: Iterator) -> Iterator:
    for i, j, *rest in found:
        yield i + by, j + by, *rest


def train(texts: list[str], y: np.ndarray, steps: int = 160, rate: float = 0.1, decay: float = 1e-2, least: int = 4, screen: float = 4.0, clean_weight: float = 3.0) -> tuple[np.ndarray, float]:
    """Word weights and bias by Adam on the mean document loss, where a clean document weighs ``clean_weight``.

    Equal texts count once. Words in fewer than ``least`` documents, or not in ``screen`` standard deviations more toxic
    documents than chance puts there, keep weight 0: they could only be learned by heart.
    """
    first = {t: k for k, t in reversed([*enumerate(texts)])}
    texts, y = list(first)[::-1], np.asarray(y)[[*first.values()][::-1]] if len(texts) else np.zeros(0)
    weights = np.zeros(BUCKETS)
    if not len(texts) or y.min() == y.max():
        return weights, (30.0 if len(texts) and y.min() == 1 else -800.0)
    n, seen, seen_toxic = len(y), np.zeros(BUCKETS), np.zeros(BUCKETS)
    blocks = lambda: ((i, j, *bags(raw, at)) for k in range(0, n, 100) for i, j, raw, at in moved(k, slices(pa.array(texts[k : k + 100], pa.large_string()))))
    for i, j, bucket, sentence, _, _, row in blocks():
        in_doc = np.unique(row[sentence] * BUCKETS + bucket)
        seen += np.bincount(in_doc % BUCKETS, minlength=BUCKETS)
        seen_toxic += np.bincount(in_doc % BUCKETS, y[i:j][in_doc // BUCKETS], minlength=BUCKETS)
    rate_toxic = y.mean()
    surprise = (seen_toxic - seen * rate_toxic) / np.sqrt(np.maximum(seen * rate_toxic * (1 - rate_toxic), 1e-9))
    kept = (seen >= least) & (surprise >= screen)
    parts, first_sentence = [], 0
    for i, _, bucket, sentence, s0, _, row in blocks():
        on = kept[bucket]
        parts.append((bucket[on].astype(np.int32), (sentence[on] + first_sentence).astype(np.int32), (row + i).astype(np.int32)))
        first_sentence += len(s0)
    bucket, sentence, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    bias = -5.0
    weight_of = np.where(y == 1, 1.0, clean_weight) / n
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.clip(bias + np.bincount(sentence, weights[bucket], minlength=first_sentence), -30, 30)
        p = 1 / (1 + np.exp(-z))
        total = np.bincount(row, np.log1p(-p), minlength=n)
        clean = np.exp(total)
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * weight_of
        g = pull[row] * p
        grad, gb = np.bincount(bucket, g[sentence], minlength=BUCKETS) + decay * weights / n, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        weights -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return weights, float(bias)


def fit(documents: DataFrame, labels: DataFrame, learn_from, per_class: int = 2000) -> tuple[np.ndarray, float]:
    """Learn from at most about ``per_class`` documents of each label (the documented bound), with their whole texts.

    ``learn_from`` is a condition on ``doc_id``. The sample is chosen by a hash of the id among all labelled rows.
    """
    known = one_label(labels.where(learn_from), "toxic")
    chosen = stratified_sample(known, "doc_id", "y", per_class)  # a few thousand ids by its bound: broadcast
    return train(*labelled_texts(documents, chosen))


def score_batch(column: pa.Array, weights: np.ndarray, bias: float, located: float) -> tuple[np.ndarray, list[list[dict]]]:
    scores, spans = [], []
    for i, j, raw, at in slices(column):
        bucket, sentence, s0, s1, row = bags(raw, at)
        has = np.bincount(sentence, minlength=len(s0)) > 0
        z = np.clip(bias + np.bincount(sentence, weights[bucket], minlength=len(s0)), -700, 30)
        p = np.where(has & (z > -700), 1 / (1 + np.exp(-z)), 0.0)
        scores.append(-np.expm1(np.bincount(row, np.log1p(-p), minlength=j - i)))
        out: list[list[dict]] = [[] for _ in range(j - i)]
        hits = np.flatnonzero(p >= located)
        if len(hits):
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            for k in hits:
                base = points[at[row[k]]]
                out[row[k]].append({"start": int(points[s0[k]] - base), "end": int(points[s1[k]] - base), "score": float(p[k])})
        spans += out
    return np.concatenate(scores) if scores else np.zeros(0), spans


def score_toxicity(documents: DataFrame, model: tuple[np.ndarray, float], located: float = 0.5) -> DataFrame:
    """``doc_id``, ``score`` and ``offending``: spans (code points) and scores of the sentences at or above ``located``."""
    weights, bias = model
    given = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # fixed size: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, spans = score_batch(b.column(1), given.value, bias, located)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "score", "offending"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double, offending array<struct<start: bigint, end: bigint, score: double>>")


def flag_toxic(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns, whose score stays under ``threshold``; rows are filtered where they are scored."""
    weights, bias = model
    given = documents.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, _ = score_batch(b.column(at), given.value, bias, 2.0)
            yield b.filter(pa.array(score < threshold))

    return documents.mapInArrow(tidy(run), documents.schema)
