"""Quality by nearest-neighbour voting in a latent semantic space (operator 6).

Features are hashed 3-byte grams, damped by the square root and weighted by an idf counted over every document. A
truncated SVD of a bounded labelled sample gives the latent space. The sample's vectors, of fixed number and width, are
broadcast; each block of documents is multiplied with all of them in double precision, so the neighbours are exact, and the
labels of the ``k`` nearest are averaged with weights that grow with the similarity. Labelled texts of equal features are one
neighbour, whose label is their mean, before anything is fitted: copies neither crowd out others nor tie.

Defined cases: null and empty texts and texts under three bytes have no direction; their score is the sample's share of
label 1 under equal class weights (0.5, so predicted 0). Without labelled rows every score is 0.5. Of equal
similarities the neighbour that stands first in the sample (order of id) counts. Of contradicting labels of an id the smallest counts.
Repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import labelled_texts, one_label, stratified_sample
from .textfeat import gram_hashes, slices

BUCKETS, RANK = 1 << 12, 48


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray  # BUCKETS x RANK
    vectors: np.ndarray  # neighbours x RANK, unit length
    labels: np.ndarray  # share of label 1
    k: int
    power: float


def count_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for i, j, raw, at in slices(column, 1_000_000, 400):
        h, row = gram_hashes(raw, at, 3)
        yield i, j, np.bincount(row * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=(j - i) * BUCKETS).reshape(j - i, BUCKETS)


def document_frequency(documents: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, over all of them; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, c in count_blocks(b.column(0)):
                df += (c > 0).sum(axis=0)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(df[on], n))], names=["bucket", "n"])

    rows = documents.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent(counts: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    z = weighted(counts, idf).astype(np.float64) @ basis
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def train(texts: list[str], y: np.ndarray, df: np.ndarray, n: int, k: int = 15, power: float = 8.0, seed: int = 5) -> QualityModel:
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.05
    if not texts:
        return QualityModel(idf, np.zeros((BUCKETS, RANK)), np.zeros((0, RANK)), np.zeros(0), k, power)
    x = np.concatenate([weighted(c, idf) for _, _, c in count_blocks(pa.array(texts, pa.large_string()))])
    first: dict[bytes, int] = {}
    of = np.array([first.setdefault(row.tobytes(), len(first)) for row in x])
    at = np.unique(of, return_index=True)[1]
    x, y = x[at], np.bincount(of, y) / np.bincount(of)
    q = x.T @ np.linalg.qr(x @ np.random.default_rng(seed).standard_normal((BUCKETS, RANK + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = x.T @ np.linalg.qr(x @ np.linalg.qr(q)[0])[0]
    q = np.linalg.qr(q)[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt[:RANK].T).astype(np.float64)
    if basis.shape[1] < RANK:
        basis = np.pad(basis, ((0, 0), (0, RANK - basis.shape[1])))
    z = x.astype(np.float64) @ basis
    return QualityModel(idf, basis, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12), y, k, power)


def fit(documents: DataFrame, labels: DataFrame, learn_from, per_class: int = 1500) -> QualityModel:
    """Neighbours: at most about ``per_class`` whole documents of each label (the documented bound) where ``learn_from`` holds."""
    df, n = document_frequency(documents)
    known = one_label(labels.where(learn_from), "quality")
    chosen = stratified_sample(known, "doc_id", "y", per_class)  # a few thousand ids by its bound: broadcast
    return train(*labelled_texts(documents, chosen), df, n)


def vote(column: pa.Array, m: QualityModel) -> np.ndarray:
    out = np.full(len(column), 0.5)
    if not len(m.labels):
        return out
    one, none = 0.5 / max(m.labels.sum(), 1e-9) * m.labels, 0.5 / max((1 - m.labels).sum(), 1e-9) * (1 - m.labels)  # classes weigh alike
    for i, j, counts in count_blocks(column):
        sim = latent(counts, m.idf, m.basis) @ m.vectors.T
        near = np.argpartition(-sim, min(m.k, sim.shape[1]) - 1, axis=1)[:, : m.k]
        last = np.take_along_axis(sim, near, 1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((sim >= last).sum(axis=1) > near.shape[1])  # the last place is shared: the first in the sample count
        near[tied] = np.argsort(-sim[tied], axis=1, kind="stable")[:, : m.k]
        weight = np.maximum(np.take_along_axis(sim, near, 1), 0) ** m.power
        total = (weight * (one + none)[near]).sum(axis=1)
        out[i:j] = np.where(total > 0, (weight * one[near]).sum(axis=1) / np.maximum(total, 1e-300), 0.5)
    return np.clip(out, 0, 1)


def score_quality(documents: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id`` and ``score``, from the whole text alone."""
    given = documents.sparkSession.sparkContext.broadcast(model)  # at most about 2 x per_class vectors of RANK and the basis

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vote(b.column(1), given.value), pa.float64())], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
