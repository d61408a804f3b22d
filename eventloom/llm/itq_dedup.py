"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables (operator 8).

For each vector length, on a bounded sample, a PCA and a rotation are learned that make the sign bits of the rotated
components balanced and close to the vectors (iterative quantisation). Every vector gets a code of up to 64 bits; the
code is cut into parts, one for each table, and two vectors are candidates if a part is equal. Labels with many vectors
have fewer and longer parts, about as many values as blocks of vectors, and two parts may then differ in one bit; so
buckets do not grow with a label. A true pair misses only if every part has more flipped bits than that. Candidates are
reranked with the original vectors, in double precision, so no link below the threshold is returned.

Equal vectors of a label are one class first, so copies cost nothing. Buckets meet as sub-blocks of about ``block`` rows:
a bucket of many rows is dealt to a triangle of block pairs, each a bounded unit of work. A pair that shares several
parts counts in the first of them only; blocks send per-vector counts and a spanning forest of their links, never all
pairs of a group.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, or whose label is null, link
with nothing: ``n_links`` 0, themselves as component, kept. Vectors of each length are compared among themselves; a
length of few vectors has a random rotation, and the vectors of a small label all meet. A cosine equal to the threshold links. Repeated rows (one id twice) link with each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, stratified_sample
from .components import connected_components


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (PCA times the learned rotation) whose signs are the code."""
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    pca = vt[:bits].T
    v = (x - mean) @ pca
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((pca.shape[1], pca.shape[1])))
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ wt).T
    return mean, pca @ r


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    on = ((x - mean) @ projection > 0).astype(np.uint64)
    return (on << np.arange(on.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def random_rotation(width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return np.zeros(width), q[:, :bits]


def plan(n: int, bits: int, tables: int, block: int) -> tuple[int, int]:
    """Tables and the bits that may differ in a part, for n vectors under one label."""
    wanted = max(0, int(np.ceil(np.log2(max(n, 1) / block))))
    if wanted <= bits // tables:
        return tables, 0
    return int(np.clip(bits // wanted, min(2, bits), tables)), 1


def parts(bits: int, tables: int) -> list[tuple[int, int]]:
    """First bit and mask of each table's part."""
    edge = [bits * t // tables for t in range(tables + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a]


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indexes of edges that span what all edges connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    used = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            used.append(k)
    return used


def link_blocks(buckets: DataFrame, threshold: float) -> DataFrame:
    """From rows ``cell, side, table, rep, copies, code, probe, shape, vector`` by cell: edges ``a, b`` and counts ``rep, n``."""

    def pairs_of(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        size = np.diff(edge)
        for n in np.unique(size[(size > 1) & (size <= 64)]):  # small cells of one size together
            i, j = np.triu_indices(int(n), 1)
            at = edge[:-1][size == n]
            for k in range(0, len(at), max(1, 200_000 // len(i))):
                some = at[k : k + max(1, 200_000 // len(i)), None]
                yield (some + i).ravel(), (some + j).ravel()
        for at, n in zip(edge[:-1][size > 64], size[size > 64], strict=True):
            for lo in range(0, n, 256):
                i, j = np.meshgrid(np.arange(lo, min(n, lo + 256)), np.arange(lo, n), indexing="ij")
                on = i < j
                yield at + i[on], at + j[on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            cols = read(b)
            cols = cols if rest is None else [joined(x, y) for x, y in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            stop = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1 if (cols[0] != cols[0][-1]).any() else 0
            if stop:
                yield compare([c[:stop] for c in cols])
            rest = [c[stop:] for c in cols]
        if rest is not None and len(rest[0]):
            yield compare(rest)

    def read(b: pa.RecordBatch) -> list[np.ndarray]:
        flat = b.column(8)
        width = np.diff(flat.offsets.to_numpy())
        x = np.zeros((len(flat), int(width.max(initial=0))))  # shorter vectors end in zeros, which change no cosine
        x[np.arange(x.shape[1]) < width[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
        return [*(b.column(k).to_numpy(zero_copy_only=False) for k in range(8)), x]

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if x.ndim == 2 and x.shape[1] != y.shape[1]:
            x, y = (np.pad(z, ((0, 0), (0, max(x.shape[1], y.shape[1]) - z.shape[1]))) for z in (x, y))
        return np.concatenate([x, y])

    def compare(cols: list[np.ndarray]) -> pa.RecordBatch:
        cell, side, table, rep, copies, code, probe, shape, x = cols
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        code = code.view(np.uint64)
        near_a, near_b = [], []
        for i, j in pairs_of(cell):
            # Off the diagonal of a hot bucket only the two sides meet; on it side is 0 everywhere. Of two parts that
            # differ in a bit, the smaller vector probes and the larger one is found.
            ok = (side[i] != side[j]) | (side[i] == 0)
            ok &= (probe[i] + probe[j] == 0) | ((probe[i] != probe[j]) & ((rep[i] < rep[j]) == (probe[i] == 1)))
            i, j = i[ok], j[ok]
            ok = np.ones(len(i), bool)
            for kind in np.unique(shape[i]):
                on = np.flatnonzero(shape[i] == kind)
                bits, tables, far = int(kind) // 100, int(kind) // 10 % 10, int(kind) % 10
                differ = code[i[on]] ^ code[j[on]]
                for t, (shift, mask) in enumerate(parts(bits, tables)):
                    met = np.bitwise_count((differ >> np.uint64(shift)) & np.uint64(mask)) <= far
                    ok[on] &= ~(met & (table[i[on]] > t))
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 100_000):
                p, q = i[k : k + 100_000], j[k : k + 100_000]
                close = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                near_a.append(p[close])
                near_b.append(q[close])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (near_a, near_b))
        n = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        on = np.flatnonzero(n)
        span = forest(rep[a], rep[b])
        edges, counts = len(span), len(on)
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(rep[a][span], pa.int64()), pa.array(rep[on], pa.int64())]),
            pa.concat_arrays([pa.array(rep[b][span], pa.int64()), pa.nulls(counts, pa.int64())]),
            pa.concat_arrays([pa.nulls(edges, pa.int64()), pa.array(n[on].astype(np.int64))]),
        ], names=["a", "b", "n"])

    return buckets.select("cell", "side", "table", "rep", "copies", "code", "probe", "shape", "vector").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, n long")


def index_of(groups: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]], tables: int, bits: int, block: int) -> DataFrame:
    """Rows ``rep, copies, code, table, part, probe, shape, vector, label, width``: each vector in each table, and where
    parts may differ in a bit also as probes of the parts one bit away. ``groups`` has ``n``, the vectors of the label."""
    names = ["rep", "copies", "code", "table", "part", "probe", "shape", "vector", "label", "width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, n = b.column(4).to_numpy(), b.column(5).to_numpy()
            for wide in np.unique(width):
                own = np.flatnonzero(width == wide)
                size = min(bits, int(wide), 64)
                mean, projection = models.get(int(wide)) or random_rotation(int(wide), size)
                v = b.column(3).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), wide).astype(np.float64)
                code = codes(v / np.linalg.norm(v, axis=1, keepdims=True), mean, projection)
                size = projection.shape[1]
                for m in np.unique(n[own]):
                    at = np.flatnonzero(n[own] == m)
                    many, far = plan(int(m), size, tables, block)
                    used = size if m > block // 16 else 0  # so few vectors all meet, in one part of no bits
                    rows = []
                    for t, (shift, mask) in enumerate(parts(used, many) or [(0, 0)]):
                        part = (code[at] >> np.uint64(shift)) & np.uint64(mask)
                        flips = [0] + [1 << k for k in range(mask.bit_length())] * far
                        rows += [(at, np.full(len(at), t), part ^ np.uint64(flip), np.full(len(at), int(flip > 0))) for flip in flips]
                    k, table, part, probe = (np.concatenate(c) for c in zip(*rows, strict=True))
                    take = pa.array(own[k])
                    shape = np.full(len(k), used * 100 + many * 10 + far)
                    cols = [b.column(0).take(take), b.column(1).take(take), *(pa.array(z.view(np.int64)) for z in (code[k], table, part, probe, shape)), *(b.column(c).take(take) for c in (3, 2, 4))]
                    for lo in range(0, len(k), 20_000):
                        yield pa.RecordBatch.from_arrays([c.slice(lo, 20_000) for c in cols], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    schema = f"rep long, copies long, code long, table long, part long, probe long, shape long, vector {kinds['vector']}, label {kinds['label']}, width long"
    return groups.select("rep", "copies", "label", "vector", "width", "n").mapInArrow(run, schema)


def near_duplicates(rows: DataFrame, vector: str = "embedding", threshold: float = 0.98, tables: int = 6, bits: int = 64, sample: int = 4000, block: int = 1024) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    able = F.col("label").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.col("vec_id").isNotNull()
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).alias("vector"), F.coalesce(able, F.lit(False)).alias("able"))
    every = every.withColumn("name", F.when(F.col("able"), F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + 0).cast("string"))), 256)))
    # The label is a key of its own: written into one string with the components it could pass for one of them.
    classes = materialize(every.where("able").groupBy("label", "name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    classes = classes.withColumn("width", F.size("vector").cast("long"))
    groups = classes.groupBy("label", "width").agg(F.count("*").alias("n"))
    lengths = groups.agg(F.count_distinct("width")).first()[0]
    if lengths:
        samples: dict[int, list] = {}
        for r in stratified_sample(classes, "rep", "width", max(64, sample // lengths)).select("width", "vector").collect():
            samples.setdefault(r["width"], []).append(r["vector"])
        models = {}
        for wide, some in samples.items():
            x = np.array(some, np.float64)
            if len(x) >= 4 * min(bits, wide, 64):  # fewer vectors would be split by their own mean
                models[wide] = learn_rotation(x / np.linalg.norm(x, axis=1, keepdims=True), min(bits, wide, 64))
        entries = index_of(classes.join(groups, ["label", "width"]), models, tables, bits, block)
        spread = materialize(entries.withColumn("bucket", F.xxhash64("label", "width", "table", "part")).drop("label", "width", "part"), "index")
        hot = spread.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")
        placed = spread.join(hot, "bucket", "left").withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.lit(0).cast("long")))
        meets = F.when(F.col("blocks") > 1, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.lit(0).cast("long")))
        placed = placed.withColumn("other", F.explode(meets))
        cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
        side = F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0)
        found = materialize(link_blocks(placed.withColumn("cell", cell).withColumn("side", side), threshold), "links")
        edges, counts = found.where("b is not null").select("a", "b"), found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        roots = connected_components(edges)
        per_class = classes.select("label", "name", "rep", "copies").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        per_class = materialize(per_class.select("label", "name", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "per_class")
    else:
        per_class = classes.select("label", "name", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    out = every.select("vec_id", "label", "name").join(per_class, ["label", "name"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
