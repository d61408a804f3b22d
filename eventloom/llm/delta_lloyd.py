"""Vector codes by product quantisation with delta-maintained Lloyd rounds (operator 11).

Components become integers ``floor(1024 * x)``, vectors are cut into four consecutive parts, and each part position has a
codebook of 256 entries that starts from the smallest ids. What a round needs of the corpus is, for each entry, the count and
the componentwise integer sum of its parts. Both are kept from round to round, and so are the assignments: a round reads the
vectors with the codes of the round before, and only parts whose code changed give a minus to the entry they left and a plus to
the one they joined. Each task adds these up before the exchange, so a round shuffles at most tasks x 1024 rows of sums,
few once assignments settle, and none of the vectors. Sums and codebooks (256 entries a position, bounded by the vector length
alone) are what the driver holds. A round without a change is the last: sums, and so entries, would stay for good.

Vectors and codes are written once a round in the shared folder beside the round's deltas, and the round before is deleted.
Distances are exact: in float64 while no square can leave 53 bits, and in Python integers beyond.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are left out. Vectors of each length have
codebooks of their own; a length that four doesn't divide is cut at ``length * k // 4``, and an empty vector has code 0 and
error 0. Where there are fewer than 256 ids the codebook has that many entries. Of an id on several rows the least vector seeds,
each row counts; a null id never seeds, and if there are null ids only, codebooks have the one entry 0. Integers beyond
2**62 are held as that; sums of errors beyond a long as the largest long. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize

PARTS, ENTRIES, SCALE = 4, 256, 1024
LARGEST, TOP = 1 << 62, (1 << 63) - 1
ROWS = "vec_id long, label {label}, width int, vector {vector}, code binary, error long, part int, entry int, n long, sums array<decimal(38,0)>"


def edges(width: int) -> list[int]:
    return [width * k // PARTS for k in range(PARTS + 1)]


def integers(x: np.ndarray) -> np.ndarray:
    """``floor(1024 * x)`` as float64 where squares of sums stay exact, else as Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x.astype(np.float64) * SCALE)
    if safe(y):
        return y
    return np.array([[int(max(-LARGEST, min(LARGEST, v))) for v in row] for row in y.tolist()], dtype=object).reshape(y.shape)


def safe(y: np.ndarray) -> bool:
    """Whether squared distances between parts of such components are below 2**53."""
    if y.dtype == object or not y.size:
        return y.dtype != object
    most = float(np.abs(y).max())
    return 4 * y.shape[1] * most * most < 2.0**53


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the smaller index."""
    if safe(np.concatenate([x, book]) if x.dtype == book.dtype else np.zeros((1, 1), dtype=object)):
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(d)), at]
    best = []
    for row in x.tolist():
        far = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, entry, strict=True)) for entry in book.tolist()]
        best.append(min(zip(far, range(len(far)), strict=True)))
    return np.array([k for _, k in best], dtype=np.int64), np.array([d for d, _ in best], dtype=object)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def assign(rows: DataFrame, books: dict[int, list[np.ndarray]], label: str, vector: str) -> DataFrame:
    """One pass: rows with new ``code`` and ``error``, and the task's sums of what changed in rows ``width, part, entry, n, sums``."""
    names = [f.split()[0] for f in ROWS.split(", ") if " " in f]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        kinds: list[pa.DataType] = []

        def note(width: int, p: int, entry: np.ndarray, x: np.ndarray, sign: int) -> None:
            if width not in deltas:
                e = edges(width)
                deltas[width] = [np.zeros((ENTRIES, b - a), dtype=object) for a, b in zip(e[:-1], e[1:], strict=True)], np.zeros((PARTS, ENTRIES), np.int64)
            sums, counts = deltas[width]
            np.add.at(counts[p], entry, sign)
            of = np.zeros(sums[p].shape, x.dtype)
            np.add.at(of, entry, x)
            sums[p] += sign * (of if of.dtype == object else of.astype(np.int64).astype(object))

        def coded(b: pa.RecordBatch) -> pa.RecordBatch:
            widths, old = b.column(2).to_numpy(), b.column(4)
            code, error = np.zeros((len(b), PARTS), np.uint8), np.zeros(len(b), np.int64)
            before = np.full((len(b), PARTS), -1)
            there = np.flatnonzero(old.is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                before[there] = np.frombuffer(b"".join(old.drop_null().to_pylist()), np.uint8).reshape(-1, PARTS)
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                x, e = integers(matrix(b.column(3).take(pa.array(own)), int(width))), edges(int(width))
                for p, book in enumerate(books[int(width)]):
                    part = x[:, e[p] : e[p + 1]]
                    at, far = nearest(part, book)
                    code[own, p] = at
                    error = error.astype(object) if far.dtype == object else error
                    error[own] += far if far.dtype == object else far.astype(np.int64)
                    moved = np.flatnonzero(before[own, p] != at)
                    left = moved[before[own[moved], p] >= 0]
                    note(int(width), p, at[moved], part[moved], 1)
                    note(int(width), p, before[own[left], p], part[left], -1)
            binary = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.arange(0, PARTS * len(b) + 1, PARTS, dtype=np.int32).tobytes()), pa.py_buffer(code.tobytes())])
            errors = pa.array(error if error.dtype != object else [min(int(v), TOP) for v in error], pa.int64())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), binary, errors, *(pa.nulls(len(b), t) for t in kinds[6:])], names=names)

        for batch in batches:
            kinds = kinds or [*(batch.schema.field(k).type for k in range(5)), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
            step = max(1, min(4096, 4_000_000 // max(1, int(max(batch.column(2).to_numpy(), default=1)))))
            for lo in range(0, len(batch), step):
                yield coded(batch.slice(lo, step))
        out = [(w, p, k, int(counts[p][k]), [int(v) for v in sums[p][k]]) for w, (sums, counts) in deltas.items() for p in range(PARTS) for k in range(ENTRIES) if counts[p][k] or any(sums[p][k])]
        for lo in range(0, len(out), 1000):
            some = out[lo : lo + 1000]
            cols = list(zip(*some, strict=True))
            sums = pa.array([[str(v) for v in s] for s in cols[4]], pa.list_(pa.string())).cast(pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), kinds[0]), pa.nulls(len(some), kinds[1]), pa.array(cols[0], pa.int32()), pa.nulls(len(some), kinds[3]), pa.nulls(len(some), kinds[4]), pa.nulls(len(some), kinds[5]), *(pa.array(c, t) for c, t in zip(cols[1:4], kinds[6:9], strict=True)), sums], names=names)

    return rows.select("vec_id", "label", "width", "vector", "code").mapInArrow(run, ROWS.format(label=label, vector=vector))


def seeds(rows: DataFrame, width: int) -> np.ndarray:
    """The vectors of the 256 smallest ids of a length, ascending."""
    own = rows.where(F.col("width") == width)
    ids = own.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES)
    found = own.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()  # at most 256
    return integers(np.array([r["vector"] for r in found], np.float64).reshape(len(found), width)) if found else np.zeros((1, width))


def compress(rows: DataFrame, vector: str = "embedding", rounds: int = 4) -> DataFrame:
    """``width, vec_id, label, vector, code, error, codebooks``: the code as bytes, and the codebooks' digest of the length."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.size(vector).alias("width"), F.col(vector).alias("vector"), F.lit(None).cast("binary").alias("code"))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    widths = [r["width"] for r in kept.select("width").distinct().collect()]
    books: dict[int, list[np.ndarray]] = {}
    sums: dict[int, list[np.ndarray]] = {}
    counts: dict[int, np.ndarray] = {}
    for w in widths:
        first, e = seeds(kept, w), edges(w)
        books[w] = [first[:, a:b] for a, b in zip(e[:-1], e[1:], strict=True)]
        sums[w], counts[w] = [np.zeros((ENTRIES, b - a), dtype=object) for a, b in zip(e[:-1], e[1:], strict=True)], np.zeros((PARTS, ENTRIES), dtype=object)
    state = kept
    for k in range(rounds + 1):
        new = materialize(assign(state, books, kinds["label"], kinds["vector"]), f"lloyd-{k}")
        if k:
            discard(done)  # noqa: F821
        done, state = new, new.where("part is null").select("vec_id", "label", "width", "vector", "code")
        if k == rounds:
            break
        each = new.where("part is not null").select("width", "part", "entry", "n", F.posexplode_outer("sums").alias("at", "s"))
        # A row for each component of the entries that changed: bounded by the codebooks.
        changed = each.groupBy("width", "part", "entry", "at").agg(F.sum("n").cast("long").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).toArrow().to_pylist()
        if not any(r["n"] or r["s"] for r in changed):
            break
        for r in changed:
            if not r["at"]:
                counts[r["width"]][r["part"]][r["entry"]] += r["n"]
            if r["at"] is not None:
                sums[r["width"]][r["part"]][r["entry"], r["at"]] += int(r["s"])
        for w in widths:
            for p in range(PARTS):
                book = books[w][p].astype(object)
                for i in range(len(book)):
                    if counts[w][p][i]:
                        book[i] = [int(s) // int(counts[w][p][i]) for s in sums[w][p][i]]
                exact = book.astype(np.float64) if book.size else np.zeros(book.shape)
                books[w][p] = exact if safe(exact) else book
    names = [(w, hashlib.sha256(",".join(str(int(v)) for book in books[w] for entry in book for v in entry).encode()).hexdigest()) for w in widths]
    digests = rows.sparkSession.createDataFrame(names, "width int, codebooks string")  # a row for each length
    return done.where("part is null").select("vec_id", "label", "width", "vector", "code", "error").join(F.broadcast(digests), "width")


def digest(coded: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; codes as two hex digits a part."""
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.col("codebooks").alias("codebooks_sha256"))


def sql(rounds: int = 4) -> str:
    """The same in DuckDB, every round in full, for vectors of one length that four divides."""
    ctes = [
        """v as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "pt as materialized (select r, vec_id, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] as x from v, range(4) t(p))",
        "b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from pt qualify row_number() over (partition by p order by vec_id) <= 256)",
    ]
    for k in range(rounds + 1):
        ctes.append(f"d{k} as (select r, pt.p, e, x, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) as d from pt join b{k} b on pt.p = b.p)")
        ctes.append(f"a{k} as materialized (select r, p, min(struct_pack(d := d, e := e)) as m, any_value(x) as x from d{k} group by 1, 2)")
        if k < rounds:
            ctes.append(f"s{k} as (select p, e, i, sum(cast(x as hugeint)) as s, count(*) as n from (select p, m.e as e, unnest(range(len(x))) as i, unnest(x) as x from a{k}) group by 1, 2, 3)")
            ctes.append(f"n{k} as (select p, e, list(cast(floor(cast(s as double) / n) as double) order by i) as c from s{k} group by 1, 2)")
            ctes.append(f"b{k + 1} as materialized (select b.p, b.e, coalesce(n.c, b.c) as c from b{k} b left join n{k} n on b.p = n.p and b.e = n.e)")
    ctes.append(f"h as (select sha256(string_agg(array_to_string(list_transform(c, lambda z: cast(cast(z as bigint) as varchar)), ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})")
    ctes.append(f"o as (select r, string_agg(printf('%02x', cast(m.e as int)), '' order by p) as code, cast(sum(m.d) as bigint) as error from a{rounds} group by 1)")
    return "with " + ",\n".join(ctes) + "\nselect vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from v join o using (r), h"
