"""Exact n-gram Jaccard self-join by set-relation skipping (operator 10).

A document is the set of its distinct word n-grams, 64-bit hashes. Equal sets are one class, named by a fingerprint, and
only classes are compared. All sets share one order of n-grams: rare before frequent, then by hash. With threshold t, two
similar sets of sizes m and n share at least ``need(m, n)`` n-grams, so if each shows its first ``size - need + k``
n-grams (its head), they share at least ``k`` of those.

Index-level skipping: a list of a rare n-gram is short, and its pairs are made and counted; a pair of short lists needs
``k`` of them. The list of a frequent n-gram is never built. It has a leader instead, the class with the smallest share
of rare n-grams, and whoever shows the n-gram is compared with the leader alone.

Answer-level skipping: with ``S(u)`` the n-grams in which ``u`` and its leader differ, two members of a leader differ in
``|S(u)| + |S(v)| - 2 |S(u) & S(v)|`` n-grams. So their answer follows from the answers of the leader and the
differences: where both are small, both are linked to the leader already, and else the members share at least a known
number of differences. Each member posts only as many differences as a link to another component can require, seldom
ones first; lists of differences are held in blocks, and block pairs whose positions rule a link out are skipped. What
is left is verified against whole texts.

Defined cases: texts without words, and null texts, have empty sets, link with nothing and are their own component.
Fewer than n words: the whole sequence is the only n-gram. Repeated rows and copies fall into one component by
definition (equal sets). The smallest id that is not null names a component; a row without id, or with an id that other
texts have too, is linked by its own text. Other columns are ignored. Which n-grams count as frequent changes speed, not
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, tidy
from .components import connected_components
from .textfeat import LOWER, SPACED, mix, slices, span_hashes, word_spans

#: An n-gram counts as frequent from so many classes on, counted in runs of CHUNK n-grams where it occurs LOCAL times: it then
#: occurs some times as often in all. At most MOST_FREQUENT are known (16 MB); lists of the others are led by their first class.
FREQUENT, LOCAL, CHUNK, MOST_FREQUENT = 6, 2, 4_000_000, 1_000_000
#: Pairs are made in lists of so many classes at most; longer ones have a leader, so no list makes more than SHORT / 2 pairs a posting.
SHORT = 32
BLOCK = 1024
#: A list of more differences is dealt to cells of two blocks of about so many.
CELL = 4096
#: Cells of a set's parity bits.
BITS = 256
#: Keys that the classes of one frequent n-gram are dealt to on their way to its leader.
SALTS = 16


def sets_of(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, ascending within the row, and the offsets of the rows."""
    raw = LOWER[raw]
    s, e = word_spans(raw, at, SPACED)
    w = span_hashes(raw, s, e)
    first = np.searchsorted(s, at)
    words = np.diff(first)
    gram = np.zeros(len(w), np.uint64)
    for k in range(n):
        part = w[k:] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        gram[: len(part)] += part
    gram = mix(gram)
    row = np.repeat(np.arange(len(words)), words)
    left = first[1:][row] - np.arange(len(w))
    keep = left >= n
    for r in np.flatnonzero((words > 0) & (words < n)):
        i = first[r]
        total = int(words[r]) + sum(int(w[i + k]) * pow(0xA24BAED4963EE407, k + 1, 1 << 64) for k in range(words[r]))
        gram[i] = mix(np.array([total % (1 << 64)], np.uint64))[0]
        keep[i] = True
    gram, row = gram[keep], row[keep]
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    gram, row = gram[new], row[new]
    return gram, np.searchsorted(row, np.arange(len(words) + 1))


def fingerprints(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set; 0 for the empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(gram ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    size = np.diff(at)
    f = mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return np.where(size == 0, 0, np.where(f == 0, 1, f)).astype(np.uint64)


def parities(gram: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set, whether the number of its n-grams in each of BITS cells is odd. Two sets differ in at least as many
    n-grams as these bits differ."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    odd = np.bincount(row * BITS + (gram % np.uint64(BITS)).astype(np.int64), minlength=rows * BITS).reshape(rows, BITS) & 1
    return [r.tobytes() for r in np.packbits(odd.astype(np.uint8), axis=1)]


def need(m, n, percent: int):
    """Least intersection of two similar sets of sizes m and n, in integers: 100 i >= percent (m + n - i)."""
    return -(-percent * (m + n) // (100 + percent))


def shown(size, percent: int):
    """How many first n-grams a set shows, and how many of them similar sets share at least (half the plain prefix more)."""
    least = -(-percent * size // 100)
    plain = size - least + 1
    extra = plain // 2
    return np.minimum(size, plain + extra), extra + 1


def describe(documents: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, body, n_shingles, fp`` of every row, and ``gram, df`` of n-grams that are frequent in some run of rows."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "body", "n_shingles", "fp", "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        none = None

        def frequent() -> pa.RecordBatch:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            g, c = g[c >= LOCAL].view(np.int64), c[c >= LOCAL]
            return pa.RecordBatch.from_arrays([pa.nulls(len(g), none), pa.nulls(len(g), pa.int64()), pa.array(c.astype(np.int64)), pa.nulls(len(g), pa.int64()), pa.array(g)], names=names)

        for b in batches:
            none = b.column(0).type
            for i, j, raw, at in slices(b.column(2), rows=4000):
                gram, to = sets_of(raw, at, n)
                fp = fingerprints(gram, to)
                fresh = np.array([f not in seen and not seen.add(f) for f in fp.tolist()], bool)  # a class counts once a run
                held.append(gram[np.repeat(fresh, np.diff(to))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(to)), pa.array(fp.view(np.int64)), pa.nulls(j - i, pa.int64())], names=names)
                if sum(map(len, held)) >= CHUNK:
                    yield frequent()
                    held, seen = [], set()
        if held:
            yield frequent()

    facts = materialize(documents.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(tidy(run), f"doc_id {kind}, body long, n_shingles long, fp long, gram long"), "sets")
    often = facts.where("gram is not null").groupBy("gram").agg(F.sum("n_shingles").alias("df")).where(F.col("df") >= FREQUENT)
    return facts.where("gram is null").drop("gram"), often


class Frequencies:
    """Document counts of the most frequent n-grams, at most MOST_FREQUENT pairs of numbers, sent to all tasks once."""

    def __init__(self, often: DataFrame):
        top = often.orderBy(F.desc("df"), "gram").limit(MOST_FREQUENT).toPandas()
        gram = top["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(gram)
        self.table = often.sparkSession.sparkContext.broadcast((gram[order], top["df"].to_numpy(np.int64)[order]))

    def of(self, gram: np.ndarray) -> np.ndarray:
        """Counts of n-grams, 0 for those that are not known as frequent."""
        known, df = self.table.value
        if not len(known):
            return np.zeros(len(gram), np.int64)
        k = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        return np.where(known[k] == gram, df[k], 0)


def heads(documents: DataFrame, frequencies: Frequencies, n: int, percent: int) -> DataFrame:
    """Heads of all classes that can link; a task sends a class once.

    ``gram, fp, size`` of each rare n-gram of a head, and one row ``fp, size, rank, often`` of a class with frequent ones:
    their 64-bit hashes, and its share of rare n-grams in millionths.
    """
    names = ["gram", "fp", "size", "rank", "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, raw, at in slices(b.column(0)):
                gram, to = sets_of(raw, at, n)
                fp, size = fingerprints(gram, to), np.diff(to)
                # A smaller set is similar to no other: even one n-gram more is too much.
                able = size * 100 >= percent * (size + 1)
                take = np.array([ok and f not in seen and not seen.add(f) for ok, f in zip(able.tolist(), fp.tolist(), strict=True)], bool)
                if len(seen) > 2_000_000:
                    seen = set()
                row = np.repeat(np.arange(len(size)), size)
                on = take[row]
                gram, row = gram[on], row[on]
                if not len(gram):
                    continue
                df = frequencies.of(gram)
                tier = np.where(df > 0, np.log2(np.maximum(df, 1)).astype(np.int64) + 1, 0)
                o = np.lexsort((gram, tier, row))
                gram, row, tier = gram[o], row[o], tier[o]
                rare = np.bincount(row[tier == 0], minlength=len(size))
                on = np.arange(len(row)) - np.searchsorted(row, row) < shown(size, percent)[0][row]
                gram, row, tier = gram[on].view(np.int64), row[on], tier[on]
                key = fp.view(np.int64)
                r = row[tier == 0]
                yield pa.RecordBatch.from_arrays([pa.array(gram[tier == 0]), pa.array(key[r]), pa.array(size[r].astype(np.int32)), pa.nulls(len(r), pa.int32()), pa.nulls(len(r), pa.binary())], names=names)
                row, gram = row[tier > 0], gram[tier > 0]
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
                r = row[first]
                lists = pa.array([x.tobytes() for x in np.split(gram, first[1:])] if len(r) else [], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key[r]), pa.array(key[r]), pa.array(size[r].astype(np.int32)), pa.array((rare[r] * 1_000_000 // np.maximum(size[r], 1)).astype(np.int32)), lists], names=names)

    return documents.select("text").mapInArrow(tidy(run), "gram long, fp long, size int, rank int, often binary")


def met(heads_: DataFrame, percent: int) -> DataFrame:
    """What the lists give, by ``kind``: 0, classes ``a, b`` that share ``n`` n-grams of short lists, of which they need
    ``least`` in all; 1, class ``a`` in a long list led by ``b``; 2, class ``a`` of rank ``n`` with a frequent n-gram ``b``.

    Streams lists sorted by n-gram; what is held of a list is at most SHORT classes, or the leader of a longer one.
    """
    names, short = ["kind", "a", "b", "n", "least"], SHORT

    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.asarray(x).astype(np.int64)) for x in (a, b, n, least))], names=names)

    def counted(pairs: list) -> pa.RecordBatch:
        a, b, least = (np.concatenate(x) for x in zip(*pairs, strict=True))
        o = np.lexsort((b, a))
        a, b, least = a[o], b[o], least[o]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return rows(0, a[at], b[at], np.diff(np.append(at, len(a))), least[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None  # the list that a batch breaks off in
        far: tuple | None = None  # n-gram, leader and last class of a longer one
        pairs, many = [], 0

        def whole(f: np.ndarray, s: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs and leaders of the lists that ``at`` cuts from the classes ``f`` of sizes ``s``."""
            nonlocal pairs, many
            count = np.diff(at)
            for n in np.unique(count[(count > 1) & (count <= short)]):
                first = at[:-1][count == n]
                for lo in range(0, len(first), 4096):
                    i, j = (first[lo : lo + 4096, None] + k for k in np.triu_indices(int(n), 1))
                    x, y, m, q = f[i].ravel(), f[j].ravel(), s[i].ravel().astype(np.int64), s[j].ravel().astype(np.int64)
                    ok = percent * np.maximum(m, q) <= 100 * np.minimum(m, q)
                    x, y, m, q = x[ok], y[ok], m[ok], q[ok]
                    pairs.append((np.minimum(x, y), np.maximum(x, y), np.minimum(shown(m, percent)[1], shown(q, percent)[1])))
                    many += len(x)
                    if many >= 1_000_000:
                        yield counted(pairs)
                        pairs, many = [], 0
            for k in np.flatnonzero(count > short):
                u = f[at[k] + 1 : at[k + 1]]
                yield rows(1, u, np.full(len(u), f[at[k]]), np.zeros(len(u)), np.zeros(len(u)))

        for b in batches:
            lone = b.column(4).is_valid()
            c = b.filter(lone)
            if c.num_rows:
                held = [np.frombuffer(x, np.int64) for x in c.column(4).to_pylist()]
                f, r = (np.repeat(c.column(k).to_numpy(), [len(x) for x in held]) for k in (1, 3))
                yield rows(2, f, np.concatenate(held), r, np.zeros(len(f)))
            b = b.filter(pc.invert(lone))
            g, f, s = (b.column(k).to_numpy() for k in range(3))
            if rest is not None:
                g, f, s = (np.concatenate(x) for x in zip(rest, (g, f, s), strict=True))
                rest = None
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (f[1:] != f[:-1])
            if far is not None and len(g):
                new[0] &= (g[0], f[0]) != (far[0], far[2])
            g, f, s = g[new], f[new], s[new]
            if far is not None and len(g):
                k = int(np.searchsorted(g, far[0], "right"))
                yield rows(1, f[:k], np.full(k, far[1]), np.zeros(k), np.zeros(k))
                far = (far[0], far[1], f[-1]) if k == len(g) else None
                g, f, s = g[k:], f[k:], s[k:]
            if not len(g):
                continue
            at = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
            if at[-1] - at[-2] > short:
                far = (g[-1], f[at[-2]], f[-1])
            else:
                rest = [x[at[-2] :] for x in (g, f, s)]
                at = at[:-1]
            yield from whole(f, s, at)
        if rest is not None:
            yield from whole(rest[1], rest[2], np.array([0, len(rest[0])]))
        if pairs:
            yield counted(pairs)

    return heads_.repartition("gram").sortWithinPartitions("gram", "fp").mapInArrow(tidy(run), "kind int, a long, b long, n long, least long")


def sets_at(column: pa.Array, n: int) -> list[np.ndarray]:
    own: list[np.ndarray] = []
    for _, _, raw, at in slices(column):
        gram, to = sets_of(raw, at, n)
        own += [gram[p:q] for p, q in zip(to[:-1], to[1:], strict=True)]
    return own


def both_sets(b: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, set of ``ta`` and set of ``tb`` of a batch with ``a, b, ta, tb``; a text that repeats in a part is hashed once."""
    for lo in range(0, b.num_rows, 256):
        part = b.slice(lo, 256)
        sets = []
        for name, text in (("a", "ta"), ("b", "tb")):
            _, first, back = np.unique(part.column(name).to_numpy(), return_index=True, return_inverse=True)
            own = sets_at(part.column(text).take(pa.array(first)), n)
            sets.append([own[k] for k in back])
        for k in range(part.num_rows):
            yield lo + k, sets[0][k], sets[1][k]


def measured(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``a, b, m, q, both``: sizes and intersection of the whole sets of each pair. ``texts`` has ``fp, text`` of all in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for k, x, y in both_sets(b, n):
                out[:, k] = len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v) for v in out)], names=["a", "b", "m", "q", "both"])

    return with_texts(pairs, texts).select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long, m long, q long, both long")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    x = texts.select(F.col("fp").alias("a"), F.col("text").alias("ta"))
    y = texts.select(F.col("fp").alias("b"), F.col("text").alias("tb"))
    return pairs.join(x, "a").join(y, "b")


def similar(percent: int):
    return (F.col("both") > 0) & (100 * F.col("both") >= percent * (F.col("m") + F.col("q") - F.col("both")))


def members(answers: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """``a, b, m, apart, weight, comp, cells``: class ``a`` of leader ``b`` and how many differences it posts in each cell.

    ``weight`` is (100 + percent) * apart - (100 - percent) * m: two members are linked if and only if they share at least
    the sum of their weights over 2 * (100 + percent) differences. A cell is a leader and a band of sizes with the band
    below, as sizes of linked sets are close. A member is held against the least weight of another component there;
    where there is none, it posts nothing.
    """
    rows = answers.withColumn("apart", F.col("m") + F.col("q") - 2 * F.col("both"))
    rows = rows.withColumn("weight", (100 + percent) * F.col("apart") - (100 - percent) * F.col("m"))
    rows = rows.join(joined.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("comp", F.coalesce("root", "a"))
    # A band is a trifle wider than two linked sizes can be apart, so that they never stand two bands apart.
    band = F.floor(F.log(F.col("m").cast("double")) / F.log(F.lit(100 / percent * (1 + 1e-9))))
    rows = rows.withColumn("own", band).select("a", "b", "m", "apart", "weight", "comp", "own", F.explode(F.array(band, band + 1)).alias("cell"))
    rows = materialize(rows, "members")
    each = materialize(rows.groupBy("b", "cell", "comp").agg(F.min("weight").alias("weight")), "weights")
    first = each.groupBy("b", "cell").agg(F.min(F.struct("weight", "comp")).alias("x")).select("b", "cell", F.col("x.weight").alias("w1"), F.col("x.comp").alias("c1"))
    second = each.join(first, ["b", "cell"]).where("comp <> c1").groupBy("b", "cell").agg(F.first("c1").alias("c1"), F.first("w1").alias("w1"), F.min("weight").alias("w2"))
    other = F.when(F.col("comp") == F.col("c1"), F.col("w2")).otherwise(F.col("w1"))
    shares = F.greatest(F.lit(1), F.ceil((F.col("weight") + other) / F.lit(2 * (100 + percent))))
    held = rows.join(second, ["b", "cell"]).withColumn("posts", F.col("apart") - shares + 1).where("posts > 0")
    return held.groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("m", "apart", "weight", "comp", "own")), F.collect_list(F.struct("cell", "posts")).alias("cells"))


def differences(members_: DataFrame, texts: DataFrame, frequencies: Frequencies, n: int) -> DataFrame:
    """Postings ``gram, fp, size, pos, apart, weight, comp, home, bits`` of the members' differences, seldom ones first.

    ``gram`` names n-gram, leader and cell; ``home`` tells whether the cell is the band of the member's own size. How many members
    have a difference is guessed: one that the leader lacks, as often as the corpus has it; one that it has, as much more
    seldom than the leader's most frequent n-gram. The guess depends on n-gram and leader alone, so all use one order.
    """
    names = ["gram", "fp", "size", "pos", "apart", "weight", "comp", "home", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, lead, m, apart, weight, comp, own = (b.column(k).to_numpy() for k in range(7))
            cells_ = b.column(7).to_pylist()
            out: list[list[np.ndarray]] = []
            for k, x, y in both_sets(b, n):
                more, less = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                all_y = frequencies.of(y)
                top = int(all_y.max(initial=0))
                guess = np.concatenate([np.minimum(frequencies.of(more), top), top - frequencies.of(less)])
                gram = np.concatenate([more, less])
                gram = gram[np.lexsort((gram, guess))]
                bits = parities(gram, np.array([0, len(gram)]))[0]
                for cell in cells_[k]:
                    at = gram[: cell["posts"]]
                    name = mix(at ^ mix(np.array([lead[k], cell["cell"]], np.int64).view(np.uint64)).sum(dtype=np.uint64))
                    out.append([name.view(np.int64), np.arange(len(at)), np.full(len(at), k), np.full(len(at), cell["cell"] == own[k]), bits])
                if sum(len(o[0]) for o in out) > 200_000:
                    yield made(out, fp, m, apart, weight, comp)
                    out = []
            if out:
                yield made(out, fp, m, apart, weight, comp)

    def made(out: list, fp, m, apart, weight, comp) -> pa.RecordBatch:
        gram, pos, k, home = (np.concatenate([o[c] for o in out]) for c in range(4))
        bits = pa.array([o[4] for o in out], pa.binary()).take(pa.array(np.repeat(np.arange(len(out)), [len(o[0]) for o in out])))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, fp[k], m[k], pos.astype(np.int64), apart[k], weight[k], comp[k], home.astype(np.int64))] + [bits], names=names)

    rows = with_texts(members_, texts).select("a", "b", "m", "apart", "weight", "comp", "own", "cells", "ta", "tb")
    return rows.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names[:-1]) + ", bits binary")


def cells(lists: DataFrame) -> DataFrame:
    """Postings of lists that hold several components, with the cell ``x, y`` they are compared in and their block ``own``.

    A list of more than CELL postings is dealt to blocks by component, or within a component that would fill a block.
    Every two blocks that can hold a pair are one cell, so a task never holds more than two blocks, and members of one
    large component do not meet each other.
    """
    mixed = lists.groupBy("gram").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n"), F.max("home").alias("any")).where("least < most and any = 1").select("gram", "n")
    held = materialize(lists.join(mixed, "gram"), "mixed")
    zero = F.lit(0).cast("long")
    short = held.where(F.col("n") <= CELL).select("*", zero.alias("own"), zero.alias("x"), zero.alias("y")).drop("n")

    long = held.where(F.col("n") > CELL)
    large = long.groupBy("gram", "comp").agg(F.count("*").alias("many")).where(F.col("many") > CELL // 8)
    spread = F.when(F.col("many").isNull(), F.xxhash64(F.pmod(F.xxhash64("comp"), F.ceil(F.col("n") / CELL)))).otherwise(F.xxhash64("comp", F.pmod(F.xxhash64("fp"), F.ceil(F.col("many") / CELL))))
    placed = long.join(large, ["gram", "comp"], "left").withColumn("own", spread).drop("many", "n")
    blocks = placed.groupBy("gram", "own").agg(F.min("comp").alias("c"), F.max("comp").alias("d"))
    x, y = (blocks.select("gram", *(F.col(c).alias(f"{side}_{c}") for c in ("own", "c", "d"))) for side in "xy")
    one = (F.col("x_c") == F.col("x_d")) & (F.col("y_c") == F.col("y_d")) & (F.col("x_c") == F.col("y_c"))
    both = x.join(y, "gram").where((F.col("x_own") <= F.col("y_own")) & ~one).select("gram", F.col("x_own").alias("x"), F.col("y_own").alias("y"))
    sides = both.select("gram", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("own"))
    return short.unionByName(placed.join(sides, ["gram", "own"]))


def lists_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Edges and columns of runs of whole lists, from rows sorted by their first ``keys`` columns; the last list of a batch
    waits for the next batch."""

    def plain(c: pa.Array) -> np.ndarray:
        if pa.types.is_binary(c.type):  # of one width: rows of whole words
            return np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1 if len(c) else BITS // 64)
        return c.to_numpy(zero_copy_only=False)

    def edges(cols: list[np.ndarray]) -> np.ndarray:
        new = np.ones(len(cols[0]) + 1, bool)
        new[1:-1] = np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)
        return np.flatnonzero(new)

    rest: list[np.ndarray] | None = None
    for b in batches:
        cols = [plain(b.column(k)) for k in range(b.num_columns)]
        cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        at = edges(cols)
        if len(at) > 2:
            yield at[:-1], [c[: at[-2]] for c in cols]
        rest = [c[at[-2] :] for c in cols]
    if rest is not None and len(rest[0]):
        yield edges(rest), rest


def cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of different components that share a posted difference where enough can follow for the least number.

    The first difference that a pair shares stands where so many can follow in both; each pair is sent once a task.
    """
    full, block = 2 * (100 + percent), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def once(pairs: list) -> pa.RecordBatch:
            p = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

        pairs, many = [], 0
        for edge, (_, cx, cy, f, size, pos, apart, weight, comp, home, bits, own) in lists_of(batches, 3):
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                # Sorted by what can follow: a block is compared with others while that can be enough.
                o = i + np.lexsort((f[i:j], pos[i:j] - apart[i:j]))
                fo, so, wo, co, ho, bo = f[o], size[o], weight[o], comp[o], home[o], own[o]
                left = (apart - pos)[o]
                for x in range(0, len(o), block):
                    xs = slice(x, x + block)
                    for y in range(x, len(o), block):
                        ys = slice(y, y + block)
                        if left[y] * full < wo[xs].min() + wo[ys].min():
                            continue
                        ok = (co[xs, None] != co[None, ys]) & (percent * np.maximum(so[xs, None], so[None, ys]) <= 100 * np.minimum(so[xs, None], so[None, ys]))
                        ok &= (ho[xs, None] | ho[None, ys]) > 0
                        ok &= np.minimum(left[xs, None], left[None, ys]) * full >= wo[xs, None] + wo[None, ys]
                        if cx[i] != cy[i]:
                            ok &= bo[xs, None] != bo[None, ys]
                        if x == y:
                            ok = np.triu(ok, 1)
                        p, q = np.nonzero(ok)
                        if len(p):  # no more n-grams may differ than similar sets can differ in, so no more bits
                            odd = np.bitwise_count(bits[o[xs]][p] ^ bits[o[ys]][q]).sum(axis=1, dtype=np.int64)
                            on = odd * (100 + percent) <= (so[xs][p] + so[ys][q]) * (100 - percent)
                            p, q = fo[xs][p[on]], fo[ys][q[on]]
                            pairs.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
                            many += len(p)
                            if many >= 500_000:
                                yield once(pairs)
                                pairs, many = [], 0
        yield once(pairs)

    dealt = cells(lists).select("gram", "x", "y", "fp", "size", "pos", "apart", "weight", "comp", "home", "bits", "own")
    return dealt.repartition("gram", "x", "y").sortWithinPartitions("gram", "x", "y").mapInArrow(tidy(run), "a long, b long").distinct()


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of every row, and ``body, group``.

    ``class_id`` is the smallest id with the same set, ``body`` the xxhash64 of the text and ``group`` a name of the
    component that is there without any id, too; null where there are no words.
    """
    facts, often = describe(documents, n)
    frequencies = Frequencies(often)
    found = materialize(met(heads(documents, frequencies, n, percent), percent), "met")
    classes = materialize(facts.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.min("body").alias("body")), "classes")
    source = documents.select(F.xxhash64("text").alias("body"), "text")

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(classes.select("fp", "body"), "fp")
        return materialize(source.join(wanted, "body").dropDuplicates(["fp"]).select("fp", "text"), "texts")

    # Every class against the leaders of its frequent n-grams.
    shows = found.where("kind = 2").select("a", F.col("n").alias("rank"), F.col("b").alias("gram"))
    leads = shows.groupBy("gram").agg(F.min(F.struct("rank", "a")).alias("x")).select("gram", F.col("x.a").alias("b"))
    # Many classes may show one n-gram: they are dealt to SALTS keys, and its leader, a small row, is repeated for each.
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS))
    led = shows.withColumn("salt", salt).join(leads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["gram", "salt"]).select("a", "b").union(found.where("kind = 1").select("a", "b"))
    led = materialize(led.where("a <> b").distinct(), "led")
    texts = texts_of(led)
    answers = materialize(measured(led, texts, n), "answers")
    links = answers.where(similar(percent)).select("a", "b")
    joined = materialize(connected_components(links), "joined")

    # Across components: members of a leader by their differences, and pairs of short lists.
    posted = differences(members(answers, joined, percent), texts, frequencies, n)
    derived = cross_pairs(materialize(posted, "differences"), percent)
    counted = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("least").alias("least")).where("n >= least").select("a", "b")
    known = joined.select("node", "root")
    short = counted.join(known.toDF("a", "ra"), "a", "left").join(known.toDF("b", "rb"), "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b")
    pairs = materialize(derived.union(short).distinct(), "pairs")
    more = measured(pairs, texts_of(pairs), n).where(similar(percent)).select("a", "b")
    final = materialize(connected_components(links.union(more)), "components")

    named = final.withColumnRenamed("node", "fp").join(classes, "fp")
    lowest = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    linked = named.select("fp", "root").join(lowest, "root")
    labels = materialize(classes.join(linked, "fp", "left").select("fp", "class_id", F.coalesce("root", "fp").alias("group"), F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("component_id")).alias("component_id")), "labels")
    empty = F.col("n_shingles") == 0
    return facts.join(labels, "fp", "left").select("doc_id", "n_shingles", *(F.when(empty, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")), "body", "group")
