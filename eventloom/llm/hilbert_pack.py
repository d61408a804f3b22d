"""Packing along a space-filling curve (operator 7).

Each document becomes the ids of its text and a closing id; a hashed histogram of the ids, projected to three
dimensions, gives its Hilbert key. Documents are range-sorted by the key and a salt below it, so a group of copies with one
key is spread over as many partitions as it needs, and written once with their ids. Prefix sums over the partitions' totals
then give every id a place in one gapless stream along the curve, which is cut every ``size`` ids: neighbours on the
curve share sequences and only the last sequence is short.

Defined cases: null and empty texts are the closing id alone. Repeated rows and repeated or null ids are separate
documents. An empty table gives no pieces. Very long texts span as many sequences as they need. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, tidy
from .textfeat import mix, slices

DIMS, BITS, HASHED = 3, 10, 64
#: Whitespace-separated chunks of odd texts and words whose ids a worker remembers at most.
CHUNKS, WORDS = 200_000, 700_000
#: Pieces that the tokenizer takes one by one, in texts of ASCII and accented Latin letters.
PIECES = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff\u0101\u0107\u010d\u0119\u0142\u0144\u0153\u015b\u0161\u017c\u017e]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z\u00df-\u00f6\u00f8-\u00ff\u0101\u0107\u010d\u0119\u0142\u0144\u0153\u015b\u0161\u017c\u017e0-9]+")
#: What those texts consist of, lower-cased, beside white space; of other texts any other chunk goes to the tokenizer whole.
SIMPLE = re.compile(r"[!-;=-~\u00df-\u00f6\u00f8-\u00ff\u0101\u0107\u010d\u0119\u0142\u0144\u0153\u015b\u0161\u017c\u017e\t-\r ]*")
#: Texts by which a worker finds out whether its tokenizer cuts as assumed here.
PROBES = [
    "It's what we're SURE they'll've don't I'd 'S ''s s'", "foo-bar  x1234\t3.14 (a+b)=c; \"quoted\"... A.B.C. _under_ 100% ~`^|\\", "\n \u00c4\u00d6 stra\u00dfe na\u00efve \u010de\u0161tina \u0141\u00d3D\u0179\r\n",
    "http://a.b/c?d=e&f=1 @user #tag $5 {x} [y] <b>bold</b> <w/>", "\u4e2d\u6587 \u043f\u0440\u0438\u0432\u0435\u0442 e\u0301 \u0130stanbul caf\u00e9\u2014\u201cx\u201d", "", " ",
]
_workers: dict[tuple[str, int], PieceEncoder] = {}


class PieceEncoder:
    """Ids of texts for tokenizers that drop white space and mark word ends, with a bounded memory of words and chunks.

    Simple texts are cut into the pieces that the tokenizer would merge separately, and only pieces not seen before are
    encoded, many at a time: the word-end mark on ids tells them apart again. Other texts are split at ASCII white space, and
    chunks that are not simple go to the tokenizer whole. Both are tried on a few texts first: a tokenizer that cuts otherwise
    gets whole chunks, or whole texts if white space matters to it.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.words = Tokenizer.from_file(path), {}, {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.end, self.width = end, 2 if max(end, len(self.ends) - 1) < 1 << 16 else 4
        probes = [p.encode() for p in PROBES]
        truth = [x + self.bytes_of([end]) for x in self.whole(probes)]
        for self.by in ("pieces", "chunks", "texts"):
            if self.encode(probes) == truth:
                break

    def bytes_of(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [self.bytes_of(e.ids) for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)] if texts else []

    def learn_words(self, found: set[str]) -> None:
        """Makes all words of ``found`` known. When the memory is full, only what this batch uses is kept: mostly the frequent ones."""
        new = [*found.difference(self.words)]
        if len(self.words) + len(new) > WORDS:
            self.words = {w: self.words[w] for w in found if w in self.words}
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, f"<u{self.width}")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):  # not one piece a word: encode one by one
                self.words.update(zip(part, self.whole([w.encode() for w in part]), strict=True))
                continue
            raw, last = ids.tobytes(), (self.width * last).tolist()
            self.words.update(zip(part, [raw[p:q] for p, q in zip([0, *last], last, strict=False)], strict=True))

    def pieces_of(self, text: bytes) -> list[str] | None:
        """The pieces of a simple text."""
        given = text.decode()
        t = given.lower()
        return PIECES.findall(t) if self.by == "pieces" and len(t) == len(given) and SIMPLE.fullmatch(t) else None

    def learn_chunks(self, found: set[bytes]) -> None:
        new = found.difference(self.known)
        if len(self.known) + len(new) > CHUNKS:
            self.known = {c: self.known[c] for c in found if c in self.known}
        cut = {c: self.pieces_of(c) for c in new}
        self.learn_words(set().union(*(p for p in cut.values() if p is not None)))
        odd = [c for c, p in cut.items() if p is None]
        self.known.update((c, b"".join([self.words[w] for w in p])) for c, p in cut.items() if p is not None)
        self.known.update(zip(odd, self.whole(odd), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text and the closing id, little-endian in ``width`` bytes each: two where all ids fit."""
        stop = self.bytes_of([self.end])
        if self.by == "texts":
            return [x + stop for x in self.whole(texts)]
        cut = [self.pieces_of(t) for t in texts]
        odd = {k: t.split() for k, (t, p) in enumerate(zip(texts, cut, strict=True)) if p is None}
        self.learn_chunks(set().union(*odd.values()))
        self.learn_words(set().union(*(p for p in cut if p is not None)))
        word, chunk = self.words.__getitem__, self.known.__getitem__
        return [(b"".join(map(chunk, odd[k])) if p is None else b"".join(map(word, p))) + stop for k, p in enumerate(cut)]


def encoder(path: str, end: int) -> PieceEncoder:
    if (path, end) not in _workers:
        _workers[path, end] = PieceEncoder(path, end)
    return _workers[path, end]


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows) with ``bits`` bits a dimension.

    Coordinates are rotated and reflected into the curve's local frame from the highest bit down, then Gray-decoded.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as concatenated ids: hashed histogram, fixed random projection, squashed to cells."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bucket = (mix(ids.astype(np.uint64)) >> np.uint64(58)).astype(np.int64)
    v = np.bincount(row * HASHED + bucket, minlength=(len(at) - 1) * HASHED).reshape(-1, HASHED).astype(np.float64)
    v = np.sqrt(v / np.maximum(v.sum(axis=1, keepdims=True), 1))
    v -= v.mean(axis=1, keepdims=True)
    plane = np.random.default_rng(3).standard_normal((HASHED, DIMS))
    unit = 1 / (1 + np.exp(-3 * (v @ plane)))
    return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encode_documents(documents: DataFrame, tokenizer_path: str, end: int, bounds: np.ndarray | None = None) -> DataFrame:
    """``doc_id``, ``place``, ``part``, ``n`` and the ``n`` ``ids`` (little-endian, two or four bytes each) of every row.

    ``place`` is the Hilbert key with a salt below it, ``part`` the interval of ``bounds`` that holds it.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    bounds = np.zeros(0, np.int64) if bounds is None else bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, salt = encoder(tokenizer_path, end), TaskContext.get().partitionId() << 34
        for b in batches:
            for i, j, raw, at in slices(b.column(1), 1_000_000, 2000):
                data = raw.tobytes()
                ids = enc.encode([data[p:q] for p, q in zip(at[:-1], at[1:], strict=True)])
                sizes = np.cumsum([0, *(len(x) // enc.width for x in ids)])
                keys = curve_keys(np.frombuffer(b"".join(ids), f"<u{enc.width}"), sizes)
                place = (keys << 32) | (mix(np.arange(salt, salt + j - i, dtype=np.uint64)) >> np.uint64(32)).astype(np.int64)
                salt += j - i
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(place), pa.array(np.searchsorted(bounds, place).astype(np.int32)), pa.array(np.diff(sizes)), pa.array(ids, pa.binary())], names=["doc_id", "place", "part", "n", "ids"])

    return documents.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, place long, part int, n long, ids binary")


def range_bounds(documents: DataFrame, tokenizer_path: str, end: int, parts: int, least: int = 4000) -> np.ndarray:
    """Places that cut the curve into ``parts`` intervals of about equally many ids, from a sample of at least ``least`` rows and twenty a part.

    Encoding is the dear step, so the sample alone is encoded twice, not all rows.
    """
    rows = documents.count()
    share = min(1.0, max(least, 20 * parts) / max(1, rows))
    some = documents if share == 1 else documents.sample(fraction=share, seed=1)
    found = encode_documents(some, tokenizer_path, end).select("place", "n").orderBy("place").toPandas()
    if not len(found):
        return np.zeros(0, np.int64)
    upto = found["n"].cumsum().to_numpy()
    return found["place"].to_numpy()[np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)]


def pack(documents: DataFrame, tokenizer_path: str, size: int = 2048, end: int = 1) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part)), pa.array(first), b.column(1), b.column(2)], names=["doc_id", "part", "first", "n", "ids"])

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(documents, tokenizer_path, end, parts)
    along = encode_documents(documents, tokenizer_path, end, bounds).repartitionById(parts, F.col("part")).sortWithinPartitions("place").select("doc_id", "n", "ids")
    placed = materialize(along.mapInArrow(tidy(place), f"doc_id {kind}, part long, first long, n long, ids binary"), "packed")
    before, total = {}, 0
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a partition
        before[r["part"]], total = total, total + r["n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            whose, out = [], {k: [] for k in names}
            for k, (part, first, n, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)):
                place, start = before[part] + first, 0
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                while start < n:
                    seq, offset = divmod(place + start, size)
                    length = min(size - offset, n - start)
                    whose.append(k)
                    for name, v in zip(names, (start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, seq, offset), strict=True):
                        out[name].append(v)
                    start += length
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whose, pa.int64())), *(pa.array(out[k], pa.int64()) for k in names)], names=["doc_id", *names])

    return placed.mapInArrow(tidy(cut), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
