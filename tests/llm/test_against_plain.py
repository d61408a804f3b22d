"""Results against plain versions, exact round trips and held-out accuracy on the smallest tables."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plain import base_spans, sha, shingles, similar_pairs, union_find
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from conftest import DATA
from eventloom.llm import _common, hilbert_pack, itq_dedup, jaccard_join, license_scan, pivot_search, quality_knn, queries, secret_scan, temperature_mix, toxicity_mil


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def test_licence_files_and_inheritance(spark):
    """Wrapped licence files of common layouts, one at the root; who inherits what, against a plain walk up the path."""
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe rest."
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this document, but changing it is not allowed."
    apache = "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS"
    mpl = "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"
    header = "Released under the BSD License.\ncode"
    files = {"LICENSE": mit, "src/a.py": "code", "src/deep/b.py": "x", "gpl/COPYING": gpl, "gpl/src/c.c": "int", "ap/LICENSE.txt": apache, "ap/x/y/z.js": "", "mpl/licence-mpl": mpl, "mpl/q.py": header, "mpl/r.py": "r", "mpl/s.py": header, "bsd/one.py": header, "bsd/two.py": "two", "lonely.txt": None, "src/LICENSES.py": "nothing"}
    want = {"LICENSE": "MIT", "gpl/COPYING": "GPL-3.0", "ap/LICENSE.txt": "Apache-2.0", "mpl/licence-mpl": "MPL-2.0", "mpl/q.py": "BSD-3-Clause", "mpl/s.py": "BSD-3-Clause", "bsd/one.py": "BSD-3-Clause"}
    declared = {"": "MIT", "gpl": "GPL-3.0", "ap": "Apache-2.0", "mpl": "MPL-2.0", "bsd": "BSD-3-Clause"}
    df = spark.createDataFrame([(p, p, t) for p, t in files.items()] + [("none", None, "x")], "file string, path string, text string")
    out = {r["file"]: r for r in license_scan.scan_licenses(df).collect()}
    for p in files:
        up = p
        while p not in want and (up := up.rpartition("/")[0]) not in declared:
            pass
        assert (out[p]["license"], out[p]["how"]) == ((want[p], "own") if p in want else (declared[up], "inherited")), p
        assert out[p]["declared_in"] == (None if p in want else up)
    assert out["none"]["how"] == "none"


def test_licence_of_repeated_files_and_unknown_ones(spark):
    """Two rows of one file id; licence files of an unknown licence, alone and beside a known one; notices; full texts without a title."""
    words = dict(sorted(license_scan.TEMPLATES, key=lambda x: len(x[1])))  # the longest of each
    owner = "Copyright (c) 2021, Some One\nAll rights reserved.\n\n"
    head = "Licensed under the Apache License, Version 2.0."
    rows = [
        ("x", "p/a.py", "Released under the MIT License."), ("x", "p/a.py", "Licensed under CC BY 4.0."), ("x", "q/a.py", "code"), ("x", "p/a.py", "Licensed under CC BY 4.0."), (None, "r/n.py", "Released under the MIT License."), (None, "r/m.py", "Licensed under CC BY 4.0."),
        ("u", "u/LICENSE", "Some terms of our own making. Ask first."), ("v", "u/f.py", head), ("w", "u/g.py", "code"), ("ww", "u/deep/g.py", "code"),
        ("k", "k/LICENSE", "Some terms of our own making."), ("l", "k/COPYING", words["Zlib"]), ("m", "k/g.py", ""),
        ("n", "n/NOTICE", "Parts are by others."), ("o", "n/f.py", head), ("e", "e/LICENSE", " \n"), ("ee", "e/f.py", head), ("en", "e/g.py", None),
        ("b2", "b2/LICENSE", owner + words["BSD-2-Clause"].replace(" 2. Red", "\n\n2. Red")), ("b3", "b3/LICENSE", owner + words["BSD-3-Clause"].replace(". IN NO", ".\nIN NO")),
        ("ag", "ag/COPYING", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation\n\nThe rest"),
        ("c0", "c0/LICENSE", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM"), ("mt", "mt/LICENSE", owner + words["MIT"]), ("m0", "m0/LICENSE", owner + words["MIT-0"]), ("is", "is/LICENSE", owner + words["ISC"]), ("0b", "0b/LICENSE", owner + words["0BSD"]),
    ]
    out = license_scan.scan_licenses(spark.createDataFrame([(*r, "x", 1) for r in rows], "file string, path string, text string, row string, whole int"))
    got = {}
    for r in out.collect():
        got.setdefault(r["file"], set()).add((r["path"], r["license"], r["how"]))
    assert got["x"] == {("p/a.py", "MIT", "own"), ("p/a.py", "CC-BY-4.0", "own"), ("q/a.py", None, "none")} and out.where("file = 'x'").count() == 4
    assert got[None] == {("r/n.py", "MIT", "own"), ("r/m.py", "CC-BY-4.0", "own")}
    one = {k: v for k, ((_, *v),) in ((k, v) for k, v in got.items() if len(v) == 1)}
    assert one["u"] == one["w"] == one["ww"] == [None, "none"] and one["v"] == ["Apache-2.0", "own"]
    assert one["k"] == [None, "none"] and one["l"] == ["Zlib", "own"] and one["m"] == ["Zlib", "inherited"]
    assert one["n"] == one["en"] == ["Apache-2.0", "inherited"]
    want = {"b2": "BSD-2-Clause", "b3": "BSD-3-Clause", "ag": "AGPL-3.0", "c0": "CC0-1.0", "mt": "MIT", "m0": "MIT-0", "is": "ISC", "0b": "0BSD"}
    assert {k: one[k][0] for k in want} == want


def test_pivot_search_equals_sql(spark):
    assert oracle.difference(queries.op2_pivot_search(spark, DATA), oracle.connect(DATA), queries.OP2_SQL) is None


def test_pivot_search_over_many_cells(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_search.pivot_top_k(df, F.col("vec_id") % 50 == 0, block=100).collect())
    z = np.floor(256 * x.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert got == want


def test_pivot_search_of_lengths_repeats_and_ties(spark):
    """Three lengths, one of them not in the pivots' sample, repeated queries, one vector in thousands of copies over many
    cells, and clusters in which bounds rule leaves out."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 8)) * 20
    rows = [(i, (centres[i % 6] + 0.05 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(5000 + i, [1.0, 2.0, 3.0]) for i in range(2500)] + [(5000, [1.0, 2.0, 3.0]), (9000, [0.5, 0.25, 0.0])]
    rows += [(9050, [3.0, 4.0]), (9051, [1.0, 1.0]), (9100, [7.0])] + rows[:1]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_search.pivot_top_k(df, F.col("vec_id") % 50 == 0, block=300, pivot_sample=500).collect())
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows]
    want = []
    for q, y in {(i, tuple(v)): (i, v) for i, v in whole if i % 50 == 0}.values():
        best = sorted((-int(v @ y), i) for i, v in whole if i != q and len(v) == len(y))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_secrets(spark, docs):
    out = {r["doc_id"]: r for r in queries.op4_secret_scan(spark, DATA).collect()}
    for i, text, _, _ in docs:
        spans = base_spans(text)
        assert out[i]["base_sha256"] == sha(spans) and set(spans) <= set(filter(None, out[i]["spans"].split(",")))


def test_secret_grammar(spark):
    texts = ["token=abc", "token=token: abcdef", "api_key : 'abcdef' apikey=xx", "ÄÖ😀 PassWd=Abcdef1", "AKIA" + "B" * 15, "xAKIA" + "B" * 16, "f" * 23, "f" * 24 + "g" + "0" * 30, "secret==abcdef", "tokentoken=a.b-c_d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r["base_sha256"] for r in secret_scan.digest(secret_scan.scan_secrets(df, F.lit("r"), F.lit("o"))).collect()}
    assert out == {i: sha(base_spans(t)) for i, t in enumerate(texts)}


def test_ownership_separates_copies(spark):
    own, copied = "Zk3" + "q7Lm" * 6, "Ab1" + "c2De" * 6
    rows = [(k, f"see {copied} here" + (f" and {own}" if k == 0 else ""), f"r{k}", f"o{k}") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    out = {r["doc_id"]: [s["value"] for s in r["added"]] for r in secret_scan.scan_secrets(df, F.col("repo"), F.col("owner")).collect()}
    assert out == {0: [own], 1: [], 2: [], 3: []}


def test_ownership_equals_a_plain_count(spark, docs):
    """Which base and owned spans are live, against sets of owners and repositories made in plain Python; hot values are salted."""
    own = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}")
    rows = [*docs, (700001, "x " + "z" * 41 + "1 end", "en", "s1"), (700002, "7_" * 30 + "b", "en", "s1"), (700003, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in secret_scan.scan_secrets(df, F.concat_ws("/", "source", "lang"), F.col("source"), rows_per_salt=3).collect()}
    found, owners, repos = {}, {}, {}
    for i, text, lang, source in rows:
        text = text or ""
        base = [(kind, int(a), int(b)) for kind, a, b in (s.split(":") for s in base_spans(text))]
        more = [("owned", m.start(), m.end()) for m in own.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for _, a, b in base)]
        found[i] = [(s, ASSIGN.fullmatch(text[s[1] : s[2]])[2] if s[0] == "assign" else text[s[1] : s[2]]) for s in base + more]
        for _, v in found[i]:
            owners.setdefault(v, set()).add(source)
            repos.setdefault(v, set()).add((source, lang))
    alone = lambda v: len(owners[v]) <= 1 and len(repos[v]) <= 8
    spans = lambda r, c: sorted((s["kind"], s["start"], s["end"]) for s in r[c])
    for i, f in found.items():
        assert spans(out[i], "live") == sorted(s for s, v in f if alone(v)) and spans(out[i], "example") == sorted(s for s, v in f if not alone(v) and s[0] != "owned")
        assert spans(out[i], "added") == sorted(s for s, v in f if alone(v) and s[0] == "owned")
    assert spans(out[700001], "added") == [("owned", 2, 44)] and spans(out[700002], "added") == [("owned", 0, 61)]


def test_values_in_many_repositories_are_examples(spark):
    df = spark.createDataFrame([(k, "token=abcdef99", f"r{k}") for k in range(5)], "doc_id long, text string, repo string")
    for most, live in ((4, 0), (5, 5)):
        assert secret_scan.scan_secrets(df, F.col("repo"), F.lit("o"), max_repositories=most).where(F.size("live") > 0).count() == live


def test_mix_draws_a_lone_document_whole(spark):
    rows = [(k, " ".join(["w"] * (7 + k % 5)), f"s{min(k // 90, 2)}") for k in range(900)] + [(900, " ".join(["w"] * 11), "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = temperature_mix.mix_sources(df, repetition=1.0, budget_share=0.9)
    assert out.where("source = 'lone'").count() == 1 and out.groupBy("doc_id").count().where("count > 1").count() == 0


def test_pack_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    extra = [(900001, "Don't STOP!?., '’s don’t <|endoftext|> naïve ÀÉ İstanbul ΣΑΣ x1y22 é ñ«a», 中文 …, a b 's'm'll '"), (900002, "_a_b--c.. 'tis 'Twas")]
    df = spark.createDataFrame([(i, x) for i, x, *_ in docs] + extra, "doc_id long, text string")
    rows = hilbert_pack.pack(df, queries.tokenizer_path()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in [*docs, *extra]:
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) == 2048 and sum(v < 2048 for v in used.values()) <= 1


@pytest.mark.parametrize(("name", "by", "end"), [("word_bpe_49k.json", "pieces", 1), ("word_bpe_49k.json", "pieces", 70_000), ("byte_bpe_50k.json", "texts", 1)])
def test_ids_are_the_tokenizers(name, by, end, monkeypatch):
    """Odd strings, with memories so small that they are emptied often; a tokenizer that keeps white space gets whole texts."""
    monkeypatch.setattr(hilbert_pack, "WORDS", 300)
    monkeypatch.setattr(hilbert_pack, "CHUNKS", 100)
    path = queries.tokenizer_path().replace("word_bpe_49k.json", name)
    rng = random.Random(4)
    letters = "abcXYZ'sdt re ve ll 019.,-_()<>\t\n \u00e9\u00df\u00c4\u0141\u4e2d\u043f\u0130 \x1c\u2014&#"
    texts = ["", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000))]
    enc = hilbert_pack.PieceEncoder(path, end)
    got = [x for k in range(0, len(texts), 500) for x in enc.encode([t.encode() for t in texts[k : k + 500]])]
    assert enc.by == by
    assert [np.frombuffer(x, f"<u{enc.width}").tolist() for x in got] == [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, end] for t in texts]


def test_hilbert_neighbours():
    n = 8
    cells = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_pack.hilbert_key(cells, 3)
    assert sorted(key) == list(range(n**3))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_embedding_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 64))
    x = np.concatenate([base, base[:60] + rng.standard_normal((60, 64)) * 0.12, np.tile(base[:1], (40, 1)) + rng.standard_normal((40, 64)) * 0.05])
    x = x.astype(np.float32).astype(float)
    label = np.arange(len(x)) % 1
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
    links = np.bincount(np.concatenate([a, b]), minlength=len(x))
    for block in (1024, 16):
        out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in itq_dedup.near_duplicates(df, block=block).collect())
        got = np.array([r[1] for r in out])
        assert (got <= links).all() and got.sum() >= 0.9 * links.sum()


def test_itq_recall_on_planted_copies(spark):
    """Near copies of the table's own vectors at cosines of 0.98 to 1, in several labels and two lengths, in tens of thousands of
    rows; a small block makes parts long and lets them differ in a bit."""
    rng = np.random.default_rng(8)
    own = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding", "label").toPandas()
    base = np.stack(own["embedding"]).astype(np.float64)
    base = np.concatenate([base, rng.standard_normal((10_000, base.shape[1]))])
    label = np.concatenate([own["label"].to_numpy() % 3, rng.choice(3, 10_000, p=[0.8, 0.15, 0.05])])
    pick = rng.integers(0, len(base), 12_000)
    unit = base[pick] / np.linalg.norm(base[pick], axis=1, keepdims=True)
    noise = rng.standard_normal(unit.shape)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    cosine = rng.uniform(0.98, 1, (len(pick), 1))
    near = cosine * unit + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    sets = [(np.concatenate([base, near]), np.concatenate([label, label[pick]])), (np.concatenate([base[:500], near[pick < 500]])[:, :5], np.concatenate([label[:500], label[pick[pick < 500]]]))]
    rows, links = [], []
    for x, y in sets:
        x = x.astype(np.float32)
        at = len(rows)
        rows += [(at + k, v, int(z)) for k, (v, z) in enumerate(zip(x.tolist(), y, strict=True))]
        u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        count = np.zeros(len(u), np.int64)
        for z in range(3):
            on = np.flatnonzero(y == z)
            for lo in range(0, len(on), 2000):
                count[on[lo : lo + 2000]] = (u[on[lo : lo + 2000]] @ u[on].T >= 0.98).sum(axis=1) - 1
        links.append(count)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8)
    for block in (1024, 8):
        got = np.array([r[1] for r in sorted((r["vec_id"], r["n_links"]) for r in itq_dedup.near_duplicates(df, block=block).collect())])
        for part, want in zip(np.split(got, [len(links[0])]), links, strict=True):
            assert (part <= want + 1e-9).all() and part.sum() >= 0.9 * want.sum(), (block, part.sum() / want.sum())
            print("recall", block, part.sum() / want.sum())


def test_itq_of_other_lengths_and_the_threshold(spark):
    """A lone pair of another length links, and so does a pair at the threshold itself."""
    rows = [(k, [math.cos(k), math.sin(k), 1.0], 1) for k in range(60)] + [(100, [1.0, 0.0], 1), (101, [1.0, 0.01], 1), (102, [1.0], 1), (103, [2.0], 1)]
    rows += [(200, [1.0, 0.0, 0.0, 0.0], 2), (201, [0.6, 0.8, 0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: r["n_links"] for r in itq_dedup.near_duplicates(df).where("vec_id >= 100 and vec_id < 200").collect()}
    assert out == {100: 1, 101: 1, 102: 1, 103: 1}
    same = {r["vec_id"]: r["n_links"] for r in itq_dedup.near_duplicates(df.where("vec_id >= 200"), threshold=0.6, tables=1, bits=1).collect()}
    assert set(same.values()) <= {0, 1}


def test_itq_labels_are_keys_of_their_own(spark):
    """Labels that hold commas and numbers, and vectors of two lengths, cannot pass for each other."""
    rows = [(1, [1.0, 2.0, 3.0], "a"), (2, [2.0, 3.0], "a,1.0"), (3, [3.0], "a,1.0,2.0"), (4, [1.0, 2.0, 3.0], "a"), (5, [2.0, 3.0], "a"), (6, [1.0, 2.0], "a,"), (7, [1.0, 2.0], "a,"), (8, [2.0, 4.0], "a,")]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).collect()}
    assert out == {1: (1, 1), 2: (0, 2), 3: (0, 3), 4: (1, 1), 5: (0, 5), 6: (2, 6), 7: (2, 6), 8: (2, 6)}


def test_jaccard_on_data(spark, docs):
    sets = [shingles(t) for _, t, *_ in docs]
    comp = union_find(len(sets), similar_pairs(sets))
    out = {r["doc_id"]: r for r in queries.op10_jaccard_join(spark, DATA).collect()}
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i, *_ in docs] == [(len(s), docs[c][0]) for s, c in zip(sets, comp)]


def test_jaccard_on_edited_groups(spark, monkeypatch):
    """Many edits of one text, of short texts and of shared passages, with small blocks and runs so that all paths work."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 8)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], text(30)
    for base in [text(120), text(40), text(9), text(6), passage]:
        for _ in range(45):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w[: len(w) - rng.choice([0, 0, 1])]))
    rows += [" ".join(text(20) + passage + text(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [shingles(t) for t in rows]
    comp = union_find(len(sets), similar_pairs(sets))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(rows))] == comp


def test_jaccard_on_stars_of_equal_length(spark):
    """Each copy is like the base alone, of its length, and its own rare n-grams fill the first places of its head."""
    rng = random.Random(5)
    rows = []
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(204)]
        rows.append(" ".join(base))
        for copy in range(50):
            w = list(base)
            for k in rng.sample(range(1, 34), 4):
                w[k * 6] = f"g{group}c{copy}k{k}"
            rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [shingles(t) for t in rows]
    comp = union_find(len(sets), similar_pairs(sets))
    assert sorted(set(comp)) == [51 * k for k in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(rows))] == comp


def test_jaccard_deals_long_lists_to_cells(spark, monkeypatch):
    """One large component, one stranger and many small components in one list: no cell holds much, every pair of two
    components meets once, and a cell of one component is not made."""
    monkeypatch.setattr(jaccard_join, "CELL", 64)
    rows = [(1, k, 1, 1) for k in range(1000)] + [(1, 1000, 2, 1)]
    rows += [(2, k, 5 if k % 3 else 10 + k, k % 2) for k in range(600)]
    rows += [(3, k, 7, 1) for k in range(300)] + [(4, k, k, 1) for k in range(2)] + [(5, k, k, 0) for k in range(2)]
    lists = spark.createDataFrame(rows, "gram long, fp long, comp long, home long")
    cells = {}
    for r in jaccard_join.cells(lists).collect():
        cells.setdefault((r["gram"], r["x"], r["y"]), []).append((r["fp"], r["comp"], r["own"]))
    assert max(map(len, cells.values())) <= 256 and {k[0] for k in cells} == {1, 2, 4}
    assert sum(len(v) for k, v in cells.items() if k[0] == 1) < 3000
    met = [(g, *sorted((a[0], b[0]))) for (g, x, y), v in cells.items() for i, a in enumerate(v) for b in v[:i] if a[1] != b[1] and (x == y or a[2] != b[2])]
    want = {(a[0], *sorted((a[1], b[1]))) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] != 5 and a[2] != b[2]}
    assert len(met) == len(set(met)) and set(met) == want


def test_jaccard_with_small_cells(spark, monkeypatch):
    for name, value in (("CELL", 8), ("BLOCK", 4), ("SHORT", 5)):
        monkeypatch.setattr(jaccard_join, name, value)
    test_jaccard_on_stars_of_equal_length(spark)
    test_jaccard_on_edited_groups(spark, monkeypatch)


def test_jaccard_without_known_frequencies(spark, monkeypatch):
    """No n-gram is known as frequent, so long lists have their first class as leader."""
    monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", 0)
    monkeypatch.setattr(jaccard_join, "SHORT", 6)
    test_jaccard_on_stars_of_equal_length(spark)
    test_jaccard_on_edited_groups(spark, monkeypatch)


def test_jaccard_of_null_and_repeated_ids(spark):
    """A row without id links to others and names nothing; rows of one id with different texts each have their own links."""
    words = [f"w{k}" for k in range(41)]
    near = [*words[:40], "end"]
    other = [f"x{k}" for k in range(41)]
    rows = [(None, words), (None, near), (5, words), (6, other), (6, words), (3, [*other[:40], "end"]), (None, [f"y{k}" for k in range(9)])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["component_id"] is None else r["component_id"]) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(-1, -1), (-1, 5), (-1, 5), (3, 3), (5, 5), (6, 3), (6, 5)]


def test_mix_meets_its_targets(spark):
    rows = [(k, " ".join(["w"] * 10), f"s{min(k // 100, 3)}" if k < 1000 else "big") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = {r["source"]: r for r in temperature_mix.source_weights(df, repetition=2.0).collect()}
    most = max(r["budget"] / r["tokens"] for r in w.values())
    assert 1.9 < most <= 2.0 + 1e-6 and abs(sum(r["weight"] for r in w.values()) - 1) < 1e-6
    out = temperature_mix.mix_sources(df, repetition=2.0, rows_per_bucket=200)
    for r in out.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("n").alias("n") if "n" in out.columns else F.count("*").alias("n")).collect():
        assert w[r["source"]]["budget"] - 10 < r["t"] <= w[r["source"]]["budget"]
    again = out.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert again <= 3
    flat = temperature_mix.source_weights(df, entropy=0.99).collect()
    p = np.array([r["weight"] for r in flat])
    assert -(p * np.log(p)).sum() >= 0.99 * np.log(len(p)) - 1e-6
    assert out.groupBy("source", "block").count().count() > 100


def plain_mix(docs, budget, repetition=None, entropy=None):
    """Token shares by source and the weights that bisection in plain Python finds."""
    tokens = {}
    for _, text, source in docs:
        n = len((text or "").split())
        if n:
            tokens[source] = tokens.get(source, 0) + n
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items()}

    def weights(a):
        z = sum(x**a for x in share.values())
        return {s: x**a / z for s, x in share.items()}

    def good(a):
        w = weights(a)
        if entropy is not None:
            return -sum(x * math.log(x) for x in w.values()) >= entropy * math.log(len(w))
        return max(w[s] * budget / tokens[s] for s in w) > repetition

    lo, hi = 0.0, 1.0
    if good(1.0):
        lo = hi
    elif not good(0.0):
        hi = lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    return tokens, weights(lo)


@pytest.mark.parametrize("limit", [{"repetition": 3.0}, {"repetition": 1.2}, {"entropy": 0.95}, {"entropy": 0.6}])
def test_mix_equals_a_plain_one(spark, limit):
    """Weights by a plain bisection; every whole epoch holds each document once, the rest a part of one more that fits."""
    rng = random.Random(8)
    sizes = {"big": 400, "mid": 60, "small": 9, None: 4}
    docs = [(k, " ".join(["w"] * rng.randrange(1, 60)), s) for s, n in sizes.items() for k in range(n)] + [(1, "", "big"), (2, None, "mid")]
    total = sum(len((t or "").split()) for _, t, _ in docs)
    tokens, want = plain_mix(docs, total, **limit)
    out = temperature_mix.mix_sources(spark.createDataFrame([(i, t, s, "x") for i, t, s in docs], "doc_id long, text string, source string, place string"), rows_per_bucket=50, **limit).collect()
    for s, w in want.items():
        own = [r for r in out if r["source"] == s]
        assert abs(own[0]["weight"] - w) < 1e-6
        budget = w * total
        per = {}
        for r in own:
            per.setdefault(r["epoch"], []).append((r["doc_id"], r["tokens"]))
        whole = sorted((i, len(t.split())) for i, t, x in docs if x == s and t)
        last = max(per)
        assert all(sorted(per[e]) == whole for e in range(last)) and set(per[last]) <= set(whole) and len(set(per[last])) == len(per[last])
        spent = sum(r["tokens"] for r in own)
        assert budget - 60 < spent <= budget + max(1.0, tokens[s] * 1e-6)  # a document that would not fit ends it


def test_mix_passes_a_small_source_many_times(spark):
    """Epochs are rows, not an array: runs of them meet without a gap."""
    df = spark.createDataFrame([(1, "one", "small"), (2, "w " * 30_000, "big")], "doc_id long, text string, source string")
    out = temperature_mix.mix_sources(df, entropy=1.0).where("source = 'small'")
    n, epochs = out.count(), out.select("epoch").distinct().count()
    assert n == epochs == 15_000 and out.agg(F.max("epoch")).first()[0] == n - 1


def test_language_of_many_classes(spark):
    """No language is left out, however many there are; the sample of all together stays within its bound."""
    rows = [(k, f"x{k % 1500}", f"l{k % 1500}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = _common.stratified_sample(df, "doc_id", "lang", 800, total=6000)
    assert got.select("lang").distinct().count() == 1500 and got.columns == df.columns
    assert _common.stratified_sample(df, "doc_id", "lang", 2, total=100).count() < 6000


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    share = lambda df, c: df.where("held_out").agg(F.avg(c.cast("int"))).first()[0]
    assert share(queries.op5_language_id(spark, sf).join(docs, "doc_id"), F.col("lang") == F.col("lang_pred")) > 0.95
    assert share(queries.op6_quality_knn(spark, sf).join(labels, "doc_id"), F.col("quality") == F.col("predicted")) > 0.9
    assert share(queries.op9_toxicity_mil(spark, sf).join(labels, "doc_id"), F.col("toxic") == F.col("predicted")) > 0.9


def test_quality_vote_is_exact():
    """The vote against one in plain Python from grams on: neighbours whose similarities differ by less than 1e-4, copies with
    labels that contradict each other, unequal classes."""
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    near = [base[:k] + "#" + base[k + 1 :] for k in range(50, 3500, 60)]  # all about equally far from each other
    known = near + ["".join(rng.choice("stuvw ") for _ in range(200)) for _ in range(20)] + near[:5] * 3
    y = np.array([rng.randrange(3) == 0 for _ in known]).astype(int)
    m = quality_knn.train(known, y, np.ones(quality_knn.BUCKETS), 60, k=7)
    asked = near[3:9] + [base[:2000] + "??" + base[2000:], base, "zz top", "abc", "", None]
    got = quality_knn.vote(pa.array(asked), m)
    bucket = {}

    def latent(text):
        raw, grams = text.encode(), {}
        for k in range(len(raw) - 2):
            g = raw[k : k + 3]
            if g not in bucket:
                (_, _, counts), = quality_knn.count_blocks(pa.array([g.decode()]))
                bucket[g] = int(np.flatnonzero(counts[0])[0])
            grams[bucket[g]] = grams.get(bucket[g], 0) + 1
        x = {b: math.sqrt(n) * float(m.idf[b]) for b, n in grams.items()}
        size = math.sqrt(sum(v * v for v in x.values())) or 1
        z = [math.fsum(v / size * float(m.basis[b, r]) for b, v in x.items()) for r in range(m.basis.shape[1])]
        size = math.sqrt(math.fsum(v * v for v in z)) or 1
        return [v / size for v in z]

    texts = list(dict.fromkeys(known))
    share = [sum(y[k] for k, t in enumerate(known) if t == own) / known.count(own) for own in texts]
    vectors = [latent(t) for t in texts]
    w1, w0 = 0.5 / sum(share), 0.5 / sum(1 - s for s in share)
    for text, score in zip(asked[:-2], got, strict=False):
        z = latent(text)
        sims = [math.fsum(a * b for a, b in zip(z, v, strict=True)) for v in vectors]
        nearest = sorted(range(len(texts)), key=lambda k: (-sims[k], k))[:7]
        weight = [max(sims[k], 0) ** m.power for k in nearest]
        total = sum(w * (w1 * share[k] + w0 * (1 - share[k])) for w, k in zip(weight, nearest, strict=True))
        assert abs(score - (sum(w * w1 * share[k] for w, k in zip(weight, nearest, strict=True)) / total if total else 0.5)) < 1e-5
    assert got[-2] == got[-1] == 0.5


def test_toxic_sentences_are_located():
    """Scores are the noisy-or of sentence scores, and the offending spans are the sentences that hold the word."""
    weights = np.zeros(toxicity_mil.BUCKETS)
    raw = np.frombuffer(b"zapword", np.uint8)
    weights[toxicity_mil.bags(raw, np.array([0, 7]))[0][:1]] = 6.0
    texts = ["Nice day. Ünïcode zapword here! Bye\nzapword zapword", "all is well. Really", "zapword", "", None]
    score, spans = toxicity_mil.score_batch(pa.array(texts, pa.large_string()), weights, -5.0, 0.5)
    p = lambda n: 1 / (1 + math.exp(5 - 6 * n))
    assert np.allclose(score, [1 - (1 - p(0)) ** 2 * (1 - p(1)) * (1 - p(2)), 1 - (1 - p(0)) ** 2, p(1), 0, 0])
    assert [texts[0][s["start"] : s["end"]].strip() for s in spans[0]] == ["Ünïcode zapword here", "zapword zapword"]
    assert [len(s) for s in spans] == [2, 0, 1, 0, 0] and abs(spans[2][0]["score"] - p(1)) < 1e-12


def test_toxicity_learns_from_one_class():
    for label, low, high in ((1, 0.999, 1), (0, 0, 0.001)):
        model = toxicity_mil.train(["some words", "other words"], np.array([label, label]))
        score, _ = toxicity_mil.score_batch(pa.array(["words", "new ones"], pa.large_string()), *model, 0.5)
        assert ((score >= low) & (score <= high)).all()


def test_labels_that_contradict_and_repeat(spark):
    """One id with two labels and several texts is one example, the same in any order of rows."""
    rows = [(1, 1), (1, 0), (2, 1), (None, 1), (3, None)]
    texts = spark.createDataFrame([(1, "b"), (1, "a"), (1, "c"), (2, "x"), (2, None), (None, "n")], "doc_id long, text string")
    for order in (rows, rows[::-1]):
        chosen = _common.one_label(spark.createDataFrame(order, "doc_id long, toxic int"), "toxic")
        got = _common.labelled_texts(texts, chosen)
        assert got[0] == ["a", "x"] and list(got[1]) == [0, 1]


def test_pipeline(spark):
    """Stage by stage: most labelled toxic documents go and others stay, one of each group stays, no secret is left and clean texts are as
    they were, sources give what a plain bisection says, and the packing holds exactly what the mix kept."""
    data = "/root/testdata/sf0.01"  # the smallest tables have eleven toxic documents, too few to learn from
    told = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    at, held = spark.read.parquet(f"{data}/documents.parquet"), {}
    docs = [(r["doc_id"], r["text"]) for r in at.collect()]
    for name, stage in corpus_pipeline.STAGES:
        at = _common.materialize(stage(spark, at, data), name)
        held[name] = {r["doc_id"]: r for r in at.collect()} if name != "pack" else at.orderBy("sequence_id", "offset").collect()
    toxic, fine = [i for i, t in told.items() if t == 1], [i for i, t in told.items() if t == 0]
    assert sum(i in held["toxicity"] for i in toxic) <= 0.3 * len(toxic) and sum(i in held["toxicity"] for i in fine) >= 0.99 * len(fine)  # from 45 toxic examples
    texts = dict(docs)
    ids = sorted(held["toxicity"])
    group = union_find(len(ids), [p for p in similar_pairs([shingles(texts[i]) for i in ids]) if shingles(texts[ids[p[0]]])])
    assert sorted(held["near_duplicates"]) == sorted({ids[g] for g in group})
    for i, r in held["secrets"].items():
        assert base_spans(r["text"]) == [] and (base_spans(texts[i]) or "SECRET" in r["text"] or "EXAMPLE" in r["text"] or r["text"] == texts[i])
    rows = [(i, r["text"], r["source"]) for i, r in held["secrets"].items()]
    total = sum(len((t or "").split()) for _, t, _ in rows)
    tokens, want = plain_mix(rows, int(total * 0.9), repetition=1.0)
    for source, w in want.items():
        sizes = [len(r["text"].split()) for r in held["mix"].values() if r["source"] == source]
        longest = max(len((t or "").split()) for _, t, x in rows if x == source)
        budget = min(tokens[source], w * int(total * 0.9))
        assert budget - longest - 1 <= sum(sizes) <= budget + max(1.0, tokens[source] * 1e-6)
    place, parts = 0, {}
    for r in held["pack"]:
        assert r["sequence_id"] * 2048 + r["offset"] == place
        place += r["length"]
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(parts) == set(held["mix"])
    for own in parts.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, *_) in zip(own, own[1:], strict=False)) and sum(n for _, n, _ in own) == own[0][2]
