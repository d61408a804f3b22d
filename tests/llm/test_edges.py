"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import hilbert_pack, itq_dedup, jaccard_join, language_id, license_scan, pivot_search, quality_knn, secret_scan, temperature_mix, toxicity_mil
from eventloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, row string, place string, base string, salt int, part string, fp string, owner string"
LONG = "alpha beta gamma delta " * 60_000
ROWS = [
    (1, "one two three four five six seven", "en", "s1"), (1, "one two three four five six seven", "en", "s1"), (2, None, "en", "s1"), (3, "", "fr", None),
    (4, LONG, None, "s2"), (5, "One two three FOUR five six seven", "en", "s2"), (6, "token=abcdef123 and AKIA" + "A" * 16, "de", "s1"), (None, "a row without an id of its own", "en", "s1"), (7, "...", "en", "s3"), (8, "  \n\t ", None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, 1, "r", "p", "b", 3, "q", "f", "o") for i, t, lang, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_license(odd, none):
    files = odd.select(F.col("doc_id").alias("file"), F.concat_ws("/", "source", "lang").alias("path"), F.concat("text", F.lit("\nReleased under the MIT License.")).alias("text"), "score", "label")
    out = {r["file"]: r for r in license_scan.scan_licenses(files).collect()}
    assert len(out) == 9 and out[1]["license"] == "MIT" and out[1]["how"] == "own" and out[2]["how"] == "inherited"
    assert license_scan.scan_licenses(files.where("false")).count() == 0


def test_pivot_search(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [0.5, 0.5]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, [1.0, None]), (0, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in pivot_search.pivot_top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(1, 1, 65536), (2, 4, 65536), (3, 5, 65536), (4, 5, 65536)]
    assert pivot_search.pivot_top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_mix(odd, none):
    out = temperature_mix.mix_sources(odd, repetition=2.0).collect()
    assert {r["doc_id"] for r in out} <= {1, 4, 5, 6, 7, None}
    assert temperature_mix.mix_sources(none, entropy=0.9).count() == 0
    assert temperature_mix.mix_sources(odd.where("doc_id in (2, 3)"), entropy=0.9).count() == 0


def test_secrets(odd, none):
    out = secret_scan.digest(secret_scan.scan_secrets(odd, F.col("lang"), F.col("source"))).collect()
    assert len(out) == len(ROWS) and {r["doc_id"]: (r["n_assign"], r["n_access"]) for r in out}[6] == (1, 1)
    assert secret_scan.scan_secrets(none, F.col("lang"), F.col("source")).count() == 0
    clean = secret_scan.redact(odd, F.col("lang"), F.col("source"))
    assert clean.columns == odd.columns and clean.count() == len(ROWS)
    assert clean.where("doc_id = 6").first()["text"] == "<SECRET> and <SECRET>"


def test_classifiers(odd, none):
    lang = language_id.fit(odd, F.lit(True), 10)
    out = {r["doc_id"]: r for r in language_id.predict_language(odd, lang).collect()}
    assert out[2]["lang_pred"] == out[3]["lang_pred"] == out[7]["lang_pred"] == "und" and out[4]["lang_pred"] in ("en", "de", "fr")
    assert language_id.predict_language(odd, language_id.fit(none, F.lit(True))).where("lang_pred <> 'und'").count() == 0
    labels = odd.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    q = quality_knn.fit(odd, labels, F.lit(True), 10)
    assert quality_knn.score_quality(odd, q).where("score between 0 and 1").count() == len(ROWS)
    assert quality_knn.score_quality(odd, quality_knn.fit(none, labels.where("false"), F.lit(True))).where("score = 0.5").count() == len(ROWS)
    t = toxicity_mil.fit(odd, labels, F.lit(True), 10)
    assert toxicity_mil.score_toxicity(odd, t).where("score between 0 and 1").count() == len(ROWS)
    empty = toxicity_mil.fit(none, labels.where("false"), F.lit(True))
    assert toxicity_mil.score_toxicity(odd, empty).where("score > 0").count() == 0
    assert toxicity_mil.score_toxicity(none, t).count() == 0


def test_pack(odd, none):
    out = hilbert_pack.pack(odd, tokenizer_path()).collect()
    assert sum(r["length"] for r in out if r["doc_id"] == 2) == 1 and sum(r["length"] for r in out if r["doc_id"] == 1) == 16
    at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    place = 0
    for seq, offset, length in at:
        assert seq * 2048 + offset == place
        place += length
    assert hilbert_pack.pack(none, tokenizer_path()).count() == 0


def test_itq(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (8, [1.0, 0.0], 1)]
    rows += [(100 + k, [math.cos(k), math.sin(k)], 100 + k) for k in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq_dedup.near_duplicates(df).where("vec_id < 100").collect()}
    assert out == {1: (3, 1, True), 2: (3, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), 7: (0, 7, True), 8: (3, 1, False)}
    assert itq_dedup.near_duplicates(df.where("false")).count() == 0


def test_jaccard(odd, none):
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(odd).collect()}
    assert out[1] == (3, 1) and out[5] == (3, 1) and out[2] == (0, 2) and out[8] == (0, 8) and out[4] == (4, 4)
    assert jaccard_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[1:]])
def test_stages(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out, empty = stage(spark, odd, ""), stage(spark, none, "")
    assert empty.count() == 0 and out.count() > 0
    if name != "pack":
        assert out.columns == odd.columns
    if name == "near_duplicates":
        assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_toxicity_stage(spark, odd, none, tmp_path):
    """The first stage reads documents and labels; null and empty texts stay, and so do all columns."""
    labels = odd.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"), F.lit("x").alias("y"))
    for name, df in (("documents", odd), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.drop_toxic(spark, odd, str(tmp_path))
    assert out.columns == odd.columns and out.count() == len(ROWS)
    assert corpus_pipeline.drop_toxic(spark, none, str(tmp_path)).count() == 0
