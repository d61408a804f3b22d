"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, delta_lloyd, filter_audit, hilbert_pack, itq_dedup, jaccard_join, language_id, license_scan, pivot_search, quality_knn, secret_scan, temperature_mix, toxicity_mil
from ._common import crc32_of_id

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, rest: int):
    return F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(modulus)) == rest, F.lit(False))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are documents, in folders of their source, its languages and hundreds of ids: every fiftieth id is a licence file
    in the source's own folder, every other tenth stands in the language's, the rest below; every thousandth is at the root."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    source, lang = F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))
    folder = F.when(i % 1000 == 0, "").when(i % 50 == 0, source).when(i % 10 == 0, F.concat_ws("/", source, lang)).otherwise(F.concat_ws("/", source, lang, F.floor(i / 100).cast("string")))
    path = F.concat(folder, F.when(folder == "", "").otherwise("/"), F.when(i % 50 == 0, F.concat(F.lit("LICENSE."), i.cast("string"))).otherwise(F.concat(i.cast("string"), F.lit(".txt"))))
    return license_scan.scan_licenses(docs.select(i.alias("file"), path.alias("path"), "text")).withColumnRenamed("file", "doc_id")


def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.pivot_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of as many tokens as there are, in which no source is passed more than twice."""
    return temperature_mix.mix_sources(table(spark, sf_dir, "documents"), repetition=2.0)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources, repositories a source's languages."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~held_out(3, 1))
    return language_id.predict_language(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"), ~held_out(4, 2))
    return quality_knn.score_quality(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_mil.fit(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    out = toxicity_mil.score_toxicity(docs, model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("body", "group")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.digest(delta_lloyd.compress(table(spark, sf_dir, "embeddings")))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, k, role, "\\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))], rows.schema)
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(tricky)), in_order=True)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.fullmatch(r"op\d+_.+", name)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL expresses."""
    return {"op1_license_scan": license_sql(), "op2_pivot_search": OP2_SQL, "op11_delta_lloyd": delta_lloyd.sql(), "op12_chat_format": chat_format.SQL, "op13_filter_audit": f"select * exclude (filter) from ({filter_audit.SQL})"}


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, q.v as qv, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from (select distinct vec_id, v from v where vec_id % 50 = 0) q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), r as (
  select query_id, cast(row_number() over (partition by query_id, qv order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def license_sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    notices = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in license_scan.TEMPLATES)
    return rf"""
with files as (
  select doc_id, doc_id % 50 = 0 as by_file, case when doc_id % 1000 = 0 then '' else coalesce(source, '-') || case when doc_id % 50 = 0 then '' else '/' || coalesce(lang, '-') || case when doc_id % 10 = 0 then '' else '/' || cast(floor(doc_id / 100) as bigint) end end end as dir, case when doc_id % 50 = 0 then 'LICENSE.' || doc_id else doc_id || '.txt' end as name, text from documents
), pieces as (
  select doc_id, trim(unnest(string_split(text, chr(10)))) as line, false as whole from files
  union all select doc_id, trim(regexp_replace(unnest(regexp_split_to_array(text, '\n[ \t\r\f]*\n')), '[ \t\n\r\f]+', ' ', 'g')), false from files where by_file
  union all select doc_id, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), true from files where by_file
), lines as (
  select doc_id, line, bool_or(whole) as whole from pieces where regexp_matches(line, {quote(license_scan.LINE)}) group by 1, 2
), di as (select line, count(*) as n from lines group by 1),
terms as (select line, n, term, count(*) as tf from (select line, n, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) as term from di) where term <> '' group by 1, 2, 3),
known(license, template) as (values {notices}),
notices as (select license, template, term, count(*) as tf from (select license, template, unnest(regexp_split_to_array(lower(template), '[^a-z0-9]+')) as term from known) where term <> '' group by 1, 2, 3),
df as (select term, sum(n) as df from terms group by 1), total as (select coalesce(sum(n), 0) as total from di),
x as (select line, term, sqrt(tf) * (ln((total + 2) / (df + 1)) + 0.2) as x from terms join df using (term), total),
y as (select license, template, term, sqrt(tf) * (ln((total + 2) / (coalesce(df, 0) + 1)) + 0.2) as y from notices left join df using (term), total),
nx as (select line, sqrt(cast(sum(cast(x * x as decimal(28, 12))) as double)) as nx from x group by 1),
ny as (select license, template, sqrt(cast(sum(cast(y * y as decimal(28, 12))) as double)) as ny from y group by 1, 2),
dots as (select line, license, template, cast(sum(cast(x * y as decimal(28, 12))) as double) as dot from x join y using (term) group by 1, 2, 3),
scored as (select line, license, round(dot / (nx * ny), 6) as cosine from dots join nx using (line) join ny using (license, template)),
best as (select line, license, cosine from scored where cosine >= 0.6 qualify row_number() over (partition by line order by cosine desc, license) = 1),
own as (select doc_id, license, cosine from lines join best using (line) qualify row_number() over (partition by doc_id order by whole desc, cosine desc, license) = 1),
marked as (select *, by_file and coalesce(regexp_matches(text, '[A-Za-z0-9]'), false) as states from files left join own using (doc_id)),
votes as (select dir, license, case when license is null then 1 when by_file then 0 else 2 end as kind, count(*) as n, sum(cast(cosine as decimal(28, 6))) as c from marked where license is not null or states group by 1, 2, 3),
declared as (select dir as ancestor, license as inherited from votes qualify row_number() over (partition by dir order by kind, n desc, c / n desc, license) = 1),
dirs as (select distinct dir, unnest(list_transform(range(0, len(string_split(dir, '/')) + 1), lambda k: array_to_string(string_split(dir, '/')[1:k], '/'))) as ancestor from files),
near as (select dir, ancestor as declared_in, inherited from dirs join declared using (ancestor) qualify row_number() over (partition by dir order by length(ancestor) desc) = 1)
select doc_id, case dir when '' then '' else dir || '/' end || name as path, coalesce(license, case when not states then inherited end) as license, cosine,
  case when license is not null then 'own' when inherited is not null and not states then 'inherited' else 'none' end as how, case when license is null and not states then declared_in end as declared_in
from marked left join near using (dir)
"""
