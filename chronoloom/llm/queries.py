"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, simhash, suffixdedup, tokenbin, topk, toxicity, urlfilter, warc
from .storage import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_index(spark, path).withColumnRenamed("id", "page_id")


OP1_SQL = """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
k as (select payload_digest, min(page_id) as keeper from p group by payload_digest)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
  case when p.payload_bytes < 100 or p.page_id is not distinct from k.keeper then 'response' else 'revisit' end as record_type,
  case when p.payload_bytes < 100 or p.page_id is not distinct from k.keeper then null else k.keeper end as refers_to
from p join k using (payload_digest)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers keeps a vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokenbin.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return tokenbin.read_tokens(spark, path).withColumnRenamed("id", "doc_id")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
with v as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.row as query, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.row <> q.row and len(c.e) = len(q.e)),
r as (select *, cast(row_number() over (partition by query order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

#: The rules of the query: (verdict, host with the start of a path).
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


OP9_SQL = """
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(verdict, rule) as (values ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
s as (select rule, verdict, substr(rule, 1, strpos(rule, '/') - 1) as rule_host, substr(rule, strpos(rule, '/')) as rule_path from r),
f as (select h.page_id, s.rule, s.verdict, row_number() over (partition by h.page_id order by length(s.rule) desc) as n
  from h join s on (h.host = s.rule_host or ends_with(h.host, '.' || s.rule_host)) and starts_with(h.path, s.rule_path))
select h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') as verdict from h left join f on f.page_id = h.page_id and f.n = 1
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_language_id, op3_decontaminate, op4_simhash_near_dedup, op5_toxicity, op6_mix_sources, op7_token_files, op8_exact_top_k, op9_url_filter, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op8_exact_top_k": OP8_SQL, "op9_url_filter": OP9_SQL}
