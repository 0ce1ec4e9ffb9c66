"""The registered queries of this subpackage, with production parameters and whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headlight.llm import decontam, jaccard, langid, lm, media, packing, quality, repair, urlfilter, warc
from headlight.llm.common import read, remainder


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def op2_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents whose label marks them as of good quality."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.fit(docs, "doc_id", members=good)).drop("text")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(read(spark, sf_dir, "pages"), rules)


OP4_SQL = """
with rules(rhost, rpath, verdict) as (values ('net','/','block'), ('example.net','/en/','allow'), ('example.com','/de/','block'), ('org','/fr/','allow')),
parts as (
  select page_id,
    case when instr(url, '://') > 0 then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
fits as (
  select p.page_id, r.rhost || r.rpath as rule, r.verdict
  from parts p join rules r on (p.host = r.rhost or ends_with(p.host, '.' || r.rhost)) and starts_with(p.path, r.rpath)
  qualify row_number() over (partition by p.page_id order by length(r.rhost || r.rpath) desc) = 1)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict from parts p left join fits f using (page_id)
"""


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = media.store(read(spark, sf_dir, "documents"), "doc_id", "text")
    return media.digests(spark.read.parquet(path), "doc_id")


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = quality.features(read(spark, sf_dir, "documents"))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    train = feats.join(labels, "doc_id").where(remainder("doc_id", 5) != 0)
    scored = quality.score(feats, quality.fit(train))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.read(spark, repair.write(read(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(remainder("doc_id", 3) != 1))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_warc_chunks": op1_warc_chunks,
    "op2_benchmark_templates": op2_benchmark_templates,
    "op3_lm_difference": op3_lm_difference,
    "op4_url_filters": op4_url_filters,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_media_columns": op6_media_columns,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_quality_rff": op8_quality_rff,
    "op9_repair_ids": op9_repair_ids,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL = {"op4_url_filters": OP4_SQL}
