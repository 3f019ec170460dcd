"""The queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import chat_format, compaction, conversation_repair, importance, mixing, near_dedup, secret_scan, simhash, substring_dedup, template_decontamination, token_files, toxicity, url_reputation
from parcelflow.llm.common import table, written


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights are counted once; the sample needs no texts."""
    rows = written(mixing.weighed(table(spark, sf_dir, "documents")).drop("text"), "weights")
    return mixing.mix(rows, text_col=None).select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 4).alias("p"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document with its id; hosts without one are judged by their domain, their suffix or all.

    A host is blocked where its lower bound is over the rate of all outcomes by more than MARGIN.
    """
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    seen = pages.join(labels.select(F.col("doc_id").alias("page_id"), "quality"), "page_id")
    outcomes = seen.select(url_reputation.url_host(F.col("url")).alias("host"), (F.col("quality") == 0).alias("bad"))
    return url_reputation.judge_urls(pages, outcomes, margin=url_reputation.MARGIN)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_documents(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen arrivals, dealt by a hash of the id; the compacted table as its manifest gives it."""
    docs = table(spark, sf_dir, "documents").withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    return compaction.compacted(docs, "arrival").select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents")).drop("kept")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_digests(turns, conversation_repair.damage(turns))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one, -7, that says what the template means to mark."""
    odd = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat_format.format_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_secret_scan, op3_simhash, op4_url_reputation, op5_near_duplicates, op6_token_files, op7_compaction, op8_toxicity, op9_template_decontamination, op10_substring_dedup, op11_importance_resampling, op12_conversation_repair, op13_chat_format)}

_RULES = sorted(url_reputation.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in _RULES]

_STRENGTH = f"1 / least(greatest(coalesce((sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0), 1 / {url_reputation.MOST + 1}::double), 1 / {url_reputation.LEAST + 1}::double) - 1"

ORACLES = {
    "op11_importance_resampling": importance.oracle(),
    "op1_mixing": mixing.oracle(),
    "op7_compaction": "select doc_id, lang, source, n_chars, md5(text) as text_md5 from documents",
    "op4_url_reputation": f"""
with p as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{url_reputation.UPPER}', '{url_reputation.UPPER.lower()}') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
o as (select host, (quality = 0)::int as bad from p join labels on page_id = doc_id where quality is not null),
h as (select host, count(*)::double as n, sum(bad)::double as bad, string_split(host, '.')[-1] as suffix, array_to_string(string_split(host, '.')[-2:], '.') as domain from o group by host),
t as (select sum(bad) / sum(n) as all_rate from h),
s as (select suffix, sum(n) as n, sum(bad) as bad, any_value(all_rate) as m from h, t group by suffix),
ks as (select {_STRENGTH} as k from s),
s2 as (select suffix, (bad + k * m) / (n + k) as s_rate from s, ks),
d as (select domain, sum(n) as n, sum(bad) as bad, any_value(s_rate) as m from h join s2 using (suffix) group by domain),
kd as (select {_STRENGTH} as k from d),
d2 as (select domain, (bad + k * m) / (n + k) as d_rate from d, kd),
kh as (select {_STRENGTH} as k from (select n, bad, d_rate as m from h join d2 using (domain))),
u as (select distinct host, string_split(host, '.')[-1] as suffix, array_to_string(string_split(host, '.')[-2:], '.') as domain from p),
w as (select u.host, coalesce(n, 0) as n, coalesce(bad, 0) as bad, coalesce(d_rate, s_rate, all_rate) as m, case when d_rate is not null then kh.k when s_rate is not null then kd.k else ks.k end as k
  from u left join h on u.host = h.host left join d2 on u.domain = d2.domain left join s2 on u.suffix = s2.suffix, t, ks, kd, kh),
h2 as (select host, bad + k * m as a, n - bad + k * (1 - m) as b from w),
r as (select host, greatest(a / (a + b) - 1.645::double * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) as low from h2)
select page_id, host, path,
  case {" ".join(f"when {fit} then '{h}{p}'" for fit, (_, h, p) in zip(_FITS, _RULES, strict=True))} end as rule,
  case {" ".join(f"when {fit} then '{v}'" for fit, (v, _, _) in zip(_FITS, _RULES, strict=True))} when low > all_rate + {url_reputation.MARGIN}::double then 'block' else 'allow' end as verdict,
  round(low, 6) as bad_low
from p left join r using (host), t""",
}
