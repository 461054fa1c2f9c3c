"""Queries that apply the operators of this subpackage to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, decontaminate, html, licenses, packing, quality, simhash, substring, toxicity, urls
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query()
def op7_substring_dedup(spark, sf_dir):
    out = substring.remove_repeats(read(spark, sf_dir, "documents"), joined=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op1_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.where(~quality.held_out(5, 0)))
    return toxicity.score(docs, lexicon).select("doc_id", quality.held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


@query()
def op9_quality_classifier(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out(4, 2)))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(4, 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


@query()
def op10_decontamination(spark, sf_dir):
    found = decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("containment", 9).alias("containment"))


@query()
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query()
def op3_embedding_near_dedup(spark, sf_dir):
    return covertree.near_duplicates(read(spark, sf_dir, "embeddings"))


SITES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query(r"""
WITH u AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r AS (SELECT *, '.' || host AS h, CASE
    WHEN suffix(h, '.example.org') AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN suffix(h, '.example.org') AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN suffix(h, '.com') AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN suffix(h, '.com') AND prefix(path, '/de/') THEN 'com/de/'
    WHEN suffix(h, '.org') AND prefix(path, '/') THEN 'org/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || path, '^[^/]*(^|[.-])(casino|bets|spam|adult|porn|ads-track|malware|phishing)([.-]|/|$)') THEN 'block'
    ELSE 'allow' END AS verdict FROM r
""")
def op5_url_filters(spark, sf_dir):
    rules = [urls.site_rule(*s) for s in SITES] + [urls.pattern_rule("block", *p) for p in urls.PATTERNS]
    return urls.judge(read(spark, sf_dir, "pages"), urls.rule_table(spark, rules)).drop("pattern")


@query()
def op6_html_extraction(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages"))


@query(licenses.oracle_sql())
def op8_license_scan(spark, sf_dir):
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    return licenses.scan(read(spark, sf_dir, "documents"), templates).withColumn("containment", F.round("containment", 9))
