"""URL rules found by their rarest literal token; only fetched rules run a regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored

#: Patterns on host and path that block a page where no site rule fits, each with literal tokens that every match has.
PATTERNS = (
    (r"^[^/]*(?:^|[.-])casino(?:[.-]|/|$)", "casino"),
    (r"^[^/]*(?:^|[.-])bets(?:[.-]|/|$)", "bets"),
    (r"^[^/]*(?:^|[.-])spam(?:[.-]|/|$)", "spam"),
    (r"^[^/]*(?:^|[.-])adult(?:[.-]|/|$)", "adult"),
    (r"^[^/]*(?:^|[.-])porn(?:[.-]|/|$)", "porn"),
    (r"^[^/]*(?:^|[.-])ads-track(?:[.-]|/|$)", "ads track"),
    (r"^[^/]*(?:^|[.-])malware(?:[.-]|/|$)", "malware"),
    (r"^[^/]*(?:^|[.-])phishing(?:[.-]|/|$)", "phishing"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_rule(verdict: str, host: str, path: str) -> dict:
    """A rule for ``host`` and all its subdomains, for paths that start with ``path``."""
    whole = path if path.endswith("/") else path.rpartition("/")[0]
    tokens = [t for t in re.split(r"[^a-z0-9]+", f"{host}{whole}".lower()) if t]
    return {"rule": f"{host}{path}", "kind": "site", "verdict": verdict, "pattern": f"^(?:[^/]*\\.)?\\Q{host}{path}\\E", "tokens": tokens, "size": len(host) + len(path)}


def pattern_rule(verdict: str, pattern: str, literals: str) -> dict:
    return {"rule": pattern, "kind": "pattern", "verdict": verdict, "pattern": pattern, "tokens": literals.split(), "size": len(pattern)}


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, kind string, verdict string, pattern string, tokens array<string>, size int")


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.split(F.lower(address), "[^a-z0-9]+"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with the rules of :func:`rule_table` applied.

    Returns page_id, host, path, rule, verdict, pattern: ``rule`` is the longest site
    rule that fits (null if none) and gives the verdict; else any pattern rule that
    fits, named in ``pattern``, gives it; else it is ``default``. Each rule is filed
    under the one of its literal tokens that fewest URLs hold. Equal URLs are judged
    once. A null URL or one without ``://`` has empty host and path and gets the
    default; ids may be null or repeated, other columns are ignored, an empty table
    gives an empty table. Of rules of equal length the greater name wins; a rule
    without a literal token is an error.
    """
    if rules.where(F.size("tokens") < 1).head(1):
        raise ValueError("every rule needs a literal token")
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.select("page_id", "host", "path", F.concat("host", "path").alias("address"))
    held = rows.select("address").distinct().withColumn("token", F.explode(_tokens(F.col("address"))))
    wanted = rules.select("rule", "kind", "verdict", "pattern", "size", F.explode("tokens").alias("token"))
    counts = held.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    filed = (
        wanted.join(counts, "token", "left").groupBy("rule", "kind", "verdict", "pattern", "size")
        .agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("token"))
    )
    fits = held.join(filed, "token").where("address rlike pattern")
    found = fits.groupBy("address").agg(
        F.max(F.when(F.col("kind") == "site", F.struct("size", "rule", "verdict"))).alias("site"),
        F.max(F.when(F.col("kind") == "pattern", F.struct("verdict", "rule"))).alias("other"),
    )
    # stored: beside an aggregate by the same key Spark can't split the join where many rows share an address, such as none
    found = sized(stored(found, "judged"), 400)
    return rows.join(found, "address", "left").select(
        "page_id", "host", "path",
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", "other.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("other.rule")).alias("pattern"),
    )
