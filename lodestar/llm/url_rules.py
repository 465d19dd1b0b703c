"""URL filters: host-suffix and path-prefix expressions, met by short hash prefixes, confirmed by full digests.

DataFrame functions only. Every distinct URL is expanded into one expression for each host suffix
(whole labels) and each path prefix whose length some rule has; an expression is hashed, joined with
the rules on the first 8 hex digits and kept where the whole digest agrees. The longest rule wins.

Null URLs and URLs without "://" have an empty host and path and meet only rules with an empty host.
Repeated rows are judged alike and all returned. An empty table gives an empty result. Extra columns
are ignored. Port and user info stay part of the host, as the contract's host ends at /, ? or #.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import skew_join

#: (verdict, host, path) of the rules that the contract fixes.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8")]
#: Rules are a parameter, sent along with the plan; past this many they are refused.
MAX_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict of each row of pages."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    spark = pages.sparkSession
    known = spark.createDataFrame([(v, h.lower(), p) for v, h, p in rules], "says string, rule_host string, rule_path string")
    known = known.select("says", F.concat("rule_host", "rule_path").alias("rule"), _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest")).withColumn("short", F.substring("rule_digest", 1, 8))
    lengths = sorted({len(p) for _, _, p in rules}) or [0]
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    parts = urls.select("url", "n", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("labels", F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    met = (
        parts.withColumn("suffix", F.explode(suffixes)).withColumn("cut", F.explode(prefixes))
        .select("url", "n", _digest(F.col("suffix"), F.substr(F.col("path"), F.lit(1), F.col("cut"))).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 8)).join(F.broadcast(known), "short").where("digest = rule_digest")
        .groupBy("url").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "says")).alias("best"), F.first("n").alias("n"))
    )
    total = rows.count()
    found = skew_join(rows, met, "url", "n", total, "left")
    return found.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"))
