"""URL rules and lists behind a blocked Bloom filter.

Listed entries are host and path prefixes (``example.org/es/``) or whole canonical URLs. A URL asks for every suffix of its host with every listed length of
its path, and for its own canonical form. What it asks for is first held against a blocked Bloom filter, built by Spark over the
list: a row of eight 32-bit words for each block, one bit in each word. Only what passes goes to an exact join with the list, so false
positives go. The filter has ``MAX_BLOCKS`` blocks of 32 bytes at most, whatever the list's length, so it can be broadcast; the list itself is joined as Spark
finds best. Each different URL is looked up once.

The longest entry that fits gives the verdict; on equal lengths the greater entry. Null URLs, and those without ``://``, have an empty host and path and are allowed.
Repeated pages give a row each. An empty table gives no rows. No column but the id and the URL is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import ASCII_LOWER, ASCII_UPPER, stored

#: The base rules, host and path prefix.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: In production listed are the canonical URLs of pages of these hosts, and of pages whose article has fewer visible characters.
LISTED_HOSTS = ["spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org"]
THIN = 200
DEFAULT = "allow"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path, without a last slash; scheme, query and fragment do not count."""
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""))


def rule_entries(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    entry = spark.createDataFrame(rules, "rule string, verdict string")
    at = F.instr("rule", "/")
    return entry.select(F.concat(F.lit("p "), "rule").alias("key"), (F.length("rule") - at + 1).alias("path_length"), "rule", "verdict")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", listed_verdict: str = "block") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed). ``listed`` has a column ``url``; rules win over it."""
    spark = pages.sparkSession
    entries = rule_entries(spark, RULES if rules is None else rules)
    lengths = sorted(r[0] for r in entries.select("path_length").distinct().collect())  # one number for each length of a rule's path
    if listed is not None:
        own = listed.where("url IS NOT NULL").select(F.concat(F.lit("u "), canonical(F.col("url"))).alias("key")).distinct()
        entries = entries.select("key", "rule", "verdict").unionByName(own.select("key", F.lit(None).cast("string").alias("rule"), F.lit(listed_verdict).alias("verdict")))
    entries = stored(entries.select("key", "rule", "verdict"), "entries")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = rows.select("url").where("url IS NOT NULL").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    prefixes = F.flatten(F.transform(suffix, lambda s: F.transform(paths, lambda p: F.concat(F.lit("p "), s, p))))
    keys = F.array_distinct(F.concat(prefixes, F.array(F.concat(F.lit("u "), canonical(F.col("url"))))))
    asked = urls.select("url", F.explode(keys).alias("key"))
    hits = bloom.possible(asked, entries.select("key")).join(entries, "key")
    best = hits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"), F.max(F.col("rule").isNull()).alias("listed"))
    out = rows.join(best, "url", "left")
    return out.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"),
    )


def visible(html: Column) -> Column:
    """Characters of the article without its marks; null without an article."""
    article = F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1)
    return F.when(html.contains("<article>"), F.char_length(F.regexp_replace(article, r"<[^>]*>", "")))


def production_list(pages: DataFrame) -> DataFrame:
    """The URLs of thin pages and of listed hosts, from (url, html)."""
    return pages.where(host_of(F.col("url")).isin(LISTED_HOSTS) | (visible(F.col("html")) < THIN)).select("url")
