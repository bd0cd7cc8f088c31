"""URL filters: rules by host and path, then a list of canonical URLs.

A blocked Bloom filter of the listed URLs, small enough to broadcast whatever the
list's length, lets through the URLs that may be listed; only those meet the list
in an exact hash join, which takes the false positives out.

Defined results: a NULL URL or one without ``://`` has empty host and path, fits no
rule and is on no list, so it is allowed. Repeated rows are each judged. An empty
list blocks nothing; an empty table gives no rows. Columns of the input other than
the id and the URL never meet the operator's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.native import MAX_BLOCKS, bloom, lower_az, probed, quoted, renamed

# The rules of the contract (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Site names whose pages make up the list of unwanted URLs.
UNWANTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.char_length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading ``www.``, path without trailing slashes, query without tracking fields; no scheme, no fragment.

    NULL without a host.
    """
    host, path = F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&+", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); NULL if none does."""
    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return reduce(lambda a, b: F.coalesce(a, b), fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def filter_urls(pages: DataFrame, listed: DataFrame, *, page_id: str = "page_id", url: str = "url", listed_url: str = "url", rules=RULES, blocks: int = MAX_BLOCKS) -> DataFrame:
    """Each row's host, path, rule and verdict. ``listed`` holds the URLs to block where no rule speaks."""
    rows = renamed(pages, page_id=page_id, url=url)
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("__key"))
    rows = rows.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    listed = listed.select(canonical(F.col(quoted(listed_url))).alias("__key")).where(F.col("__key").isNotNull())
    seen = probed(rows, F.col("__key"), bloom(listed, F.col("__key"), blocks), "__maybe", blocks)
    # Rows that the filter rules out join on NULL: they stay where they are in the outer join and match nothing.
    seen = seen.withColumn("__open", F.when(F.col("__rule").isNull() & F.col("__maybe"), F.col("__key")))
    sure = seen.where(F.col("__open").isNull()).withColumn("__hit", F.lit(False))
    asked = seen.where(F.col("__open").isNotNull()).join(
        listed.distinct().select(F.col("__key").alias("__listed")), F.col("__open") == F.col("__listed"), "left"
    ).withColumn("__hit", F.col("__listed").isNotNull()).drop("__listed")
    return sure.unionByName(asked).select(
        "page_id", "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), F.when(F.col("__hit"), "block").otherwise("allow")).alias("verdict"),
    )


def unwanted_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """The URLs of unwanted sites, as a list to block."""
    labels = F.split(host_of(F.col(quoted(url))), r"\.")
    return pages.where(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in UNWANTED]))).select(F.col(quoted(url)).alias("url"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, unwanted_urls(pages))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, coalesce(rest, '') AS rest,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(regexp_extract(coalesce(rest, ''), '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS q
  FROM parts
), keyed AS (
  SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS k FROM split
), listed AS (
  SELECT DISTINCT k FROM keyed WHERE k IS NOT NULL
    AND list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
), rules(verdict, rule, h, p) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
    ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), judged AS (
  SELECT k.*, (SELECT max_by({'rule': rule, 'verdict': r.verdict}, length(rule)) FROM rules r
    WHERE (k.host = h OR suffix(k.host, '.' || h)) AND starts_with(k.path, p)) AS r
  FROM keyed k
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN listed.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN listed ON judged.k = listed.k
"""
