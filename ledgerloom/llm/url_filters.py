"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of up to this count are broadcast; more go through a shuffle join.
BROADCAST_RULES = 100_000
#: Hex digits of the digest that the equi-join compares: four bytes.
PREFIX_DIGITS = 8
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, with A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every url: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains when the path starts with the rule's. The longest rule wins (host and path
    together, then the longer host); of one rule given twice with different verdicts, ``block`` wins. Without a rule,
    ``default`` holds. A null url, or one without ``://``, has an empty host and path and fits no rule. Repeated rows
    are judged alike; an empty table gives no rows; further columns are ignored.
    """
    rules = rules.select(
        "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_length"),
    ).withColumn("digest", F.sha2("rule", 256))
    shapes = [(r.labels, r.path_length) for r in rules.select("labels", "path_length").distinct().collect()]
    known = rules.select(F.left("digest", F.lit(PREFIX_DIGITS)).alias("prefix"), F.col("digest").alias("rule_digest"), "rule", "host_length", "verdict")
    if rules.count() <= BROADCAST_RULES:
        known = F.broadcast(known)

    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("place", F.concat("host", "path"))
    places = urls.groupBy("place", "host", "path").agg(F.count(F.lit(1)).alias("n_urls"))
    label_list, path = F.split("host", r"\."), F.col("path")
    expressions = [
        F.when(
            (F.col("host") != "") & (F.size(label_list) >= labels) & (F.length(path) >= length),
            F.concat(F.array_join(F.slice(label_list, F.greatest(F.size(label_list) - labels + 1, F.lit(1)), labels), "."), F.left(path, F.lit(length))),
        )
        for labels, length in shapes
    ]
    hits = places.select("place", "n_urls", F.explode_outer(F.array_compact(F.array(*expressions))).alias("expression"))
    hits = hits.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.left("digest", F.lit(PREFIX_DIGITS))).join(known, "prefix", "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule"), "host_length", "rule", "verdict"))
    judged = hits.groupBy("place").agg(F.max("n_urls").alias("n_urls"), F.max(confirmed).alias("best"))
    judged = judged.select("place", "n_urls", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return lookup_join(urls, judged, "place", "n_urls").select("page_id", "host", "path", "rule", "verdict")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


SQL = r"""
with u as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
  from pages),
r(verdict, rhost, rpath) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
select page_id, host, path,
  (select rhost || rpath from r where (u.host = rhost or ends_with(u.host, '.' || rhost)) and starts_with(u.path, rpath)
   order by length(rhost || rpath) desc, length(rhost) desc limit 1) as rule,
  coalesce((select verdict from r where (u.host = rhost or ends_with(u.host, '.' || rhost)) and starts_with(u.path, rpath)
   order by length(rhost || rpath) desc, length(rhost) desc limit 1), 'allow') as verdict
from u
"""
