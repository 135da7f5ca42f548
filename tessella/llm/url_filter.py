"""URL rules by host and path.

Every URL is expanded into expressions ``host suffix + path prefix`` of exactly those shapes (labels in the host, characters in
the path) that some rule has. Expressions and rules meet in an equi-join on the first bytes of a SHA-256 digest; the full digest
confirms a match, and the longest confirmed rule decides.

Defined results: a null URL, or one without ``://``, has empty host and path and gets the default verdict; repeated pages keep
all their rows; no pages give no rows; no rules give the default verdict; extra columns of ``pages`` are not read. Of two
rules of equal length the one with the longer host wins, then ``block``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url):
    """Columns (host, path) of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", 2)


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    """Rules as (action, r_host, r_path, digest); digest is the join key's source."""
    df = spark.createDataFrame(list(RULES if rules is None else rules), "action string, r_host string, r_path string")
    return df.withColumn("digest", F.sha2(F.concat("r_host", "r_path"), 256))


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", key_hex: int = 8, broadcast_rules: int = 200_000, broadcast_matches: int = 200_000) -> DataFrame:
    """``pages(page_id, url)`` with host, path, rule and verdict.

    A shape is a number of labels and a number of characters, so there are at most as many as the rules' most labels times their
    longest path, however many rules, and a URL gives at most one expression each. The rules are broadcast only if there are at most
    ``broadcast_rules`` of them; otherwise both sides are shuffled on the key. Distinct URLs that match are written, then broadcast
    if they are at most ``broadcast_matches``, or else joined by shuffling both sides, so that adaptive execution can split a URL
    that many pages have. Pages without a host match nothing and do not enter that join.
    """
    labels = F.size(F.split("r_host", "\\.", -1))
    shapes = rules.select(labels.alias("labels"), F.length("r_path").alias("chars")).distinct().collect()
    host, path = split_url(F.col("url"))
    named = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    if not shapes:
        return named.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", "\\.", -1)
    known = F.expr("array(" + ", ".join(f"named_struct('labels', {s.labels}, 'chars', {s.chars})" for s in sorted(shapes)) + ")")
    fits = F.filter(known, lambda s: (F.size(parts) >= s["labels"]) & (F.length("path") >= s["chars"]))
    made = F.transform(fits, lambda s: F.concat(F.array_join(F.slice(parts, -s["labels"], s["labels"]), "."), F.substring(F.col("path"), F.lit(1), s["chars"])))
    urls = named.filter("host <> ''").select("host", "path").distinct()
    asked = urls.select("host", "path", F.explode(made).alias("expression")).withColumn("asked", F.sha2("expression", 256))
    keyed = rules.withColumn("key", F.substring("digest", 1, key_hex))
    if rules.count() <= broadcast_rules:
        keyed = F.broadcast(keyed)
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("action"))
    best = materialise(
        asked.withColumn("key", F.substring("asked", 1, key_hex))
        .join(keyed, "key")
        .filter(F.col("asked") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "action"), rank).alias("won"))
    )
    if best.count() <= broadcast_matches:
        best = F.broadcast(best)
    judged = named.filter("host <> ''").join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))
    return judged.unionByName(named.filter("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


OP6_SQL = """
WITH rules(action, r_host, r_path) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'),
  ('block','example.net','/de/8'), ('block','org','/es/')),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM p),
m AS (SELECT rid, arg_max(r_host || r_path, length(r_host) + length(r_path)) AS rule, arg_max(action, length(r_host) + length(r_path)) AS action
  FROM h JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM h LEFT JOIN m USING (rid)
"""
