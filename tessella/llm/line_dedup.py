"""Boilerplate lines by their frequency within a site.

For each host: the share of its pages that hold a line. Lines that at least ``min_pages`` pages hold and whose share exceeds
``max_ratio`` are boilerplate there and are dropped from every page of that host.

Defined results: a null text stays null with no lines; a null host is a host of its own; blank lines are never boilerplate;
a line counts once a page, however often it is repeated in it; repeated page rows count as pages; a page of boilerplate only
keeps its row with an empty text; extra columns are carried along unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

MAX_RATIO, MIN_PAGES = 0.1, 3


def boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(tessella_host, tessella_drop: hashes of the host's boilerplate lines), hosts without any left out.

    A host's list is bounded by its mean number of lines a page over ``max_ratio``, so what a page is held against grows with the
    host's pages' length and not with the host. The ratio counts in millionths, in whole numbers. Lines are counted by 64-bit hash: a clash
    within one host can matter only if it meets one of those few lines. Counting is pre-aggregated before its shuffle, so a
    line on a third of all pages costs one row a task.
    """
    key = _host(host)
    totals = pages.groupBy(key.alias("tessella_host")).agg(F.count("*").alias("n_pages"))
    seen = pages.select(key.alias("tessella_host"), F.explode(F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))).alias("line"))
    often = seen.groupBy("tessella_host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return (
        often.join(totals, "tessella_host")
        .filter(F.col("n") * 1_000_000 > F.col("n_pages") * round(max_ratio * 1_000_000))
        .groupBy("tessella_host")
        .agg(F.collect_set("line").alias("tessella_drop"))
    )


def _host(host: str):
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("null"))


def drop_boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = 500_000) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text``, and ``n_lines``, ``n_dropped``.

    The boilerplate is written once and measured: up to ``broadcast_lines`` hashes (4 MB) go to every executor and the texts are
    not shuffled; beyond that the pages are joined by host and a hot host is split by adaptive execution.
    """
    found = materialise(boilerplate(pages, host=host, text=text, max_ratio=max_ratio, min_pages=min_pages))
    size = found.agg(F.coalesce(F.sum(F.size("tessella_drop") + F.lit(4)), F.lit(0))).first()[0]
    side = F.broadcast(found) if size <= broadcast_lines else found
    lines = F.split(text, "\n", -1)
    hits = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.col("tessella_drop"))
    joined = pages.withColumn("tessella_host", _host(host)).join(side, "tessella_host", "left").withColumn("tessella_hits", F.when(F.col("tessella_drop").isNotNull(), hits))
    kept = F.filter(lines, lambda x: ~F.array_contains("tessella_hits", F.xxhash64(x)))
    touched = F.coalesce(F.size("tessella_hits") > 0, F.lit(False))
    out = joined.withColumn("tessella_kept", F.when(touched, kept))
    total = F.coalesce(F.size(lines), F.lit(0))
    n_lines = F.when(F.col(text).isNull(), F.lit(0)).otherwise(total)
    return out.withColumns({
        "n_lines": n_lines.cast("long"),
        "n_dropped": F.when(touched, F.size(lines) - F.size("tessella_kept")).otherwise(F.lit(0)).cast("long"),
        text: F.when(touched, F.array_join("tessella_kept", "\n")).otherwise(F.col(text)),
    }).drop("tessella_host", "tessella_drop", "tessella_hits", "tessella_kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
n AS (SELECT source, count(*) AS n_pages FROM d GROUP BY source),
l AS (SELECT rid, source, unnest(list_distinct(lines)) AS line FROM d),
b AS (SELECT l.source, line FROM l JOIN n ON l.source IS NOT DISTINCT FROM n.source WHERE trim(line) <> '' GROUP BY l.source, line
  HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO} * max(n_pages)),
s AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
k AS (SELECT doc_id, d.source, text, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)) AS kept
  FROM d LEFT JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped FROM k
"""
