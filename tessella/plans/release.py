"""Packaging a release: licences and attribution, dropped columns, scrubbed paths, references of kept documents, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import license_of
from tessella.operators import dedup, joins
from tessella.operators.mining import licensed
from tessella.schemas import keep_columns, scrub

# Columns that stay at home, and those that a skew release keeps.
DROPPED = ["src_dir", "bundles", "seed", "compile_seconds", "ctx_chars", "query", "stars", "single_file_build", "upstream", "upstream_license", "ahead_by", "commit_message"]
SKEW_KEPT = {"id": "string", "doc": "string", "arxiv_id": "string", "year": "int", "hist_year": "int", "signature": "string", "first_error": "string", "missing_file": "string", "n_files": "int", "engine": "string", "license": "string"}


def attributed(rows: DataFrame, posts: DataFrame, users: DataFrame, site: str) -> DataFrame:
    """Rows with ``attribution``: link, author and licence of the question and of the answer that fixed it."""
    named = joins.author_names(posts, users).select("id", "author", "created", "content_license")

    def source(key: str, name: str, path: str) -> DataFrame:
        s = F.struct(F.concat(F.lit(f"{site}/{path}/"), F.col("id").cast("string")).alias("url"), "author", F.coalesce("content_license", license_of(F.col("created"))).alias("license"))
        return named.select(F.col("id").alias(key), s.alias(name))

    out = rows.join(source("question_id", "q_", "q"), "question_id", "left").join(source("answer_id", "a_", "a"), "answer_id", "left")
    return out.withColumn("attribution", F.struct(F.col("q_").alias("question"), F.col("a_").alias("answer"))).drop("q_", "a_")


def released(rows: DataFrame, dropped_ids: DataFrame, home: Column, *, needs_license: bool) -> DataFrame:
    """Rows of a set without audited drops, without unlicensed ones if licences matter, without private columns and paths."""
    kept = rows.join(dropped_ids.select("id"), "id", "left_anti")
    if needs_license:
        kept = kept.filter(licensed(F.col("license")))
    return scrub(kept.drop(*DROPPED), home, ".", "/(?:Users|home)/[^/\"\\\\ ]+/", "~/")


def released_skew(rows: DataFrame) -> DataFrame:
    return keep_columns(rows, SKEW_KEPT)


def released_references(refs: DataFrame, docs: DataFrame, pool: DataFrame) -> DataFrame:
    """References of released documents; those of pool documents are marked as pseudo."""
    kept = refs.join(docs.select("doc").distinct(), "doc", "left_semi")
    marked = pool.select("doc").distinct().withColumn("pool_", F.lit(True))
    return kept.drop("pseudo").join(marked, "doc", "left").withColumn("pseudo", F.coalesce("pool_", F.lit(False))).drop("pool_")


def check(held: DataFrame, train: DataFrame, *keys: str, text: str | None = None) -> dict[str, DataFrame]:
    """Findings by name: shared keys, and texts of both sides whose line sets are nearly the same."""
    out = {"leaks": dedup.leaks(held, train, *keys)}
    if text is not None:
        from tessella.functions.text import line_set

        sides = [df.select("id", line_set(F.col(text)).alias("items")) for df in (held, train)]
        out["near_duplicates"] = joins.similar_sets(*sides, "id", "items")
    return out
