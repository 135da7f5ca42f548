"""Histories of repositories: commits from logs, and what a fork has that its source has not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .closure import Rounds, kept

RECORD = "\x1e"
#: How a log is written that ``log_records`` reads: a record mark, then id, parents and subject, then a status and a path a line.
LOG_FORMAT = "git log --no-renames --name-status --format=%x1e%H%x1f%P%x1f%s"


def log_records(spark: SparkSession, path) -> DataFrame:
    """(file, sha, parents, subject, changes array<struct<status, path>>) of logs in ``LOG_FORMAT``. The record mark is the reader's
    line end, so a log of any size is split over tasks between records."""
    raw = spark.read.option("lineSep", RECORD).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = F.split("value", "\n", -1)
    head = F.split(F.get(lines, F.lit(0)), "\x1f", 3)
    rows = raw.filter(F.trim("value") != "").select("file", head.alias("h"), F.slice(lines, 2, F.size(lines)).alias("rest"))
    change = F.transform(F.filter("rest", lambda x: x.rlike("^[A-Z][0-9]*\t")), lambda x: F.struct(F.substring_index(x, "\t", 1).alias("status"), F.regexp_extract(x, "^[^\t]*\t(.*)$", 1).alias("path")))
    parents = F.filter(F.split(F.get("h", F.lit(1)), " "), lambda p: p != "")
    return rows.select("file", F.get("h", F.lit(0)).alias("sha"), F.coalesce(parents, F.array().cast("array<string>")).alias("parents"), F.coalesce(F.get("h", F.lit(2)), F.lit("")).alias("subject"), change.alias("changes"))


def small_fixes(records: DataFrame, said: str, suffixes: tuple[str, ...], most: int = 4) -> DataFrame:
    """Commits with one parent whose subject matches ``said`` and that modify 1 to ``most`` files of the suffixes, without adding or
    deleting any of them."""
    of_kind = F.filter("changes", lambda c: F.exists(F.array(*map(F.lit, suffixes)), lambda s: c["path"].endswith(s)))
    fits = (F.size("parents") == 1) & F.col("subject").rlike(f"(?i){said}") & F.size(of_kind).between(1, most) & F.forall(of_kind, lambda c: c["status"] == "M")
    return records.filter(fits).withColumn("changed", F.transform(of_kind, lambda c: c["path"]))


def ahead(commits: DataFrame, forks: DataFrame, *, repo: str = "repo", fork: str = "fork") -> DataFrame:
    """(fork, sha): commits that a fork's tip reaches and its source's tip does not.

    commits(repo, sha, parents, generation): a generation is larger than those of all parents. forks(fork, repo, tip, source).

    Both tips spread at once; a commit that the source reaches needs no mark of the fork. A mark of the source is only followed while its
    generation exceeds the lowest that the fork's marks came to, else it is held as long as these spread: nothing below can lead there.
    So work follows what a fork is ahead by and how far its source moved on, not the whole history. Marks are added to one table and a
    commit's parents lie in another, both in buckets, so a round shuffles its front only; forks that are done have none. Tips or
    parents that are no commits are left out; a null tip reaches nothing.
    """
    spark, mark = commits.sparkSession, [fork, repo, "sha"]
    born = commits.groupBy(repo, "sha").agg(F.max("generation").alias("generation"))
    links = commits.select(repo, F.col("sha").alias("at"), F.explode("parents").alias("sha")).join(born, [repo, "sha"])
    n_commits = commits.count()
    parents, seen = Rounds(spark, [repo, "at"], n_commits), Rounds(spark, mark, n_commits)
    links = parents.add(parents.dealt(links.select(repo, "at", "sha", "generation")).distinct())
    tips = forks.select(fork, repo, F.explode(F.array(F.struct(F.col("tip").alias("sha"), F.lit(1).alias("by")), F.struct(F.col("source").alias("sha"), F.lit(2).alias("by")))).alias("t"))
    tips = tips.select(fork, repo, "t.sha", "t.by").join(born, [repo, "sha"])
    # ``low`` is the lowest generation of the fork's marks as far as a row's round knew it.
    met = tips.select(*mark, "generation", "by", F.lit(None).cast(born.schema["generation"].dataType).alias("low"))
    held = None
    while True:
        met = seen.dealt(met).groupBy(*mark).agg(F.max("generation").alias("generation"), F.bit_or("by").alias("by"), F.min("low").alias("low"))
        if seen.last >= 0:
            was = seen.table().groupBy(*mark).agg(F.bit_or("by").alias("was"))
            met = met.join(was.hint("merge"), mark, "left").filter(F.col("was").isNull() | ((F.col("was") == 1) & (F.col("by") != 1))).drop("was")
        front = seen.add(met.withColumn("by", F.when(F.col("by") == 1, 1).otherwise(2)))
        front = front.unionByName(held) if held else front
        own = F.col("by") == 1
        lows = front.groupBy(fork).agg(F.least(F.min("low"), F.min(F.when(own, F.col("generation")))).alias("low"), F.max(own).alias("live"))
        front = kept(front.drop("low").join(lows, fork).withColumn("spreads", F.coalesce(own | (F.col("generation") > F.col("low")), F.lit(False))))
        spread = front.filter("spreads").select(fork, repo, F.col("sha").alias("at"), "by", "low")
        if spread.isEmpty():
            parents.removed()
            return seen.all().groupBy(fork, repo, "sha").agg(F.bit_or("by").alias("by")).filter("by = 1").select(fork, "sha")
        held = front.filter("live and not spreads").select(*mark, "generation", "by", "low")
        met = parents.dealt(spread).join(links, [repo, "at"]).select(*mark, "generation", "by", "low")
