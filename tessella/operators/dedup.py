"""Exact deduplication, leak checks and stages of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import lines, path_leaks, wskey

from .selection import first_wins


def text_hash(x: Column) -> Column:
    return F.sha1(x)


def normal_hash(x: Column) -> Column:
    """SHA-1 of the text with white space collapsed in each line and blank lines gone."""
    return F.sha1(F.array_join(F.filter(F.transform(lines(x), lambda s: wskey(s)), lambda s: s != ""), "\n"))


def unique_texts(df: DataFrame, text: str, order: str, normal: bool = False) -> DataFrame:
    """The first row of each text."""
    h = normal_hash(F.col(text)) if normal else text_hash(F.col(text))
    return first_wins(df.withColumn("hash_", h), ["hash_"], order).drop("hash_")


def exclusion_stage(df: DataFrame, key: str, text: str, order: str, used: DataFrame, rejected: DataFrame, external: Column, seen: DataFrame) -> DataFrame:
    """``stage`` of each candidate, checked in this order: used, rejected, external, dup (in an earlier set or row), kept."""
    flag = lambda other, on, name: (other.select(on).distinct().withColumn(name, F.lit(True)))
    h = df.withColumn("hash_", normal_hash(F.col(text)))
    h = h.join(flag(used, key, "used_"), key, "left").join(flag(rejected, key, "rejected_"), key, "left")
    known = seen.select(normal_hash(F.col(text)).alias("hash_")).distinct().withColumn("seen_", F.lit(True))
    h = h.join(known, "hash_", "left").withColumn("external_", F.coalesce(external, F.lit(False)))
    open_ = F.col("used_").isNull() & F.col("rejected_").isNull() & ~F.col("external_")
    first = h.filter(open_).groupBy("hash_").agg(F.min(order).alias("first_"))
    h = h.join(first, "hash_", "left")
    stage = F.when(F.col("used_"), "used").when(F.col("rejected_"), "rejected").when(F.col("external_"), "external").when(F.coalesce(F.col("seen_"), F.lit(False)) | (F.col("first_") < F.col(order)), "dup").otherwise("kept")
    return h.withColumn("stage", stage).drop("hash_", "used_", "rejected_", "seen_", "external_", "first_")


def without(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key none of the others has."""
    for other in others:
        df = df.join(other.select(key), key, "left_anti")
    return df


def leak_keys(df: DataFrame, *columns: str) -> DataFrame:
    """(column, key): all non-empty values of the identifying columns."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in columns])
    return df.select(F.explode(each).alias("k")).select("k.*").filter("key is not null and key <> ''").distinct()


def leaks(held: DataFrame, train: DataFrame, *columns: str) -> DataFrame:
    """Keys that held-out and training rows share; must be empty."""
    return leak_keys(held, *columns).intersect(leak_keys(train, *columns))


def require_empty(df: DataFrame, what: str, shown: int = 10) -> None:
    some = df.limit(shown).collect()
    if some:
        raise ValueError(f"{what}: {[tuple(r) for r in some]}")


def leaked_paths(df: DataFrame, group: str, text: str) -> DataFrame:
    return df.groupBy(group).agg(F.sum(path_leaks(F.coalesce(F.col(text), F.lit("")))).alias("n_paths"))
