"""Splits, samples and mixes. Every random choice is an order by a hash of seed and key, so it does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import sha1_mod


def drawn(key: str, seed: int = 0) -> Column:
    """The sortable draw of a row."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def uniform(key: str, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 32 bits of the draw."""
    return F.conv(F.left(drawn(key, seed), F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def stratified(df: DataFrame, stratum: str, key: str, fraction: float, forced: Column | None = None, seed: int = 0) -> DataFrame:
    """``side`` eval or train: of each stratum about a fraction (halves to even), at least one of two, never all; forced rows always."""
    forced = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    marked = df.withColumn("forced_", forced)
    sizes = marked.groupBy(stratum).agg(F.count("*").alias("n_"), F.count_if("forced_").alias("f_"))
    want = F.least(F.greatest(F.bround(F.lit(fraction) * F.col("n_"), 0), F.when(F.col("n_") >= 2, 1).otherwise(0)), F.col("n_") - 1)
    place = F.row_number().over(W.partitionBy(stratum).orderBy(F.desc("forced_"), drawn(key, seed), key))
    joined = marked.join(sizes, stratum).withColumn("place_", place)
    return joined.withColumn("side", F.when(F.col("place_") <= F.greatest(want, F.col("f_")), "eval").otherwise("train")).drop("forced_", "n_", "f_", "place_")


def by_hash(df: DataFrame, key: Column, percent: int) -> DataFrame:
    """``side`` heldout for keys whose SHA-1 modulo 100 is under ``percent``."""
    return df.withColumn("side", F.when(sha1_mod(key.cast("string"), 100) < percent, "heldout").otherwise("train"))


def frozen(df: DataFrame, key: str, assigned: DataFrame, percent: int) -> DataFrame:
    """As ``by_hash``, but keys in ``assigned(key, side)`` keep their side."""
    old = assigned.select(F.col(key).alias("old_key"), F.col("side").alias("old_side"))
    out = by_hash(df, F.col(key), percent).join(old, F.col(key) == F.col("old_key"), "left")
    return out.withColumn("side", F.coalesce("old_side", "side")).drop("old_key", "old_side")


def by_predicate(df: DataFrame, held: Column) -> DataFrame:
    """``side`` heldout where a predicate holds; where it is null, train."""
    return df.withColumn("side", F.when(held, "heldout").otherwise("train"))


def lowest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """``side`` heldout for the n keys of lowest SHA-1: growing n keeps those chosen before."""
    chosen = df.select(key).distinct().orderBy(F.sha1(F.col(key).cast("string"))).limit(n).withColumn("side_", F.lit("heldout"))
    return df.join(chosen, key, "left").withColumn("side", F.coalesce("side_", F.lit("train"))).drop("side_")


def document_split(df: DataFrame, doc: str, k: int, val_fraction: float, seed: int = 0) -> DataFrame:
    """``side`` by document: min(k, n // 3) held out, of the rest at least one for validation, the rest for training."""
    docs = df.select(doc).distinct()
    n = docs.count()
    held = min(k, n // 3)
    val = max(1, int(val_fraction * (n - held))) if n > held else 0
    chosen = docs.orderBy(drawn(doc, seed), doc).limit(held + val)
    ranked = chosen.withColumn("place_", F.row_number().over(W.orderBy(drawn(doc, seed), doc)))  # of at most k + a fraction of documents
    return df.join(ranked, doc, "left").withColumn("side", F.when(F.col("place_") <= held, "heldout").when(F.col("place_").isNotNull(), "val").otherwise("train")).drop("place_")


def weighted(df: DataFrame, key: str, weight: Column, seed: int = 0) -> DataFrame:
    """Each row as often as the whole part of its weight, and once more with the chance of the rest; ``copy`` from 0."""
    times = F.floor(weight) + F.when(uniform(key, seed) < weight - F.floor(weight), 1).otherwise(0)
    return df.withColumn("times_", times).filter("times_ > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times_") - 1))).drop("times_")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(drawn(key, seed), key).limit(n)


def shuffled_slice(df: DataFrame, key: str, skip: int, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(drawn(key, seed), key).offset(skip).limit(n)


def top_then_sample(df: DataFrame, score: str, most: int, key: str, n: int, seed: int = 0) -> DataFrame:
    return sample(df.orderBy(F.desc(score), key).limit(most), key, n, seed)


def balanced(df: DataFrame, prompt: str, positive: Column, key: str, most: int, seed: int = 0) -> DataFrame:
    """Of each prompt up to ``most`` positive and as many negative rows."""
    place = F.row_number().over(W.partitionBy(prompt, positive).orderBy(drawn(key, seed), key))
    return df.withColumn("place_", place).filter(F.col("place_") <= most).drop("place_")


def of_each(df: DataFrame, kind: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """A drawn sample of n rows of each kind."""
    place = F.row_number().over(W.partitionBy(kind).orderBy(drawn(key, seed), key))
    return df.withColumn("place_", place).filter(F.col("place_") <= n).drop("place_")


def batches(df: DataFrame, key: str, size: int, seed: int = 0, rows_a_cell: int = 100_000) -> DataFrame:
    """``batch`` numbers of whole batches in shuffled order; the remainder is dropped. Rows are numbered by ranges of the draw, whose
    number grows with the rows, so no task sees more than a share of them."""
    n = df.count()
    digits = min(5, max(1, len(f"{n // rows_a_cell:x}")))
    marked = df.withColumn("cell_", F.conv(F.left(drawn(key, seed), F.lit(digits)), 16, 10).cast("int"))
    before = marked.groupBy("cell_").count().withColumn("before_", F.sum("count").over(W.orderBy("cell_").rowsBetween(W.unboundedPreceding, -1)))  # at most 16 ** 5 rows
    place = F.coalesce("before_", F.lit(0)) + F.row_number().over(W.partitionBy("cell_").orderBy(drawn(key, seed), key)) - 1
    out = marked.join(F.broadcast(before.drop("count")), "cell_").withColumn("place_", place)
    return out.filter(F.col("place_") < n // size * size).withColumn("batch", F.floor(F.col("place_") / size)).drop("cell_", "before_", "place_")
