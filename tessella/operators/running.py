"""Running totals in arrival order, and what is decided by them: caps that act on one another, and draws until a target is met.

A total over all earlier rows is taken in two levels. Rows fall into blocks of about ``rows_a_block`` rows by ranges of the order;
each block's sum is known after one aggregation, sums of earlier blocks are added over at most ``MAX_BLOCKS`` rows a key, and only rows
of one block are ordered together. So no task holds a key, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .closure import kept
from .splits import drawn

ROWS_A_BLOCK, MAX_BLOCKS = 50_000, 4096


def in_blocks(df: DataFrame, order: str, *, rows_a_block: int = ROWS_A_BLOCK, out: str = "block_") -> DataFrame:
    """``df`` with the number of each row's range of ``order``, a number without nulls; equal numbers share a block."""
    from pyspark.ml.feature import Bucketizer

    n = min(MAX_BLOCKS, max(1, df.count() // rows_a_block))
    cuts = df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumn(out, F.lit(0))
    marked = df.withColumn("order_", F.col(order).cast("double"))
    cutter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="order_", outputCol=out)
    return cutter.transform(marked).withColumn(out, F.col(out).cast("int")).drop("order_")


def totals_before(df: DataFrame, order: str, values: dict[str, Column], keys: tuple[str, ...] = (), ties: tuple[str, ...] = (), *, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """``df`` with, for each name of ``values``, its sum over the earlier rows of the same ``keys`` (none null) by ``order``, then
    ``ties``."""
    df = in_blocks(df, order, rows_a_block=rows_a_block).withColumns({f"{k}_v": v for k, v in values.items()})
    sums = df.groupBy(*keys, "block_").agg(*[F.sum(f"{k}_v").alias(f"{k}_s") for k in values])
    earlier = W.partitionBy(*keys).orderBy("block_").rowsBetween(W.unboundedPreceding, -1)  # at most MAX_BLOCKS rows a key
    base = sums.select(*keys, "block_", *[F.coalesce(F.sum(f"{k}_s").over(earlier), F.lit(0)).alias(f"{k}_b") for k in values])
    own = W.partitionBy(*keys, "block_").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(base, [*keys, "block_"]).withColumns({k: F.col(f"{k}_b") + F.coalesce(F.sum(f"{k}_v").over(own), F.lit(0)) for k in values})
    return out.drop("block_", *[f"{k}_{x}" for k in values for x in "vb"])


def within_caps(df: DataFrame, order: str, tested: Column, counted: Column, *, chunk: int = 20_000, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """``df`` with ``kept``: whether a row is kept if rows arrive by ``order`` (unique numbers) and only kept rows count.

    ``tested``: array<struct<key string, most bigint>>; a row is kept while each of these keys has counted fewer than ``most`` kept
    rows. ``counted``: array<string>, the keys that a kept row adds to. The two may differ, and a row may have many of both.

    A round holds every open row against two totals of each key: the earlier rows that are surely kept, and those that may be. Below
    the limit by the second it is kept, at the limit by the first it is not. Rows that depend on one another in long chains
    would need a round each, so a round also decides the first ``chunk`` open rows one after another, in one task of that size. The
    result is that of a loop over all rows, whatever the number of rounds. A null list is an empty one; a null order is an error.
    """
    empty = "array<struct<key:string,most:bigint>>"
    own = F.transform(F.coalesce(counted, F.array().cast("array<string>")), lambda k: F.struct(k.alias("key"), F.lit(1).alias("adds"), F.lit(None).cast("bigint").alias("most")))
    held = F.transform(F.coalesce(tested.cast(empty), F.array().cast(empty)), lambda t: F.struct(t["key"].alias("key"), F.lit(0).alias("adds"), t["most"].alias("most")))
    slim = df.select(F.col(order).alias("at"), F.concat(own, held).alias("entries"), F.lit(None).cast("boolean").alias("kept"))
    slim = kept(slim.withColumn("at", F.when(F.col("at").isNull(), F.raise_error(F.lit("a row without an order"))).otherwise(F.col("at"))))
    open_rows = slim.count()
    while open_rows:
        slim = kept(_decided(slim, rows_a_block, F.col("kept").isNull()))
        left = slim.filter("kept is null").count()
        if left and left > open_rows // 2:
            slim = kept(_in_turn(slim, chunk, rows_a_block))
            left = slim.filter("kept is null").count()
        open_rows = left
    return df.join(slim.select(F.col("at").alias(order), "kept"), order)


def _entries(slim: DataFrame) -> DataFrame:
    """A row for each key of a row that is not rejected; keys that are tested and counted are one."""
    each = slim.filter("kept is null or kept").select("at", "kept", F.explode("entries").alias("e"))
    return each.groupBy("at", "kept", F.col("e.key").alias("key")).agg(F.max("e.adds").alias("adds"), F.min("e.most").alias("most"))


def _decided(slim: DataFrame, rows_a_block: int, open_: Column) -> DataFrame:
    one = lambda c: F.when(c, F.col("adds")).otherwise(0)
    run = totals_before(_entries(slim), "at", {"sure": one(F.col("kept")), "maybe": one(F.lit(True))}, ("key",), rows_a_block=rows_a_block)
    held = run.filter("kept is null and most is not null").groupBy("at").agg(F.bool_and(F.col("maybe") < F.col("most")).alias("in_"), F.bool_or(F.col("sure") >= F.col("most")).alias("out_"))
    verdict = F.when(F.coalesce("in_", F.lit(True)), True).when(F.col("out_"), False)  # a row without tests is kept
    return slim.join(held, "at", "left").select("at", "entries", F.when(open_, verdict).otherwise(F.col("kept")).alias("kept"))


def _in_turn(slim: DataFrame, chunk: int, rows_a_block: int) -> DataFrame:
    """Decides the first ``chunk`` open rows in a loop; what was kept before each of them is known."""
    first = kept(slim.filter("kept is null").orderBy("at").limit(chunk).select("at"))
    last = first.agg(F.max("at")).first()[0]
    run = totals_before(_entries(slim.filter(F.col("at") <= last)), "at", {"sure": F.when(F.col("kept"), F.col("adds")).otherwise(0)}, ("key",), rows_a_block=rows_a_block)
    rows = run.filter("kept is null").join(first, "at").groupBy("at").agg(F.collect_list(F.struct("key", "adds", "most", "sure")).alias("keys"))

    def loop(frame):
        import pandas as pd

        frame, added, out = frame.sort_values("at"), {}, []
        for keys in frame["keys"]:
            keep = all(k["most"] is None or k["sure"] + added.get(k["key"], 0) < k["most"] for k in keys)
            if keep:
                for k in keys:
                    added[k["key"]] = added.get(k["key"], 0) + k["adds"]
            out.append(keep)
        return pd.DataFrame({"at": frame["at"], "turn": out})

    turns = rows.withColumn("one_", F.lit(0)).groupBy("one_").applyInPandas(loop, f"at {slim.schema['at'].dataType.simpleString()}, turn boolean")  # ``chunk`` rows
    return slim.join(turns, "at", "left").select("at", "entries", F.coalesce("kept", "turn").alias("kept"))


def draw_until(df: DataFrame, key: str, accepts: Column, target: int, *, tries: int = 30, seed: int = 0, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """The rows that are tried if rows are drawn without replacement in a seeded order until ``target`` were accepted, or ``tries``
    times as many tried; ``accepted`` says which were, ``tried`` is each one's number in the draw.

    One plan instead of a loop: both counts are running totals over the draw, and the cut is where either ends. ``key`` is unique;
    a missing verdict is no acceptance.
    """
    yes = F.coalesce(accepts, F.lit(False))
    rows = df.withColumns({"draw_": F.conv(F.left(drawn(key, seed), F.lit(13)), 16, 10).cast("long"), "accepted": yes})
    run = totals_before(rows, "draw_", {"before_": F.lit(1).cast("long"), "had_": F.col("accepted").cast("long")}, ties=(key,), rows_a_block=rows_a_block)
    return run.filter((F.col("had_") < target) & (F.col("before_") < target * tries)).withColumn("tried", F.col("before_") + 1).drop("draw_", "before_", "had_")
