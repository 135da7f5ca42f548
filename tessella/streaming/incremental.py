"""Incremental runs: bounded batches over growing folders, resumable by key, with stage counters kept beside the data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.readers import existing


def process_available(spark: SparkSession, source: str, schema, key: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, files_per_batch: int = 100, timeout: int | None = None) -> int:
    """Runs ``work`` over files that came since the last run, and appends its rows whose key is new; returns the number of batches.

    Two streams: one writes each batch's results to a folder of its own beside the checkpoint, overwritten if a crash repeats the batch;
    the other appends those to ``out`` and keeps the keys it has seen as state, so a batch costs its own rows, however many came
    before. Both are exactly once, by the checkpoint's record of files and the file sink's record of what it committed.
    """
    batches = []
    staged = f"{checkpoint}/staged"

    def write(df: DataFrame, n: int) -> None:
        work(df).dropDuplicates([key]).write.mode("overwrite").parquet(f"{staged}/batch={n}")
        batches.append(n)

    def run(writer) -> None:
        query = writer.trigger(availableNow=True).start()
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            query.stop()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/work"))
    if existing(spark, [staged]):
        made = spark.read.parquet(staged).drop("batch").schema
        fresh = spark.readStream.schema(made).parquet(f"{staged}/*").dropDuplicates([key])
        run(fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/keys"))
    return len(batches)


def todo(candidates: DataFrame, log: DataFrame, key: str, retry: tuple[str, ...] = ()) -> DataFrame:
    """Candidates without an entry in the stage log, and those whose last stage is to be tried again."""
    done = log.groupBy(key).agg(F.max_by("stage", "at").alias("stage")).filter(~F.col("stage").isin(*retry) if retry else F.lit(True))
    return candidates.join(done.select(key), key, "left_anti")


def stage_counts(log: DataFrame, key: str) -> DataFrame:
    """Counters of the last stage of each candidate."""
    return log.groupBy(key).agg(F.max_by("stage", "at").alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    return df.groupBy(F.col(key).alias("key_")).agg(F.max_by(F.struct(*df.columns), F.col(at)).alias("r")).select("r.*")


def until(target: int, batches, run: Callable[[object], int], most: int | None = None) -> int:
    """Batches one after another until enough rows were kept or enough batches tried; returns the rows kept."""
    kept = 0
    for i, batch in enumerate(batches):
        if kept >= target or most is not None and i >= most:
            break
        kept += run(batch)
    return kept


def capped_stream(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """A stream's rows up to ``most`` a group over its whole life: the state holds one count a group."""
    def step(key, frames, state):
        import pandas as pd

        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        kept = rows.head(max(0, most - n))
        state.update((n + len(kept),))
        yield kept

    return df.groupBy(group).applyInPandasWithState(step, df.schema, "n long", "append", "NoTimeout")


def episodes(turns: DataFrame) -> DataFrame:
    """Running totals of each episode's turns: turns(episode, turn, deleted, applied, think_chars)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("episode").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return turns.withColumns({"turns": F.count("*").over(w), "deleted_so_far": F.sum(F.when(F.col("applied"), F.col("deleted")).otherwise(0)).over(w), "thought_so_far": F.sum("think_chars").over(w)})
