"""Snapshots of a running stream: counters that its rows are observed by, and an estimate of the time left."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Snapshots(StreamingQueryListener):
    """Keeps what each batch of the query ``name`` was observed to hold: a few counters a batch, made where the rows are."""

    def __init__(self, name: str, metric: str):
        self.name, self.metric, self.held, self.done = name, metric, {}, threading.Event()
        self.run_id = None

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.run_id = event.runId

    def onQueryProgress(self, event):
        p = event.progress
        if p.name == self.name and self.metric in p.observedMetrics and p.numInputRows:
            self.held[p.batchId] = (p.timestamp, p.batchDuration / 1000, p.observedMetrics[self.metric].asDict())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.runId == self.run_id:
            self.done.set()


def run(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, counters: dict[str, Column], *, target: int, progress: str, files_per_batch: int = 100) -> DataFrame:
    """Runs ``work`` over the files at ``source``, ``files_per_batch`` of them in flight at once, and returns a row a batch: (batch, at,
    seconds, counters map<string, bigint>, so_far, eta_seconds).

    ``counters`` are aggregates of the source's rows. ``so_far`` is the total of those whose names start with ``progress``;
    ``eta_seconds`` is (target - so far) x seconds so far / so far, so it is null before anything was counted. Batches that found no
    rows have no row; a source without files has none at all.
    """
    name = f"snapshots-{uuid.uuid4().hex}"
    listener = Snapshots(name, "snapshot")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        seen = stream.observe("snapshot", *[c.alias(k) for k, c in counters.items()])
        query = work(seen).writeStream.queryName(name).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        listener.done.wait(60)  # progress is told in order, the end last
    finally:
        spark.streams.removeListener(listener)
    rows, total, seconds = [], 0, 0.0
    for batch, (at, took, counted) in sorted(listener.held.items()):
        total += sum(n for k, n in counted.items() if k.startswith(progress))
        seconds += took
        rows.append((batch, at, took, counted, total, (target - total) * seconds / total if total else None))
    return spark.createDataFrame(rows, "batch long, at string, seconds double, counters map<string,bigint>, so_far long, eta_seconds double")
