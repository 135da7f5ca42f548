"""A keyed cache of looked-up values as a versioned table, which several runs may fill at the same time.

``folder/data/<id>/`` holds Parquet written by one fill; ``folder/versions/<n>.json`` lists the data folders of version n. A version
is taken by creating its file, which fails if another run has it: that run's folders are then read and the next number is tried. So
no fill is lost, and a reader sees whole fills only. Of a key that two fills looked up the later version's row is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.closure import kept


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, folder: str) -> list[int]:
    files, path = _file_system(spark, folder)
    held = path(f"{folder}/versions")
    names = [s.getPath().getName() for s in files.listStatus(held)] if files.exists(held) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _listed(spark: SparkSession, folder: str, version: int) -> list[str]:
    return json.loads(spark.read.text(f"{folder}/versions/{version}.json", wholetext=True).first()[0])


def read(spark: SparkSession, folder: str, key: str, ddl: str) -> DataFrame:
    """The cached rows, one a key; none of a cache that was never filled."""
    known = versions(spark, folder)
    if not known:
        return spark.createDataFrame([], ddl)
    rows = None
    for i, name in enumerate(_listed(spark, folder, known[-1])):
        part = spark.read.schema(ddl).parquet(f"{folder}/data/{name}").withColumn("fill_", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c != "fill_"]
    return rows.groupBy(F.col(key).alias("key_")).agg(F.max_by(F.struct(*columns), "fill_").alias("r")).select("r.*")


def _take(spark: SparkSession, folder: str, version: int, names: list[str]) -> bool:
    """Creates a version's file with its whole content, if no other run has."""
    files, path = _file_system(spark, folder)
    drafts = path(f"{folder}/drafts")
    files.mkdirs(drafts)
    files.mkdirs(path(f"{folder}/versions"))
    draft, final = path(f"{folder}/drafts/{uuid.uuid4().hex}.json"), path(f"{folder}/versions/{version}.json")
    out = files.create(draft, False)
    out.write(json.dumps(names).encode())
    out.close()
    try:
        if files.getScheme() == "file":  # a local rename replaces what is there; a hard link does not
            import os

            os.link(spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(draft).toString(), spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(final).toString())
            return True
        return files.rename(draft, final)
    except FileExistsError:
        return False
    finally:
        files.delete(draft, False)


def fill(spark: SparkSession, folder: str, wanted: DataFrame, key: str, ddl: str, look_up: Callable, *, batch: int = 100) -> int:
    """Looks up the keys of ``wanted`` that the cache lacks, ``batch`` at a time, and adds them; returns how many keys were absent.

    ``look_up(keys)`` gets a list of at most ``batch`` keys on an executor and returns their rows as dicts; keys that it knows nothing
    of are cached with nulls, so that they are not asked again.
    """
    absent = wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(read(spark, folder, key, ddl).select(key), key, "left_anti")
    absent = kept(absent.withColumn("row_", F.monotonically_increasing_id()))
    n = absent.count()
    if not n:
        return 0
    names = [f.name for f in spark.createDataFrame([], ddl).schema.fields]
    # Keys of one task are numbered in its rows, so batches are full but for a task's last.
    part = absent.select(key, F.shiftright("row_", 33).alias("task_"), "row_")
    batched = part.withColumn("batch_", F.floor((F.row_number().over(W.partitionBy("task_").orderBy("row_")) - 1) / batch))

    def asked(frame):
        import pandas as pd

        keys = frame[key].tolist()
        found = {r[key]: r for r in look_up(keys)}
        return pd.DataFrame([{**dict.fromkeys(names), **found.get(k, {}), key: k} for k in keys], columns=names, dtype=object)

    name = uuid.uuid4().hex
    batched.groupBy("task_", "batch_").applyInPandas(asked, ddl).write.parquet(f"{folder}/data/{name}")
    while True:
        known = versions(spark, folder)
        listed = _listed(spark, folder, known[-1]) if known else []
        if _take(spark, folder, known[-1] + 1 if known else 1, [*listed, name]):
            return n
