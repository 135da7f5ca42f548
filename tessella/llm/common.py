"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names in ``spark.checkpoint.dir``. Only a local master, whose
    executors are the driver, gets a temporary folder where none is named; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder")
    return (named or tempfile.mkdtemp(prefix="tessella-")).rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own, by whatever file system it is on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that no later step recomputes it and a lost executor
    costs a reread only."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Bounds what one Arrow batch holds, so that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def sql_list(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def append_arrow(df: DataFrame, added: str, make) -> DataFrame:
    """``df`` with further columns that ``make(batch)`` gives as Arrow arrays, batch by batch; ``added`` is their DDL.

    Columns of ``df`` that have one of the new names are replaced.
    """
    import pyarrow as pa

    new = StructType.fromDDL(added)
    kept = df.drop(*new.fieldNames())
    schema = StructType([*kept.schema.fields, *new.fields])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=schema.fieldNames())

    return kept.mapInArrow(run, schema)
