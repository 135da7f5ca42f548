"""Where intermediate data lies: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``. Only a local master, whose executors are the driver, gets a temporary
    folder where none is named; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder")
    return (named or tempfile.mkdtemp(prefix="tessella-")).rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own, on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder's name under the shared one; what was written there is removed at the end."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        removed(spark, path)
