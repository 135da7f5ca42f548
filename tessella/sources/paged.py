"""Sources that answer page by page, as Spark data sources: searches by (query, page) and tables by offset, with bounded retries.

A source's ``fetch`` gets one request and returns its rows; it runs on executors. Requests are planned before they are sent: a
partition holds a run of one query's pages, read in turn until a page is short; offsets are planned whole. A request that fails is
tried again a bounded number of times, after growing pauses; after the last it fails the task, which Spark tries again elsewhere.
``ended`` then drops what lies beyond a query's first short page, so the result does not depend on how pages were dealt.

``source`` has a task for each planned run, so it is for few of them. ``asked`` takes the runs as rows of a DataFrame, so any number of
requests is dealt over as many tasks as it has partitions, and none of them passes the driver.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def retried(call: Callable, *, tries: int = 3, pause: float = 1.0, growth: float = 2.0, transient=(OSError, ValueError), sleep=time.sleep):
    """What ``call()`` returns, tried up to ``tries`` times; between them pauses that grow by ``growth``. Other errors than transient
    ones, and the last one, are raised."""
    for i in range(tries):
        try:
            return call()
        except transient:
            if i + 1 == tries:
                raise
            sleep(pause * growth**i)


class Pages(InputPartition):
    """Pages ``first`` to ``last`` of one query."""

    def __init__(self, query: str, first: int, last: int):
        self.query, self.first, self.last = query, first, last


class Offsets(InputPartition):
    """``length`` rows from ``offset``."""

    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


def page_runs(queries: list[str], most: int, run: int) -> list[Pages]:
    """Every query's pages from 1 to ``most``, in runs of ``run``."""
    return [Pages(q, i, min(i + run - 1, most)) for q in queries for i in range(1, most + 1, run)]


def offset_runs(n: int, size: int, first: int = 0) -> list[Offsets]:
    """The requests that read the rows from ``first`` up to ``n``."""
    return [Offsets(i, min(size, n - i)) for i in range(first, n, size)]


def _schema(paged: bool, ddl: str) -> tuple[StructType, list[str]]:
    """The columns of pages or of offsets with those of ``ddl``, and the latter's names."""
    places = "query string, page int" if paged else "offset long"
    return StructType.fromDDL(places + (f", {ddl}" if ddl else "")), [f.name for f in StructType.fromDDL(ddl).fields]


def _answers(part, fetch: Callable, names: list[str], page_size: int, tries: int, pause: float):
    """The rows of a run, page by page until one is short, or of one offset."""
    if isinstance(part, Offsets):
        for r in retried(lambda: fetch(part.offset, part.length), tries=tries, pause=pause):
            yield (part.offset, *[r.get(n) for n in names])
        return
    for page in range(part.first, part.last + 1):
        rows = retried(lambda page=page: fetch(part.query, page, page_size), tries=tries, pause=pause)
        for r in rows:
            yield (part.query, page, *[r.get(n) for n in names])
        if len(rows) < page_size:
            return


def source(name: str, ddl: str, fetch: Callable, partitions: list[InputPartition], *, page_size: int = 100, tries: int = 3, pause: float = 1.0) -> type[DataSource]:
    """A data source ``name`` with the columns of ``ddl``. ``fetch(query, page, page_size)`` returns a page's rows as dicts and
    ``fetch(offset, length)`` those of an offset; pages have the columns query and page added, offsets the column offset."""
    schema, names = _schema(bool(partitions) and isinstance(partitions[0], Pages), ddl)

    class Reader(DataSourceReader):
        def partitions(self):
            return partitions

        def read(self, part):
            return _answers(part, fetch, names, page_size, tries, pause)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Source


def read(spark: SparkSession, made: type[DataSource]) -> DataFrame:
    spark.dataSource.register(made)
    return spark.read.format(made.name()).load()


def asked(requests: DataFrame, ddl: str, fetch: Callable, *, page_size: int = 100, tries: int = 3, pause: float = 1.0, rows_a_batch: int = 5000) -> DataFrame:
    """The rows that requests get, with the columns of ``source``: requests(query, first, last) are runs of pages, requests(offset, length)
    offset reads. They are sent in the tasks and the order that they are dealt in."""
    paged = "query" in requests.columns
    schema, names = _schema(paged, ddl)

    def send(frames):
        import itertools

        import pandas as pd

        runs = (r for f in frames for r in zip(*[f[c].tolist() for c in (("query", "first", "last") if paged else ("offset", "length"))]))
        rows = (x for r in runs for x in _answers((Pages if paged else Offsets)(*r), fetch, names, page_size, tries, pause))
        while some := list(itertools.islice(rows, rows_a_batch)):
            yield pd.DataFrame(some, columns=schema.names, dtype=object)

    return requests.mapInPandas(send, schema)


def ended(rows: DataFrame, page_size: int) -> DataFrame:
    """The rows up to the first page of each query that is short, that page included; a page without rows ends its query too."""
    by = W.partitionBy("query").orderBy("page")  # a query's pages
    sizes = rows.groupBy("query", "page").agg(F.count("*").alias("n")).withColumn("next", F.col("page") == F.row_number().over(by))
    full = F.min(((F.col("n") >= page_size) & F.col("next")).cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1))
    open_ = sizes.withColumn("open", F.coalesce(full, F.lit(1)) == 1).filter("open and next")
    return rows.join(open_.select("query", "page"), ["query", "page"])


def recorded_pages(folder: str) -> Callable:
    """``fetch`` of recorded answers: ``folder/query=<q>/page=<n>/`` holds a page's items, a JSON object a line. A page that was not
    recorded has no items. Paths are opened by pyarrow's file systems, so they may be remote."""

    def fetch(query: str, page: int, page_size: int) -> list[dict]:
        return _json_lines(f"{folder.rstrip('/')}/query={query}/page={page}")

    return fetch


def recorded_offsets(folder: str) -> Callable:
    """``fetch`` of recorded offset reads: ``folder/offset=<n>/``, as ``recorded_pages``."""

    def fetch(offset: int, length: int) -> list[dict]:
        return _json_lines(f"{folder.rstrip('/')}/offset={offset}")[:length]

    return fetch


PAGES_A_RUN = 100


def page_bucket(query, page, buckets: int):
    """The Column that says in which of ``buckets`` files of answers a page is recorded; a query's runs of 100 pages stay together."""
    run = F.floor((page - 1) / PAGES_A_RUN).cast("string")
    return (F.crc32(F.concat(query, F.lit(":"), run)) % buckets).cast("int")


def bucketed_pages(folder: str, buckets: int) -> Callable:
    """``fetch`` of answers that are recorded many in a file: ``folder/bucket=<b>/`` holds a JSON object an item with its query and page, and
    ``page_bucket`` says where. The last bucket is held, so requests in order of buckets read each of them once."""
    find = _held(folder, "bucket", lambda r: (r["query"], r["page"]))
    return lambda query, page, page_size: find(zlib.crc32(f"{query}:{(page - 1) // PAGES_A_RUN}".encode()) % buckets, (query, page))


def bucketed_offsets(folder: str, rows_a_bucket: int) -> Callable:
    """``fetch`` of offset reads that are recorded many in a file: ``folder/bucket=<offset // rows_a_bucket>/``, a JSON object a row with the
    offset of its request; held as ``bucketed_pages``."""
    find = _held(folder, "bucket", lambda r: r["offset"])
    return lambda offset, length: find(offset // rows_a_bucket, offset)[:length]


def _held(folder: str, column: str, key: Callable) -> Callable:
    """``find(b, k)``: the rows of key ``k`` in the files of ``folder/column=<b>``; those of the last ``b`` are held by their keys."""
    last: dict = {}

    def find(b: int, k) -> list[dict]:
        if b not in last:
            rows: dict = {}
            for r in _json_lines(f"{folder.rstrip('/')}/{column}={b}"):
                rows.setdefault(key(r), []).append(r)
            last.clear()
            last[b] = rows
        return last[b].get(k, [])

    return find


def _json_lines(folder: str) -> list[dict]:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    out = []
    for f in sorted(found, key=lambda f: f.path):
        if f.is_file and not f.base_name.startswith(("_", ".")):
            with files.open_input_stream(f.path) as s:
                out += [json.loads(line) for line in s.read().decode().splitlines() if line.strip()]
    return out


def flaky(fetch: Callable, failures: int) -> Callable:
    """``fetch`` whose every request fails that often before it answers; for trying out retries."""
    seen: dict = {}

    def failing(*request):
        seen[request] = seen.get(request, 0) + 1
        if seen[request] <= failures:
            raise ConnectionError(f"failure {seen[request]} of {request}")
        return fetch(*request)

    return failing
