"""Parquet by row groups: a data source whose partitions are row groups, so that a run can draw some of them and read these only.

Spark's own reader packs row groups into splits as it likes; sampling by row group, as one does with shards that are too large to
read, needs them by number. Footers are read when the scan is planned; row groups whose minimum or maximum rules out a pushed filter,
or that ``only`` does not name, have no partition. Of the rest the columns of the given schema are read and no others. The columns
``shard`` (the file's place in order) and ``row_group`` may be asked for too.

    read(spark, folder, "doc_id long, row_group int", only=drawn(spark, folder, 20))
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

PLACES = ("shard", "row_group")


@dataclass
class RowGroup(InputPartition):
    path: str
    shard: int
    row_group: int
    rows: int


def _files(folder: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    if files.get_file_info(path).is_file:
        return files, [path]
    found = files.get_file_info(fs.FileSelector(path, recursive=True))
    return files, sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


def _may_hold(statistics, filters) -> bool:
    """Whether a column's statistics allow a row that meets all filters (operator, value)."""
    if statistics is None or not statistics.has_min_max:
        return True
    low, high = statistics.min, statistics.max
    ruled = {"=": lambda v: low <= v <= high, ">": lambda v: high > v, ">=": lambda v: high >= v, "<": lambda v: low < v, "<=": lambda v: low <= v}
    try:
        return all(ruled[op](value) for op, value in filters)
    except TypeError:  # a value of another type than the column's: nothing is known
        return True


def planned(folder: str, filters: dict[str, list], only: set[tuple[int, int]] | None = None) -> list[RowGroup]:
    """The row groups that may hold rows under ``filters`` (column to (operator, value)), of those that ``only`` names."""
    import pyarrow.parquet as pq

    files, paths = _files(folder)
    out = []
    for shard, path in enumerate(paths):
        with files.open_input_file(path) as f:
            footer = pq.ParquetFile(f).metadata
        for g in range(footer.num_row_groups):
            group = footer.row_group(g)
            held = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
            named = only is None or (shard, g) in only
            if named and all(_may_hold(held.get(c), fs) for c, fs in filters.items()):
                out.append(RowGroup(path, shard, g, group.num_rows))
    return out


class Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.fields = [f.name for f in schema.fields]
        self.folder = options["path"]
        only = options.get("only")
        self.only = {tuple(map(int, x.split(":"))) for x in only.split(",") if x} if only is not None else None
        self.filters: dict[str, list] = {}

    def partitions(self):
        return planned(self.folder, self.filters, self.only)

    def read(self, part):
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, _ = _files(self.folder)
        places = {"shard": part.shard, "row_group": part.row_group}
        with files.open_input_file(part.path) as f:
            held = pq.ParquetFile(f)
            columns = [c for c in self.fields if c not in PLACES]
            for batch in held.iter_batches(row_groups=[part.row_group], columns=columns, batch_size=1024):
                n = batch.num_rows
                arrays = [pa.array([places[c]] * n, pa.int32()) if c in places else batch.column(batch.schema.get_field_index(c)) for c in self.fields]
                yield pa.RecordBatch.from_arrays(arrays, names=self.fields)


class PushingReader(Reader):
    """A reader that takes Spark's filters, which must be allowed to push them (``spark.sql.python.filterPushdown.enabled``)."""

    OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def pushFilters(self, filters):
        """Filters on one column against a value prune row groups; Spark applies all of them again to the rows."""
        for f in filters:
            op = self.OPERATORS.get(type(f))
            if op and len(f.attribute) == 1 and f.attribute[0] not in PLACES:
                self.filters.setdefault(f.attribute[0], []).append((op, f.value))
            yield f


class RowGroups(DataSource):
    @classmethod
    def name(cls):
        return "row_groups"

    def schema(self):
        raise ValueError("row_groups needs a schema: the columns to read")

    def reader(self, schema):
        return (PushingReader if self.options.get("push") == "true" else Reader)(schema, self.options)


def read(spark: SparkSession, folder: str, ddl: str, *, only: list[tuple[int, int]] | None = None) -> DataFrame:
    """The columns of ``ddl`` of the row groups that ``only`` names, all if not given. Filters on the result prune row groups if the
    session lets Python sources take them."""
    spark.dataSource.register(RowGroups)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("row_groups").schema(ddl).option("push", push)
    return (reader if only is None else reader.option("only", ",".join(f"{a}:{b}" for a, b in only))).load(folder)


def drawn(spark: SparkSession, folder: str, n: int, seed: int = 0) -> list[tuple[int, int]]:
    """``n`` (shard, row group) of a folder, drawn by a seeded hash; only footers are read."""
    every = [(g.shard, g.row_group) for g in planned(folder, {})]
    return sorted(every, key=lambda g: sha1(f"{seed}:{g[0]}:{g[1]}".encode()).hexdigest())[:n]
