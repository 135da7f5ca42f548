"""Files that a root reaches through inclusion, and the root of a project."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import strip_comments
from tessella.sources.folders import removed, shared_folder

ROWS_A_BUCKET = 50_000
INCLUDE = r"\\(?:input|include|subfile)\s*\{([^{}]+)\}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def inclusions(files: DataFrame, project: str = "project", path: str = "path", text: str = "text") -> DataFrame:
    """(project, src, dst): names that files include, as they are and next to the including file, with and without the suffix."""
    found = files.select(project, F.col(path).alias("src"), F.explode(F.regexp_extract_all(strip_comments(F.col(text)), F.lit(INCLUDE), F.lit(1))).alias("name"))
    folder = F.regexp_extract("src", r"^(.*/)?[^/]*$", 1)
    name = F.trim("name")
    each = found.select(project, "src", F.explode(F.array(name, F.concat(name, F.lit(".tex")), F.concat(folder, name), F.concat(folder, name, F.lit(".tex")))).alias("dst")).distinct()
    return each.join(files.select(project, F.col(path).alias("dst")), [project, "dst"]).select(project, "src", "dst").filter("src <> dst").distinct()


class Rounds:
    """Rows that are found round by round, each once: a table in the shared folder, in buckets of ``by``. A round is added to it and
    nothing is written again; ``new`` compares rows with the earlier ones bucket by bucket, so only what may be new is shuffled."""

    def __init__(self, spark: SparkSession, by: list[str], rows: int):
        self.spark, self.by, self.n, self.last = spark, by, min(2000, max(8, rows // ROWS_A_BUCKET)), -1
        self.name, self.path = f"rounds_{uuid.uuid4().hex}", f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` shuffled as the buckets are."""
        return rows.repartition(self.n, *self.by)

    def table(self) -> DataFrame:
        return self.spark.table(self.name).drop("round_")

    def new(self, rows: DataFrame) -> DataFrame:
        """The distinct rows of ``rows``, whose columns are ``by``, that no round has."""
        rows = self.dealt(rows).distinct()
        return rows if self.last < 0 else rows.join(self.table().hint("merge"), self.by, "left_anti")

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes a round, whose rows are dealt, and reads it."""
        self.last += 1
        out = rows.withColumn("round_", F.lit(self.last)).write.mode("append").partitionBy("round_").bucketBy(self.n, *self.by).sortBy(*self.by)
        out.option("path", self.path).saveAsTable(self.name)
        return self.spark.table(self.name).filter(F.col("round_") == self.last).drop("round_")

    def all(self) -> DataFrame:
        """All rows, read from the folder; the table's name is given up."""
        schema = self.spark.table(self.name).schema
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(schema).parquet(self.path).drop("round_")

    def removed(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        removed(self.spark, self.path)


def closure(edges: DataFrame, roots: DataFrame, keys: list[str], *, max_depth: int | None = None) -> DataFrame:
    """(keys, root, node) of all nodes reachable from each root, itself included; edges(keys, src, dst), roots(keys, root).

    Breadth first; nodes seen are not expanded again, so cycles end, and chains of any length are followed unless ``max_depth`` makes
    a longer one an error. Each pair is written once, in its round, and shuffled when it is expanded and as often as it is reached; the
    edges are shuffled once a round. The lineage is cut by what is written, and a lost executor costs a reread.
    """
    spark, pair = edges.sparkSession, [*keys, "root", "node"]
    edges = kept(edges.select(*keys, "src", "dst").distinct())
    seen = Rounds(spark, pair, edges.count() + roots.count())
    front = seen.add(seen.new(roots.select(*keys, "root", F.col("root").alias("node"))))
    for depth in itertools.count(1):
        step = front.join(edges, [*[front[k] == edges[k] for k in keys], front["node"] == edges["src"]]).select(*[front[k] for k in keys], front["root"], edges["dst"].alias("node"))
        front = seen.add(seen.new(step))
        if front.isEmpty():
            return seen.all()
        if depth == max_depth:
            seen.all()
            raise RuntimeError(f"a closure is deeper than {max_depth}")


def pick_root(reached: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root): the only root; else the one that reaches a changed file; else the one that reaches most; ties by name."""
    hit = changed.select(*keys, F.col("path").alias("node")).withColumn("hit", F.lit(1))
    per = reached.join(hit, [*keys, "node"], "left").groupBy(*keys, "root").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.min_by("root", F.struct(-F.least(F.col("hits"), F.lit(1)), -F.col("n"), F.col("root"))).alias("root"))


def is_multi(paths: Column, root_text: Column) -> Column:
    """At least two source files, and the root includes something."""
    return (F.size(F.filter(paths, lambda p: p.endswith(".tex"))) >= 2) & root_text.rlike(INCLUDE)


def non_root(paths: Column, reached: Column) -> Column:
    return F.filter(paths, lambda p: (F.array_contains(reached, p) & p.endswith(".tex")) | p.endswith(".sty") | p.endswith(".cls"))
