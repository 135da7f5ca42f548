"""Writers: JSON lines, routed tables, maps, project trees, the manifest of a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, *, order: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines; in range-partitioned order if one is asked for, so the parts read in turn are sorted."""
    (df if order is None else df.orderBy(order)).write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the table at ``path`` does not hold yet; writing again after a crash adds nothing twice. Returns
    what the table did not hold before."""
    from .readers import existing

    rows = df.dropDuplicates([key])
    if existing(df.sparkSession, [path]):
        rows = rows.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    rows.write.mode("append").parquet(path)
    return rows


def routed(df: DataFrame, path: str, route: Column) -> None:
    """One table, partitioned by route: one pass, however many routes."""
    df.withColumn("route", route).write.partitionBy("route").mode("append").parquet(path)


def json_map(df: DataFrame, key: str, path: str) -> None:
    """JSON objects of the rows by key, one object a part."""
    name = F.regexp_extract(F.to_json(F.struct(F.col(key).cast("string").alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    entry = F.concat(name, F.lit(":"), F.to_json(F.struct(*[c for c in df.columns if c != key])))
    df.groupBy(F.spark_partition_id().alias("p")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value")).select("value").write.text(path)


def released_files(files: DataFrame) -> DataFrame:
    """The files of projects that a release takes: no build outputs, no PDF beside a source of its name."""
    kept = files.filter(~F.col("path").rlike(r"\.(aux|log|out|fls|fdb_latexmk|blg)$"))
    sources = kept.filter(F.col("path").endswith(".tex")).select("project", F.regexp_replace("path", r"\.tex$", ".pdf").alias("path"))
    return kept.join(sources, ["project", "path"], "left_anti")


def write_tree(files: DataFrame, root: str) -> None:
    """Project trees as one table, partitioned by project: (path, text). Trees of many small files do not scale."""
    files.write.partitionBy("project").mode("overwrite").parquet(root)


def manifest(spark: SparkSession, paths: dict[str, str], rows: dict[str, DataFrame]) -> DataFrame:
    """(file, rows, bytes, sha256) of each named file or folder; a folder's digest is that of its parts' digests in order."""
    out = None
    for name, path in paths.items():
        parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("d"))
        total = parts.agg(F.sum("length").alias("bytes"), F.sort_array(F.collect_list(F.struct("path", "d"))).alias("ds"))
        one = total.select(F.lit(name).alias("file"), F.lit(rows[name].count() if name in rows else None).cast("long").alias("rows"), "bytes", F.when(F.size("ds") == 1, F.get("ds", F.lit(0))["d"]).otherwise(F.sha2(F.array_join("ds.d", ""), 256)).alias("sha256"))
        out = one if out is None else out.unionByName(one)
    return out


def placeholders_needed(docs: DataFrame, key: str, texts: list[str], files: DataFrame) -> DataFrame:
    """(key, path) of graphics that documents name and projects lack; names without a suffix get ``.pdf``, examples none."""
    pattern = r"\\includegraphics\*?(?:\[[^\]]*\])?\{([^{}]+)\}"
    names = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(t), F.lit("")), F.lit(pattern), F.lit(1)) for t in texts]))
    each = docs.select(key, F.explode(F.array_distinct(names)).alias("n")).withColumn("n", F.regexp_extract(F.trim("n"), r"([^/]*)$", 1)).filter(~F.col("n").startswith("example-"))
    path = F.when(F.col("n").contains("."), F.col("n")).otherwise(F.concat("n", F.lit(".pdf")))
    return each.select(key, path.alias("path")).distinct().join(files.select(key, "path"), [key, "path"], "left_anti")
