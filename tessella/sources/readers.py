"""Readers of the formats that curation meets: JSON lines, maps, result files, post dumps, project trees, concatenations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.schemas import EVAL_RESULT, REFERENCE, schema

POST = "`_Id` bigint, `_PostTypeId` int, `_ParentId` bigint, `_AcceptedAnswerId` bigint, `_Score` int, `_CreationDate` string, `_Title` string, `_Tags` string, `_Body` string, `_OwnerUserId` bigint, `_OwnerDisplayName` string, `_ContentLicense` string"
USER = "`_Id` bigint, `_DisplayName` string"
TEXT_SUFFIXES = (".tex", ".sty", ".cls", ".bib", ".bst", ".bbl", ".def", ".cfg", ".txt")
BUILD_SUFFIXES = (".aux", ".log", ".out", ".fls", ".fdb_latexmk", ".blg")


def json_lines(spark: SparkSession, path, ddl: str) -> DataFrame:
    """Rows of JSON lines; blank lines are none, a malformed one is an error."""
    return spark.read.schema(schema(ddl)).option("mode", "FAILFAST").json(path)


def reference_map(spark: SparkSession, path: str) -> DataFrame:
    """References of a file that is one JSON object, by document."""
    fields = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema(REFERENCE).fields if f.name not in ("doc", "img")) + ", img:array<string>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{fields}>>")).alias("doc", "r"))
    return whole.select("doc", "r.*").withColumn("img", F.transform("img", lambda x: F.unbase64(x)))


def overlay(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows by key, later frames before earlier ones."""
    marked = [f.withColumn("layer_", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    return rows.groupBy(F.col(key).alias("key_")).agg(F.max_by(F.struct(*rows.columns), F.col("layer_")).alias("r")).select("r.*").drop("layer_")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that exist, in order, on any file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return [p for p in paths if path(p).getFileSystem(conf).exists(path(p))]


def post_rows(spark: SparkSession, path: str, ddl: str = POST) -> DataFrame:
    """Attributes of the ``<row .../>`` elements of a dump, one a line, entities decoded; names without the underscore."""
    rows = spark.read.text(path).filter(F.ltrim("value").startswith("<row ")).select(F.from_xml("value", ddl).alias("r")).select("r.*")
    return rows.select(*[F.col(c).alias(c.lstrip("_")) for c in rows.columns])


def post_attributes(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, attributes) of each row with entities left as they are; ``ids(id)`` restricts the rows before attributes are read."""
    rows = spark.read.text(path).filter(F.ltrim("value").startswith("<row "))
    rows = rows.withColumn("id", F.regexp_extract("value", r'\bId="(\d+)"', 1).cast("long"))
    if ids is not None:
        rows = rows.join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(r'(\w+)="([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all("value", F.lit(r'(\w+)="([^"]*)"'), F.lit(2)).alias("v"))
    return rows.select("id", F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"]))).alias("attributes"))


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """(project, path, text) of the text files under ``root/<project>/``, build outputs left out; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rest = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^\\Q" + root.rstrip("/") + "\\E/", "")
    out = files.select(F.substring_index(rest, "/", 1).alias("project"), F.regexp_extract(rest, "^[^/]*/(.*)$", 1).alias("path"), F.expr("make_valid_utf8(cast(content AS string))").alias("text"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return out.filter(suffix.isin(*TEXT_SUFFIXES) & ~suffix.isin(*BUILD_SUFFIXES))


def as_map(files: DataFrame, key: str = "project") -> DataFrame:
    """Project trees as one map a project; a path that comes twice keeps its last text."""
    one = files.groupBy(key, "path").agg(F.max("text").alias("text"))
    return one.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "text")))).alias("files"))


def split_container(df: DataFrame, text: str) -> DataFrame:
    """Files of a text in which each starts after a ``====`` banner that names it; absolute and upward paths are dropped."""
    part = F.explode(F.split(text, r"(?m)^={4,}\n(?=FILE: )", -1)).alias("part_")
    out = df.select(*[c for c in df.columns if c != text], part)
    out = out.filter(F.col("part_").startswith("FILE: "))
    out = out.withColumn("path", F.trim(F.regexp_extract("part_", r"^FILE: ([^\n]*)", 1))).withColumn("text", F.regexp_replace("part_", r"^FILE: [^\n]*\n(?:={4,}\n)?", ""))
    return out.filter(~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")).drop("part_")


def eval_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of result files, one JSON document each with a header and ``results``; ``arm`` from the file name, second passes left out."""
    fields = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema(EVAL_RESULT).fields)
    docs = spark.read.schema(schema(f"results array<struct<{fields}>>")).option("multiLine", "true").json(pattern).select("results", F.col("_metadata.file_name").alias("file"))
    named = docs.filter(~F.col("file").contains("_p2_")).withColumn("arm", F.regexp_extract("file", r"^[^_]+_(.*)\.json$", 1))
    return named.select("file", "arm", F.explode("results").alias("r")).select("file", "arm", "r.*")


def discover(files: DataFrame, manifest: str, pattern: str) -> DataFrame:
    """(project, entry): names that a pattern finds in each project's manifest file."""
    return files.filter(F.col("path") == manifest).select("project", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("entry"))


def pages_of(n: int, size: int, most: int | None = None) -> list[tuple[int, int]]:
    """(offset, length) of each request that reads n rows."""
    ends = range(0, n if most is None else min(n, most), size)
    return [(i, min(size, (n if most is None else min(n, most)) - i)) for i in ends]


def month_windows(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(start, end) dates of each month from first to last."""
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("start"))
    return months.select("start", F.last_day("start").alias("end"))
