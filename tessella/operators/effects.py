"""Effects behind contracts: compiling, sampling, judging and fetching enter as recorded results, or through a local command."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.schemas import COMPILE_RESULT, schema


def project_hash(files: Column, root: Column) -> Column:
    """The key of a compile: SHA-256 of the root's name and the files in order of their paths."""
    entries = F.array_sort(F.map_entries(files))
    return F.sha2(F.concat(root, F.lit("\0"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\0"), F.sha2(e["value"], 256))), "\0")), 256)


class CompileBackend(Protocol):
    def compile(self, jobs: DataFrame) -> DataFrame:
        """``jobs(files, root, ...)`` with a column ``result`` of the compile result's shape; ``project_key``, if there, is the jobs' hash."""


class Recorded:
    """Results joined by content; what was never recorded counts as timed out."""

    def __init__(self, results: DataFrame):
        self.results = results

    def compile(self, jobs: DataFrame) -> DataFrame:
        names = [f.name for f in schema(COMPILE_RESULT).fields]
        have = self.results.select(F.col("key").alias("key_"), F.struct(*names).alias("result"))
        key = F.col("project_key") if "project_key" in jobs.columns else project_hash(F.col("files"), F.col("root"))
        out = jobs.withColumn("key_", key).join(have, "key_", "left").drop("key_")
        lost = F.struct(*[(F.lit(True) if n == "timed_out" else F.lit(False) if n == "ok" else F.lit(None)).cast(f.dataType).alias(n) for n, f in zip(names, schema(COMPILE_RESULT).fields)])
        return out.withColumn("result", F.coalesce("result", lost))


class Local:
    """A command on the executors, one folder a job, killed after a time limit. The command gets the root's name as last argument."""

    def __init__(self, command: list[str], timeout: int = 120):
        self.command, self.timeout = command, timeout

    def compile(self, jobs: DataFrame) -> DataFrame:
        command, timeout = self.command, self.timeout

        def run(files, root):
            import os
            import subprocess
            import tempfile
            import time

            from tessella.functions.logs import parse_log

            with tempfile.TemporaryDirectory() as folder:
                for name, text in dict(files).items():
                    path = os.path.normpath(os.path.join(folder, name))
                    if not path.startswith(folder + os.sep):
                        continue
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(path, "w", encoding="utf-8", errors="surrogatepass") as f:
                        f.write(text)
                began, late = time.monotonic(), False
                try:
                    done = subprocess.run([*command, root], cwd=folder, capture_output=True, timeout=timeout, errors="replace")
                    log, code = done.stdout + done.stderr, done.returncode
                except subprocess.TimeoutExpired:
                    log, code, late = "", 1, True
                items = parse_log(log, root)
                errors = [x for x in items if x["severity"] == "error"]
                return {"ok": code == 0 and not errors and not late, "log": log, "items": items, "error_items": errors, "seconds": time.monotonic() - began, "timed_out": late}

        made = F.udf(run, schema(COMPILE_RESULT), useArrow=True)
        return jobs.withColumn("result", made("files", "root"))


def with_samples(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows with what an arm answered: samples(id, response, wall_s, out_tokens, sample_error)."""
    return rows.join(samples.select("id", "response", "wall_s", "out_tokens", "sample_error"), "id", "left")


def with_verdicts(rows: DataFrame, verdicts: DataFrame, *keys: str) -> DataFrame:
    """Rows with a judge's recorded verdict; ``unclear`` where there is none."""
    return rows.join(verdicts.select(*keys, "verdict", "reason"), list(keys), "left").withColumn("verdict", F.coalesce("verdict", F.lit("unclear")))


def known_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """``known``: whether the installation has the file."""
    return names.join(known.select("name").distinct().withColumn("known", F.lit(True)), "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def pair_stage(parent: Column, child: Column, n_opened: Column, assets_there: Column, located: Column) -> Column:
    """Whether a commit's two sides make an example: the child compiles from at least two files, the parent fails with a located error."""
    return (
        F.when(child["timed_out"] | parent["timed_out"], "timeout")
        .when(~child["ok"], "child_fails")
        .when(n_opened < 2, "single_file")
        .when(~assets_there, "asset_missing")
        .when(parent["ok"], "parent_compiles")
        .when(~located, "no_located_error")
        .otherwise("kept")
    )


def baseline(results: DataFrame, most_seconds: float) -> DataFrame:
    """Clean documents that compile, fast enough to break."""
    return results.filter(F.col("result.ok") & (F.col("result.seconds") <= most_seconds))
