"""Reports as tables: DataFrames in, Markdown out. Only finished aggregates reach the driver, up to a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import selection, stats


def markdown(df: DataFrame, limit: int = 200) -> str:
    rows = df.limit(limit).collect()
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def mining_report(log: DataFrame, kept: DataFrame, stages: list[str]) -> dict[str, DataFrame]:
    """The funnel of stages, and histograms of what was kept: error, tag, year, size of the fix."""
    return {
        "funnel": stats.funnel(log, stages).orderBy("place"),
        "errors": stats.histogram(kept, "error_category", 15),
        "tags": stats.element_histogram(kept, F.col("tags")).orderBy(F.desc("n"), "item").limit(15),
        "years": kept.groupBy(F.left("created", F.lit(4)).alias("year")).agg(F.count("*").alias("n")).orderBy("year"),
        "diff_lines": kept.groupBy(stats.bucket(F.col("diff_lines"), [2, 5, 20]).alias("lines")).agg(F.count("*").alias("n")),
    }


def family(signature: Column, missing_file: Column) -> Column:
    """The family of a first error."""
    return F.when(F.coalesce(missing_file, F.lit("")) != "", "missing-pkg").when(signature.contains("unicode"), "encoding").when(signature.contains("graphic"), "graphics").otherwise("other")


def family_rates(results: DataFrame, *flags: str) -> DataFrame:
    return stats.rates(results.withColumn("family", family(F.col("signature"), F.col("missing_file"))), ["family"], *flags)


def arms(results: DataFrame, drops: DataFrame) -> DataFrame:
    """The held-out table over all arms, best first, audited drops left out."""
    return stats.held_out_table(results.join(drops.select("id"), "id", "left_anti")).orderBy(F.desc("compiles"), "arm")


def latency(results: DataFrame, keys: list[str]) -> DataFrame:
    return stats.percentiles(results, keys, "wall_s", [0.5, 0.9])


def lanes(rows: DataFrame, lane: str, dimensions: list[str]) -> DataFrame:
    """(lane, dimension, value, n): the counts of every table of every lane's report, from one pass over the rows. A missing value of a
    dimension is counted as null."""
    sets = [[F.col(lane), F.col(d)] for d in dimensions]
    grouped = rows.groupingSets(sets, lane, *dimensions).agg(F.count("*").alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dimensions])
    pick = lambda of: F.coalesce(*[F.when(F.col(f"g_{d}") == 0, of(d)) for d in dimensions])
    return grouped.select(F.col(lane).alias("lane"), pick(F.lit).alias("dimension"), pick(lambda d: F.col(d).cast("string")).alias("value"), "n")


def chart_points(results: DataFrame, prices: DataFrame) -> DataFrame:
    """Per arm: accuracy, upper-median latency and cost a thousand fixes; prices(arm, price_in, price_out)."""
    cost = stats.cost_per_thousand(F.col("prompt_chars"), F.col("out_tokens"), F.col("price_in"), F.col("price_out"))
    joined = results.join(prices, "arm")
    per = joined.groupBy("arm").agg((F.avg(F.coalesce("compiled", F.lit(False)).cast("double")) * 100).alias("accuracy"), cost.alias("cost"))
    return per.join(latency(results, ["arm"]).select("arm", F.col("p50").alias("latency")), "arm", "left")


def group_rewards(df: DataFrame, group: str, size: str, ok: Column) -> DataFrame:
    """Rewards within a prompt's group by how small the edit is among those that work; ``queue``: no answer of the group is strict."""
    from pyspark.sql import Window as W

    ranked = selection.scaled_rank(df, [group], size, ok, "rank_")
    return ranked.withColumn("size_reward", F.when(ok, 1 - F.col("rank_")).otherwise(0.0)).withColumn("queue", ~F.coalesce(F.bool_or("strict").over(W.partitionBy(group)), F.lit(False))).drop("rank_")


def on_policy(samples: DataFrame, key: str = "id", least: float = 0.95) -> DataFrame:
    """The sample to learn from: near enough to the reference, the nearest, then the shortest."""
    return selection.best_row(samples.filter(F.col("sim") >= least), [key], -F.col("sim"), F.length("response"))


def verifier_rows(cands: DataFrame, key: str, most: int) -> DataFrame:
    """Labelled rows for a verifier, as many right as wrong of each prompt at most, one of each text."""
    from tessella.operators.splits import balanced

    unique = selection.first_wins(cands, [key, "text"], "i").withColumn("label", F.when(F.col("sim") >= 0.95, "yes").otherwise("no"))
    return balanced(unique.withColumn("pick_", F.concat_ws(":", F.col(key).cast("string"), F.col("i").cast("string"))), key, F.col("label") == "yes", "pick_", most).drop("pick_")
