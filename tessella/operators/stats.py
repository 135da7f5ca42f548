"""Counts, rates, percentiles, tests and costs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .closure import kept


def histogram(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts, most common first, ties by value."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), F.asc_nulls_first(column)).limit(top)


def funnel(df: DataFrame, stages: list[str], column: str = "stage") -> DataFrame:
    """Counts of the stages that occur, with their place in the given order."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col(column))
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("place", F.when(place > 0, place).otherwise(len(stages) + 1))


def element_histogram(df: DataFrame, items: Column) -> DataFrame:
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def bucket(x: Column, edges: list[int]) -> Column:
    """A label of the range that holds a number: ``<2``, ``2-4``, ``5-19``, ``>=20`` for edges 2, 5, 20."""
    out = F.lit(f">={edges[-1]}")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when(x < high, f"{low}-{high - 1}").otherwise(out)
    return F.when(x < edges[0], f"<{edges[0]}").otherwise(out)


def percentiles(df: DataFrame, keys: list[str], x: str, shares: list[float]) -> DataFrame:
    """The sorted values' elements at ``int(n * share)`` of whole groups: no interpolation, the upper median at 0.5."""
    return _at_ranks(df, keys, x, {f"p{round(s * 100)}": lambda n, s=s: F.least(F.floor(n * F.lit(s)), n - 1) for s in shares})


def rounded_percentiles(df: DataFrame, keys: list[str], x: str, percents: list[float]) -> DataFrame:
    """The values at the ranks rounded half to even, of whole groups without gathering them."""
    return _at_ranks(df, keys, x, {f"p{round(p)}": lambda n, p=p: F.least(n - 1, F.bround((n - 1) * F.lit(p / 100), 0)) for p in percents})


def _at_ranks(df: DataFrame, keys: list[str], x: str, ranks: dict, *, most: int = 100_000) -> DataFrame:
    """The values at ranks (from 0) that follow from a group's size: counts of distinct values, then a running count over those.

    A group of more than ``most`` distinct values is first narrowed to the ranges that hold the ranks, again and again. Where there is
    none, one window by group does.
    """
    counts = df.filter(F.col(x).isNotNull()).groupBy(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], F.col(x).alias("x_")).agg(F.count("*").alias("c_"))
    by = [f"k{i}_" for i in range(len(keys))]
    if (counts.groupBy(*by).agg(F.count("*").alias("d_")).agg(F.max("d_")).first()[0] or 0) <= most:
        run = counts.withColumns({"upto_": F.sum("c_").over(W.partitionBy(*by).orderBy("x_").rowsBetween(W.unboundedPreceding, 0)), "n_": F.sum("c_").over(W.partitionBy(*by))})
        found = run.groupBy(*by).agg(*[F.min(F.when(F.col("upto_") > rank(F.col("n_")), F.col("x_"))).alias(name) for name, rank in ranks.items()])
        return found.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *ranks)
    counts = kept(counts)
    sizes = kept(counts.groupBy(*by).agg(F.sum("c_").alias("n_"), F.count("*").alias("d_")))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name_"), rank(F.col("n_")).cast("long").alias("rank_")) for name, rank in ranks.items()]))
    asked = sizes.select(*by, "d_", wanted.alias("w")).select(*by, "d_", "w.*")
    found, rows, group = [], counts, by
    while True:
        small = asked.filter(F.col("d_") <= most)
        found.append(_ranked(rows, small, group).select(*by, "name_", "x_"))
        asked = asked.filter(F.col("d_") > most)
        if asked.isEmpty():
            break
        rows, asked = _narrowed(rows, asked, group)
        group = [*by, "name_"]
    values = reduce(DataFrame.unionByName, found)
    out = values.groupBy(*by).agg(*[F.max(F.when(F.col("name_") == name, F.col("x_"))).alias(name) for name in ranks])
    return out.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *ranks)


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on ``by``, where nulls are equal; the columns of ``b`` that are not in ``by`` are added."""
    b = b.select(*[F.col(c).alias(f"{c}r") for c in by], *[c for c in b.columns if c not in by])
    on = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"{c}r")) for c in by], F.lit(True))
    return a.join(b, on).drop(*[f"{c}r" for c in by])


def _ranked(rows: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """(by, name_, x_): the value at each asked rank, by a running count over a group's distinct values."""
    held = _same(rows, asked.select(*by).distinct(), by)
    run = held.withColumn("upto_", F.sum("c_").over(W.partitionBy(*by).orderBy("x_").rowsBetween(W.unboundedPreceding, 0)))
    asked = asked if "name_" not in by else asked.select(*by, "rank_")
    return _same(run, asked, by).filter(F.col("upto_") > F.col("rank_")).groupBy(*dict.fromkeys([*by, "name_"])).agg(F.min("x_").alias("x_"))


def _narrowed(rows: DataFrame, asked: DataFrame, by: list[str], parts: int = 256) -> tuple[DataFrame, DataFrame]:
    """The rows of the ranges that hold the asked ranks, keyed by the rank's name, and the ranks within them. Ranges are cut at
    ``parts`` approximate quantiles of a group's distinct values, whose rows are then counted, so ranks stay exact."""
    groups = kept(asked.select(*by).distinct())
    cuts = kept(_same(rows, groups, by).groupBy(*by).agg(F.percentile_approx("x_", [i / parts for i in range(1, parts)], 50 * parts).alias("cuts_")))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(parts.bit_length()))])
    bin_ = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get("cuts_", at + s - 1) <= F.col("x_"), s).otherwise(0))
    binned = _same(rows, cuts, by).withColumn("bin_", bin_).drop("cuts_")
    sums = binned.groupBy(*by, "bin_").agg(F.sum("c_").alias("s_"), F.count("*").alias("d_"))
    before = F.coalesce(F.sum("s_").over(W.partitionBy(*by).orderBy("bin_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # ``parts`` rows a group
    met = _same(asked.drop("d_"), sums.withColumn("before_", before), by)
    chosen = met.filter((F.col("before_") <= F.col("rank_")) & (F.col("rank_") < F.col("before_") + F.col("s_")))
    chosen = kept(chosen.withColumn("rank_", F.col("rank_") - F.col("before_")).drop("s_", "before_"))
    narrow = _same(binned, chosen.select(*dict.fromkeys([*by, "bin_", "name_"])), [*by, "bin_"]).drop("bin_")
    return kept(narrow), chosen.drop("bin_")


def agreed(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(n, n_agreed): rows, and those whose two columns are equal as they are given."""
    return df.agg(F.count("*").alias("n"), F.count_if(a == b).alias("n_agreed"))


def error_prefix(x: Column, n: int = 25) -> Column:
    """What two error messages are held against each other by: up to the first quote, ``n`` characters."""
    return F.left(F.substring_index(x, "'", 1), F.lit(n))


def any_and_all(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Per group, whether any and whether every row has a flag; a missing flag is false."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return df.groupBy(*keys).agg(F.bool_or(f).alias(f"any_{flag}"), F.bool_and(f).alias(f"all_{flag}"))


def rates(df: DataFrame, keys: list[str], *flags: str) -> DataFrame:
    """Per group: rows, and of each flag how many and what share; a missing flag is false."""
    of = lambda f: F.coalesce(F.col(f), F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[a for f in flags for a in (F.count_if(of(f)).alias(f"n_{f}"), F.avg(of(f).cast("double")).alias(f"rate_{f}"))])


def held_out_table(df: DataFrame, arm: str = "arm") -> DataFrame:
    """Per arm, in percent of all its rows: compiles, few deletions, intact, strict, near; the mean similarity, where an answer that
    does not compile counts 0 and one that compiles without a reference does not count; mean tokens."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    pct = lambda c: F.avg(yes(c).cast("double")) * 100
    ok = yes(F.col("compiled"))
    sim = F.when(~ok, 0.0).otherwise(F.col("sim"))
    return df.groupBy(arm).agg(
        F.count("*").alias("n"),
        pct(ok).alias("compiles"),
        pct(ok & (F.col("deleted") <= 40)).alias("few_deleted"),
        pct(ok & (F.col("deleted") <= 40) & (F.col("lost") == 0)).alias("intact"),
        pct(F.col("strict")).alias("strict"),
        pct(ok & (F.col("sim") >= 0.95)).alias("near"),
        F.avg(sim).alias("mean_sim"),
        F.avg("out_tokens").alias("mean_tokens"),
    )


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(n, a_only, b_only, p): the exact two-sided test over ``pairs(a, b)``; p is 1 without discordant pairs. The driver holds the two
    counts only.

    The tail is summed from its largest term down, each term by its ratio to the one before, so the work grows with the count. The
    largest is e to the power of the deviance and Stirling's errors, which do not cancel for large counts."""
    r = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("a") & ~F.col("b")).alias("a"), F.count_if(F.col("b") & ~F.col("a")).alias("b"))
    m, k = F.col("a") + F.col("b"), F.least("a", "b")
    d = (m - 2 * k) / m
    deviance = -k * F.log1p(-d) - (m - k) * F.log1p(d)
    largest = F.when(k == 0, F.exp(-m * math.log(2))).otherwise(F.exp(deviance + 0.5 * F.ln(m / (2 * math.pi * k * (m - k))) + _stirling_error(m) - _stirling_error(k) - _stirling_error(m - k)))
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s, j):
        i = k - j + 1  # from term i to term i - 1
        term = s["term"] * i / (m - i + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    total = largest * F.aggregate(steps, state, add)["total"]
    return r.select("n", F.col("a").alias("a_only"), F.col("b").alias("b_only"), F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total)).alias("p"))


def _stirling_error(m):
    """ln m! less Stirling's (m + 1/2) ln m - m + ln(2 pi) / 2, for m of at least 1."""
    x = m.cast("double")
    short = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi)) for i in range(1, 16)])
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(m < 16, F.get(short, (m - 1).cast("int"))).otherwise(series)


def rank_checkpoints(df: DataFrame, key: str, kind: str, good: str, main: list[str], gate: str, least: float = 70.4) -> DataFrame:
    """Checkpoints by the pooled rate over the main sets; ``passes``: the rate on the gate set reaches its floor."""
    yes = F.coalesce(F.col(good), F.lit(False)).cast("double")
    return df.groupBy(key).agg(F.avg(F.when(F.col(kind).isin(*main), yes)).alias("pooled"), (F.avg(F.when(F.col(kind) == gate, yes)) * 100).alias("gate")).withColumn("passes", F.coalesce(F.col("gate") >= least, F.lit(False)))


def cost_per_thousand(in_chars: Column, out_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Mean price of a thousand calls, prices a million tokens, four characters an input token."""
    return F.avg(in_chars / 4 * price_in + out_tokens * price_out) / 1e6 * 1000


def fleet_cost(fixes_per_hour: Column, gpus: int = 8, price: float = 0.001261) -> Column:
    return F.lit(gpus * price * 3600 * 1000) / fixes_per_hour


def multiset_loss(before: DataFrame, after: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per group, how many items of ``before`` are missing from ``after``, as multisets."""
    b = before.groupBy(*keys, item).agg(F.count("*").alias("b_"))
    a = after.groupBy(*keys, item).agg(F.count("*").alias("a_"))
    return b.join(a, [*keys, item], "left").groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("b_") - F.coalesce("a_", F.lit(0)))).alias("lost"))


def collapse(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key with the number of rows."""
    return df.groupBy(*[F.col(k).alias(f"k_{k}") for k in keys]).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("r"), F.count("*").alias("n_rows")).select("r.*", "n_rows")
