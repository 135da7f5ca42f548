import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import running, stats


def looped(rows):
    """Kept orders of (order, tested, counted), one after another."""
    n, out = {}, set()
    for at, tested, counted in sorted(rows):
        if all(n.get(k, 0) < most for k, most in tested or []):
            out.add(at)
            for k in set(counted or []):
                n[k] = n.get(k, 0) + 1
    return out


@pytest.mark.parametrize("chunk,block", [(20_000, 50_000), (5, 40)])
def test_caps_that_act_on_one_another_equal_a_loop(spark, chunk, block):
    rng = random.Random(chunk)
    keys = [f"k{i}" for i in range(6)] + ["all"]
    cases = {
        "mixed": [(i * 3, [(k, rng.randrange(0, 25)) for k in rng.sample(keys, rng.randrange(0, 3))], rng.sample(keys, rng.randrange(0, 4))) for i in rng.sample(range(300), 200)],
        # Each row is kept only if the one before it is not: a chain of decisions.
        "chain": [(i, [(f"c{i}", 1)], [f"c{i + 1}"]) for i in range(60)],
        "odd": [(1, None, None), (2, [("a", 0)], ["a"]), (3, [("a", 1), ("a", 2)], ["a", "a"]), (4, [("a", 1)], None), (5, None, ["a"])],
        "none": [],
    }
    for name, rows in cases.items():
        if name in ("odd", "none") and chunk == 5:
            continue
        df = spark.createDataFrame(rows, "at long, tested array<struct<key:string,most:long>>, counted array<string>").repartition(3)
        got = running.within_caps(df, "at", F.col("tested"), F.col("counted"), chunk=chunk, rows_a_block=block).collect()
        assert len(got) == len(rows) and {r["at"] for r in got if r.kept} == looped(rows), name


def test_a_draw_stops_at_its_target_or_its_tries(spark):
    df = spark.range(2000).withColumn("x", F.col("id") % 5)
    order = [r.id for r in df.orderBy(F.conv(F.left(running.drawn("id", 3), F.lit(13)), 16, 10).cast("long"), "id").collect()]
    for target, tries, good in ((40, 30, F.col("x") == 1), (40, 2, F.col("x") == 1), (5000, 30, F.col("x") == 1), (10, 30, F.lit(None).cast("boolean")), (0, 30, F.lit(True))):
        got = running.draw_until(df, "id", good, target, tries=tries, seed=3, rows_a_block=100).orderBy("tried").collect()
        n, want = 0, []
        for i in order:
            if n >= target or len(want) >= target * tries:
                break
            want.append(i)
            n += i % 5 == 1 and good is not None and "NULL" not in str(good)
        assert [r.id for r in got] == want and [r.tried for r in got] == list(range(1, len(want) + 1))
        assert sum(r.accepted for r in got) == n


def test_percentiles_by_narrowing_equal_a_sort(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else None if i % 2 else "b", rng.choice([rng.randrange(50), rng.randrange(10**9), -(i**2)])) for i in range(4000)] + [("c", 7)] * 50 + [("d", None)]
    df = spark.createDataFrame(rows, "k string, x long").repartition(5)
    groups = {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    ranks = {f"p{p}": (lambda n, p=p: F.least(F.floor(n * F.lit(p / 100)), n - 1)) for p in (0, 1, 50, 90, 100)}
    want = {k: [sorted(v)[min(len(v) * p // 100, len(v) - 1)] for p in (0, 1, 50, 90, 100)] for k, v in groups.items()}
    for most in (100_000, 300, 3):
        got = stats._at_ranks(df, ["k"], "x", ranks, most=most).collect()
        assert {r.k: list(r)[1:] for r in got} == want, most
    whole = stats._at_ranks(df, [], "x", ranks, most=50).collect()
    every = sorted(x for v in groups.values() for x in v)
    assert [list(r) for r in whole] == [[every[min(len(every) * p // 100, len(every) - 1)] for p in (0, 1, 50, 90, 100)]]


def test_what_a_task_orders_follows_rows_and_nulls_rank_last(spark, monkeypatch):
    from tessella.operators import selection
    from tessella.plans import reports

    monkeypatch.setattr(selection.dealt, "__defaults__", (100,))
    rows = spark.range(3000).select((F.col("id") % 500).alias("g"), F.when(F.col("id") >= 500, F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2 == 0).alias("strict"))
    ranked = selection.scaled_rank(rows, ["g"], "v", F.lit(True))
    assert ranked.rdd.getNumPartitions() == 30 and selection.islands(rows.select("g", F.col("v").alias("a"), F.col("v").alias("b")), ["g"], "a", "b").rdd.getNumPartitions() == 30
    got = {r.scaled for r in ranked.filter("v is null").collect()}
    assert got == {1.0} and ranked.agg(F.min("scaled"), F.max("scaled"), F.count("*")).first() == (0.0, 1.0, 3000)
    plan = reports.group_rewards(rows, "g", "v", F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
