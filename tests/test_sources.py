import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessella.operators import history
from tessella.sources import cache_table, paged, row_groups


def test_retries_are_bounded_and_pauses_grow():
    pauses, calls = [], []

    def failing(n, error=OSError):
        def call():
            calls.append(1)
            if len(calls) <= n:
                raise error("no")
            return "yes"

        calls.clear(), pauses.clear()
        return call

    assert paged.retried(failing(2), tries=3, pause=1, sleep=pauses.append) == "yes" and pauses == [1, 2]
    with pytest.raises(OSError):
        paged.retried(failing(3), tries=3, sleep=pauses.append)
    with pytest.raises(KeyError):
        paged.retried(failing(1, KeyError), tries=3, sleep=pauses.append)
    assert len(calls) == 1


def test_pages_end_at_the_first_short_one(spark):
    size, lengths = 10, {"a": [10, 10, 4, 10], "b": [10] * 5, "c": [], "d": [3], "e": [10, 0, 10]}

    def fetch(query, page, page_size):
        n = lengths[query][page - 1] if page <= len(lengths[query]) else 0
        return [{"item": f"{query}{page}{i}"} for i in range(n)]

    want = {"a": 24, "b": 50, "d": 3, "e": 10}
    for run in (1, 2, 5):
        made = paged.source(f"pages{run}", "item string, extra int", paged.flaky(fetch, 2), paged.page_runs(list(lengths), 5, run), page_size=size, pause=0.001)
        got = paged.ended(paged.read(spark, made), size).groupBy("query").count().collect()
        assert {r["query"]: r["count"] for r in got} == want
    tired = paged.source("tired", "item string", paged.flaky(fetch, 9), paged.page_runs(["d"], 1, 1), page_size=size, pause=0.001)
    with pytest.raises(Exception, match="failure"):
        paged.read(spark, tired).count()


def test_recorded_pages_and_offsets(spark, tmp_path):
    items = spark.range(95).select(F.col("id").alias("item"), (F.col("id") % 2).cast("string").alias("query"))
    items.filter("query = '0'").withColumn("page", (F.col("item") / 20).cast("int") + 1).write.partitionBy("query", "page").json(str(tmp_path / "p"))
    made = paged.source("recorded", "item long", paged.recorded_pages(str(tmp_path / "p")), paged.page_runs(["0", "1"], 10, 3), page_size=10)
    assert sorted(r["item"] for r in paged.ended(paged.read(spark, made), 10).collect()) == list(range(0, 95, 2))
    items.withColumn("offset", F.floor(F.col("item") / 25) * 25).write.partitionBy("offset").json(str(tmp_path / "o"))
    made = paged.source("offsets", "item long", paged.recorded_offsets(str(tmp_path / "o")), paged.offset_runs(95, 25))
    assert sorted(r["item"] for r in paged.read(spark, made).collect()) == list(range(95))
    assert [(p.offset, p.length) for p in paged.offset_runs(95, 25, 50)] == [(50, 25), (75, 20)]


def test_row_groups_are_pruned_and_drawn(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for shard in range(2):
        ids = list(range(shard * 100, shard * 100 + 100))
        pq.write_table(pa.table({"id": ids, "text": [f"t{i}" for i in ids], "other": ids}), tmp_path / f"s{shard}.parquet", row_group_size=10)
    folder = str(tmp_path)
    assert len(row_groups.planned(folder, {})) == 20
    assert [(g.shard, g.row_group) for g in row_groups.planned(folder, {"id": [(">=", 38), ("<", 51)]})] == [(0, 3), (0, 4), (0, 5)]
    assert [(g.shard, g.row_group) for g in row_groups.planned(folder, {"id": [("=", 131)]}, {(1, 3), (0, 1)})] == [(1, 3)]
    assert len(row_groups.planned(folder, {"id": [("=", "x")], "none": [("=", 1)]})) == 20
    rows = row_groups.read(spark, folder, "text string, row_group int, id long, shard int")
    assert rows.count() == 200 and {(r.shard, r.row_group, r.id // 10 % 10) for r in rows.collect()} == {(s, g, g) for s in range(2) for g in range(10)}
    assert sorted(r.id for r in row_groups.read(spark, folder, "id long", only=[(1, 0), (0, 9)]).collect()) == list(range(90, 110))
    chosen = row_groups.drawn(spark, folder, 7)
    assert len(set(chosen)) == 7 and row_groups.read(spark, folder, "id long", only=chosen).count() == 70
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = row_groups.read(spark, folder, "id long, text string").filter("id >= 38 and id < 51")
        assert some.rdd.getNumPartitions() == 3 and some.count() == 13
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_cache_that_two_runs_fill(spark, tmp_path):
    folder, ddl = str(tmp_path / "cache"), "k long, v string"
    sizes = str(tmp_path / "sizes")

    def look_up(keys):
        with open(sizes, "a") as f:
            f.write(f"{len(keys)}\n")
        return [{"k": k, "v": f"v{k}"} for k in keys if k % 10]

    wanted = [spark.range(a, b).withColumnRenamed("id", "k") for a, b in ((0, 230), (150, 400), (300, 310))]
    assert cache_table.read(spark, folder, "k", ddl).count() == 0
    threads = [threading.Thread(target=cache_table.fill, args=(spark, folder, w, "k", ddl, look_up), kwargs={"batch": 30}) for w in wanted]
    [t.start() for t in threads], [t.join() for t in threads]
    got = {r.k: r.v for r in cache_table.read(spark, folder, "k", ddl).collect()}
    assert got == {k: f"v{k}" if k % 10 else None for k in range(400)}
    assert cache_table.versions(spark, folder) == [1, 2, 3]
    assert max(map(int, open(sizes).read().split())) <= 30
    assert cache_table.fill(spark, folder, wanted[0], "k", ddl, look_up) == 0
    assert cache_table.fill(spark, folder, spark.createDataFrame([(None,), (900,), (900,)], "k long"), "k", ddl, look_up) == 1


def test_logs_are_split_into_commits(spark, tmp_path):
    text = "\x1ea1\x1fb2\x1ffix the build\n\nM\ta.tex\nM\tb c.sty\n\x1eb2\x1fc3 d4\x1fmerge\n\x1ec3\x1f\x1ffirst\n\nA\ta.tex\n\x1ed4\x1fc3\x1fFix it\n\nM\ta.tex\nD\tb.tex\n"
    (tmp_path / "r1.log").write_text(text)
    got = {r.sha: r for r in history.log_records(spark, str(tmp_path / "r1.log")).collect()}
    assert {k: (r.parents, r.subject, [tuple(c) for c in r.changes]) for k, r in got.items()} == {
        "a1": (["b2"], "fix the build", [("M", "a.tex"), ("M", "b c.sty")]), "b2": (["c3", "d4"], "merge", []), "c3": ([], "first", [("A", "a.tex")]), "d4": (["c3"], "Fix it", [("M", "a.tex"), ("D", "b.tex")]),
    }
    assert [(r.sha, r.changed) for r in history.small_fixes(history.log_records(spark, str(tmp_path / "r1.log")), "fix", (".tex", ".sty")).collect()] == [("a1", ["a.tex", "b c.sty"])]


def test_ahead_equals_brute_force(spark):
    rng = random.Random(2)
    commits, forks, want = [], [], set()
    for r in range(12):
        parents = {}
        for i in range(rng.randrange(1, 40)):
            parents[i] = rng.sample(range(max(0, i - 6), i), min(i, rng.choice([1, 1, 1, 2, 3]))) if i else []
        generation = {}
        for i in parents:
            generation[i] = 1 + max((generation[p] for p in parents[i]), default=0)
        commits += [(f"r{r}", f"{r}-{i}", [f"{r}-{p}" for p in ps], generation[i]) for i, ps in parents.items()]

        def reach(tip):
            out, todo = set(), [tip]
            while todo:
                x = todo.pop()
                if x not in out:
                    out.add(x)
                    todo += parents[x]
            return out

        for f in range(4):
            a, b = rng.randrange(len(parents)), rng.randrange(len(parents))
            forks.append((f"f{r}.{f}", f"r{r}", f"{r}-{a}", f"{r}-{b}"))
            want |= {(f"f{r}.{f}", f"{r}-{x}") for x in reach(a) - reach(b)}
    forks += [("odd", "r0", None, "0-0"), ("gone", "r0", "0-0", "nowhere")]
    want |= {("gone", "0-0")}
    got = history.ahead(spark.createDataFrame(commits, "repo string, sha string, parents array<string>, generation int"), spark.createDataFrame(forks, "fork string, repo string, tip string, source string"))
    assert {tuple(r) for r in got.collect()} == want


def test_a_round_of_ahead_writes_its_front_only(spark, monkeypatch):
    commits = [(f"r{r}", f"{r}-{i}", [f"{r}-{i - 1}"] if i else [], i) for r in range(40) for i in range(12)]
    forks = [(f"f{r}", f"r{r}", f"{r}-11", f"{r}-{8 - r % 3}") for r in range(40)]
    rows, kept = [], history.kept

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(history, "kept", counted)
    got = history.ahead(spark.createDataFrame(commits, "repo string, sha string, parents array<string>, generation int"), spark.createDataFrame(forks, "fork string, repo string, tip string, source string"))
    assert {tuple(r) for r in got.collect()} == {(f"f{r}", f"{r}-{i}") for r in range(40) for i in range(9 - r % 3, 12)}
    assert max(rows) <= 80 and rows[-1] < 80  # a mark of either tip for each fork, until it is done
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rounds_")]


def test_hosts_are_searched_whatever_their_names_in_few_tasks(spark, tmp_path):
    from tessella.plans import catalog

    urls = [f"http://h:80/{i}" for i in range(41)] + ["https://a b%3A/1", "http://h/1", "no host", "http:///x"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.QUERIES["src09_paged_search"](spark, str(tmp_path))
    assert sorted((r.query, r.item) for r in got.collect()) == sorted([("h:80", i) for i in range(41)] + [("a b%3A", 41), ("h", 42)])


def test_offset_reads_are_dealt_by_files(spark, tmp_path):
    from tessella.plans import catalog

    spark.range(0, 240_000, 2).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.QUERIES["src08_offsets"](spark, str(tmp_path))
    assert got.agg(F.count("*"), F.min("place"), F.max("place"), F.count_if(F.col("o_orderkey") != F.col("place") * 2)).first() == (120_000, 0, 119_999, 0)
    assert got.rdd.getNumPartitions() <= 3


def test_row_groups_are_written_by_ranges_of_bounded_rows(spark, tmp_path, monkeypatch):
    from tessella.operators import selection
    from tessella.plans import catalog

    shards, planned = [], row_groups.planned
    monkeypatch.setattr(selection, "ROWS_A_TASK", 500)
    monkeypatch.setattr(row_groups, "planned", lambda folder, *a: shards.append(len(row_groups._files(folder)[1])) or planned(folder, *a))
    lines = spark.range(5000).select(F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").cast("double").alias("l_quantity"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["src07_row_groups"](spark, str(tmp_path))
    assert sorted(r.l_orderkey for r in got.collect()) == list(range(1000, 3001)) and shards[0] == 10
