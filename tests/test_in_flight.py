import random

from pyspark.sql import functions as F

from tessella.streaming import in_flight, snapshots


def looped(events, limit, patience, most):
    """(task, at, what) of one worker's events, second by second."""
    flying, waiting, out, last = {}, [], [], max(e[2] for e in events)
    at = {}
    for task, start, t in sorted(events, key=lambda e: (e[2], e[0])):
        at.setdefault(t, []).append((task, start))
    for now in range(0, last + 5000):
        gone = [k for k, since in flying.items() if since + patience <= now]
        for k in gone:
            del flying[k]
        while waiting and len(flying) < limit:
            flying[waiting.pop(0)] = now
            out.append((list(flying)[-1], now, "sent"))
        for task, start in at.get(now, []):
            if start and len(flying) >= limit and len(waiting) >= most:
                out.append((task, now, "refused"))
                continue
            if start:
                waiting.append(task)
            else:
                flying.pop(task, None)
                waiting = [x for x in waiting if x != task]
            while waiting and len(flying) < limit:
                flying[waiting.pop(0)] = now
                out.append((list(flying)[-1], now, "sent"))
    return out


def test_requests_in_flight_are_bounded(spark, tmp_path):
    rng = random.Random(4)
    events, tasks = [], 0
    for w in range(5):
        for _ in range(40):
            tasks += 1
            t = rng.randrange(0, 400)
            events.append((f"w{w}", tasks, True, t))
            if rng.random() < 0.6:
                events.append((f"w{w}", tasks, False, t + rng.randrange(1, 60)))
    events.sort(key=lambda e: e[3])
    for i in range(0, len(events), 60):
        part = spark.createDataFrame(events[i : i + 60], "worker string, task long, start boolean, s long").select("worker", "task", "start", F.timestamp_seconds("s").alias("ts"))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:05d}"))
    stream = spark.readStream.schema("worker string, task long, start boolean, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = in_flight.bounded(stream, limit=2, patience=25, most_waiting=6)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.worker, r.task, r["at"] // 1_000_000, r.what) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for w in {e[0] for e in events}:
        own = [e[1:] for e in events if e[0] == w]
        want = {(w, *x) for x in looped(own, 2, 25, 6)}
        last = max(t for *_, t in own)
        mine = {x for x in got if x[0] == w}
        assert {x for x in want if x[2] <= last} <= mine <= want


def test_parts_of_a_stream_are_written_by_many_tasks(spark, small, monkeypatch):
    import glob

    from tessella.plans import catalog, collection

    folder, files, bounded = spark.conf.get("spark.checkpoint.dir"), [], in_flight.bounded
    want = {tuple(r) for r in catalog.QUERIES["strm04_in_flight"](spark, small).collect()}

    def looking(stream, **named):
        files.extend(f.split("/")[-2] for f in glob.glob(f"{folder}/scratch-*/in/*/*.parquet"))
        return bounded(stream, **named)

    monkeypatch.setattr(collection, "ROWS_A_FILE", 60)
    monkeypatch.setattr(in_flight, "bounded", looking)
    got = [tuple(r) for r in catalog.QUERIES["strm04_in_flight"](spark, small).collect()]
    assert set(got) == want and len(got) == len(want) > 900
    assert len({files.count(x) for x in files}) == 1 and files.count(files[0]) > 1  # as many files for each part


def test_snapshots_estimate_the_time_left(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "in"))
    counters = {"n": F.count("*"), "odd": F.count_if(F.col("id") % 2 == 1)}
    got = snapshots.run(spark, str(tmp_path / "in"), "id long", lambda df: df.filter("id % 2 = 1"), str(tmp_path / "out"), str(tmp_path / "log"), counters, target=80, progress="odd", files_per_batch=1).orderBy("batch").collect()
    assert len(got) == 4 and sum(r.counters["n"] for r in got) == 40 and got[-1].so_far == 20
    assert all(r.eta_seconds > 0 for r in got) and spark.read.parquet(str(tmp_path / "out")).count() == 20
