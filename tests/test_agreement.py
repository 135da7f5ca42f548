import random

from pyspark.sql import functions as F

from tessella.functions import python_text as P
from tessella.operators import closure, selection
from tessella.sources import folders


def dice(a, b):
    from collections import Counter

    x, y = Counter(a.split()), Counter(b.split())
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if sum(x.values()) and sum(y.values()) else 0.0


def test_agreement_within_a_large_group(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 2 else f"g{i % 7}", rng.randrange(150)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, x long").repartition(4)
    got = selection.agreement(df, "k", lambda a, b: F.abs(a["x"] - b["x"]) <= 1)
    want = {i: any(k == l and i != j and abs(x - y) <= 1 for j, l, y in rows) for i, k, x in rows}
    assert {r.id: r.agreed for r in got.collect()} == want and "collect_list" not in got._jdf.queryExecution().toString()


def test_similar_agreement_equals_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 40))) for _ in range(12)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("abcxyz")
        rng.shuffle(w) if i % 5 == 0 else None
        rows.append((i, f"d{i % 2}", i % 3 or None, " ".join(w)))
    rows += [(500, "d0", 1, None), (501, "d0", 1, ""), (502, "d0", 1, "")]
    df = spark.createDataFrame(rows, "id long, doc string, pages int, text string").repartition(3)
    for t in (0.7, 0.985):
        for confirm, of in ((None, dice), (lambda a, b: P.words_similarity_udf(a, b), lambda a, b: min(dice(a, b), P.words_similarity(a, b) or 0))):
            got = selection.similar_agreement(df, "id", ["doc", "pages"], "text", t, confirm)
            want = {r[0]: any(r[0] != q[0] and r[1:3] == q[1:3] and (sorted(r[3].split()) == sorted(q[3].split()) != [] or of(r[3], q[3]) >= t) for q in rows if r[3] and q[3]) for r in rows}
            assert {r.id: r.agreed for r in got.collect()} == want, t


def test_a_long_chain_is_followed(spark):
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(60)], "project int, src string, dst string")
    roots = spark.createDataFrame([(1, "n0")], "project int, root string")
    assert closure.closure(edges, roots, ["project"]).count() == 61


def test_pairs_are_written_once_and_compared_in_place(spark, monkeypatch):
    rng = random.Random(5)
    links = {(g, rng.randrange(30), rng.randrange(30)) for g in range(3) for _ in range(45)}
    starts = {(g, rng.randrange(30)) for g in range(4) for _ in range(12)}
    want = set()
    for g, r in starts:
        todo = [r]
        while todo:
            x = todo.pop()
            if (g, r, x) not in want:
                want.add((g, r, x))
                todo += [d for k, s, d in links if (k, s) == (g, x)]
    calls, plans, kept, add = [], [], closure.kept, closure.Rounds.add
    monkeypatch.setattr(closure, "kept", lambda df: calls.append(1) or kept(df))
    monkeypatch.setattr(closure.Rounds, "add", lambda self, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or add(self, rows))
    got = closure.closure(spark.createDataFrame(sorted(links), "g long, src long, dst long"), spark.createDataFrame(sorted(starts), "g long, root long"), ["g"])
    rows = [(r.g, r.root, r.node) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert len(calls) == 1 and len(plans) > 3  # what is seen is not written again, nor shuffled:
    # On the right of the comparison, the last lines of its plan, the table is sorted in its buckets.
    assert all("LeftAnti" in p and "Exchange" not in p[p.rindex("Sort ["):] for p in plans[1:])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rounds_")]


def test_scratch_folders_are_shared_and_removed(spark):
    with folders.scratch(spark) as path:
        assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
        spark.range(3).write.parquet(path)
        held = closure.kept(spark.read.parquet(path))
    assert held.count() == 3
    from tessella.sources.readers import existing

    assert existing(spark, [path]) == []


def test_like_texts_are_not_met_pair_by_pair(spark, monkeypatch):
    """Texts are held against the nearest that sketches find, and against others only if that one is not like them."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:59], f"x{i}"]) for i in range(200)]  # every two are alike
    texts += [" ".join([*[f"v{j}" for j in range(50)], *[f"y{i}_{j}" for j in range(10)]]) for i in range(60)]  # no two are
    df = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "id long, k string, text string").repartition(3)
    made, near = [], selection.near_sketches
    monkeypatch.setattr(selection, "near_sketches", lambda *a: made.append(closure.kept(near(*a))) or made[-1])
    got = {r.id: r.agreed for r in selection.similar_agreement(df, "id", ["k"], "text", 0.9).collect()}
    assert got == {i: i < 200 for i in range(260)} and sum(m.count() for m in made) <= 2 * 260


def test_sketches_lose_no_pair(spark, monkeypatch):
    from tessella.operators import joins

    rng, t = random.Random(11), 0.8
    sets = [set(rng.sample(range(1 << 40), rng.choice([1, 2, 5, 30, 200]))) for _ in range(25)]
    sets += [set(rng.sample(sorted(s), len(s) - rng.randrange(1 + len(s) // 6))) | {rng.randrange(1 << 40)} for s in sets for _ in range(3)]
    band_of, bits_of = joins.bands(t)
    import numpy as np

    rows = []
    for i, s in enumerate(sets):
        items, band = np.array(sorted(s), np.int64), band_of(len(s))
        rows.append((i, bytearray(b"k"), len(s), band, bytearray(joins.sketch(items, bits_of(band))), bytearray(joins.sketch(items, bits_of(band + 1)))))
    monkeypatch.setattr(joins, "ROWS_A_CELL", 7)
    df = spark.createDataFrame(rows, "id long, block binary, size int, band int, own binary, next binary")
    like = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])}
    got = [frozenset(r) for r in joins.near_sketches(df, t, df.select("id")).collect()]
    assert like and like <= set(got) and len(got) == len(set(got))
