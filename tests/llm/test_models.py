import math
import re

import numpy as np
import pytest
from fixtures import ROWS, documents, texts
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import mixing, pii, quality
from tessella.llm.ann import op10_ann, search

# --- personal data


def strict(t):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = {}
    for kind, p in patterns.items():
        out[kind] = []
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            odd = [int(c) for c in d[::-1]]
            luhn = sum(c if i % 2 == 0 else sum(divmod(2 * c, 10)) for i, c in enumerate(odd)) % 10 == 0
            if {"email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) <= 255, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out[kind].append((m.start(), m.end()))
    return out


def test_base_spans_against_patterns(spark):
    odd = ["a@b.c@d.e", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.1", "4111-1111 1111 1111 9", "12 4111111111111111", "+1", "+12 3", "+1 (555) 555-1234-", "😀a@b.de", "1." * 5000, "a" * 20000, "+1" + " " * 9000, "٣٤.1.1.1"]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts() + odd)]
    got = {r.doc_id: r for r in pii.detect(documents(spark, rows)).collect()}
    for i, t, *_ in rows:
        assert {k: [(s.start, s.end) for s in got[i][k]] for k in pii.BASE} == strict(t), t
    assert pii.detect(documents(spark, [])).count() == 0


def test_trees_add_secrets_and_leave_clean_text(spark):
    rng = np.random.default_rng(4)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f'some text here token = "{key()}" and more', "en", "a", 0) for i in range(60)] + [(100 + i, f"version {i}.0 of {i + 1990}, pages {i}", "en", "a", 0) for i in range(60)]
    got = {r.doc_id: r.added for r in pii.detect(documents(spark, rows)).collect()}
    assert all([(a.kind, a.end - a.start) for a in got[i]] == [("secret", 40)] for i in range(60))
    assert not any(got[100 + i] for i in range(60))


def test_a_long_secret_is_found_whole(spark):
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    secret = "".join(np.random.default_rng(9).choice(letters, 2000))
    docs = spark.createDataFrame([(f'key = 1, secret="{secret}" and more',), (f"secret={secret}==",)], "text string").withColumn("none", F.array().cast("array<struct<start:int,end:int>>"))
    got = [[(c.start, c.end, c.y) for c in r.c] for r in docs.select(pii.candidates("text", "none", "none").alias("c")).collect()]
    assert got == [[(17, 2017, 1)], [(7, 2009, 1)]]


def test_cued_secrets_of_any_form_are_found_among_look_alikes(spark):
    rng = np.random.default_rng(8)
    value = lambda: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 32))
    cued = ["token: {}", "secret = {}", "password: {}", "api_key={}", "x?a=1&token={}&b=2", 'export ACCESS_KEY="{}"']
    alike = ["bearer {}", "pwd=x {}", "key: {}", "see {} there"]
    rows = [(i, f"see {cued[i % 6].format(value())} ok", "en", "a", 0) for i in range(60)] + [(1000 + i, alike[i % 4].format(value()), "en", "a", 0) for i in range(600)]
    rows += [(2000 + i, f"version {i}.0 of {i + 1990}, pages {i}", "en", "a", 0) for i in range(30)]
    got = {r.doc_id: r.added for r in pii.detect(documents(spark, rows)).collect()}
    for i, text, *_ in rows[:60]:
        assert [text[a.start : a.end] for a in got[i]] == [re.search("[A-Za-z0-9]{32}", text)[0]], text
    assert not any(got[i] for i, *_ in rows if i >= 1000)


@pytest.mark.parametrize("steps", [1, 3, 31])
def test_running_totals_double_as_often_as_they_must(spark, monkeypatch, steps):
    """The module's doublings are as many as an array can have; fewer give other sums beyond 2 ** steps elements."""
    assert 1 << pii.STEPS > (1 << 31) - 1
    monkeypatch.setattr(pii, "STEPS", steps)
    for n in (0, 1, 2, 7, 8, 9, 1000):
        got = spark.range(1).select(F.expr(pii.running(f"transform(sequence(0, {n}), (x, i) -> int(i + 1))", "p + x"))).first()[0]
        want = [i * (i + 1) // 2 for i in range(1, n + 2)]
        assert (got == want) == (n + 1 <= 1 << steps)


def test_secrets_of_a_small_table_and_failed_cards(spark, small):
    for folder in (small, small.replace("0.001", "0.01")):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        texts_ = {r.doc_id: r.text or "" for r in docs.collect()}
        hits = planted = 0
        for r in pii.op2_rows(docs).collect():
            spans = {tuple(x.split(":")) for x in r.spans.split(",") if x}
            for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', texts_[r.doc_id]):
                planted += 1
                hits += ("secret", str(m.start(1)), str(m.end(1))) in spans
            for kind, a, b in spans:
                number = re.sub("[^0-9]", "", texts_[r.doc_id][int(a) : int(b)])
                assert kind != "number" or not 13 <= len(number) <= 19
        assert hits >= 0.9 * planted, (folder, hits, planted)


def test_spans_are_sorted_by_kind_and_start(spark):
    text = 'mail: me@localhost and a.b@c.example.org, secret = "0123456789abcdef0123456789abcdef01234567", mail: you@localhost, card 4111 1111 1111 1112'
    rows = [(i, text, "en", "a", 0) for i in range(40)]
    r = pii.op2_rows(documents(spark, rows)).first()
    spans = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(","))]
    assert spans == sorted(spans) and (0, 23, 40) in spans and len(spans) == r.n_spans == r.n_email + r.n_added
    assert r.n_card == 0 and not any(k == 4 for k, *_ in spans)
    assert [k for k, *_ in spans].count(5) == 1
    assert [f.dataType.simpleString() for f in pii.op2_rows(documents(spark)).schema.fields[:7]] == ["bigint"] * 5 + ["string"] * 2


def test_many_matches_in_one_text(spark):
    text = " ".join(f"{i}.1.1.1" for i in range(256)) * 40
    r = pii.op2_rows(documents(spark, [(1, text, "en", "a", 0)])).first()
    want = strict(text)
    assert r.n_ip == len(want["ip"]) > 9000 and r.spans.split(",")[-1] == "ip:{}:{}".format(*want["ip"][-1])


def test_tree_expression_equals_its_trees(spark):
    rng = np.random.default_rng(0)
    data = [(tuple(int(rng.integers(0, n)) for n in pii.RANGES.values()), 10, int(rng.integers(0, 11))) for _ in range(60)]
    trees = pii.fit(data, rounds=5)
    frame = spark.createDataFrame([x for x, _, _ in data], ", ".join(f"{k} int" for k in pii.RANGES))
    got = frame.withColumn("f", F.struct(*pii.RANGES)).select(F.expr(pii.as_expression(trees, "f")).alias("s"), *pii.RANGES).collect()
    assert all(abs(r.s - pii.predict(trees, tuple(r)[1:])) < 1e-9 for r in got)


# --- mixing


def weighted(tokens, exponent):
    total = sum(tokens.values())
    raw = {s: (t / total) ** exponent for s, t in tokens.items() if t > 0}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def bisected(tokens, budget, target, epochs):
    """The exponent by plain bisection."""
    if sum(t > 0 for t in tokens.values()) < 2:
        return 1.0
    repeats = lambda a: max(x * budget / tokens[s] for s, x in weighted(tokens, a).items())
    good = lambda a: entropy(weighted(tokens, a)) >= target * math.log(sum(t > 0 for t in tokens.values()))
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    a = 1.0 if good(1.0) else lo
    if repeats(a) <= epochs:
        return a
    lo, hi = a, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if repeats(mid) <= epochs else (mid, hi)
    return hi


def test_exponent_meets_entropy_and_repetition(spark):
    have = {"a": 9000, "b": 900, "c": 100}
    sums = spark.createDataFrame([*have.items(), ("none", 0)], "s string, t long")
    a = mixing.solve_exponent(sums, 10_000, target_entropy=0.8, max_epochs=1e9)
    w = weighted(have, a)
    assert abs(entropy(w) - 0.8 * math.log(3)) < 1e-6 and abs(a - bisected(have, 10_000, 0.8, 1e9)) < 1e-8
    a = mixing.solve_exponent(sums, 10_000, target_entropy=1.0, max_epochs=2.0)
    assert max(x * 10_000 / have[s] for s, x in weighted(have, a).items()) <= 2.0 + 1e-9
    assert abs(a - bisected(have, 10_000, 1.0, 2.0)) < 1e-8
    assert mixing.solve_exponent(sums.filter("s = 'a'"), 5) == 1.0


def brute_mix(rows, budget, target, epochs):
    """The same plan by sorting each source on one machine; rows: (source, tokens, key, hash of block, order of blocks)."""
    have = {}
    for s, t, *_ in rows:
        have[s] = have.get(s, 0) + t
    w = weighted(have, bisected(have, budget, target, epochs))
    out = []
    for s in have:
        full, rest = divmod(int(w[s] * budget + 0.5), have[s])
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[4], r[3], r[2]))
        taken, at, blocks = [], 0, []
        for r in own:
            if r[3] not in blocks:
                blocks.append(r[3])
        order = {b: i + 1 for i, b in enumerate(blocks)}
        for b in blocks:
            block = [r for r in own if r[3] == b]
            size = sum(r[1] for r in block)
            if at >= rest:
                break
            if at + size <= rest:
                taken += block
            else:
                run = 0
                for r in block:
                    run += r[1]
                    if run > rest - at:
                        break
                    taken.append(r)
            at += size
        out += [(e, order[r[3]], r[2]) for e in range(full) for r in own] + [(full, order[r[3]], r[2]) for r in taken]
    return sorted(out)


def test_mix_against_brute_force(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", "big" if i % 10 else f"s{i % 3}", 0) for i in range(900)]
    docs = documents(spark, rows)
    n = docs.groupBy("source").count().withColumn("blocks", F.greatest(F.lit(1), F.floor(F.sqrt("count"))))
    src = F.concat(F.lit("="), F.col("source"))
    key = mixing.row_key(docs, mixing.SEED)
    block = F.pmod(F.xxhash64(F.lit(mixing.SEED + 1), "k", F.lit(0).cast("long")), F.col("blocks"))
    each = docs.withColumn("k", key).join(n, "source").select(src.alias("s"), mixing.token_count().alias("t"), "k", block.alias("b"), F.xxhash64(F.lit(mixing.SEED + 2), src, block).alias("o")).collect()
    for limit in (500_000, 0):
        got = mixing.mix(docs, target_entropy=0.9, max_epochs=3.0, budget=5000, broadcast_rows=limit)
        assert sorted((r.mix_epoch, r.mix_block, r.mix_place) for r in got.collect()) == brute_mix([tuple(r) for r in each], 5000, 0.9, 3.0)
        assert got.agg(F.sum("mix_tokens")).first()[0] <= 5000 + 4


def test_copies_are_mixed_like_other_rows(spark):
    rows = [(7, " ".join(["w"] * 50), "en", "a", 1)] * 200 + [(100 + i, " ".join(["v"] * 50), "en", "b", 1) for i in range(20)]
    docs = documents(spark, rows)
    have = {"a": 10_000, "b": 1000}
    for budget, limits in ((11_000, (500_000, 0)), (3000, (500_000,)), (60, (0,)), (1_000_000, (500_000,))):
        for limit in limits:
            got = mixing.mix(docs, budget=budget, broadcast_rows=limit).groupBy("source").agg(F.sum("mix_tokens").alias("t"), F.first("mix_weight").alias("w")).collect()
            got = {r.source: r.t for r in got}
            real = min(budget, 44_000)
            w = weighted(have, bisected(have, real, mixing.ENTROPY, mixing.MAX_EPOCHS))
            for s in have:
                quota = int(w[s] * real + 0.5)
                assert quota - 50 < got.get(s, 0) <= quota, (budget, s, got, quota)


def test_items_whose_hashes_clash_in_half_are_apart(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 3), "en", "a" if i % 2 else "b", i) for i in range(40)])
    for key in (F.struct(F.lit(1).alias("a"), F.xxhash64("doc_id").alias("b")), F.struct(F.xxhash64("doc_id").alias("a"), F.lit(1).alias("b")), F.floor(F.col("doc_id") / 2)):
        got = mixing.mix(docs, key=key, target_entropy=0.1, max_epochs=4.0).filter("mix_epoch = 0").collect()
        assert sorted(r.doc_id for r in got) == list(range(40))
    two = docs.select(mixing.row_key(docs, 1).alias("k")).distinct().collect()
    assert len({r.k.a for r in two} | {r.k.b for r in two}) == 80


def test_mix_edges(spark):
    clash = documents(spark)
    for name in ("rest", "full", "blocks", "stop", "mix_block", "mix_key", "times", "t", "n", "j", "c", "r", "last", "upto"):
        clash = clash.withColumn(name, F.lit("x"))
    got = mixing.mix(clash).collect()
    assert {r.rest for r in got} == {"x"} and {r.last for r in got} == {"x"}
    assert {r.source for r in got} <= {"a", "b", None}
    assert mixing.mix(documents(spark, [])).count() == 0
    blank = documents(spark, [(1, None, None, "a", None), (2, "", None, None, 0)])
    assert sorted(r.doc_id for r in mixing.mix(blank).collect()) == [1, 2]
    odd = documents(spark).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    assert mixing.mix(odd).count() == mixing.mix(odd).count() > 0
    assert mixing.mix(documents(spark), budget=0).count() == 0


def test_mix_of_the_given_documents(spark, small):
    out = mixing.op3_mixing(spark, small)
    assert out.dtypes == [("doc_id", "bigint"), ("source", "string"), ("epoch", "bigint"), ("block", "int"), ("place", "bigint"), ("n_tokens", "bigint"), ("weight", "double")]
    assert out.count() > 100


# --- quality


def test_quality_separates_held_out_rows(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = " ".join(word() for _ in range(60)) + "." if good else " ".join(word().upper() + "!!" for _ in range(60))
        rows.append((i, text, "en", "a", 0))
        labels.append((i, int(good)))
    marks = spark.createDataFrame(labels + [(7, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    stats = quality.with_statistics(documents(spark, rows)).select("doc_id", "stats")
    model = quality.train(stats, marks)
    got = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert all((s >= quality.CUT) == (i % 4 != 0) and 0 <= s <= 1 for i, s in got.items())
    odd = quality.score(quality.with_statistics(documents(spark)).select("doc_id", "stats"), model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    none = quality.train(stats, marks.limit(0))
    assert {r.score for r in quality.score(stats, none).collect()} == {0.5}
    assert quality.score(stats.limit(0), model).count() == 0


def test_quality_against_plain_ridge(spark, small):
    """The registered query's scores from its own statistics, the model refitted with numpy on one machine."""
    out = quality.op7_quality(spark, small)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = quality.with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats", quality.fold().alias("f")).collect()
    known = [r for r in rows if r.f and r.doc_id in marks]
    x, y, f = np.array([r.stats for r in known]), np.array([marks[r.doc_id] for r in known], float), np.array([r.f for r in known])
    model = quality.Model(x.mean(0), np.maximum(x.std(0), 1e-3), 3.0)
    z = model.features(x[f != 4])
    a = z.T @ z
    model.beta = np.linalg.solve(a + 1e-3 * a[-1, -1] * np.eye(len(a)), z.T @ y[f != 4])
    held = model.raw(x[f == 4])
    bins = {}
    for raw, label in zip(held, y[f == 4]):
        bins.setdefault(np.floor(np.clip(raw, -1, 2) * 400 + 0.5), []).append((raw, label))
    model.x, model.y = quality._isotonic([(np.mean([r for r, _ in v]), len(v), sum(b for _, b in v)) for _, v in sorted(bins.items())])
    want = dict(zip([r.doc_id for r in rows], model.score(np.array([r.stats for r in rows]))))
    for r in out.collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize("folds", [[4], [1, 2, 3]])
def test_quality_with_rows_of_one_kind_of_fold_only(spark, folds):
    docs = documents(spark, [(i, "good words in a row. " * 9 if i % 2 else "@@ ## 11 " * 9, "en", "a", 0) for i in range(300)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int").filter(quality.fold().isin(folds))
    model = quality.train(quality.with_statistics(docs).select("doc_id", "stats"), marks)
    got = quality.score(quality.with_statistics(docs), model).collect()
    assert min(r.score for r in got if r.doc_id % 2) > 0.7 > 0.3 > max(r.score for r in got if not r.doc_id % 2)


def test_isotonic_is_monotone():
    x, y = quality._isotonic([(0, 1, 0), (1, 1, 1), (2, 2, 0), (3, 1, 1)])
    assert list(y) == sorted(y) and abs(y[1] - 1 / 3) < 1e-12 and len(x) == 3


# --- nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    x[200:300] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [1.0] * 3), (2400, [None] + [1.0] * 15), (2500, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = search(frame, is_query=F.col("id") % 100 == 0).collect()
    found, hits = {}, []
    for r in sorted(got):
        found.setdefault(r.query_id, []).append(r)
    assert sorted(found) == list(range(0, 1500, 100))
    for q, rs in found.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(1500), far))[:10]
        hits.append(np.isin(best, [r.vec_id for r in rs]).mean())
        assert [r.rank for r in rs] == list(range(1, 11)) and all(abs(far[r.vec_id] - r.score) < 1e-12 for r in rs)
    assert np.mean(hits) >= 0.9
    assert [r.vec_id for r in found[200]] == list(range(201, 211))  # ties to the smaller id
    few = search(frame.filter("vec_id < 3"), is_query=F.col("id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert search(frame.limit(0)).count() == 0


def test_every_query_gets_its_neighbours(spark):
    rng = np.random.default_rng(8)
    tight = np.repeat(rng.normal(size=(60, 16)) * 10, 50, axis=0) + rng.normal(size=(3000, 16)) * 0.01
    v = np.concatenate([tight, rng.normal(size=(60, 16)) * 60])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5, v[5].tolist())] * 14  # a query with 15 rows of its own
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), is_query=(F.col("id") >= 3000) | (F.col("id") == 5)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {5, *range(3000, 3060)}
    assert all(len(x) == 10 and q not in x for q, x in by.items())
    assert max(by[5]) < 50


def brute_neighbours(ids, v, query, k=10):
    far = np.sqrt(((v - v[ids == query][0]) ** 2).sum(1))
    other = np.flatnonzero(ids != query)
    return [ids[j] for j in other[np.lexsort((ids[other], far[other]))][:k]]


def test_few_vectors_in_any_order(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(60, 2))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    results = []
    for order in (rows, rows[::-1], [rows[i] for i in rng.permutation(60)]):
        got = search(spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3), is_query=F.col("id") == 0).orderBy("rank").collect()
        results.append([(r.vec_id, r.score) for r in got])
    assert len(results[0]) == 10 and results[0] == results[1] == results[2]


def test_a_query_with_many_rows_of_its_own(spark):
    v = np.random.default_rng(13).normal(size=(60, 4))
    rows = [(0, v[0].tolist())] * 14 + [(i, x.tolist()) for i, x in enumerate(v)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), is_query=F.col("id") == 0).collect()
    assert len(got) == 10 and all(r.vec_id for r in got)


def test_an_id_that_repeats_is_dealt_in_blocks(spark):
    v = np.random.default_rng(17).normal(size=(90, 4))
    rows = [(1, v[1].tolist())] * 500 + [(2, v[i % 30].tolist()) for i in range(300)] + [(i, x.tolist()) for i, x in enumerate(v) if i > 2]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = search(frame, is_query=F.col("id").isin(1, 50), block=16).orderBy("query_id", "rank").collect()
    for q in (1, 50):
        far = np.sqrt(((x - v[q]) ** 2).sum(1))
        best = sorted((f, i) for f, i in zip(far, ids) if i != q)[:10]
        own = [r for r in got if r.query_id == q]
        assert len(own) == 10 and own[0].vec_id == best[0][1] and sum(r.score <= best[-1][0] + 1e-9 for r in own) >= 7
    assert sum(r.vec_id == 2 for r in got) > 2  # its equal rows are candidates each


def test_recall_on_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    out = op10_ann(spark, "/root/testdata/sf0.1")
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    for r in out.collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in frame.collect() if r.embedding and any(r.embedding)]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    hits = [np.isin(brute_neighbours(ids, v, q), x).mean() for q, x in got.items()]
    assert all(len(x) == 10 for x in got.values()) and np.mean(hits) >= 0.9


# --- pipeline


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, small)
        out = spark.createDataFrame(out.collect(), out.schema)
        if name != "encoding":
            assert out.columns == docs.columns
        if name == "near_copies":
            assert out.count() == out.select("doc_id").distinct().count()
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").filter("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1").collect()}
            ids = {r.doc_id for r in out.collect()}
            assert len(good - ids) <= 0.03 * len(good) and len(bad & ids) <= 0.3 * len(bad)
        kept = out
    assert kept.filter("n_tokens <> size(ids)").count() == 0 and kept.count() > 0
    odd = documents(spark).withColumn("stats", F.lit(1)).withColumn("score", F.lit(1)).withColumn("id", F.lit(1)).withColumn("ids", F.lit(1))
    assert corpus_pipeline.STAGES[0][1](spark, odd, small).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES[1:]:
        odd = stage(spark, odd, small)
    assert odd.count() > 0
