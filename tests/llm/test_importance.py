import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

from fixtures import ROWS, documents
from pyspark.sql import functions as F

from tessella.llm.importance import op13_importance, op13_rows, ranked, resample


def features(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return len(w), [crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def by_force(docs, target):
    """(doc_id, n_features, weight, score, rank) of each document."""
    made = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    ranks = {id(r): i for i, r in enumerate(drawn[: 5 * len(drawn) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def agree(spark, docs, target):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("x"), "rank": F.lit(0), "weight": F.lit(1)}).repartition(3)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = op13_rows(d, t).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, by_force(docs, target)))
    return got


def test_importance_equals_brute_force(spark):
    rng = random.Random(6)
    letters = [*"abcdefgh", "ÄÖ", "日本語", "The", "OF", "it's", "x-1", "😀"]
    docs = [(i, " ".join(rng.choice(letters[: 4 + i % 12]) for _ in range(rng.randrange(0, 90)))) for i in rng.sample(range(1000), 240)]
    docs += [docs[0], docs[0], (2000, None), (2001, ""), (2002, "w " * 30000), (None, "no id " * 30)]
    target = [" ".join(rng.choice(letters[:6]) for _ in range(30)) for _ in range(9)] + [None, "", "one"]
    got = agree(spark, docs, target)
    assert sum(r["rank"] is not None for r in got) > 5
    agree(spark, [r[:2] for r in ROWS], target)
    agree(spark, docs[:50], [])
    assert op13_rows(documents(spark, []), documents(spark)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("id"), (F.col("id") % 2).alias("score")).repartition(7)
    got = ranked(rows, [F.desc("score"), F.asc("id")], among=F.col("id") >= 100, keep=lambda n: n // 2).collect()
    want = sorted((-r.score, r.id) for r in got if r.id >= 100)[:1450]
    assert [(-r.score, r.id) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1451))


def test_texts_like_the_target_are_drawn(spark):
    like, other = [f"alpha beta gamma delta w{i % 5} " * 6 for i in range(200)], [f"one two three four v{i % 5} " * 6 for i in range(1800)]
    docs = spark.createDataFrame(list(enumerate(like + other)), "doc_id long, text string")
    got = resample(docs, spark.createDataFrame([("alpha beta gamma delta " * 5,)], "text string")).filter("rank is not null").collect()
    assert len(got) == 100 and sum(r.id < 200 for r in got) > 95


def test_query_equals_brute_force(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    want = by_force([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in items.collect()])
    assert sorted(map(str, map(tuple, op13_importance(spark, small).collect()))) == sorted(map(str, want))
