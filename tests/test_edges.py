"""Rows on which queries once differed from their SQL."""

import math
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tessella.functions import python_text as P
from tessella.operators import stats


def same(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(driver.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in driver.queries()[name](spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)), name


def test_miners_at_the_caps_and_with_large_ids(spark, tmp_path):
    rows = [(i, "x" * n) for i, n in enumerate(range(13_920, 13_936))] + [(50 + i, "y" * 13_914 + "z" * i) for i in range(20)]
    rows += [(d + s, "a b " * (d - 197)) for d in range(200, 206) for s in (0, 1_000_000, 2_000_000)]
    docs = [(i + 100, t, "en", "a", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("aux04_questions_only", "mine_strict_lane", "mine_relaxed_lane"):
        same(spark, name, str(tmp_path), ["documents"])


def test_changed_lines_of_repeated_lines(spark, tmp_path):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["the a", "b", "c", "b the", ""]) for _ in range(n)) for n in (0, 1, 5, 30, 300, 450)]
    docs = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, "edit15_changed_lines_sql", str(tmp_path), ["documents"])
    assert any(P.changed_lines(t, t.replace("the", "teh")) != P.least_changed_lines(t, t.replace("the", "teh")) for t in texts)
    assert P.least_changed_lines("a\nb\nc", "b\nc\nd\ne") == 3 and P.least_changed_lines("", "x") == 1 and P.least_changed_lines("x", "") == 1


def test_entities_that_are_cut_off(spark, tmp_path):
    pages = [(1, "h", "<p>a &amp; b &lt;i&gt; &copy;&middot;&quot;</p>x &amp"), (2, "h", "a &am"), (3, "h", "&ampx; &amp;lt; &copy 1 &gt"), (4, "h", "&amp;amp;")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same(spark, "str07_html", str(tmp_path), ["pages"])
    assert P.unescape_closed("&#65;&#x42;&eacute;&notit;&nbsp;") == "AB\u00e9&notit;\u00a0"


def test_mcnemar_of_many_pairs(spark):
    for x, y in ((0, 0), (0, 3), (1, 1), (3, 9), (40, 61), (100_000, 100_900)):
        pairs = spark.range(x + y).select((F.col("id") < x).alias("a"), (F.col("id") >= x).alias("b"))
        n, k = x + y, min(x, y)
        want = sum(math.comb(n, i) for i in range(k + 1)) / 2**n if n < 1000 else math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
        got = stats.mcnemar(pairs).first()
        assert (got.n, got.a_only, got.b_only) == (n, x, y) and abs(got.p - (min(1, 2 * want) if n else 1)) < (1e-12 if n < 1000 else 1e-7)


def test_similar_agreement_carries_its_words_within_rows(spark):
    """The words of a text leave it as hashes of its prefix; before, every word was shuffled as text, several times."""
    from tessella.operators import selection

    words = [f"w{i}" for i in range(60)]
    near, far = [*words[:58], "x", "y"], [*words[:40], *[f"v{i}" for i in range(20)]]
    rows = [(3, "a", words), (4, "a", near), (5, "a", far), (6, "b", near), (7, "b", ["w0", "w0", "w1"]), (8, "b", ["w0", "w1", "w1"]), (9, "c", far), (10, "c", far)]
    df = spark.createDataFrame([(i, k, " ".join(w)) for i, k, w in rows] + [(11, "c", None), (12, "c", " ")], "id long, k string, text string")
    out = selection.similar_agreement(df, "id", ["k"], "text", 0.9)
    assert {r.id: r.agreed for r in out.collect()} == {3: True, 4: True, 5: False, 6: False, 7: False, 8: False, 9: True, 10: True, 11: False, 12: False}


def test_miners_shuffle_texts_by_their_question_only(spark, small, monkeypatch):
    """Plans are made once, builds are found by keys; before, texts were shuffled for both and plans were made for every use of them."""
    from tessella.plans import miners

    plans, kept = [], miners.kept
    of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(miners, "kept", lambda df: plans.append(of(df)) or kept(df))
    last = of(driver.queries()["mine_relaxed_lane"](spark, small))
    made, build = plans
    assert "ArrowEvalPython" in made and "ArrowEvalPython" not in build and "ArrowEvalPython" not in last
    aggregate = build[build.index("Aggregate"):].splitlines()[0]
    assert "key" in aggregate and "text" not in aggregate and "main.tex" not in aggregate
