import collections

from fixtures import ROWS, documents
from pyspark.sql import functions as F

from tessella.llm.line_dedup import drop_boilerplate
from tessella.llm.url_filter import RULES, judge_urls, rules_frame


def brute_lines(rows, ratio, least):
    pages, seen = collections.Counter(), collections.Counter()
    for _, t, _, s, _ in rows:
        pages[s] += 1
        seen.update((s, x) for x in set((t or "").split("\n")) if x.strip(" "))
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad)) for d, t, _, s, _ in rows]


def test_lines_against_brute_force(spark):
    for broadcast in (500_000, 0):
        got = drop_boilerplate(documents(spark), max_ratio=0.3, min_pages=3, broadcast_lines=broadcast).collect()
        assert sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(map(str, brute_lines(ROWS, 0.3, 3)))
        assert {r.n_dropped for r in got} == {0, 1} and all(r.n_lines == 0 for r in got if r.text is None)


def test_lines_clashing_names_and_empty_table(spark):
    docs = documents(spark).withColumn("n", F.lit(1)).withColumn("line", F.lit("x")).withColumn("n_lines", F.lit("old"))
    got = drop_boilerplate(docs, max_ratio=0.3)
    assert got.count() == len(ROWS) and dict(got.dtypes)["n_lines"] == "bigint" and got.first().line == "x"
    assert drop_boilerplate(documents(spark, [])).count() == 0


URLS = [
    (1, "http://Example.COM/en/71?x"), (2, "https://example.com/en/8"), (3, "com/en/"), (4, None), (5, ""), (6, "x://a.net/de/8"),
    (7, "x://example.net/de/8/9#f"), (8, "x://notexample.net/de/8"), (9, "x://org"), (10, "x://b.org/es/" + "y" * 50_000), (10, "x://b.org/es/" + "y" * 50_000),
    (11, "x://a..com/en/"), (12, "x://com?/en/"), (13, "x://y://com/en/"), (None, "x://com/en/"),
]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls_against_brute_force(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("digest", F.lit("clash")).withColumn("host", F.lit("clash"))
    for most in (200_000, 0):
        got = judge_urls(pages, rules_frame(spark), broadcast_rules=most, broadcast_matches=most).collect()
        assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(map(str, [(i, *brute_url(u)) for i, u in URLS]))
    assert judge_urls(pages.limit(0), rules_frame(spark)).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules_frame(spark, []), default="block").collect()} == {"block"}


def test_hot_urls_and_many_shapes(spark):
    hot = [(i, "http://example.com/en/7") for i in range(300)] + [(1000 + i, None) for i in range(300)] + [(2000, "http://a.b.c.example.org/es/x")]
    pages = spark.createDataFrame(hot, "page_id long, url string")
    for most in (200_000, 0):
        got = judge_urls(pages, rules_frame(spark), broadcast_matches=most).collect()
        assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got])) == sorted(map(str, [(i, *brute_url(u)) for i, u in hot]))
    rules = [("block", ".".join(["x"] * k), "/" + "y" * n) for k in range(1, 9) for n in range(0, 700)]
    got = judge_urls(spark.createDataFrame([(1, "u://x.x.x/" + "y" * 40), (2, "u://z/")], "page_id long, url string"), rules_frame(spark, rules)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: ("x.x.x/" + "y" * 40, "block"), 2: (None, "allow")}


def test_rules_of_many_labels(spark):
    long = ".".join(["x"] * 300)
    rules = rules_frame(spark, [("block", long, "/"), ("allow", "x", "/")])
    pages = spark.createDataFrame([(1, f"u://a.{long}/p"), (2, "u://a.x/p"), (3, f"u://{long[2:]}/p")], "page_id long, url string")
    assert {r.page_id: r.rule for r in judge_urls(pages, rules).collect()} == {1: f"{long}/", 2: "x/", 3: "x/"}
