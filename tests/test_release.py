from pyspark.sql import functions as F

from tessella.functions import prompts as M
from tessella.functions import python_text as P
from tessella.operators import perturb
from tessella.plans import release, reports


def test_release(spark):
    rows = spark.createDataFrame([("a", 1, 2, "MIT", "/home/me/x", 1), ("b", 1, 2, None, "y", 2), ("c", 1, 2, "MIT", "z", 3)], "id string, question_id long, answer_id long, license string, prompt string, seed int")
    drops = spark.createDataFrame([("c",)], "id string")
    out = release.released(rows, drops, F.lit("zzz"), needs_license=True).collect()
    assert [(r.id, r.prompt) for r in out] == [("a", "~/x")] and "seed" not in out[0].asDict()
    posts = spark.createDataFrame([(1, 7, None, "2010-01-01", None), (2, None, "Bo", "2020-01-01", "X")], "id long, owner_user_id long, owner_display_name string, created string, content_license string")
    users = spark.createDataFrame([(7, "Al")], "id long, display_name string")
    a = release.attributed(rows, posts, users, "s").first().attribution
    assert (a.question.url, a.question.author, a.question.license) == ("s/q/1", "Al", "CC-BY-SA-2.5") and (a.answer.author, a.answer.license) == ("Bo", "X")
    found = release.check(rows.filter("id = 'a'"), rows.filter("id <> 'a'"), "question_id", "id")
    assert [tuple(r) for r in found["leaks"].collect()] == [("question_id", "1")]
    refs = spark.createDataFrame([("d1", "t"), ("d2", "t"), ("d3", "t")], "doc string, text string")
    docs, pool = spark.createDataFrame([("d1",), ("d2",)], "doc string"), spark.createDataFrame([("d2",)], "doc string")
    assert {r.doc: r.pseudo for r in release.released_references(refs, docs, pool).collect()} == {"d1": False, "d2": True}


def test_reports(spark):
    log = spark.createDataFrame([("kept",), ("kept",), ("pool",)], "stage string")
    kept = spark.createDataFrame([("e", ["t", "u"], "2020-01-01", 3), ("e", ["t"], "2021-01-01", 30)], "error_category string, tags array<string>, created string, diff_lines int")
    r = reports.mining_report(log, kept, ["pool", "kept"])
    assert reports.markdown(r["funnel"]) == "| stage | n | place |\n|---|---|---|\n| pool | 1 | 1 |\n| kept | 2 | 2 |"
    assert [tuple(x) for x in r["tags"].collect()] == [("t", 2), ("u", 1)]
    c = spark.createDataFrame([(1, 0, 5, True, True, 0.99, "aa"), (1, 1, 9, True, False, 0.97, "b"), (2, 0, 5, False, False, 0.1, "c")], "id int, i int, size int, ok boolean, strict boolean, sim double, text string")
    got = {(x.id, x.i): (x.size_reward, x.queue) for x in reports.group_rewards(c, "id", "size", F.col("ok")).collect()}
    assert got == {(1, 0): (1.0, False), (1, 1): (0.0, False), (2, 0): (0.0, True)}
    assert [x.i for x in reports.on_policy(c.withColumn("response", F.col("text"))).collect()] == [0]
    assert {(x.id, x.label) for x in reports.verifier_rows(c, "id", 1).collect()} == {(1, "yes"), (2, "no")}


def test_examples_and_companions(spark):
    doc = "\\documentclass{a}\n\\begin{document}\nText \\textbf{x} $ab$ y\n\\end{document}\n"
    made = perturb.examples(perturb.perturbed(spark.createDataFrame([(1, doc)], "id int, text string"), "text", ["drop_dollar"]), "id", "text").first()
    assert P._applied(made.broken, [(e.replace, e.search) for e in made.break_edits]) == doc and made.target.startswith("<edit>")
    texts = F.create_map(*[F.lit(x) for x in ("main.tex", "\\usepackage{my}\\input{a}", "a.tex", "A", "my.sty", "S", "r.bib", "B")])
    errors = F.array(F.struct(F.lit(1).alias("line"), F.lit("Citation x").alias("text"), F.lit("a.tex").alias("file"), F.lit("a.tex").alias("fileLabel")))
    got = spark.range(1).select(M.wanted_companions(F.lit("main.tex"), F.lit("main.tex"), errors, F.lit("(./my.sty)"), texts).alias("w"), texts.alias("t")).select("w", M.companions(F.map_keys("t"), F.col("w"), F.col("t")).alias("c")).first()
    assert got.w[:2] == ["a.tex", "my.sty"] and "r.bib" in got.w and "`r.bib`" in got.c
