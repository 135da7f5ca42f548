import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.operators import closure, effects, evaluation, joins, mining, perturb, selection
from tessella.plans import catalog
from tessella.sources import readers, writers
from tessella.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    def norm(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 6)
        return str(v)

    order = sorted(columns)
    return sorted(json.dumps([norm(r[columns.index(c)]) for c in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, small, duck, name):
    got = catalog.QUERIES[name](spark, small)
    cur = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(cur.fetchall(), columns)


def test_text_similarity_over_long_texts(spark, small):
    from tessella.functions.python_text import text_similarity

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r.chars for r in catalog.QUERIES["sim02_text_similarity"](spark, small).collect()}
    assert got == {d: text_similarity(t, t and t.replace("the", "teh")) for d, t in texts.items()}
    assert any(t and len(t) > 3000 for t in texts.values())


def test_json_lines_and_schemas(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "score": 2}\n\n{"id": "2", "extra": 1}\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, score int")
    assert sorted(map(tuple, rows.collect())) == [("1", 2), ("2", None)]
    assert "seed" in schemas.conform(rows, schemas.EXAMPLE).columns
    clean = schemas.scrub(spark.createDataFrame([("/a/b/x", ["/a/b"])], "p string, q array<string>"), F.lit("/a/b"), ".", "x", "y").first()
    assert (clean.p, clean.q) == ("./y", ["."])


def test_reference_maps_and_overlay(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"d1": {"text": "a", "pages": 1, "img": ["AAE="]}, "d2": {"text": "b"}}))
    refs = readers.reference_map(spark, str(tmp_path / "r.json"))
    got = {r.doc: (r.text, r.pages, r.img) for r in refs.collect()}
    assert got["d1"] == ("a", 1, [bytearray(b"\x00\x01")]) and got["d2"] == ("b", None, None)
    newer = spark.createDataFrame([("d2", "new")], "doc string, text string")
    assert {r.doc: r.text for r in readers.overlay([refs, newer], "doc").collect()} == {"d1": "a", "d2": "new"}


def test_posts(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<posts>\n  <row Id="1" PostTypeId="1" Body="a &lt;b&gt; &amp;" Score="3" />\n  <row Id="2" PostTypeId="2" ParentId="1" />\n</posts>\n')
    rows = readers.post_rows(spark, str(tmp_path / "p.xml")).orderBy("Id").collect()
    assert [(r.Id, r.PostTypeId, r.Body, r.ParentId) for r in rows] == [(1, 1, "a <b> &", None), (2, 2, None, 1)]
    raw = readers.post_attributes(spark, str(tmp_path / "p.xml"), spark.createDataFrame([(1,)], "id long")).collect()
    assert [r.attributes["Body"] for r in raw] == ["a &lt;b&gt; &amp;"]


def test_projects_containers_results(spark, tmp_path):
    for name, text in {"p1/main.tex": "\\input{sub/a}", "p1/sub/a.tex": "\\input{main}\\input{sub/b} %\\input{c}", "p1/sub/b.tex": "x", "p1/main.aux": "no", "p2/main.tex": "y", "p2/other.tex": "\\input{main}"}.items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    files = readers.project_files(spark, str(tmp_path / "t"))
    assert {(r.project, r.path) for r in files.collect()} == {("p1", "main.tex"), ("p1", "sub/a.tex"), ("p1", "sub/b.tex"), ("p2", "main.tex"), ("p2", "other.tex")}
    edges = closure.inclusions(files)
    roots = files.filter("path in ('main.tex', 'other.tex')").select("project", F.col("path").alias("root"))
    reached = closure.closure(edges, roots, ["project"])
    assert {(r.project, r.root, r.node) for r in reached.collect()} == {("p1", "main.tex", "main.tex"), ("p1", "main.tex", "sub/a.tex"), ("p1", "main.tex", "sub/b.tex"), ("p2", "main.tex", "main.tex"), ("p2", "other.tex", "other.tex"), ("p2", "other.tex", "main.tex")}
    changed = spark.createDataFrame([("p2", "other.tex")], "project string, path string")
    assert {tuple(r) for r in closure.pick_root(reached, changed, ["project"]).collect()} == {("p1", "main.tex"), ("p2", "other.tex")}
    box = spark.createDataFrame([(1, "====\nFILE: a.tex\n====\nA\n====\nFILE: ../b\nB\n====\nFILE: /c\nC")], "id int, text string")
    assert [(r.path, r.text) for r in readers.split_container(box, "text").collect()] == [("a.tex", "A\n")]
    (tmp_path / "set_arm1.json").write_text(json.dumps({"n": 1, "results": [{"id": "x", "compiled": True}]}, indent=1))
    (tmp_path / "set_p2_arm1.json").write_text(json.dumps({"results": [{"id": "x"}]}))
    assert [(r.arm, r.id, r.compiled) for r in readers.eval_results(spark, str(tmp_path / "set_*.json")).collect()] == [("arm1", "x", True)]
    assert readers.pages_of(5, 2) == [(0, 2), (2, 2), (4, 1)] and readers.month_windows(spark, "2024-01-01", "2024-03-01").count() == 3


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "id string, v int")
    out = str(tmp_path / "t")
    assert writers.append_new(rows, out, "id").count() == 2
    writers.append_new(rows, out, "id")
    assert spark.read.parquet(out).count() == 2
    writers.routed(rows, str(tmp_path / "r"), F.when(F.col("v") > 1, "kept").otherwise("pool"))
    assert spark.read.parquet(str(tmp_path / "r")).filter("route = 'kept'").count() == 2
    writers.json_lines(rows, str(tmp_path / "j"), order="id")
    m = writers.manifest(spark, {"j": str(tmp_path / "j")}, {"j": rows}).first()
    assert m.rows == 3 and m.bytes > 0 and len(m.sha256) == 64
    files = spark.createDataFrame([("p", "a.tex"), ("p", "a.pdf"), ("p", "b.log"), ("p", "c.pdf")], "project string, path string")
    assert {r.path for r in writers.released_files(files).collect()} == {"a.tex", "c.pdf"}


ROOT = "main.tex"


def test_compile_and_score(spark):
    broken, fixed = {ROOT: "a \\bad b"}, {ROOT: "a good b"}
    block = "<edit>\n<<<<<<< SEARCH\n{}\n=======\n{}\n>>>>>>> REPLACE\n</edit>"
    rows = [("exact", block.format("\\bad", "good")), ("other", block.format("\\bad", "fine")), ("fails", block.format("\\bad", "\\worse")), ("none", "sorry"), ("same", block.format("a", "a")), ("lost", block.format("zzz", "x"))]
    df = spark.createDataFrame([(i, "d", ROOT, broken, fixed, r) for i, r in rows], "id string, doc string, root string, files map<string,string>, fixed map<string,string>, response string")
    refs = spark.createDataFrame([("d", "a good b", 1, None)], "doc string, text string, pages int, sim_min double")
    seen = spark.createDataFrame([({ROOT: "a fine b"}, True, "a fine b", 1), ({ROOT: "a \\worse b"}, False, None, None)], "files map<string,string>, ok boolean, pdf_text string, pdf_pages int")
    results = schemas.conform(seen, schemas.COMPILE_RESULT).withColumn("timed_out", F.lit(False))
    keyed = seen.withColumn("key", effects.project_hash(F.col("files"), F.lit(ROOT))).select("key", "ok", "pdf_text", "pdf_pages")
    full = schemas.conform(keyed, "key string, " + schemas.COMPILE_RESULT).withColumn("timed_out", F.lit(False))
    assert results.count() == 2
    got = {r.id: r for r in evaluation.score(df, refs, effects.Recorded(full)).collect()}
    assert got["exact"].exact and got["exact"].strict and got["exact"].sim == 1
    assert got["other"].compiled and not got["other"].strict and 0 < got["other"].sim < 1
    assert not got["fails"].compiled and got["none"].apply_error == "no edit blocks parsed" and not got["same"].compiled and got["lost"].apply_error == "SEARCH not found"
    second = spark.createDataFrame([("fails", True, True, 1.0, True, "x")], "id string, compiled boolean, strict boolean, sim double, applied boolean, response string")
    merged = {r.id: r for r in evaluation.with_retry(spark.createDataFrame([("fails", False, False, 0.0), ("other", True, False, 0.5)], "id string, compiled boolean, strict boolean, sim double"), second).collect()}
    assert merged["fails"].compiled and not merged["fails"].pass1 and merged["other"].sim == 0.5


def test_local_backend(spark):
    jobs = spark.createDataFrame([(1, ROOT, {ROOT: "exit 0\n"}), (2, ROOT, {ROOT: "echo '! Bad thing.'; echo 'l.3 x'; exit 1\n"}), (3, ROOT, {ROOT: "sleep 9\n"})], "id int, root string, files map<string,string>")
    got = {r.id: r.result for r in effects.Local(["sh"], 2).compile(jobs).collect()}
    assert got[1].ok and not got[2].ok and got[2].error_items[0].line == 3 and got[3].timed_out


def test_mining(spark):
    doc = "\\documentclass{a}\n\\begin{document}\n\\input{x}\n\\end{document}\n"
    posts = spark.createDataFrame([
        (1, 1, 2, 5, "2020-01-02T00", "t", "<a><b>", "fails<br>\n! Undefined control sequence.\nl.3 &lt;x&gt;", [doc, "short"]),
        (3, 1, None, 1, "2020-01-02T00", "t", "|c|d|", "nothing here", [doc]),
        (4, 2, None, 1, "2020-01-02T00", "t", None, "x", [doc]),
    ], "id long, post_type int, accepted_answer_id long, score int, created string, title string, tags string, body string, blocks array<string>")
    q = mining.questions(posts).collect()
    assert [(r.question_id, r.tags, r.created, r.error_message) for r in q] == [(1, ["a", "b"], "2020-01-02", "Undefined control sequence.")]
    r = posts.select(mining.needs_external(F.lit(doc)).alias("a"), mining.needs_external(F.lit("\\begin{filecontents}{x.tex}\n" + doc)).alias("b"), mining.block_kind(F.lit("@book{a")).alias("c"), mining.block_kind(F.lit("! error")).alias("d"), mining.tags(F.lit("|c|d|")).alias("e"), mining.bad_prompt(F.lit("a\ufffd")).alias("f")).first()
    assert tuple(r) == (True, False, "bib", None, ["c", "d"], True)
    stage = lambda *x: spark.range(1).select(mining.strict_stage(*[F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>") for v in x]).alias("s")).first().s
    assert stage(True, [], False, False, True, "m", "kept") == "external_files" and stage(False, [], False, False, True, "m", "kept") == "no_fix_candidate"
    assert stage(False, ["identical", "diff_too_big", "diff_too_big"], False, False, True, "m", "kept") == "diff_too_big" and stage(False, ["ok"], False, False, True, "x not found", "kept") == "local_file_missing"
    commits = spark.createDataFrame([("s1", "a.tex", "M", 3, 2), ("s1", "build/x", "A", 900, 0), ("s2", "a.tex", "A", 1, 1), ("s3", "a.tex", "M", 40, 1)], "sha string, path string, status string, added int, removed int")
    assert [r.sha for r in mining.commit_candidates(commits).collect()] == ["s1"]


def test_assignment_names_agreement(spark):
    needed = spark.createDataFrame([(1, "src", "a.tex", 0), (1, "src", "b.tex", 1), (2, "src", "x.tex", 0), (2, "src", "y.tex", 1)], "id int, family string, name string, pos int")
    blocks = spark.createDataFrame([(1, "src", "dir/b.tex", 0, "B"), (1, "src", None, 1, "A"), (2, "src", None, 0, "only")], "id int, family string, hint string, pos int, code string")
    assert {(r.id, r.name, r.code) for r in joins.assign_blocks(needed, blocks).collect()} == {(1, "b.tex", "B"), (1, "a.tex", "A")}
    names = spark.createDataFrame([(1, "a.tex"), (1, "c.tex")], "project int, name string")
    files = spark.createDataFrame([(1, "z/a.tex"), (1, "b/a.tex")], "project int, path string")
    assert {(r.name, r.path) for r in joins.resolve_names(names, files, "project").collect()} == {("a.tex", "b/a.tex"), ("c.tex", None)}
    c = spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("d", 3, "y")], "doc string, candidate int, text string")
    assert {r.candidate: r.agreed for r in selection.agreement(c, "doc", lambda a, b: a["text"] == b["text"]).collect()} == {1: True, 2: True, 3: False}


def test_perturbed_frame(spark):
    doc = "\\documentclass{a}\n\\begin{document}\nText \\textbf{x} $ab$ y\n\\end{document}\n"
    df = spark.createDataFrame([(1, doc), (2, None)], "id int, text string")
    got = perturb.perturbed(df, "text", ["typo_macro", "drop_dollar"], [0, 1]).collect()
    assert len(got) == 4 and {r.mutation for r in got} == {"typo_macro", "drop_dollar"} and all(doc.count(r.edit.search) == 1 for r in got)


def test_incremental(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.mode("append").parquet(src)
    work = lambda df: df.withColumn("w", F.upper("v"))
    schema = spark.read.parquet(src).schema
    incremental.process_available(spark, src, schema, "id", work, out, check)
    spark.createDataFrame([(2, "x"), (3, "c")], "id int, v string").write.mode("append").parquet(src)
    incremental.process_available(spark, src, schema, "id", work, out, check)
    assert sorted((r.id, r.w) for r in spark.read.parquet(out).collect()) == [(1, "A"), (2, "B"), (3, "C")]
    assert incremental.process_available(spark, src, schema, "id", work, out, check) == 0
    log = spark.createDataFrame([("a", "kept", 1), ("b", "worker_error", 1), ("b", "kept", 2), ("c", "worker_error", 1)], "key string, stage string, at int")
    cands = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    assert {r.key for r in incremental.todo(cands, log, "key").collect()} == {"d"} and {r.key for r in incremental.todo(cands, log, "key", ("worker_error",)).collect()} == {"c", "d"}
    assert {r.stage: r.n for r in incremental.stage_counts(log, "key").collect()} == {"kept": 2, "worker_error": 1}
    assert incremental.until(5, range(10), lambda b: 2) == 6
