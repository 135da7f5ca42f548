import hashlib
import re

from pyspark.sql import functions as F

from tessella.functions import edits as E
from tessella.functions import logs as L
from tessella.functions import prompts as M
from tessella.functions import rewards as R
from tessella.functions import text as X

TEXTS = ["", "a  b\t c\n", "  x % comment\n\\% kept % gone", "line\r\nnext\u2028third\x0bfourth", "ÄÖ\u00a0ß 日本", "😀 end ", "%only", "\n\n", "<think>why\nnot</think>  then <think>b</think>"]


def evaluate(spark, f, values=TEXTS):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text_against_python(spark):
    comment = re.compile(r"(?<!\\)%.*")
    cases = [
        (X.wskey, lambda t: " ".join(t.split())),
        (X.rstrip, str.rstrip),
        (X.indent_of, lambda t: re.match(r"^\s*", t).group()),
        (X.strip_comments, lambda t: comment.sub("", t)),
        (X.content_chars, lambda t: len(re.sub(r"\s+", "", comment.sub("", t)))),
        (X.splitlines, str.splitlines),
        (X.lines, lambda t: t.split("\n")),
        (X.newlines, lambda t: t.replace("\r\n", "\n").replace("\r", "\n")),
        (X.strip_thought, lambda t: re.sub(r"(?s)<think>.*?</think>\s*", "", t, count=1)),
        (X.slug, lambda t: re.sub(r"[^A-Za-z0-9_.-]", "_", t)),
        (X.line_count, lambda t: t.count("\n") + 1),
        (lambda c: X.literal_count(c, F.lit(" ")), lambda t: t.count(" ")),
        (lambda c: X.literal_count(c, F.lit("")), lambda t: t.count("")),
        (lambda c: X.replace_first(c, F.lit(" "), F.lit("_")), lambda t: t.replace(" ", "_", 1)),
        (lambda c: X.replace_first(c, F.lit(""), F.lit("_")), lambda t: t.replace("", "_", 1)),
        (lambda c: X.sha1_mod(c, 100), lambda t: int(hashlib.sha1(t.encode()).hexdigest(), 16) % 100),
        (lambda c: X.line_set(c), lambda t: list(dict.fromkeys(x.strip() for x in t.splitlines() if x.strip()))),
    ]
    for column, python in cases:
        assert evaluate(spark, column) == [python(t) for t in TEXTS], column


def test_errors_and_dates(spark):
    said = ["! Undefined control sequence \\foo{bar} 12", "main.tex:3: File `a.sty' not found", 'x "q" {y}']
    assert evaluate(spark, X.normalize_error, said) == ["Undefined control sequence \\CS{X} N", "File 'X' not found", "x 'X' {X}"]
    assert evaluate(spark, X.license_of, ["2010-01-01", "2011-04-08", "2018-05-02"]) == ["CC-BY-SA-2.5", "CC-BY-SA-3.0", "CC-BY-SA-4.0"]
    assert evaluate(spark, X.year_of_paper, ["9912.123", "math/9912345", "2101.00001", "hep/0101234", "none"]) == [1999, 1999, 2021, 2001, None]
    assert evaluate(spark, X.texlive_version, ["This is pdfTeX (TeX Live 2026)", "no"]) == ["TeX Live 2026", None]
    assert evaluate(spark, X.pick_engine, ["\\usepackage[x]{fontspec}", "\\directlua{}", "plain"]) == ["xelatex", "lualatex", "pdflatex"]
    n = F.lit(4)
    assert evaluate(spark, lambda c: X.judge_choice(c, n), ["Candidate 2 of 9", "so [3]", "either 1 or 4", "9", ""]) == [1, 2, 3, None, None]
    assert evaluate(spark, X.missing_file, ["! File `a.sty' not found.", "Could not open file b.tex, x", "no"]) == ["a.sty", "b.tex", None]
    assert evaluate(spark, lambda c: X.error_signature(c, F.lit("l.3 \\foo")), ["Undefined control sequence.", "LaTeX Error: `x' 12"]) == ["undefined control sequence. \\foo", "latex error: `<x>' <n>"]
    assert evaluate(spark, lambda c: X.swap_adjacent(c, F.lit(2)), ["abcd"]) == ["acbd"]


RESPONSE = E.BLOCK and "<edit>\n<<<<<<< SEARCH\nb\n=======\nB\n>>>>>>> REPLACE\n</edit>\n\n<edit>\n<<<<<<< SEARCH\nB c\n=======\n>>>>>>> REPLACE\n</edit>"


def test_edits(spark):
    one = spark.createDataFrame([("a b c d", RESPONSE), ("b b", RESPONSE), ("none", RESPONSE), ("x", "no blocks"), ("", "")], "doc string, r string")
    got = [tuple(r) for r in one.select(E.apply_edits(F.col("doc"), E.parse_any(F.col("r"))).alias("a")).select("a.*").collect()]
    assert got == [("a  d", None), ("b b", "SEARCH ambiguous (2 matches)"), ("none", "SEARCH not found"), ("x", "no edit blocks parsed"), ("", "no edit blocks parsed")]
    again = one.limit(1).select(E.parse_edits(E.format_edits(E.parse_edits(F.col("r")))).alias("x"), E.parse_edits(F.col("r")).alias("y"), E.deleted_chars(F.col("r")).alias("d"), E.edit_size(F.col("r")).alias("s"), E.diff_lines_of(E.parse_edits(F.col("r"))).alias("l")).first()
    assert again.x == again.y and (again.d, again.s, again.l) == (2, 4, 4)
    files = one.limit(1).select(F.create_map(F.lit("main.tex"), F.lit("q b"), F.lit("s.tex"), F.lit("q")).alias("f"))
    named = '<edit file="s.tex">\n<<<<<<< SEARCH\nq\n=======\nr\n>>>>>>> REPLACE\n</edit>' + RESPONSE[: RESPONSE.index("\n\n<edit>")]
    done = files.select(E.apply_file_edits(F.col("f"), E.parse_any(F.lit(named))).alias("a"), E.apply_file_edits(F.col("f"), E.parse_any(F.lit(named.replace("s.tex", "t.tex")))).alias("b")).first()
    assert done.a.files == {"main.tex": "q B", "s.tex": "r"} and done.a.error is None and done.b.error == "no such file"
    back = one.limit(1).select(E.round_trips(F.lit("a b c"), E.parse_edits(F.lit(RESPONSE[: RESPONSE.index("\n\n<edit>")]))).alias("ok"), E.break_text(F.lit("b b"), E.parse_edits(F.lit(RESPONSE))).alias("b"), E.structure_lost(F.lit("\\item a \\item % \\item\n\\section{x}"), F.lit("\\item")).alias("lost")).first()
    assert back.ok and back.b == "" + "B b" and back.lost == 2


def test_rewards(spark):
    r = spark.range(1)
    args = lambda *x: [F.lit(v) if v is not None else F.lit(None).cast("double") for v in x]
    value = lambda *x, **k: r.select(R.reward(*args(*x), **k).alias("v")).first().v
    assert value(False, False, False, 0, None, 0) == -0.2 and value(True, False, False, 0, None, 0) == 0
    assert value(True, True, True, 25, None, 0) == 1.5 and value(True, True, False, 150, None, 0) == 0
    assert value(True, True, True, 30, 0.9, 0, mode="gate") == 0 and value(True, True, True, 25, None, 0, mode="gate") == 1.5
    assert value(True, True, True, 41, 1.0, 0, mode="ke") == 1 and value(True, True, False, 0, 0.5, 0, mode="sim") == 1.25


LOG = """This is pdfTeX (TeX Live 2026)
(./main.tex
(./sections/intro.tex
! Undefined control sequence.
<recently read> \\foo
l.12 \\foo
         {x}
)
LaTeX Warning: Reference `a' undefined
 on input line 7.
Overfull \\hbox (1.0pt too wide) in paragraph at lines 3--5
./main.tex:20: Missing $ inserted.
! Undefined control sequence.
l.12 \\bar
)"""


def test_logs_and_prompts(spark):
    items = L.parse_log(LOG, "main.tex")
    short = [(x["severity"], x["file"], x["line"]) for x in items]
    assert short == [("error", "sections/intro.tex", 12), ("warning", "main.tex", 7), ("badbox", "main.tex", 3), ("error", "main.tex", 20), ("error", "main.tex", 12)]
    assert items[0]["message"] == "Undefined control sequence \\foo" and items[1]["fileFromLog"]
    assert L.parse_log("error: x")[0]["message"] == "Compile failed (see log)" and L.parse_log("") == [] == L.parse_log(None)
    files = F.array(F.lit("main.tex"), F.lit("sections/intro.tex"))
    df = spark.createDataFrame([(LOG, "\n".join(f"s{i}" for i in range(1, 200)))], "log string, source string")
    df = df.withColumn("e", L.error_lines(L.parse_log_udf("log", F.lit("main.tex")), F.lit("main.tex"), files))
    r = df.select("e", M.fix_prompt(F.lit("main.tex"), F.col("source"), F.col("e"), F.col("log")).alias("p"), L.files_of_build(F.col("log"), files).alias("b"), M.messages(F.lit("q"), F.lit("t")).alias("m")).first()
    assert [(x.line, x.file, x.fileLabel) for x in r.e] == [(12, "sections/intro.tex", "intro.tex"), (20, "main.tex", None), (12, "main.tex", None)]
    assert r.b == ["main.tex", "sections/intro.tex"] and [x.role for x in r.m] == ["system", "user", "assistant"]
    assert "(lines 1-45, line-numbered)" in r.p and "\n45: s45\n" in r.p and "- sections/intro.tex line 12: Undefined" in r.p and r.p.endswith("\n```")
    placed = df.select(M.insert_before(F.lit("a MARK b"), F.lit("[x]"), "ZZZ", "MARK").alias("p"), M.companions(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("a")), F.create_map(F.lit("a"), F.lit("A"), F.lit("b"), F.lit("B"))).alias("c")).first()
    assert placed.p == "a [x]MARK b" and placed.c.index("`b`") < placed.c.index("`a`")


def test_breaks_are_visible(spark):
    edits = [("good line one", "bad line one\nx"), ("only taken away\nanother line", "")]
    rows = spark.createDataFrame([("bad line one ... only taken away",), ("bad line one",), ("good line one only taken away",), ("another line bad line one",)], "prompt string")
    made = F.array(*[F.struct(F.lit("main.tex").alias("file"), F.lit(s).alias("search"), F.lit(r).alias("replace")) for s, r in edits])
    assert [r.v for r in rows.select(E.breaks_visible(made, F.col("prompt")).alias("v")).collect()] == [True, False, False, False]
    assert rows.select(E.breaks_visible(F.slice(made, 1, 0), F.col("prompt")).alias("v")).first().v
