"""Mining of broken and fixed documents: predicates, candidates and the stage each candidate ends in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import U, line_count, lines, pick_engine, strip_tags, unescape_basic

# Error messages start with one of these; what a document takes from outside; what it brings along; licences that
# allow release; what needs a shell; stages in order; what betrays a missing resource; what a question says when something does not compile.
ERROR_STARTS = (
    "LaTeX Error:", "LaTeX3 Error:", "Package ", "Class ", "Undefined control sequence",
    "Missing ", "Runaway argument", "Extra ", "Misplaced ", "Paragraph ended before",
    "File ended while scanning", "Too many }", "Illegal ", "You can't use", "Argument of",
    "Double su", "Emergency stop", "Use of ", "Not in outer par mode", "Display math should end",
    "Bad ", "I can't find file", "Font ", "Dimension too large", "TeX capacity exceeded",
    "Incomplete ", "Text line contains an invalid character", "Undefined tab position",
    "Improper ", "Unbalanced ", "Command ", "Environment ", "Lonely ", "There's no line here",
    "Something's wrong", "Unknown ", "Cannot ", "Please ", "Limit controls", "Math ",
    "Interruption", "Infinite glue", "Arithmetic overflow", "Number too big",
)
ERROR_LINE = r"(?m)(?d)(?U)^[ \t]*(?:! |\S+\.tex:\d+: )(.{5,}?)\s*$"
EXTERNAL = r"\\(?:input|include|addbibresource|lstinputlisting|includepdf|import|subfile|verbatiminput|includesvg|includestandalone|InputIfFileExists)\s*(?:\[[^\]]*\])?\s*\{([^{}]+)\}"
PROVIDED = r"\\begin\{filecontents\*?\}\s*(?:\[[^\]]*\])?\s*\{([^{}]+)\}"
MENTION = r"(?im)error|undefined control sequence|missing|runaway|extra \}|misplaced|does ?n[o']t compile|won'?t compile|fails? to compile|emergency stop|^[ \t]*! |\bl\.\d+"
MISSING = (
    "(?i)not found|not existent|not installed|not loadable|not available|cannot be found|cannot be opened|could not be opened|"
    "Cannot find file|Cannot determine size|Cannot be run with|can't find file|can't write on file|can't open file|"
    "did not find|system call|shell escape|write18|Unknown graphics extension|Package fontspec Error|pdftex|XeTeX|XeLaTeX|"
    r"LuaTeX|Lua\(HB\)|LuaLaTeX|Unicode-compliant|Backend request|auto-pst-pdf|gnuplot-result|externalization failed|Perl module"
)
MISSING_WIDE = MISSING + "|Could not read|No file"
BAD_PROMPT = (
    r"(?i)(?d)\x{fffd}|\.(cls|sty)' not found|cref@override@label@type|caption@setfloatcapt|"
    r"Command \\[a-zA-Z@]+ already defined.*\n.*Command \\[a-zA-Z@]+ already defined.*\n.*already defined"
)
SHELL = r"\\usepackage(?:\[[^\]]*\])?\{[^}]*\b(?:minted|pythontex|gnuplottex|svg)\b|\\write18|-shell-escape"
LICENSES = ["MIT", "Apache-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "LPPL-1.3c", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
MAX_LINES, MAX_CHARS = 400, 14_000
STAGES = ["broken_timeout", "broken_compiles", "no_located_error", "missing_file", "worker_error", "kept", "pool"]
FIX_STAGES = ["no_fix_candidate", "external_files", "identical", "diff_too_big", "edit_not_unique", "roundtrip_mismatch", "sites_hidden", "fixed_timeout", "fixed_compile_fail"]


def is_full_document(x: Column) -> Column:
    return x.contains("\\documentclass") & x.contains("\\end{document}")


def within_caps(x: Column) -> Column:
    return (line_count(x) - 1 <= MAX_LINES) & (F.length(x) <= MAX_CHARS)


def error_messages(body: Column) -> Column:
    """Messages of error lines in an HTML body, those that start like one."""
    found = F.regexp_extract_all(unescape_basic(strip_tags(body)), F.lit(ERROR_LINE), F.lit(1))
    starts = "^(?:" + "|".join("\\Q" + s + "\\E" for s in ERROR_STARTS) + ")"
    return F.filter(found, lambda x: x.rlike(starts))


def mention(body: Column) -> Column:
    """The first sign of an error, in lower case; null without one."""
    text = unescape_basic(strip_tags(body, " "))
    return F.when(text.rlike(MENTION), F.lower(F.trim(F.regexp_extract(text, MENTION, 0))))


def longest_document(blocks: Column) -> Column:
    """The longest full document among code blocks, the first of equals."""
    full = F.filter(blocks, is_full_document)
    return F.aggregate(full, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull() | (F.length(x) > F.length(s)), x).otherwise(s))


def needs_external(x: Column) -> Column:
    base = lambda n: F.regexp_extract(F.trim(n), r"([^/]*)$", 1)
    provided = F.transform(F.regexp_extract_all(x, F.lit(PROVIDED), F.lit(1)), base)
    wanted = F.transform(F.regexp_extract_all(x, F.lit(EXTERNAL), F.lit(1)), base)
    return F.exists(wanted, lambda n: ~F.array_contains(provided, n) & ~F.array_contains(provided, F.concat(n, F.lit(".tex"))))


def missing_resource(message: Column, wide: bool = False) -> Column:
    return message.rlike(MISSING_WIDE if wide else MISSING)


def bad_prompt(x: Column) -> Column:
    return x.rlike(BAD_PROMPT)


def within_length(x: Column, most: int = 20_000) -> Column:
    """Whether a prompt is short enough."""
    return F.length(x) <= most


def shell_escape(files: Column) -> Column:
    """Whether any file of a map needs a shell while it compiles."""
    return F.exists(F.map_values(files), lambda t: t.rlike(SHELL))


def engine_consistent(files: Column, root: str = "main.tex") -> Column:
    """Whether the root alone asks for the engine that all files together ask for."""
    return pick_engine(F.element_at(files, root)) == pick_engine(F.array_join(F.map_values(files), "\n"))


def keeps_companions(files: Column, fixed: Column, root: str = "main.tex") -> Column:
    """Whether a fix leaves a project one of several files: the root takes none of them in anew, and some other file still names
    each file but the root, without its suffix."""
    inlined = F.lit("\\begin{filecontents")
    taken = F.contains(F.element_at(fixed, root), inlined) & ~F.contains(F.element_at(files, root), inlined)
    stem = lambda f: F.regexp_replace(F.regexp_extract(f, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    named = lambda f: F.exists(F.map_entries(fixed), lambda e: (e["key"] != f) & F.contains(e["value"], stem(f)))
    return ~taken & F.forall(F.filter(F.map_keys(files), lambda f: f != root), named)


def licensed(x: Column) -> Column:
    return F.coalesce(x.isin(LICENSES), F.lit(False))


def tags(x: Column) -> Column:
    """``<a><b>`` or names between bars."""
    angled = F.regexp_extract_all(x, F.lit("<([^>]+)>"), F.lit(1))
    return F.when(F.size(angled) > 0, angled).otherwise(F.filter(F.split(x, r"\|"), lambda t: t != ""))


LOG_LIKE = r"(?m)^(?:!|l\.\d+|This is \w*TeX|\*\*|Latexmk|\(\./|Output written|Package \w+ (?:Warning|Error)|LaTeX (?:Warning|Error)|Runaway argument|[OU]\w+full \\|\S+\.\w+:\d+:|\$ |> )"


def block_kind(x: Column) -> Column:
    """bib, sty, cls or tex; null for logs, whole documents and anything else."""
    return (
        F.when(is_full_document(x) & ~x.contains("{subfiles}"), F.lit(None).cast("string"))
        .when(x.rlike(r"(?m)^\s*@\w+\s*[{(]"), "bib")
        .when(x.contains("\\ProvidesPackage"), "sty")
        .when(x.contains("\\ProvidesClass"), "cls")
        .when(x.rlike(LOG_LIKE) | ~x.rlike(r"\\[a-zA-Z]+"), F.lit(None).cast("string"))
        .otherwise("tex")
    )


def questions(posts: DataFrame) -> DataFrame:
    """Candidate questions: a full document within the caps, and an error line or a mention of one.

    posts(id, post_type, accepted_answer_id, score, created, title, tags, body, blocks), ``blocks`` from ``code_blocks_udf``.
    """
    q = posts.filter("post_type = 1").withColumn("broken", longest_document(F.col("blocks")))
    q = q.filter(F.col("broken").isNotNull()).filter(within_caps(F.col("broken")))
    return q.select(
        F.col("id").alias("question_id"), "title", tags(F.col("tags")).alias("tags"), "score", F.left("created", F.lit(10)).alias("created"),
        F.get(error_messages(F.col("body")), F.lit(0)).alias("error_message"), mention(F.col("body")).alias("error_mention"), "broken", "accepted_answer_id",
    ).filter("error_message is not null or error_mention is not null")


def unlabelled(posts: DataFrame) -> DataFrame:
    """Candidate questions for a pool without fixes: no answer is needed; ``has_accepted`` says whether there is one."""
    return questions(posts).withColumn("has_accepted", F.col("accepted_answer_id").isNotNull()).drop("accepted_answer_id")


def question_funnel(posts: DataFrame) -> DataFrame:
    """(stage, n): questions, those with a sign of an error, with a whole document, and of these the ones too long; in one pass."""
    signs = (F.size(error_messages(F.col("body"))) > 0) | mention(F.col("body")).isNotNull()
    doc = longest_document(F.col("blocks"))
    q = posts.filter("post_type = 1").select(signs.alias("s"), doc.alias("d"))
    whole = F.col("s") & F.col("d").isNotNull()
    counts = q.agg(F.count("*").alias("questions"), F.count_if("s").alias("q_error_line"), F.count_if(whole).alias("q_mwe"), F.count_if(whole & ~within_caps(F.col("d"))).alias("q_too_long"))
    return counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c))])).alias("stage", "n"))


def commit_candidates(files: DataFrame, key: str = "sha", suffixes: tuple[str, ...] = (".tex", ".sty", ".cls", ".bib"), ignored: str = r"(^|/)(build|out|\.github)/") -> DataFrame:
    """Commits that only modify 1 to 4 text files by at most 40 lines; commit_files(sha, path, status, added, removed)."""
    seen = files.filter(~F.col("path").rlike(ignored))
    text = F.lit(False)
    for s in suffixes:
        text = text | F.col("path").endswith(s)
    g = seen.groupBy(key).agg(F.count("*").alias("n_files"), F.bool_and((F.col("status") == "M") & text).alias("ok_"), F.sum(F.col("added") + F.col("removed")).alias("n_lines"))
    return g.filter(F.col("ok_") & F.col("n_files").between(1, 4) & (F.col("n_lines") <= 40)).drop("ok_")


def forks_worth(forks: DataFrame, seen: DataFrame) -> DataFrame:
    """Forks pushed to after their creation, not seen before, 1 to 250 commits ahead."""
    return forks.filter("pushed_at > created_at").filter(F.col("ahead_by").between(1, 250)).join(seen.select("fork").distinct(), "fork", "left_anti")


def repositories_worth(repos: DataFrame, most_kb: int = 200_000) -> DataFrame:
    return repos.filter(~F.coalesce("is_fork", F.lit(False)) & (F.col("size") <= most_kb) & F.coalesce(F.col("default_branch") != "", F.lit(False)))


def relaxed_stage(timed_out: Column, ok: Column, located_in_root: Column, message: Column, any_plan: Column) -> Column:
    """Where a candidate ends that is compiled before it is matched with a fix."""
    return (
        F.when(timed_out, "broken_timeout")
        .when(ok, "broken_compiles")
        .when(~F.coalesce(located_in_root, F.lit(False)), "no_located_error")
        .when(missing_resource(message, True), "missing_file")
        .when(any_plan, "kept")
        .otherwise("pool")
    )


def strict_stage(external: Column, reasons: Column, timed_out: Column, ok: Column, located: Column, message: Column, last_plan: Column) -> Column:
    """Where a candidate ends that needs a fix first: ``reasons`` are why its fixes gave no edits (``ok`` where they did), and
    ``last_plan`` what became of the last plan tried (``kept`` if one was kept)."""
    good = F.exists(reasons, lambda r: r == "ok")
    counted = F.transform(F.array_distinct(reasons), lambda r, i: F.struct(F.size(F.filter(reasons, lambda x: x == r)).alias("n"), (-i).alias("i"), r.alias("r")))
    common = F.array_max(counted)["r"]
    return (
        F.when(external, "external_files")
        .when(F.size(reasons) == 0, "no_fix_candidate")
        .when(~good, common)
        .when(timed_out, "broken_timeout")
        .when(ok, "broken_compiles")
        .when(~F.coalesce(located, F.lit(False)), "broken_no_located_error")
        .when(missing_resource(message), "local_file_missing")
        .otherwise(last_plan)
    )


def group_key(repo: Column, question_id: Column) -> Column:
    return F.coalesce(repo, F.concat(F.lit("q"), question_id.cast("string")))


def visible_lines(x: Column, least: int = 8) -> Column:
    return F.filter(lines(x), lambda s: F.length(F.trim(s)) >= least)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "F", "U")]
