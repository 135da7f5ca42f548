"""Registered queries over whole texts: predicates, parsers and edits meet whatever the documents, pages and conversations hold.

The tables have no LaTeX, logs or replies, so frequent words of their texts are exchanged for such things, by literal replacement that
Spark and SQL do alike. Where and how often they stand, next to what and in which order, then varies with every text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import edits as E
from tessella.functions import logs as L
from tessella.functions import prompts as M
from tessella.functions import python_text as P
from tessella.functions import text as X
from tessella.operators import closure, mining
from tessella.sources.tables import table

from .registry import query


def swapped(column, swaps):
    """``column`` with each word of ``swaps`` exchanged, in order."""
    for old, new in swaps:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def swapped_sql(column: str, swaps) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'" if "\n" not in x else "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in x.split("\n")) + ")"
    for old, new in swaps:
        column = f"replace({column}, {lit(old)}, {lit(new)})"
    return column


def _docs(spark, sf_dir, swaps, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns, swapped(F.coalesce("text", F.lit("")), swaps).alias("t"))


def _docs_sql(swaps, *columns) -> str:
    return f"SELECT {', '.join(['doc_id', *columns])}, {swapped_sql("coalesce(text, '')", swaps)} AS t FROM documents"


# --- predicates

BODY = [(" on ", " <b>Runaway</b> argument "), (" it ", " won&#39;t compile "), (" at ", "\n! "), (" as ", " l.12 "), (" for ", " emergency <i>stop</i> ")]


@query(
    "flt05_mentions_in_texts",
    f"WITH b AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM ({_docs_sql(BODY)})) "
    r"SELECT doc_id, CASE WHEN regexp_matches(t, p) THEN lower(trim(regexp_extract(t, p))) END AS mention FROM b, (SELECT '(?im)error|undefined control sequence|missing|runaway|extra \}|misplaced|does ?n[o'']t compile|won''?t compile|fails? to compile|emergency stop|^[ \t]*! |\bl\.\d+' AS p)",
)
def flt05(spark, sf_dir):
    return _docs(spark, sf_dir, BODY).select("doc_id", mining.mention(F.col("t")).alias("mention"))


EXTERNAL = [(" the ", " \\input{the} "), (" and ", " \\include{parts/and.tex} "), (" to ", " \\begin{filecontents}{the.tex}\\end{filecontents} "), (" in ", " \\begin{filecontents*}[x]{y/and.tex}\\end{filecontents*} "), (" de ", " \\subfile {ch1} "), (" und ", " \\import[a]{b/de} ")]


@query(
    "flt07_external_in_texts",
    f"WITH d AS ({_docs_sql(EXTERNAL)}), "
    r"x AS (SELECT doc_id, list_transform(regexp_extract_all(t, '\\begin\{filecontents\*?\}\s*(?:\[[^\]]*\])?\s*\{([^{}]+)\}', 1), lambda n: regexp_extract(trim(n), '([^/]*)$', 1)) AS own, "
    r"list_transform(regexp_extract_all(t, '\\(?:input|include|addbibresource|lstinputlisting|includepdf|import|subfile|verbatiminput|includesvg|includestandalone|InputIfFileExists)\s*(?:\[[^\]]*\])?\s*\{([^{}]+)\}', 1), lambda n: regexp_extract(trim(n), '([^/]*)$', 1)) AS wanted FROM d) "
    "SELECT doc_id, len(list_filter(wanted, lambda n: NOT list_contains(own, n) AND NOT list_contains(own, n || '.tex'))) > 0 AS external FROM x",
)
def flt07(spark, sf_dir):
    return _docs(spark, sf_dir, EXTERNAL).select("doc_id", mining.needs_external(F.col("t")).alias("external"))


KINDS = [("\nThe ", "\n@book{"), (" zu ", " \\ProvidesPackage "), (" que ", " \\ProvidesClass "), ("\nDie ", "\n! "), ("\nLa ", "\nl.12 "), (" that ", " \\emph "), (" und ", " \\section "), (" we ", " \\documentclass \\end{document} "), (" les ", " \\textbf "), ("\nLe ", "\nRunaway argument ")]


@query(
    "prj04_kinds_in_texts",
    f"WITH d AS ({_docs_sql(KINDS)}) SELECT doc_id, CASE WHEN contains(t, '\\documentclass') AND contains(t, '\\end{{document}}') THEN NULL WHEN regexp_matches(t, '(?m)^\\s*@\\w+\\s*[{{(]') THEN 'bib' WHEN contains(t, '\\ProvidesPackage') THEN 'sty' "
    "WHEN contains(t, '\\ProvidesClass') THEN 'cls' "
    r"WHEN regexp_matches(t, '(?m)^(?:!|l\.\d+|This is \w*TeX|\*\*|Latexmk|\(\./|Output written|Package \w+ (?:Warning|Error)|LaTeX (?:Warning|Error)|Runaway argument|[OU]\w+full \\|\S+\.\w+:\d+:|\$ |> )') OR NOT regexp_matches(t, '\\[a-zA-Z]+') THEN NULL ELSE 'tex' END AS kind FROM d",
)
def prj04(spark, sf_dir):
    return _docs(spark, sf_dir, KINDS).select("doc_id", mining.block_kind(F.col("t")).alias("kind"))


ENGINES = [(" the ", " \\usepackage[a]{x,fontspec} "), (" de ", " \\RequirePackage{luacode} "), (" und ", " \\usepackage{polyglossia} "), (" and ", " \\usepackage{inputenc} "), (" que ", " \\directlua "), (" der ", " \\usepackage{luatextra,x} ")]


@query(
    "str17_engines_in_texts",
    f"WITH d AS ({_docs_sql(ENGINES)}) SELECT doc_id, CASE WHEN regexp_matches(t, '\\\\(?:usepackage|RequirePackage)(?:\\[[^\\]]*\\])?\\{{[^}}]*(?:fontspec|polyglossia|unicode-math|xeCJK)') THEN 'xelatex' "
    "WHEN regexp_matches(t, '\\\\(?:usepackage|RequirePackage)(?:\\[[^\\]]*\\])?\\{[^}]*(?:luacode|luatextra)|\\\\directlua') THEN 'lualatex' ELSE 'pdflatex' END AS engine FROM d",
)
def str17(spark, sf_dir):
    return _docs(spark, sf_dir, ENGINES).select("doc_id", X.pick_engine(F.col("t")).alias("engine"))


CHOICES = [(" the ", " Candidate 2 "), (" de ", " candidate 3, "), (" und ", " [1] "), (" und,", " Candidate 9"), (" and ", " 4 "), (" to ", " 0 "), ("que", "candidate"), ("en ", "5 ")]


@query(
    "str22_choices_in_replies",
    f"WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace({swapped_sql("coalesce(text, '')", CHOICES)}, '^\\s+', ''), '\\s+$', '') AS t FROM conversations), "
    r"k AS (SELECT conv_id, turn, try_cast(coalesce(regexp_extract_all(right(t, 300), '[Cc]andidate\s*(\d+)', 1)[-1], regexp_extract_all(right(t, 40), '(\d+)', 1)[-1], regexp_extract_all(t, '(\d+)', 1)[-1]) AS INT) AS k FROM c) "
    "SELECT conv_id, turn, CASE WHEN k BETWEEN 1 AND 4 THEN k - 1 END::INT AS choice FROM k",
)
def str22(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", swapped(F.coalesce("text", F.lit("")), CHOICES).alias("t"))
    return rows.select("conv_id", "turn", X.judge_choice(F.col("t"), F.lit(4)).alias("choice"))


# --- blocks of pages, inclusions between documents

PAGE = [("<p>", "<pre class=x> <code>"), ("</p>", "</code> </pre>"), ("<br>", "\r\n")]


@query(
    "prj01_code_of_pages",
    f"WITH p AS (SELECT page_id, unnest(regexp_extract_all({swapped_sql("coalesce(html, '')", PAGE[:2])}, '(?s)<pre[^>]*>\\s*<code[^>]*>(.*?)</code>\\s*</pre>', 1)) AS raw FROM pages), "
    "u AS (SELECT page_id, list_transform(regexp_split_to_array(replace(replace(replace(replace(replace(raw, '<br>', chr(10)), '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '\"'), '&amp;', '&'), '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '\\s+$', '')) AS l FROM p), "
    "e AS (SELECT page_id, l, list_filter(range(1, len(l) + 1), lambda i: l[i] <> '') AS f FROM u) "
    "SELECT page_id, count(*) AS n, sum(length(code))::BIGINT AS n_chars, max(sha1(code)) AS most FROM (SELECT page_id, CASE WHEN len(f) > 0 THEN array_to_string(l[f[1]:f[-1]], chr(10)) ELSE '' END || chr(10) AS code FROM e) GROUP BY page_id",
)
def prj01(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", swapped(F.coalesce("html", F.lit("")), PAGE).alias("h"))
    code = pages.select("page_id", F.explode(P.code_blocks_udf("h")).alias("code"))
    return code.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("code")).alias("n_chars"), F.max(F.sha1("code")).alias("most"))


@query(
    "prj07_inclusions_between_texts",
    "WITH d AS (SELECT source AS project, doc_id, 'a/' || doc_id::VARCHAR || '.tex' AS path, replace(replace(replace(coalesce(text, ''), '%', ' '), ' the ', ' \\input{a/' || (doc_id + 20)::VARCHAR || '} '), ' de ', ' \\include{' || (doc_id - 40)::VARCHAR || '.tex} ') AS t FROM documents), "
    "n AS (SELECT project, path AS src, trim(unnest(regexp_extract_all(t, '\\\\(?:input|include|subfile)\\s*\\{([^{}]+)\\}', 1))) AS name FROM d), "
    "w AS (SELECT DISTINCT project, src, unnest([name, name || '.tex', 'a/' || name, 'a/' || name || '.tex']) AS dst FROM n) SELECT w.project, src, dst FROM w JOIN d ON d.project = w.project AND d.path = dst WHERE src <> dst",
)
def prj07(spark, sf_dir):
    k = F.col("doc_id")
    t = F.replace(F.coalesce("text", F.lit("")), F.lit("%"), F.lit(" "))
    t = F.replace(t, F.lit(" the "), F.concat(F.lit(" \\input{a/"), (k + 20).cast("string"), F.lit("} ")))
    t = F.replace(t, F.lit(" de "), F.concat(F.lit(" \\include{"), (k - 40).cast("string"), F.lit(".tex} ")))
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.concat(F.lit("a/"), k.cast("string"), F.lit(".tex")).alias("path"), t.alias("text"))
    return closure.inclusions(files)


# --- edits

MACROS = [("%", " "), (" the ", " \\cite{the} "), (" and ", " \\begin{x} "), (" to ", " \\section "), (" in ", " \\item "), (" de ", " \\def "), (" und ", " \\footnotemark "), (" la ", " \\ref ")]
_MACRO = r"(\\(?:includegraphics|begin\{[a-zA-Z*]+\}|cite[a-z]*|ref|label|item|section\*?|subsection\*?|caption|newcommand|renewcommand|def|newenvironment|usepackage|addplot|draw|node|footnote))(?:[^a-zA-Z]|$)"


@query(
    "edit11_structure_in_texts",
    f"WITH d AS ({_docs_sql(MACROS)}), m AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_MACRO}', 1)) AS m, 1 AS a, 0 AS b FROM d UNION ALL SELECT doc_id, unnest(regexp_extract_all(replace(left(t, length(t) // 2), ' \\item ', ' \\cite '), '{_MACRO}', 1)), 0, 1 FROM d), "
    "l AS (SELECT doc_id, greatest(0, sum(a) - sum(b)) AS lost FROM m GROUP BY doc_id, m) SELECT doc_id, coalesce(sum(lost), 0)::INT AS lost FROM d LEFT JOIN l USING (doc_id) GROUP BY doc_id",
)
def edit11(spark, sf_dir):
    half = F.replace(F.left("t", F.floor(F.length("t") / 2).cast("int")), F.lit(" \\item "), F.lit(" \\cite "))
    return _docs(spark, sf_dir, MACROS).select("doc_id", E.structure_lost(F.col("t"), half).alias("lost"))


_LINES = "l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, l, list_transform(l, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS k FROM l WHERE len(l) >= 5)"


@query(
    "edit12_splices_in_texts",
    f"WITH {_LINES} SELECT doc_id, sha1(array_to_string(l[:2] || ['  changed line', l[4]] || l[5:], chr(10))) AS h FROM k WHERE k[2] <> '' AND k[4] <> '' AND k[2] <> k[4] AND len(list_filter(k, lambda x: x = k[2])) = 1 AND len(list_filter(k, lambda x: x = k[4])) = 1 AND NOT list_contains(k, 'changed line')",
)
def edit12(spark, sf_dir):
    """A document's second and fourth line with another line between: where both lines are unique they mark the place."""
    lines = F.split("text", "\n", -1)
    k = F.transform(lines, X.wskey)
    once = lambda i: (F.get(k, F.lit(i)) != "") & (F.size(k) - F.size(F.array_remove(k, F.get(k, F.lit(i)))) == 1)  # noqa: E731 - k is made once a row, not once a line
    docs = table(spark, sf_dir, "documents").filter(F.size(lines) >= 5).filter(once(1) & once(3) & ~F.array_contains(k, F.lit("changed line")))
    snippet = F.concat_ws("\n", F.get(lines, F.lit(1)), F.lit("  changed line"), F.get(lines, F.lit(3)))
    return docs.select("doc_id", F.sha1(P.splice_udf("text", snippet)).alias("h"))


@query(
    "edit10_sizes_in_texts",
    f"WITH {_LINES} SELECT doc_id, (length(regexp_replace(replace(l[1], '%', ''), '\\s+', '', 'g')) + length(regexp_replace(replace(l[3], '%', ''), '\\s+', '', 'g')))::INT AS size, "
    "greatest(0, length(regexp_replace(replace(l[1], '%', ''), '\\s+', '', 'g')) - length(regexp_replace(replace(l[3], '%', ''), '\\s+', '', 'g')))::INT AS deleted FROM k",
)
def edit10(spark, sf_dir):
    """An answer that puts a document's third line for its first."""
    lines = F.split(F.replace("text", F.lit("%"), F.lit("")), "\n", -1)
    answer = F.concat(F.lit("so:\n<edit>\n<<<<<<< SEARCH\n"), F.get(lines, F.lit(0)), F.lit("\n=======\n"), F.get(lines, F.lit(2)), F.lit("\n>>>>>>> REPLACE\n</edit>"))
    docs = table(spark, sf_dir, "documents").filter(F.size(F.split("text", "\n", -1)) >= 5)
    return docs.select("doc_id", E.edit_size(answer).alias("size"), E.deleted_chars(answer).alias("deleted"))


# --- logs

LOG = [(". ", ".\n"), ("\nThe ", "\n! Undefined control sequence "), (" the ", " \\the "), (" to ", "\nl.17 \\to "), (" and ", "\n! Missing "), (" de ", "\n! "), (" la ", "\nl.203 "), ("\nDer ", "\n! "), (" und ", "\nl.5 a \\b \\und ")]
_LOG_ITEMS = (
    f"WITH d AS ({_docs_sql(LOG)}), x AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM d WHERE trim(t) <> ''), "
    "y AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM x), "
    "s AS (SELECT doc_id, i, try_cast(regexp_extract(s, '^l\\.(\\d+)\\b', 1) AS INT) AS line, regexp_extract_all(s, '\\\\[a-zA-Z@]+|\\\\.')[-1] AS macro FROM y WHERE regexp_matches(s, '^l\\.\\d+\\b ?')), "
    "e AS (SELECT doc_id, i, coalesce(nullif(trim(substr(s, 3)), ''), 'LaTeX error') AS message FROM y WHERE starts_with(s, '! ')), "
    "f AS (SELECT e.doc_id, e.i, any_value(message) AS message, arg_min(s.line, s.i) AS line, arg_min(coalesce(s.macro, ''), s.i) AS macro FROM e LEFT JOIN s ON s.doc_id = e.doc_id AND s.i > e.i AND s.i < e.i + 40 GROUP BY e.doc_id, e.i), "
    "g AS (SELECT doc_id, i, line, CASE WHEN line IS NOT NULL AND starts_with(message, 'Undefined control sequence') AND macro <> '' THEN 'Undefined control sequence ' || macro ELSE message END AS message FROM f) "
)


@query("log01_items_of_texts", _LOG_ITEMS + "SELECT doc_id, count(*) AS n, count(line) AS n_located, sum(line)::BIGINT AS lines, max(sha1(message)) AS most FROM g GROUP BY doc_id")
def log01(spark, sf_dir):
    """Error lines and the source lines that follow within forty lines, in logs of any shape."""
    items = _docs(spark, sf_dir, LOG).select("doc_id", F.explode(L.parse_log_udf("t", F.lit("main.tex"))).alias("x")).filter("x.severity = 'error' and startswith(x.rawExcerpt, '! ')")
    return items.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("x.line").alias("n_located"), F.sum("x.line").alias("lines"), F.max(F.sha1("x.message")).alias("most"))


@query(
    "log04_error_lines_of_texts",
    _LOG_ITEMS + ", c AS (SELECT doc_id, line, arg_min(message, i) AS message, min(i) AS i FROM g WHERE line >= 1 GROUP BY doc_id, line) "
    "SELECT doc_id, list(line ORDER BY i)[:12] AS lines, array_to_string(list(left(message, 160) ORDER BY i)[:12], '|') AS texts FROM c GROUP BY doc_id",
)
def log04(spark, sf_dir):
    items = F.filter(L.parse_log_udf("t", F.lit("main.tex")), lambda x: F.startswith(x["rawExcerpt"], F.lit("! ")))
    found = _docs(spark, sf_dir, LOG).select("doc_id", L.error_lines(items, F.lit("main.tex"), F.array(F.lit("main.tex"))).alias("e")).filter(F.size("e") > 0)
    return found.select("doc_id", F.col("e.line").alias("lines"), F.array_join("e.text", "|").alias("texts"))


@query("log03_collapsed_of_texts", _LOG_ITEMS + "SELECT doc_id, count(DISTINCT coalesce(line, -1))::INT AS n FROM g GROUP BY doc_id")
def log03(spark, sf_dir):
    """One item of each line, and one of all that have none."""
    items = F.filter(L.parse_log_udf("t", F.lit("main.tex")), lambda x: F.startswith(x["rawExcerpt"], F.lit("! ")))
    return _docs(spark, sf_dir, LOG).select("doc_id", F.size(L.collapsed(items)).alias("n")).filter("n > 0")


BLG = [(". ", ".\n"), ("\nThe ", "\nI couldn't open style file "), (" and ", "\nERROR - "), (" de ", "\nI was expecting "), (" und ", "\nI found no \\und commands "), (" que ", " I couldn't find "), (" la ", "\nI found no ")]


@query(
    "log05_fatal_lines_of_texts",
    f"WITH d AS ({_docs_sql(BLG)}) SELECT doc_id, regexp_extract_all(t, '(?m)^(I couldn''t open (?:style|database) file .*|I found no \\\\\\w+ commands?.*|ERROR - .*|I couldn''t find .*|I was expecting .*)$', 1)::VARCHAR[] AS lines FROM d",
)
def log05(spark, sf_dir):
    return _docs(spark, sf_dir, BLG).select("doc_id", L.bibliography_errors(F.col("t")).alias("lines"))


OPENED = [(" the ", " (./a.tex"), (" and ", " (sub/b\n.tex)"), (" de ", " (./c.\nsty"), (" und ", " a.tex "), (" to ", " (/usr/d.cls")]


@query(
    "log06_files_of_texts",
    f"WITH d AS (SELECT doc_id, replace(t, chr(10), '') AS t FROM ({_docs_sql(OPENED)})) SELECT doc_id, list_filter(['a.tex', 'sub/b.tex', 'c.sty', '/usr/d.cls', 'none.tex'], lambda f: contains(t, '(./' || f) OR contains(t, '(' || f)) AS files FROM d",
)
def log06(spark, sf_dir):
    return _docs(spark, sf_dir, OPENED).select("doc_id", L.files_of_build(F.col("t"), F.array(*map(F.lit, ["a.tex", "sub/b.tex", "c.sty", "/usr/d.cls", "none.tex"]))).alias("files"))


# --- prompts

_said = lambda x: "'" + x.replace("'", "''") + "'"


@query(
    "str15_verifier_prompts_of_texts",
    f"SELECT a.conv_id, a.turn, sha1(a.text || {_said(M.ASK[0])} || regexp_replace(regexp_replace(b.text, '^\\s+', ''), '\\s+$', '') || {_said(M.ASK[1])}) AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
)
def str15(spark, sf_dir):
    """Each turn as the prompt and the next one as the fix that is asked about."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("fix"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.sha1(M.verifier_prompt(F.col("text"), F.col("fix"))).alias("h"))


@query(
    "prm06_messages_of_texts",
    f"SELECT a.conv_id, a.turn, sha1('system' || {_said(M.system_prompt(512))} || 'user' || a.text || coalesce('assistant' || b.text, '')) AS h FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
)
def prm06(spark, sf_dir):
    """Each turn as the user's message, with the next one, where there is one, as the answer."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    m = M.messages(F.col("text"), F.col("answer"), 512)
    flat = F.array_join(F.flatten(F.transform(m, lambda x: F.array(x["role"], x["content"]))), "")
    return turns.join(after, ["conv_id", "turn"], "left").select("conv_id", "turn", F.sha1(flat).alias("h"))


# --- more predicates and parsers

BAD = [("que", "\ufffd"), (" the ", " a.STY' not found "), (" and ", " Command \\and already defined.\n"), (" de ", " cref@override@label@type ")]


@query(
    "flt09_bad_prompts_in_texts",
    f"WITH d AS ({_docs_sql(BAD[1:])}) SELECT doc_id, regexp_matches(t, '(?i)\\x{{fffd}}|\\.(cls|sty)'' not found|cref@override@label@type|caption@setfloatcapt|Command \\\\[a-zA-Z@]+ already defined.*\\n.*Command \\\\[a-zA-Z@]+ already defined.*\\n.*already defined') AS bad FROM d",
)
def flt09(spark, sf_dir):
    return _docs(spark, sf_dir, BAD[1:]).select("doc_id", mining.bad_prompt(F.col("t")).alias("bad"))


SHELL = [(" the ", " \\usepackage[a]{x,svg} "), (" und ", " \\usepackage{mysvg} "), (" de ", " -shell-escape "), (" zu ", " \\write18 ")]


@query(
    "flt17_shell_in_texts",
    f"WITH d AS ({_docs_sql(SHELL)}) SELECT doc_id, regexp_matches(t, '\\\\usepackage(?:\\[[^\\]]*\\])?\\{{[^}}]*\\b(?:minted|pythontex|gnuplottex|svg)\\b|\\\\write18|-shell-escape') AS shell FROM d",
)
def flt17(spark, sf_dir):
    return _docs(spark, sf_dir, SHELL).select("doc_id", mining.shell_escape(F.create_map(F.lit("main.tex"), F.col("t"), F.lit("b.tex"), F.lit("plain"))).alias("shell"))


GRAPHICS = [(" the ", " \\includegraphics[w]{figs/the} "), (" and ", " \\includegraphics{and.png} "), (" de ", " \\includegraphics{example-image} "), (" und ", " \\includegraphics*{ der } ")]


@query(
    "snk07_placeholders_of_texts",
    f"WITH d AS ({_docs_sql(GRAPHICS)}), n AS (SELECT DISTINCT doc_id, regexp_extract(trim(unnest(regexp_extract_all(t, '\\\\includegraphics\\*?(?:\\[[^\\]]*\\])?\\{{([^{{}}]+)\\}}', 1))), '([^/]*)$', 1) AS n FROM d) "
    "SELECT doc_id, CASE WHEN contains(n, '.') THEN n ELSE n || '.pdf' END AS path FROM n WHERE NOT starts_with(n, 'example-') AND NOT (n = 'and.png' AND doc_id % 2 = 0)",
)
def snk07(spark, sf_dir):
    from tessella.sources import writers

    docs = _docs(spark, sf_dir, GRAPHICS)
    have = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("and.png").alias("path"))
    return writers.placeholders_needed(docs, "doc_id", ["t"], have)


BANNER = [("\n", "\n====\nFILE: "), (" the ", "/the")]


@query(
    "src13_containers_of_texts",
    f"WITH d AS ({_docs_sql(BANNER)}), p AS (SELECT doc_id, unnest(string_split(t, chr(10) || '====' || chr(10) || 'FILE: ')) AS p, generate_subscripts(string_split(t, chr(10) || '====' || chr(10) || 'FILE: '), 1) AS i FROM d), "
    "f AS (SELECT doc_id, trim(regexp_extract(p, '^[^\\n]*')) AS path FROM p WHERE i > 1) SELECT doc_id, count(*) AS n, max(path) AS last_path FROM f WHERE NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') GROUP BY doc_id",
)
def src13(spark, sf_dir):
    """Every line of a document after the first as a file of a container, named by the line."""
    from tessella.sources import readers

    files = readers.split_container(_docs(spark, sf_dir, BANNER).withColumnRenamed("t", "text"), "text")
    return files.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("path").alias("last_path"))


MANIFEST = [(". ", ";\n"), (" the ", " use the;"), (" de ", "\nuse  de;"), (" und ", " use und2; ")]


@query(
    "src14_discovered_in_texts",
    f"WITH d AS ({_docs_sql(MANIFEST, 'source')}) SELECT source AS project, unnest(regexp_extract_all(t, 'use (\\w+);', 1)) AS entry FROM d WHERE doc_id % 2 = 0",
)
def src14(spark, sf_dir):
    from tessella.sources import readers

    name = F.when(F.col("doc_id") % 2 == 0, "list.txt").otherwise("other.txt")
    files = _docs(spark, sf_dir, MANIFEST, "source").select(F.col("source").alias("project"), name.alias("path"), F.col("t").alias("text"))
    return readers.discover(files, "list.txt", "use ([A-Za-z0-9_]+);")


@query(
    "join14_names_in_texts",
    "WITH f AS (SELECT source, 'd' || (doc_id % 7)::VARCHAR || '/' || regexp_extract(coalesce(text, ''), '^[A-Za-z]*') || '.tex' AS path FROM documents), n AS (SELECT DISTINCT source, regexp_extract(coalesce(text, ''), '^[A-Za-z]*') || '.tex' AS name FROM documents UNION SELECT DISTINCT source, path FROM f UNION SELECT DISTINCT source, 'none.tex' FROM f) "
    "SELECT n.source, n.name, arg_min(f.path, (f.path <> n.name, f.path)) AS path FROM n LEFT JOIN f ON f.source = n.source AND (f.path = n.name OR ends_with(f.path, '/' || n.name)) GROUP BY n.source, n.name",
)
def join14(spark, sf_dir):
    """The first words of a source's texts as files in folders, and names that may or may not say the folder."""
    from tessella.operators import joins

    first = F.concat(F.regexp_extract(F.coalesce("text", F.lit("")), "^[A-Za-z]*", 0), F.lit(".tex"))
    docs = table(spark, sf_dir, "documents").select("source", first.alias("base"), F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), first).alias("path"))
    names = docs.select("source", F.col("base").alias("name")).unionByName(docs.select("source", F.col("path").alias("name"))).unionByName(docs.select("source", F.lit("none.tex").alias("name"))).distinct()
    return joins.resolve_names(names, docs.select("source", "path"), "source").select("source", "name", "path")


@query(
    "edit13_candidates_in_texts",
    f"WITH {_LINES}, d AS (SELECT doc_id, '\\documentclass{{a}}' || chr(10) || regexp_replace(array_to_string(l, chr(10)), '\\s+$', '') || chr(10) || '\\end{{document}}' || chr(10) AS t FROM k) SELECT doc_id, 2::INT AS n, sha1(replace(t, '\\documentclass{{a}}', '\\documentclass{{bb}}')) AS h FROM d",
)
def edit13(spark, sf_dir):
    """Whole documents among an answer's blocks, each with another first line, beside a snippet that is not tried then."""
    lines = F.split("text", "\n", -1)
    docs = table(spark, sf_dir, "documents").filter(F.size(lines) >= 5)
    whole = lambda name: F.concat(F.lit("\\documentclass{" + name + "}\n"), X.rstrip(F.col("text")), F.lit("\n\\end{document}\n"))
    made = P.fix_candidates_udf(whole("a"), F.array(whole("a"), F.get(lines, F.lit(1)), whole("b"), whole("bb")))
    return docs.select("doc_id", made.alias("f")).select("doc_id", F.size("f").alias("n"), F.sha1(F.get("f", F.lit(0))).alias("h"))
