"""Prompts for repairing a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import line_count, lines, numbered, strip, tree_block

LOG_CHARS, SOURCE_CHARS, FULL_LINES, RADIUS = 1500, 4000, 120, 25

# The wording of prompts.
HEADER = ("The LaTeX file `", "` fails to compile. Apply the smallest edit that fixes the compile errors and keep my content intact.")
SYSTEM = """You fix LaTeX compile errors. You receive the failing file, parsed error lines, and the compile log tail. Reply ONLY with the smallest edit operations that make the document compile, keeping the content intact, in this exact format:

<edit>
<<<<<<< SEARCH
(exact text from the file)
=======
(replacement text)
>>>>>>> REPLACE
</edit>

For multi-file projects, name the file on the tag: <edit file="sections/intro.tex"> (default: the file shown).
The SEARCH text must match the file exactly and unambiguously. Do not explain."""
ASK = ("\n\nProposed fix:\n", "\n\nThe patched document compiles. Does this fix resolve the error correctly and keep the document's content and intent intact? Answer yes or no.")
BUDGET = ("\nYou may reason first, inside <think>...</think>, using at most ", " tokens; then output only the edit blocks.")


def cat(*xs) -> Column:
    return F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])


def system_prompt(think_tokens: int = 0) -> str:
    return SYSTEM + (f"{BUDGET[0]}{think_tokens}{BUDGET[1]}" if think_tokens else "")


def source_block(path: Column, source: Column, errors: Column, full_lines: int = FULL_LINES, max_chars: int = SOURCE_CHARS) -> Column:
    """The numbered source: whole if short, else the window around the first error of the file itself, else around the first."""
    n = line_count(source)
    local = F.get(F.filter(errors, lambda e: F.coalesce(e["fileLabel"], F.lit("")) == ""), F.lit(0))["line"]
    first = F.coalesce(local, F.get(errors, F.lit(0))["line"])
    whole = n <= full_lines
    start = F.when(whole, F.lit(0)).otherwise(F.greatest(F.lit(0), first - 1 - RADIUS))
    end = F.when(whole, n).otherwise(F.least(n, first + RADIUS))
    part = F.array_join(F.slice(lines(source), start + 1, F.greatest(end - start, F.lit(0))), "\n")
    shown = F.left(F.array_join(F.transform(lines(part), lambda s, i: cat((i + start + 1).cast("string"), ": ", s)), "\n"), F.lit(max_chars))
    label = F.when((start == 0) & (end == n), "full file").otherwise(cat("lines ", (start + 1).cast("string"), "-", end.cast("string")))
    block = cat("\n\nCurrent content of `", path, "` (", label, ", line-numbered):\n```\n", shown, "\n```")
    usable = source.isNotNull() & (strip(source) != "") & (whole | first.isNotNull()) & (end > start)
    return F.when(usable, block).otherwise(F.lit(""))


def error_block(path: Column, source: Column, errors: Column) -> Column:
    n = line_count(source)

    def line(e):
        labelled = F.coalesce(e["fileLabel"], F.lit("")) != ""
        where = F.when(labelled, cat(F.coalesce(e["file"], e["fileLabel"]), " ")).otherwise(F.lit(""))
        number = e["line"].cast("string")
        beyond = F.coalesce(~labelled & (e["line"] > n), F.lit(False))
        return F.when(beyond, cat("- inside a package (its line ", number, ", not `", path, "`): ", e["text"])).otherwise(cat("- ", where, "line ", number, ": ", e["text"]))

    return F.when(F.size(errors) > 0, cat("\nErrors:\n", F.array_join(F.transform(F.slice(errors, 1, 12), line), "\n"))).otherwise(F.lit(""))


def log_block(log: Column) -> Column:
    shown = strip(F.right(F.coalesce(log, F.lit("")), F.lit(LOG_CHARS)))
    return F.when(shown != "", cat("\n\nCompile log (tail):\n```\n", shown, "\n```")).otherwise(F.lit(""))


def fix_prompt(path: Column, source: Column, errors: Column, log: Column, tree: Column | None = None, full_lines: int = FULL_LINES, max_chars: int = SOURCE_CHARS) -> Column:
    extra = F.lit("") if tree is None else tree
    return cat(HEADER[0], path, HEADER[1], error_block(path, source, errors), extra, source_block(path, source, errors, full_lines, max_chars), log_block(log))


def project_tree(names: Column) -> Column:
    """The project's files, without what a build leaves."""
    kept = F.filter(names, lambda n: ~n.rlike(r"\.(aux|log|out|toc|bbl|blg|synctex\.gz)$") & (n != "main.pdf"))
    return cat("\n\nProject files:\n", tree_block(kept))


def insert_before(prompt: Column, context: Column, *markers: str) -> Column:
    """The context in front of the first marker that the prompt holds, else at its end."""
    places = F.array_compact(F.array(*[F.when(F.position(F.lit(m), prompt) > 0, F.position(F.lit(m), prompt)) for m in markers]))
    at = F.array_min(places)
    return F.when(at.isNull(), cat(prompt, context)).otherwise(cat(F.substring(prompt, F.lit(1), at - 1), context, F.substring(prompt, at, F.length(prompt))))


def messages(prompt: Column, target: Column | None = None, think_tokens: int = 0) -> Column:
    """Chat messages: system, user, and the assistant's if there is a target."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    base = F.array(turn("system", F.lit(system_prompt(think_tokens))), turn("user", prompt))
    return base if target is None else F.when(target.isNotNull(), F.array_append(base, turn("assistant", target))).otherwise(base)


def verifier_prompt(prompt: Column, fix: Column) -> Column:
    return cat(prompt, ASK[0], strip(fix), ASK[1])


def judge_prompt(source: Column, errors: Column, response: Column, radius: int = 12) -> Column:
    """The source around the first error, the messages and the answer; uses the messages' ``text``."""
    from tessella.operators.selection import around

    first = F.coalesce(F.get(errors, F.lit(0))["line"], F.lit(1))
    said = F.array_join(F.transform(errors, lambda e: cat("- line ", e["line"].cast("string"), ": ", e["text"])), "\n")
    return cat("Errors:\n", said, "\n\nSource:\n", around(source, first, radius), "\n\nAnswer:\n", response)


def companions(names: Column, wanted: Column, texts: Column, budget: int = 14_000, each: int = 6_000, most: int = 5) -> Column:
    """The first wanted files that a project has, whole if short, else their first 30 lines without comments; the list stops at the
    first that would exceed the budget."""
    have = F.slice(F.filter(F.array_distinct(wanted), lambda w: F.array_contains(names, w)), 1, most)

    def body(w):
        t = F.try_element_at(texts, w)
        short = F.array_join(F.slice(F.filter(lines(t), lambda x: ~F.ltrim(x).startswith("%")), 1, 30), "\n")
        return F.struct(w.alias("name"), F.when(F.length(t) <= each, t).otherwise(short).alias("body"))

    def step(s, x):
        fits = ~s["over"] & (s["n"] + F.length(x["body"]) <= budget)
        return F.struct((~fits).alias("over"), (s["n"] + F.when(fits, F.length(x["body"])).otherwise(0)).alias("n"), F.when(fits, F.array_append(s["out"], cat("\n\nFile `", x["name"], "`:\n```\n", x["body"], "\n```"))).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(False).alias("over"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(F.transform(have, body), start, step, lambda s: s["out"]), "")


__all__ = ["fix_prompt", "source_block", "error_block", "log_block", "messages", "system_prompt", "insert_before", "companions", "verifier_prompt", "judge_prompt", "project_tree", "numbered"]


def wanted_companions(reported: Column, root: Column, errors: Column, log: Column, texts: Column) -> Column:
    """Names of files worth showing beside the reported one, in order of discovery: files of the errors, files that the log's tail
    opens, inclusions around the first located error, the root, local classes and packages, all inclusions, and every bibliography
    if an error speaks of citations. The reported file itself is left out."""
    own, top = F.coalesce(F.try_element_at(texts, reported), F.lit("")), F.coalesce(F.try_element_at(texts, root), F.lit(""))
    include = r"\\(?:input|include|subfile)\s*\{([^{}]+)\}"
    package = r"\\(?:usepackage|RequirePackage|documentclass|LoadClass)(?:\[[^\]]*\])?\{([^}]+)\}"
    named = lambda x: F.flatten(F.transform(F.regexp_extract_all(x, F.lit(include), F.lit(1)), lambda n: F.array(n, F.concat(n, F.lit(".tex")))))
    styles = lambda x: F.flatten(F.transform(F.flatten(F.transform(F.regexp_extract_all(x, F.lit(package), F.lit(1)), lambda n: F.split(n, r"\s*,\s*"))), lambda n: F.array(F.concat(n, F.lit(".sty")), F.concat(n, F.lit(".cls")))))
    first = F.get(F.transform(F.filter(errors, lambda e: e["line"].isNotNull()), lambda e: e["line"]), F.lit(0))
    near = F.array_join(F.slice(lines(own), F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - RADIUS), 2 * RADIUS + 1), "\n")
    cites = F.exists(errors, lambda e: e["text"].rlike("(?i)citation|bibliograph"))
    bibs = F.sort_array(F.filter(F.map_keys(texts), lambda n: n.endswith(".bib")))
    none = F.array().cast("array<string>")
    found = F.concat(
        F.filter(F.transform(errors, lambda e: e["file"]), lambda f: f.isNotNull()),
        F.regexp_extract_all(F.right(log, F.lit(LOG_CHARS)), F.lit(r"\(\./([^\s()]+)"), F.lit(1)),
        F.when(first.isNotNull(), named(near)).otherwise(none),
        F.array(root),
        styles(F.concat(F.left(top, F.lit(6000)), F.lit("\n"), own)),
        named(own),
        F.when(cites, bibs).otherwise(none),
    )
    return F.filter(F.array_distinct(found), lambda f: f != reported)
