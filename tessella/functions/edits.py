"""Edit blocks as Column expressions: parsing, rendering, applying, measuring.

An edit is struct<file, search, replace>. Applying is sequential: each search must occur exactly once in the text as edited so far.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import content_chars, line_count, literal_count, replace_first, strip_comments

# The block format of answers, and the macros that give a document its structure.
BLOCK = r"(?s)<edit>\s*<<<<<<< SEARCH\n(.*?)\n?=======\n?(.*?)>>>>>>> REPLACE\s*</edit>"
FILE_BLOCK = r'(?s)<edit(?:\s+file="([^"]+)")?>\s*<<<<<<< SEARCH\n(.*?)\n?=======\n?(.*?)>>>>>>> REPLACE\s*</edit>'
STRUCTURE = (
    r"\\(?:includegraphics|begin\{[a-zA-Z*]+\}|cite[a-z]*|ref|label|item|section\*?|subsection\*?|caption|newcommand|renewcommand|def|newenvironment|usepackage|addplot|draw|node|footnote)(?![a-zA-Z])"
)
ROOT = "main.tex"
EDIT = "struct<file:string,search:string,replace:string>"


def _groups(x: Column, pattern: str, *groups: int) -> Column:
    names = "abc"
    return F.arrays_zip(*[F.regexp_extract_all(x, F.lit(pattern), F.lit(g)).alias(names[i]) for i, g in enumerate(groups)])


def _edit(file: Column, search: Column, replace: Column) -> Column:
    return F.struct(file.alias("file"), search.alias("search"), replace.alias("replace"))


def parse_edits(x: Column) -> Column:
    """Blocks without a file name; line feeds at a replacement's end are the format's."""
    return F.transform(_groups(x, BLOCK, 1, 2), lambda e: _edit(F.lit(ROOT), e["a"], F.regexp_replace(e["b"], r"\n+\z", "")))


def parse_file_edits(x: Column) -> Column:
    """Blocks with or without a file name; the root file where there is none."""
    return F.transform(_groups(x, FILE_BLOCK, 1, 2, 3), lambda e: _edit(F.when(F.coalesce(e["a"], F.lit("")) == "", ROOT).otherwise(e["a"]), e["b"], F.regexp_replace(e["c"], r"\n+\z", "")))


def parse_any(x: Column) -> Column:
    """File blocks if any block names a file, else plain blocks."""
    return F.when(x.contains("<edit file="), parse_file_edits(x)).otherwise(parse_edits(x))


def format_edits(edits: Column, files: bool = False) -> Column:
    def block(e):
        tag = F.concat(F.lit('<edit file="'), e["file"], F.lit('">')) if files else F.lit("<edit>")
        end = F.when(e["replace"] != "", F.concat(e["replace"], F.lit("\n"))).otherwise(F.lit(""))
        return F.concat(tag, F.lit("\n<<<<<<< SEARCH\n"), e["search"], F.lit("\n=======\n"), end, F.lit(">>>>>>> REPLACE\n</edit>"))

    return F.array_join(F.transform(edits, block), "\n\n")


def _problem(n: Column) -> Column:
    return F.when(n == 0, "SEARCH not found").when(n > 1, F.concat(F.lit("SEARCH ambiguous ("), n.cast("string"), F.lit(" matches)")))


def apply_edits(doc: Column, edits: Column) -> Column:
    """struct<doc, error>: stops at the first edit that does not fit, with the text as edited so far."""
    start = F.struct(doc.alias("doc"), F.lit(None).cast("string").alias("error"))

    def step(s, e):
        n = literal_count(s["doc"], e["search"])
        fits = s["error"].isNull() & (n == 1)
        return F.struct(
            F.when(fits, replace_first(s["doc"], e["search"], e["replace"])).otherwise(s["doc"]).alias("doc"),
            F.when(s["error"].isNull(), _problem(n)).otherwise(s["error"]).alias("error"),
        )

    none = F.struct(doc.alias("doc"), F.lit("no edit blocks parsed").alias("error"))
    return F.when(F.size(edits) == 0, none).otherwise(F.aggregate(edits, start, step))


def apply_file_edits(files: Column, edits: Column) -> Column:
    """struct<files, error> over a map of files."""
    start = F.struct(files.alias("files"), F.lit(None).cast("string").alias("error"))

    def step(s, e):
        text = F.try_element_at(s["files"], e["file"])
        n = literal_count(text, e["search"])
        fits = s["error"].isNull() & F.coalesce(n == 1, F.lit(False))
        changed = F.transform_values(s["files"], lambda k, v: F.when(k == e["file"], replace_first(v, e["search"], e["replace"])).otherwise(v))
        problem = F.when(text.isNull(), "no such file").otherwise(_problem(n))
        return F.struct(F.when(fits, changed).otherwise(s["files"]).alias("files"), F.when(s["error"].isNull(), problem).otherwise(s["error"]).alias("error"))

    none = F.struct(files.alias("files"), F.lit("no edit blocks parsed").alias("error"))
    return F.when(F.size(edits) == 0, none).otherwise(F.aggregate(edits, start, step))


def break_text(doc: Column, edits: Column) -> Column:
    """Each search's first occurrence replaced, unchecked."""
    return F.aggregate(edits, doc, lambda d, e: replace_first(d, e["search"], e["replace"]))


def reverse_edits(edits: Column) -> Column:
    """The edits that undo these."""
    return F.transform(F.reverse(edits), lambda e: _edit(e["file"], e["replace"], e["search"]))


def round_trips(doc: Column, edits: Column) -> Column:
    """Whether the edits apply and their reverse gives the text back."""
    there = apply_edits(doc, edits)
    back = apply_edits(there["doc"], reverse_edits(edits))
    return there["error"].isNull() & back["error"].isNull() & (back["doc"] == doc)


def deleted_chars(response: Column) -> Column:
    """Content characters that an answer takes away, over all its blocks."""
    return F.aggregate(parse_any(response), F.lit(0), lambda s, e: s + F.greatest(F.lit(0), content_chars(e["search"]) - content_chars(e["replace"])))


def edit_size(response: Column) -> Column:
    return F.aggregate(parse_any(response), F.lit(0), lambda s, e: s + content_chars(e["search"]) + content_chars(e["replace"]))


def diff_lines_of(edits: Column) -> Column:
    """Lines on both sides of all edits."""
    return F.aggregate(edits, F.lit(0), lambda s, e: s + line_count(e["search"]) + line_count(e["replace"]))


def structure_lost(before: Column, after: Column) -> Column:
    """How many structural macros, counted as a multiset, are gone."""
    found = lambda x: F.regexp_extract_all(strip_comments(x), F.lit(STRUCTURE), F.lit(0))
    a, b = found(before), found(after)
    count = lambda xs, y: F.size(F.filter(xs, lambda x: x == y))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, y: s + F.greatest(F.lit(0), count(a, y) - count(b, y)))


def sites_visible(edits: Column, prompt: Column, least: int = 8, prefix: int = 60, every: bool = True) -> Column:
    """Whether the prompt shows the changed lines of at least ``least`` characters, by their first ``prefix`` ones."""
    from .text import lines, strip

    changed = F.filter(F.flatten(F.transform(edits, lambda e: lines(e["search"]))), lambda x: F.length(strip(x)) >= least)
    shown = lambda x: F.contains(prompt, F.left(strip(x), F.lit(prefix)))
    return F.forall(changed, shown) if every else F.exists(changed, shown)


def breaks_visible(edits: Column, prompt: Column, least: int = 8, prefix: int = 60) -> Column:
    """Whether the prompt shows where every one of the edits that broke a text stands: the lines of at least ``least`` characters that it
    put there, or, where it put none, the first such line that it took away."""
    from .text import lines, strip

    long = lambda x: F.filter(F.transform(lines(x), strip), lambda t: F.length(t) >= least)
    marks = lambda e: F.when(F.size(long(e["replace"])) > 0, long(e["replace"])).otherwise(F.slice(long(e["search"]), 1, 1))
    return F.forall(F.flatten(F.transform(edits, marks)), lambda t: F.contains(prompt, F.left(t, F.lit(prefix))))
