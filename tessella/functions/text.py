"""Text functions as Column expressions.

Patterns follow Python's semantics: ``U`` makes classes Unicode-aware, ``D`` makes only a line feed end a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U, D = "(?U)", "(?d)"


def wskey(x: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(x, U + r"\s+", " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, U + r"^\s+|\s+\z", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, U + r"\s+\z", "")


def indent_of(x: Column) -> Column:
    return F.regexp_extract(x, U + r"^\s*", 0)


def strip_comments(x: Column) -> Column:
    """Without the unescaped ``%`` of each line and what follows it."""
    return F.regexp_replace(x, D + r"(?<!\\)%.*", "")


def content_chars(x: Column) -> Column:
    """Characters that are neither white space nor comment."""
    return F.length(F.regexp_replace(strip_comments(x), U + r"\s+", ""))


# What an error message's particulars look like, in the order in which they are replaced.
PARTICULARS = [
    (U + r"^(?:! |\S+\.tex:\d+: )", ""),
    (r"`[^']*'|'[^']*'|\"[^\"]*\"", "'X'"),
    (r"\\[A-Za-z@]+", r"\\CS"),
    (r"\{[^{}]*\}", "{X}"),
    (U + r"\d+", "N"),
]


def normalize_error(x: Column) -> Column:
    """An error message with its particulars replaced: prefix, quotations, macros, groups, numbers; 70 characters, trimmed."""
    for pattern, by in PARTICULARS:
        x = F.regexp_replace(x, pattern, by)
    return strip(F.left(x, F.lit(70)))


# How logs name a missing file, and a character that is not set up.
UNICODE_CHARACTER = D + r"unicode character .+? \(u\+[0-9a-f]+\)"
FILE_NOT_FOUND = r"File `([^']+)' not found|Cannot find file `([^']+)'|Could not open file (\S+),"


def missing_file(excerpt: Column) -> Column:
    """The file that an excerpt says is missing; null without one."""
    names = [F.regexp_extract(excerpt, FILE_NOT_FOUND, g) for g in (1, 2, 3)]
    return F.coalesce(*[F.when(n != "", n) for n in names])


def error_signature(message: Column, excerpt: Column) -> Column:
    """A bin for a first error: quoted names go unless a file is missing, lost bytes stay a bin of their own, numbers go, the macro of
    an undefined control sequence stays; 100 characters."""
    m = F.when(message.rlike(FILE_NOT_FOUND), message).otherwise(F.regexp_replace(message, r"`[^']*'", "`<x>'"))
    m = F.lower(strip(m))
    m = F.when(m.contains("u+fffd"), m).otherwise(F.regexp_replace(m, UNICODE_CHARACTER, "unicode character <c> (u+<n>)"))
    m = F.regexp_replace(m, U + r"\d+", "<n>")
    line = F.regexp_extract(excerpt, r"(?m)(?d)^l\.\d+.*$", 0)
    macro = F.regexp_extract(line, r"(\\[A-Za-z@]+|\\.)\s*$", 1)
    return F.left(F.when(m.contains("undefined control sequence") & (macro != ""), F.concat(m, F.lit(" "), macro)).otherwise(m), F.lit(100))


def strip_tags(x: Column, by: str = "\n") -> Column:
    return F.regexp_replace(x, "<[^>]+>", by)


def unescape_basic(x: Column) -> Column:
    """The five XML entities and the no-break space; ``python_text.unescape`` knows all names."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def strip_thought(x: Column) -> Column:
    """Without the first block of ``<think>`` and the space after it."""
    return F.concat_ws("", F.split(x, U + r"(?s)<think>.*?</think>\s*", 2))


def newlines(x: Column) -> Column:
    """CRLF and CR as LF."""
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def slug(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_.-]", "_")


def tail(x: Column, n: int) -> Column:
    return F.right(x, F.lit(n))


def literal_count(x: Column, s: Column) -> Column:
    """Non-overlapping occurrences of a literal; an empty one occurs once more than there are characters."""
    n = F.length(x)
    return F.when(F.length(s) == 0, n + 1).otherwise(((n - F.length(F.replace(x, s, F.lit("")))) / F.greatest(F.length(s), F.lit(1))).cast("int"))


def replace_first(x: Column, s: Column, r: Column) -> Column:
    """The first occurrence of a literal replaced; an empty one stands before the text."""
    at = F.position(s, x)
    return F.when(F.length(s) == 0, F.concat(r, x)).when(at == 0, x).otherwise(F.concat(F.substring(x, F.lit(1), at - 1), r, F.substring(x, at + F.length(s), F.length(x))))


def tree_block(names: Column, shown: int = 40) -> Column:
    """Sorted names, one a line behind a dash, up to ``shown`` and how many more."""
    s = F.sort_array(names)
    more = F.size(s) - shown
    listed = F.array_join(F.transform(F.slice(s, 1, shown), lambda n: F.concat(F.lit("- "), n)), "\n")
    return F.concat(listed, F.when(more > 0, F.concat(F.lit("\n- ... ("), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")))


def numbered(x: Column, first: int = 1) -> Column:
    return F.array_join(F.transform(F.split(x, "\n", -1), lambda s, i: F.concat((i + first).cast("string"), F.lit(": "), s)), "\n")


def lines(x: Column) -> Column:
    """Pieces between line feeds, as ``split("\\n")``."""
    return F.split(x, "\n", -1)


def splitlines(x: Column) -> Column:
    """Lines by every line boundary that Python knows; the empty piece after a last boundary does not count."""
    parts = F.split(x, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1


def pick_engine(x: Column) -> Column:
    """The engine that a preamble (with local classes' text) asks for."""
    use = r"\\(?:usepackage|RequirePackage)(?:\[[^\]]*\])?\{[^}]*"
    return (
        F.when(x.rlike(use + "(?:fontspec|polyglossia|unicode-math|xeCJK)"), "xelatex")
        .when(x.rlike(use + r"(?:luacode|luatextra)|\\directlua"), "lualatex")
        .otherwise("pdflatex")
    )


def texlive_version(log: Column) -> Column:
    year = F.regexp_extract(F.left(log, F.lit(300)), U + r"TeX Live (\d{4})", 1)
    return F.when(year != "", F.concat(F.lit("TeX Live "), year))


def label_of(x: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """The label of the first name, in order, that the text holds."""
    out = F.lit(default) if default is not None else x
    for name, label in reversed(labels.items()):
        out = F.when(x.contains(name), label).otherwise(out)
    return out


def swap_adjacent(x: Column, at: Column) -> Column:
    """Characters ``at`` and ``at + 1`` (from 1) exchanged."""
    one = F.lit(1)
    return F.concat(F.substring(x, one, at - 1), F.substring(x, at + 1, one), F.substring(x, at, one), F.substring(x, at + 2, F.length(x)))


def judge_choice(reply: Column, n: Column) -> Column:
    """The candidate, from 0, that a judge's reply names last: ``candidate k`` near the end, else a number at the very end, else any
    number; null if it is none of 1 to n."""
    t = strip(reply)

    def last(x, pattern):
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
        return F.when(F.size(found) > 0, F.element_at(found, -1))

    k = F.coalesce(last(F.right(t, F.lit(300)), r"[Cc]andidate\s*(\d+)"), last(F.right(t, F.lit(40)), r"(\d+)"), last(t, r"(\d+)")).cast("int")
    return F.when(k.between(1, n), k - 1)


def first_json(x: Column, schema: str) -> Column:
    """The JSON object between the first and the last brace of a free text."""
    return F.from_json(F.regexp_extract(x, r"(?s)\{.*\}", 0), schema)


def sorted_json(m: Column) -> Column:
    """A map as JSON with sorted keys: a key for maps."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def license_of(created: Column) -> Column:
    """Content licence by ISO date of the post."""
    return F.when(created < "2011-04-08", "CC-BY-SA-2.5").when(created < "2018-05-02", "CC-BY-SA-3.0").otherwise("CC-BY-SA-4.0")


def year_of_paper(id: Column) -> Column:
    """Year from a paper id, ``YYMM.n`` or ``archive/YYMMnnn``; two digits over 90 are of the last century."""
    new, old = F.regexp_extract(id, r"^(\d{2})\d{2}\.\d+", 1), F.regexp_extract(id, r"/(\d{2})\d{5}", 1)
    yy = F.when(new != "", new).when(old != "", old).cast("int")
    return F.when(yy > 90, yy + 1900).otherwise(yy + 2000)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sha1_mod(x: Column, n: int) -> Column:
    """The SHA-1 of a text, as a whole number, modulo n: folded digit by digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.position(F.substring(F.sha1(x), i, F.lit(1)), F.lit("0123456789abcdef")) - 1)
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % n)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def line_set(x: Column) -> Column:
    """Distinct non-empty stripped lines."""
    return F.array_distinct(F.filter(F.transform(splitlines(x), lambda s: strip(s)), lambda s: s != ""))


def path_leaks(x: Column) -> Column:
    """How many absolute local paths a text names."""
    return F.regexp_count(x, F.lit("/(?:Users|home|private|tmp|var/folders)/"))
