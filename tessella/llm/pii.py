"""Personal data by candidates, boosted trees and calibrated thresholds, in built-in expressions.

Four strict patterns give the base spans; they always stay. High-recall generators then propose overlapping candidates: anything
around an @, any run of digits and separators, any long run of token characters. Features of format and context, each with a few
values, describe a candidate. Its weak label comes from elsewhere: an address or number counts as personal if a base span covers
it or a word before it says so, a token if the name before it says that it is a secret. None of these is a feature, so the trees
learn what such candidates look like and find others like them. How often each combination of features occurs, and how often it is
so labelled, is counted over all rows: at most 5 * ``MAX_VECTORS`` combinations reach the driver, by the features' ranges. A few
fixed examples (``EXAMPLES``) are counted with them, so that a small table learns too.

Boosted trees are fitted to these counts, each fifth of the rows scored by trees that have not seen it. A generator's threshold is
the least score at which the candidates that no base span covers are precise enough; without labelled ones among them it is the
score of a probability of ``PRECISION``. Candidates with a cue have a threshold of their own, found among such candidates alone. The trees are applied as CASE expressions. Chosen candidates that no base span overlaps
are added; a number that overlaps a card or an address that failed its check never is.

Matches have no positions in SQL; they follow from the lengths of the pieces that the same pattern splits a text into, summed by
doubling steps, so that a text with many matches costs n log n.

Defined results: a null or empty text has no spans; positions are code points, the end exclusive; texts of any length are read
whole; repeated rows keep their rows; a null id is kept; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty

# The strict kinds, in order: pattern, and what a text must hold for a search to be worth while. Possessive quantifiers and look-
# behinds only spare searches that cannot succeed. Shorter and longer runs of digits are no cards, so they are not matched at all.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
GENERATORS = {
    "email": (r"[^\s@<>|]{1,200}+@[^\s@<>|]{1,200}+", "@"),
    "number": (r"(?<![A-Za-z0-9])\+?[0-9](?:[ ().-]{0,3}[0-9]){4,40}+(?![A-Za-z0-9])", "[0-9]"),
    # A name up to its = is no part of the value.
    "secret": (r"(?<![A-Za-z0-9_/+-])(?![A-Za-z_][A-Za-z0-9_-]*+=[A-Za-z0-9_/+-])[A-Za-z0-9_/+-][A-Za-z0-9_/+=-]{19,}+", r"[A-Za-z0-9_/+=-]{20}"),
}
KINDS = ["email", "ip", "card", "phone", "number", "secret"]
# Fixed cue words: names that announce a secret, and names that announce contact or payment data. They label, and are no features.
SECRET_CUE = r"(?i)(?:token|secret|passw(?:or)?d|api[ _-]?key|access[ _-]?key)[\"']?\s*[=:]\s*[\"']?$"
CONTACT_CUE = r"(?i)(?:mail|phone|tel|fax|call|mobile|card|iban|account|ssn|address|ip)\W{0,3}$"
RANGES = {"generator": 3, "length": 5, "digits": 4, "upper": 3, "hexadecimal": 2, "separators": 3, "quoted": 2, "assigned": 2, "domain": 2}
MAX_VECTORS = int(np.prod(list(RANGES.values())))
PRECISION, ROUNDS, RATE, FOLDS = 0.9, 30, 0.3, 5
STEPS, ANY = 31, -1e300
# Fixed examples of our own: how secrets and contacts are written, and what only looks like them.
EXAMPLES = [
    'token = "0f3a9c55d7e1b2648a90cc13ef5d7720b4a6e811"', "api_key: 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "password='Zq8vT2mLx0Rk7Yw5Nc3B'", "secret=dGhpcyBpcyBhIHNlY3JldCB2YWx1ZQ==",
    "ACCESS_KEY=AKQ7Z2M4X9L1B8V5T3R6", 'token = "8D3F0A6B1C9E4725F0B8A1D6C3E97542AB60FD18"', "mail: someone@localhost", "phone: (030) 123 45 67", "call 0171-555-01-99",
    "Rechtsschutzversicherungsgesellschaften", "internationalization_and_localization", "see docs/operators/line-dedup/overview", "________________________", "------------------------------",
    "pages 10 20 30 40 50", "in 2019 - 2020 - 2021", "version 1.2.3.4.5.6", "user@@host", "a @ b", "x@y z",
]


def sql(x: str) -> str:
    """A string as an SQL literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _powers(ks) -> str:
    return f"array({', '.join(str(1 << k) for k in ks)})"


def running(xs: str, step: str) -> str:
    """SQL of running totals of an array under an associative ``step`` of p (before) and x, by doubling. ``STEPS`` doublings are as
    many as an array can have; those beyond its size do nothing."""
    shifted = f"transform(a, (x, i) -> if(i >= d, transform(array(a[greatest(i - d, 0)]), p -> {step})[0], x))"
    return f"aggregate({_powers(range(STEPS))}, {xs}, (a, d) -> if(size(a) > d, {shifted}, a))"


def found(text: str, pattern: str, worth: str) -> str:
    """SQL of a pattern's matches, array<struct<start, end, m>>: leftmost, not overlapping."""
    pairs = f"filter(arrays_zip(split({text}, {sql(pattern)}, -1), regexp_extract_all({text}, {sql(pattern)}, 0)), p -> p.`1` IS NOT NULL)"
    ends = running("transform(s, p -> length(p.`0`) + length(p.`1`))", "p + x")
    placed = f"transform(array({pairs}), s -> transform(array({ends}), e -> transform(s, (p, i) -> named_struct('start', e[i] - length(p.`1`), 'end', e[i], 'm', p.`1`)))[0])[0]"
    return f"if({text} RLIKE {sql(worth)}, {placed}, cast(array() AS array<struct<start:int,end:int,m:string>>))"


# Whether a match ``m`` passes its kind's check; the sum of a card's digits is Luhn's.
LUHN = "aggregate(transform(split(reverse(regexp_replace(m.m, '[^0-9]', '')), ''), (c, i) -> if(i % 2 = 0, int(c), int(c) * 2 - if(int(c) > 4, 9, 0))), 0, (s, x) -> s + x) % 10 = 0"
VALID = {
    "email": "true",
    "ip": f"m.m RLIKE {sql(rf'^{OCTET}[.]{OCTET}[.]{OCTET}[.]{OCTET}$')}",
    "card": LUHN,
    "phone": "length(regexp_replace(m.m, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def checked(kind: str, text: str) -> Column:
    """array<struct<start, end, ok>> of a kind's strict matches; ``ok``: whether a match passes the kind's check."""
    return F.expr(f"transform({found(text, *BASE[kind])}, m -> named_struct('start', m.start, 'end', m.end, 'ok', {VALID[kind]}))")


def reach(spans: str) -> str:
    """SQL of spans by their start, ``end`` raised to the furthest end so far; for ``overlap``."""
    return running(f"array_sort({spans})", "named_struct('start', x.start, 'end', greatest(p.end, x.end))")


def overlap(far: str) -> str:
    """SQL of how many code points of ``m`` the last span that starts before its end reaches over; ``far`` as ``reach`` gives it."""
    last = f"aggregate({_powers(reversed(range(STEPS)))}, -1, (at, d) -> if(at + d < size({far}) AND {far}[at + d].start < m.end, at + d, at))"
    return f"coalesce(transform(array({last}), l -> if(l < 0, 0, greatest(0, least({far}[l].end, m.end) - greatest({far}[l].start, m.start))))[0], 0)"


def _bin(x: str, *edges) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {e}D THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"


def candidates(text: str, base: str, failed: str) -> Column:
    """array<struct<start, end, features, free, cue, y>> of a text; ``base`` and ``failed`` are columns of spans. ``free``: no base
    span, and of numbers no failed one, overlaps; ``cue``: a word before it says what it is; ``y``: the weak label."""
    features = {
        "length": _bin("length(m.m)", 8, 13, 19, 32),
        "digits": _bin("length(regexp_replace(m.m, '[^0-9]', '')) / length(m.m)", 0.05, 0.5, 0.95),
        "upper": _bin("length(regexp_replace(m.m, '[^A-Z]', '')) / length(m.m)", 0, 0.5),
        "hexadecimal": "int(m.m RLIKE '^[0-9a-fA-F]+$')",
        "separators": _bin("length(regexp_replace(m.m, '[A-Za-z0-9]', ''))", 0, 3),
        "quoted": f"int(m.before RLIKE {sql("[\"'`]$")})",
        "assigned": f"int(m.before RLIKE {sql("\\w[\"']?\\s*[=:]\\s*[\"'`]?$")})",
        "domain": "int(m.m RLIKE '@[A-Za-z0-9-]+[.][A-Za-z]')",
    }
    assert ["generator", *features] == list(RANGES)

    def described(g, kind):
        met = f"named_struct('start', m.start, 'end', m.end, 'm', m.m, 'over', {overlap('far')}, 'bad', {overlap('bad')}, 'before', substring({text}, greatest(m.start - 23, 1), least(m.start, 24)))"
        free = "m.over = 0 AND m.bad = 0" if kind == "number" else "m.over = 0"
        cue = f"m.before RLIKE {sql(SECRET_CUE if kind == 'secret' else CONTACT_CUE)}"
        y = "x.cue" if kind == "secret" else "(m.over * 5 >= (m.end - m.start) * 4 OR x.free AND x.cue)"
        fields = ", ".join(f"'{k}', {v}" for k, v in {"generator": g, **features}.items())
        marked = f"transform(array(named_struct('free', {free}, 'cue', {cue})), x -> named_struct('start', m.start, 'end', m.end, 'features', named_struct({fields}), 'free', x.free, 'cue', x.cue, 'y', int({y})))[0]"
        return f"transform(transform({found(text, *GENERATORS[kind])}, m -> {met}), m -> {marked})"

    every = ", ".join(described(g, kind) for g, kind in enumerate(GENERATORS))
    return F.expr(f"transform(array({reach(base)}), far -> transform(array({reach(failed)}), bad -> concat({every}))[0])[0]")


def fit(counts: list, rounds: int = ROUNDS, rate: float = RATE, depth: int = 3) -> list:
    """Boosted trees (log loss) over (features, n, positives); a tree is a number or (feature, edge, left, right)."""
    x = np.array([c[0] for c in counts], dtype=np.int64)
    n, p = np.array([c[1] for c in counts], dtype=float), np.array([c[2] for c in counts], dtype=float)
    prior = float(np.log((p.sum() + 0.5) / (n.sum() - p.sum() + 0.5)))
    score, trees = np.full(len(n), prior), [prior]

    def grow(rows, g, h, level):
        best, total = None, g[rows].sum() ** 2 / (h[rows].sum() + 1)
        if level < depth:
            for f in range(x.shape[1]):
                for edge in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= edge
                    a, b = rows[left], rows[~left]
                    gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - total
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = gain, f, int(edge), a, b
        if best is None:
            return float(rate * g[rows].sum() / (h[rows].sum() + 1))
        return best[1], best[2], grow(best[3], g, h, level + 1), grow(best[4], g, h, level + 1)

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(n)), p - n * q, n * q * (1 - q), 0)
        trees.append(tree)
        score = score + np.array([_at(tree, row) for row in x])
    return trees


def _at(tree, row):
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def predict(trees, row) -> float:
    return sum(_at(t, row) for t in trees)


def as_expression(trees, features: str) -> str:
    """SQL of the boosted score of a struct of features, as nested CASE expressions."""
    names = list(RANGES)

    def node(t):
        return f"{t!r}D" if isinstance(t, float) else f"CASE WHEN {features}.{names[t[0]]} <= {t[1]} THEN {node(t[2])} ELSE {node(t[3])} END"

    return " + ".join(f"({node(t)})" for t in trees)


def thresholds(scored: list, precision: float = PRECISION) -> list[float]:
    """For each generator, the least score at which (generator, score, n, positives) of free candidates are precise enough, none
    (``ANY``) if all of them together are; without positives, or if no score is precise enough, the score of that probability, or
    just above all that were seen to be wrong."""
    out, fixed = [], float(np.log(precision / (1 - precision)))
    for g in range(RANGES["generator"]):
        own = sorted(((s, n, p) for k, s, n, p in scored if k == g), reverse=True)
        cut, n, p = None, 0, 0
        for i, (s, a, b) in enumerate(own):
            n, p = n + a, p + b
            if p and p >= precision * n and (i + 1 == len(own) or own[i + 1][0] < s):
                cut = s if i + 1 < len(own) else ANY
        out.append(float(cut) if cut is not None else max([fixed, *(s + 1e-9 for s, a, b in own if b < a)]))
    return out


def learned(counts: list) -> tuple[list, list[float], list[float]]:
    """Trees, thresholds of all candidates and thresholds of those with a cue, from (fold, features, free, cue, n, positives); the
    fixed examples are fold -1 and in every training set. Look-alikes without a cue raise the first thresholds only, so they hide
    none that a word before it names."""

    def merged(rows):
        total: dict = {}
        for _, f, _, _, n, p in rows:
            a, b = total.get(f, (0, 0))
            total[f] = a + n, b + p
        return [(f, *v) for f, v in sorted(total.items())]

    scored: list = []
    for k in range(FOLDS):
        trees = fit(merged([c for c in counts if c[0] != k]))
        seen: dict = {}
        scored += [(c[1][0], seen.setdefault(c[1], predict(trees, c[1])), c[4], c[5], c[3]) for c in counts if c[0] == k and c[2]]
    return fit(merged(counts)), thresholds([c[:4] for c in scored]), thresholds([c[:4] for c in scored if c[4]])


def detect(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, email, ip, card, phone: array<struct<start, end>>, added: array<struct<kind, start, end>>) of each whole text."""
    t = F.col("t_")

    place = lambda k, ok: F.expr(f"transform(filter({k}, s -> {ok}), s -> named_struct('start', s.start, 'end', s.end))")
    own = docs.select(F.col(id), text_or_empty(text).alias("t_"), (F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(1)) % FOLDS).cast("int").alias("fold_"))
    given = docs.sparkSession.createDataFrame([(x, -1) for x in EXAMPLES], "t_ string, fold_ int")
    rows = own.unionByName(given, allowMissingColumns=True)
    rows = rows.select(id, "fold_", "t_", *[checked(k, "t_").alias(k) for k in BASE])
    rows = rows.withColumn("failed_", F.concat(place("ip", "NOT s.ok"), place("card", "NOT s.ok"))).withColumns({k: place(k, "s.ok") for k in BASE})
    rows = materialise(rows.withColumn("c_", candidates("t_", "concat(email, ip, card, phone)", "failed_")).drop("t_", "failed_"))
    each = rows.select("fold_", F.explode("c_").alias("c"))
    counts = each.groupBy(F.col("fold_").alias("fold"), "c.features", "c.free", "c.cue").agg(F.count("*").alias("n"), F.sum("c.y").alias("p")).collect()  # at most 24 * MAX_VECTORS rows
    seen = rows.filter("fold_ >= 0").drop("fold_")
    trees, cuts, cued = learned(sorted((r.fold, tuple(r.features[f] for f in RANGES), r.free, r.cue, r.n, r.p) for r in counts))
    of_generator = lambda xs: f"array({', '.join(f'{x!r}D' for x in xs)})[c.features.generator]"
    chosen = f"filter(c_, c -> c.free AND ({as_expression(trees, 'c.features')}) >= if(c.cue, least({of_generator(cued)}, {of_generator(cuts)}), {of_generator(cuts)}))"
    kind = f"array({', '.join(map(sql, GENERATORS))})[c.features.generator]"
    return seen.withColumn("added", F.expr(f"array_sort(transform({chosen}, c -> named_struct('kind', {kind}, 'start', c.start, 'end', c.end)))")).drop("c_")


def listed(spans: str) -> Column:
    """kind:start:end of array<struct<k, start, end>> by kind as listed, then start, comma-joined."""
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat_ws(':', array({', '.join(map(sql, KINDS))})[s.k], s.start, s.end)), ',')")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_rows(table(spark, sf_dir, "documents"))


def op2_rows(docs: DataFrame) -> DataFrame:
    spans = detect(docs)
    base = "concat(" + ", ".join(f"transform({k}, s -> named_struct('k', {n}, 'start', s.start, 'end', s.end))" for n, k in enumerate(BASE)) + ")"
    more = f"transform(added, s -> named_struct('k', int(array_position(array({', '.join(map(sql, KINDS))}), s.kind)) - 1, 'start', s.start, 'end', s.end))"
    return spans.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(f"concat({base}, {more})").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.expr("size(email) + size(ip) + size(card) + size(phone) + size(added)").cast("long").alias("n_spans"),
    )
