"""Benchmark decontamination by winnowing, in built-in expressions.

Texts become words (A-Z lower-cased; digits, a-z and every character beyond ASCII make words). Runs of ``gram`` words are hashed,
and of every ``window - gram + 1`` consecutive hashes the least is kept (the first of equals), as a fingerprint with its place. Two
texts that share ``window`` words in a row share all hashes of one such stretch, so they keep the same one of them: no shared
span of that length is missed. Documents and benchmark are joined on fingerprints; each hit is extended word by word to both sides,
as far as a window can reach, and stands if the agreeing words make a whole window. The words themselves are compared, so a clash
of hashes adds nothing. All windows that cover a document's word are found from a fingerprint inside them; spans are merged.

An item shorter than a window is one window. Stretches are then as short as the shortest item of at least ``gram`` words needs; items of
fewer words have grams of their own length, all of them kept.

The benchmark's hashes also set bits of one map of at most ``MAP_BITS`` bits, a constant of the plan: fingerprints without a
bit are dropped before they leave a document's row, so rows are made of likely hits only, each with its few words of context. The map
lets others pass in a large benchmark, which costs time and no hit. Benchmark sides are broadcast up to ``broadcast_rows`` rows; beyond
that they are joined by shuffling, where adaptive execution splits a hot fingerprint. Benchmark texts with equal words are
one class, so copies of an item cost one row a document.

Defined results: null and empty texts have no words, hit nothing and are never hit; benchmark rows with a null id take no part; rows
of one item id are one item; repeated documents keep their rows; no documents give no rows, no benchmark hits nothing; texts are read
whole; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

WINDOW, GRAM = 10, 5
MAP_BITS = 1 << 22
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none of a null text."""
    return F.filter(F.split(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), BETWEEN, -1), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(w: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    runs = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
    return _let(hashed, runs)


def winnow(hashes: Column, stretch: int) -> Column:
    """(at, hash) of the least hash of every ``stretch`` consecutive ones, the first of equals, each once."""

    def least(h):
        def of(x, i):
            near = [x, *[F.get(h, i + k) for k in range(1, stretch)]]
            least_ = F.least(*near) if stretch > 1 else x
            step = reduce(lambda rest, k: F.when(near[k] == least_, F.lit(k)).otherwise(rest), range(stretch - 2, -1, -1), F.lit(stretch - 1))
            return F.struct((i + step).alias("at"), least_.alias("hash"))

        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (stretch - 1), F.lit(0))), of)

    # A stretch that keeps what the one before it keeps adds nothing.
    return _let(_let(hashes, least), lambda m: F.filter(m, lambda x, i: (i == 0) | (x["at"] != F.get(m, i - 1)["at"])))


def _reach(w: Column, at: Column, size: int, window: int) -> tuple[Column, Column, Column]:
    """(gram, words before it with the nearest first, words after it) as far as a window around the gram can reach."""
    side = window - size
    before = F.transform(F.sequence(F.lit(1), F.lit(side)), lambda k: F.get(w, at - k)) if side else F.array().cast("array<string>")
    return F.slice(w, at + 1, F.lit(size)), before, F.slice(w, at + size + 1, F.lit(side))


def levels(items: DataFrame, window: int, gram: int) -> list[tuple[int, int]]:
    """(words of a gram, hashes of a stretch) that find every item's windows, from the lengths below a window that there are."""
    short = sorted(r.m for r in items.filter(F.col("m") < window).select("m").distinct().collect())
    shortest = min([m for m in short if m >= gram], default=window)
    return [(m, 1) for m in short if m < gram] + [(gram, shortest - gram + 1)]


def _fingerprints(w: Column, level: tuple[int, int], window: int) -> Column:
    size, stretch = level
    return _let(w, lambda v: F.transform(winnow(grams(v, size), stretch), lambda x: F.struct(F.lit(size).alias("size"), x["at"].alias("at"), x["hash"].alias("hash"))))


def _bit_map(prints: DataFrame, n: int, bits: int) -> tuple[Column, int]:
    """(words of 32 bits as a constant array, bits) of the hashes; of at most ``bits`` bits."""
    size = 1 << 12
    while size < min(bits, 64 * n):
        size *= 2
    at = F.pmod(F.col("hash"), F.lit(size))
    held = prints.select(F.shiftright(at, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(31)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = {r.w: r.b for r in held.collect()}  # at most size / 32 rows
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(size // 32))), ",").cast("array<bigint>"), size


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _agreeing(own: str, other: str, most: int) -> Column:
    """How many of the first ``most`` words of both agree, up to the first that does not."""
    same = lambda k: F.coalesce(F.get(own, F.lit(k)) == F.get(other, F.lit(k)), F.lit(False))
    return reduce(lambda rest, k: F.when(same(k), rest).otherwise(F.lit(k)), range(most - 1, -1, -1), F.lit(most))


def leaks(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, map_bits: int = MAP_BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, n_words, spans, items): each document's words that are in an occurrence of a window, as disjoint spans (start, end
    exclusive) in order, and the ids, distinct and as strings in order, of the items whose windows occur."""
    if not 0 < gram <= window:
        raise ValueError("a gram has from one word to a window's")
    classes = materialise(
        benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
        .groupBy("w").agg(F.collect_set("item").alias("items")).select(F.sha2(F.array_join("w", " "), 256).alias("class"), "w", F.size("w").alias("m"), "items")
    )
    found = levels(classes, window, gram)
    made = []
    for size, stretch in found:
        at_level = classes.filter(F.col("m") == size) if size < gram else classes.filter(F.col("m") >= gram)
        whole, before, after = _reach(F.col("w"), F.col("p.at"), size, window)
        made.append(at_level.select("class", "m", "w", F.explode(_fingerprints(F.col("w"), (size, stretch), window)).alias("p")).select("p.size", "p.hash", whole.alias("i_gram"), before.alias("i_before"), after.alias("i_after"), F.least(F.col("m"), F.lit(window)).alias("need"), "class"))
    prints = materialise(reduce(DataFrame.unionByName, made).distinct())
    n = prints.count()
    rows = docs.select(F.col(id).alias("id"), words(F.col(text)).alias("w"))
    schema = "array<struct<size:int,at:int,hash:bigint,d_gram:array<string>,d_before:array<string>,d_after:array<string>>>"
    if n:
        bits, size = _bit_map(prints, n, map_bits)

        def likely(level):
            passes = lambda x: F.call_function("shiftright", F.get(bits, F.shiftright(F.pmod(x["hash"], F.lit(size)), 5).cast("int")), F.pmod(x["hash"], F.lit(32)).cast("int")).bitwiseAND(F.lit(1)) == 1
            return F.filter(_fingerprints(F.col("w"), level, window), passes)

        def reaching(level):
            def reach(x):
                whole, before, after = _reach(F.col("w"), x["at"], level[0], window)
                return F.struct(x["size"].alias("size"), x["at"].alias("at"), x["hash"].alias("hash"), whole.alias("d_gram"), before.alias("d_before"), after.alias("d_after"))

            return F.transform(likely(level), reach)

        hits = F.concat(*[reaching(level) for level in found]).cast(schema)
    else:
        hits = F.array().cast(schema)
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("w").cast("long").alias("n_words"), hits.alias("hits")))
    none = rows.filter(F.size("hits") == 0).select("row", "id", "n_words", F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    if not n:
        return none.drop("row")
    hit = rows.filter(F.size("hits") > 0).select("row", "id", "n_words", F.explode("hits").alias("h")).select("row", "id", "n_words", "h.*")
    # All of a row's likely hits may be none, so rows stay by a left join, and spans that do not stand are null.
    met = hit.join(_small(prints, n, broadcast_rows), ["size", "hash"], "left")
    left, right = _agreeing("d_before", "i_before", window - 1), _agreeing("d_after", "i_after", window - 1)
    stands = F.coalesce((F.col("d_gram") == F.col("i_gram")) & (left + F.col("size") + right >= F.col("need")), F.lit(False))
    span = F.struct((F.col("at") - left).alias("start"), (F.col("at") + F.col("size") + right).alias("end"))
    spanned = met.select("row", "id", "n_words", F.when(stands, F.col("class")).alias("class"), F.when(stands, span).alias("span"))
    by_class = spanned.groupBy("row", "id", "n_words", "class").agg(F.collect_set("span").alias("spans"))
    n_classes = classes.count()
    named = by_class.join(_small(classes.select("class", "items"), n_classes, broadcast_rows), "class", "left")
    by_row = named.groupBy("row", "id", "n_words").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return by_row.withColumn("spans", merged(F.col("spans"))).unionByName(none).drop("row")


def merged(spans: Column) -> Column:
    """Sorted spans as disjoint ones: a span begins where none before it reaches, and ends before the next that does."""
    kind = "struct<ends:array<int>,most:int>"
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(-1).alias("most")).cast(kind)
    # For each span the furthest end of those before it; then spans that begin beyond it start an island.
    step = lambda s, x: F.struct(F.concat(s["ends"], F.array(s["most"])).alias("ends"), F.greatest(s["most"], x["end"]).alias("most")).cast(kind)

    def islands(reach):
        firsts = F.filter(F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), F.get(reach["ends"], i).alias("before"))), lambda p: p["start"] > p["before"])
        return _let(firsts, lambda f: F.transform(f, lambda p, i: F.struct(p["start"].alias("start"), F.coalesce(F.get(f, i + 1)["before"], reach["most"]).alias("end"))))

    return _let(F.aggregate(spans, start, step), islands)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = leaks(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""with d as materialized (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
pieces as (select distinct item_id, least(len(w), 10) as m, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') as run
 from (select item_id, w, unnest(range(greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
sizes as (select distinct m from pieces),
runs as (select r, m, i, array_to_string(w[i + 1:i + m], ' ') as run from (select r, w, m, unnest(range(greatest(len(w) - m + 1, 0))) as i from d join sizes on true)),
hits as materialized (select r, i, m, item_id from runs join pieces using (m, run)),
places as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from hits) group by r),
items as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (r) left join items using (r)"""
