"""One-permutation MinHash fingerprints in built-in expressions.

Each shingle of five words is hashed once. The hash's top bits choose one of ``2 ** BIN_BITS`` bins, which keeps its least hash.
Empty bins are filled by optimal densification: bin i takes the first non-empty bin of a random order of bins of its own, the same
for every text. Of each bin the low eight bits are stored, eight bins to a long. Likeness is the share of equal bins, corrected
for the equality by chance of eight random bits.

Sorting a text's hashes, with the largest hash of every bin added, puts each bin's least first; an added one marks an empty bin.

Defined results: fewer words than a shingle make one shingle; a text without words has fingerprint zero and is like another such
text (1) and unlike any other (0); a null text is taken as empty; texts of any length are read whole; repeated rows keep their
rows; a null id sorts first; rows of one id are ordered by text; extra columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, text_or_empty

BIN_BITS, SHINGLE, PROBES = 8, 5, 4
BINS = 1 << BIN_BITS
SHIFT = 63 - BIN_BITS
ONES = (1 << SHIFT) - 1
_rng = random.Random(3)
ORDER = [j for _ in range(BINS) for j in _rng.sample(range(BINS), PROBES)]


def hashes(text: Column, size: int = SHINGLE) -> Column:
    """Non-negative 63-bit hashes of a text's shingles, in order; of all its words if they are fewer."""
    words = F.filter(F.split(text, "[ \\t-\\r]+", -1), lambda w: w != "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) >= size,
        F.transform(F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]).bitwiseAND(F.lit((1 << 63) - 1))),
    ).when(F.size(h) > 0, F.array(F.xxhash64(h).bitwiseAND(F.lit((1 << 63) - 1)))).otherwise(F.array().cast("array<bigint>")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def minhash(text: Column) -> Column:
    """Packed fingerprint: BINS / 8 longs."""
    ends = F.array(*[F.lit((b << SHIFT) | ONES) for b in range(BINS)])
    order = F.array(*[F.lit(j) for j in ORDER])
    value = lambda x: F.when(x.bitwiseAND(F.lit(ONES)) != ONES, x)

    def first_of_bins(s):
        return F.transform(F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, SHIFT) != F.shiftright(F.get(s, i - 1), SHIFT))), value)

    def fill(bins):
        held = F.filter(F.transform(bins, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].isNotNull())

        def filled(held):
            def one(x, i):
                probes = [F.get(bins, F.get(order, i * PROBES + a)) for a in range(PROBES)]
                rest = F.array_min(F.transform(held, lambda p: F.struct(F.xxhash64(i, p["i"]).alias("o"), p["x"].alias("x"))))["x"]
                return F.coalesce(x, *probes, rest, F.lit(0).cast("long"))

            return F.transform(bins, one)

        return _let(held, filled)

    def pack(full):
        byte = lambda k, j: F.shiftleft(F.get(full, k * 8 + j).bitwiseAND(F.lit(255)), 8 * j)

        def long(k):
            out = byte(k, 0)
            for j in range(1, 8):
                out = out.bitwiseOR(byte(k, j))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), long)

    return _let(_let(_let(F.sort_array(F.concat(hashes(text), ends)), first_of_bins), fill), pack)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1."""

    def equal_bytes(x, y):
        d = x.bitwiseXOR(y)
        for k in (4, 2, 1):  # the lowest bit of each byte: whether any of its bits is set
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.lit(8) - F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    same = F.aggregate(F.zip_with(a, b, equal_bytes), F.lit(0), lambda s, x: s + x)
    empty = lambda f: F.forall(f, lambda x: x == 0)
    chance = 1 / 256
    return F.when(empty(a) | empty(b), F.when(empty(a) & empty(b), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def hex_of(f: Column) -> Column:
    return F.array_join(F.transform(f, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def beside_next(docs: DataFrame, key: str, columns: list[str], *, rows_a_bucket: int = 1000, max_buckets: int = 16_384) -> DataFrame:
    """``docs`` with ``next_<c>`` of the following row by ``key`` (then by the first of ``columns``); after the last comes the first.

    Rows are dealt to ranges of the key, cut at approximate quantiles, so each row is shuffled once; the first row of each range
    is also sent to the range before it. The driver gets one key a range, of at most ``max_buckets`` ranges.
    """
    order = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    n = docs.count()
    buckets = max(1, min(max_buckets, n // rows_a_bucket))
    cuts = docs.select(order.cast("double").alias("o")).stat.approxQuantile("o", [i / buckets for i in range(1, buckets)], 1 / (8 * buckets)) if buckets > 1 else []
    cuts = sorted({int(c) for c in cuts})
    depth = max(1, len(cuts).bit_length())
    table_ = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(depth))])
    bucket = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get(table_, at + s - 1) <= F.col("o_"), s).otherwise(0))
    dealt = docs.withColumn("o_", order).withColumn("b_", bucket)
    firsts = {r.b_: r.f for r in docs.select(order.alias("o_")).withColumn("b_", bucket).groupBy("b_").agg(F.min("o_").alias("f")).collect()}
    held = sorted(firsts)
    before = {b: held[i - 1] for i, b in enumerate(held)}
    first = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(len(cuts) + 1)])
    back = F.array(*[F.lit(before.get(b)).cast("int") for b in range(len(cuts) + 1)])
    own = F.struct(F.col("b_").alias("b"), F.lit(False).alias("copy"))
    copy = F.struct(F.get(back, F.col("b_")).alias("b"), F.lit(True).alias("copy"))
    sent = dealt.withColumn("to_", F.explode(F.when(F.get(first, F.col("b_")) == F.col("o_"), F.array(own, copy)).otherwise(F.array(own))))
    by = W.partitionBy("bucket_").orderBy("copy_", "o_", columns[0])
    out = sent.withColumns({"bucket_": F.col("to_.b"), "copy_": F.col("to_.copy")})
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(by))
    return out.filter("not copy_").drop("o_", "b_", "to_", "bucket_", "copy_")


def fingerprint_edits(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited, fp, edited_fp, next_fp): each text's fingerprint, and that of the text whose last half of the code
    points is replaced by the first as many of the next row's."""
    rows = docs.select(F.col(id), text_or_empty(text).alias("text")).withColumn("fp", minhash(F.col("text")))
    pairs = beside_next(rows, id, ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = pairs.select(id, n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    return out.withColumn("edited_fp", minhash(F.col("edited")))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_rows(table(spark, sf_dir, "documents"))


def op4_rows(docs: DataFrame) -> DataFrame:
    made = fingerprint_edits(docs)
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        hex_of(F.col("fp")).alias("fingerprint"),
        hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
