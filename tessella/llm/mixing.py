"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised. The exponent is found by bisection: the largest at most 1
(the proportional mix) whose weights reach a target entropy. If that mix would repeat a source more often than allowed within the
token budget, the exponent is bisected upwards until it does not. A step of the search holds many exponents against one aggregate
over the sources, so sources stay distributed, however many there are. A budget beyond ``max_epochs`` of all tokens cannot be met
under that limit: the mix is then ``max_epochs`` of every source.

The weights are realised as block permutations under a budget of tokens: every source gets whole epochs of its rows, then the
rest of its quota. A source's rows fall into about sqrt(n) blocks, which have a place in a seeded permutation; rows have a seeded
place within their block. The rest of the quota is the blocks in their order as long as they fit, and of the first block that does
not, the rows in their order up to the first that does not fit. So a source's tokens are below its quota by less than one row, and
no task sees more than about sqrt(n) rows of a source, however large the source is.

Rows that are equal in every column are copies: one item with a count. Its copies are dealt over the blocks by arithmetic, and any
number of them may be taken, so that a source of one row a million times is mixed like any other and no task holds all copies.

Defined results: a null source is a source of its own; a null or empty text has no tokens, and comes once per epoch (with the
first one always); no rows give no rows; extra columns are carried along, but for those named like ``INTERNAL``, which are
replaced. A row's place is (``mix_epoch``, ``mix_block``, ``mix_place``); copies share theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import materialise, table

INTERNAL = [f"mix_{x}" for x in ("source", "tokens", "key", "weight", "epoch", "block", "place", "n", "full", "rest", "blocks", "order", "copies", "taken", "room", "row", "last", "run", "i")]
ENTROPY, MAX_EPOCHS, SEED = 0.98, 4.0, 11
POINTS, ROUNDS, PART = 256, 4, 1000


def solve_exponent(sums: DataFrame, budget: float, *, target_entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS) -> float:
    """The exponent for a target entropy (a share of the largest possible one) under a limit on repetition, of ``sums(t)``.

    Entropy falls and the largest repetition (weight times budget over tokens) falls as the exponent grows from 0 to 1. A round
    narrows the exponent to one of ``POINTS`` parts, so four rounds leave less than 3e-10.
    """
    some = sums.filter("t > 0")
    facts = some.agg(F.count("*").alias("m"), F.sum("t").alias("t"), F.min("t").alias("least")).first()
    if facts.m < 2:
        return 1.0
    most = math.log(facts.m)
    log_share = F.log(F.col("t") / F.lit(float(facts.t)))

    def measured(exponents):
        """(entropy, largest repetition) at each exponent; the smallest source is the one that is repeated most."""
        held = some.withColumns({"x": log_share, "a": F.explode(F.array(*map(F.lit, exponents)))}).groupBy("a").agg(F.sum(F.exp(F.col("x") * F.col("a"))).alias("norm"), F.sum(F.exp(F.col("x") * F.col("a")) * F.col("x") * F.col("a")).alias("dot"))
        rows = {r.a: r for r in held.collect()}  # a row for each exponent
        return [(math.log(rows[a].norm) - rows[a].dot / rows[a].norm, (facts.least / facts.t) ** a / rows[a].norm * budget / facts.least) for a in exponents]

    def narrowed(lo, hi, ok):
        """The parts' edges between which ``ok`` changes, again and again; ``ok`` holds at ``lo`` and not at ``hi``, or the reverse."""
        first = None
        for _ in range(ROUNDS):
            if hi <= lo:
                break
            at = [lo + (hi - lo) * k / POINTS for k in range(POINTS)] + [hi]
            held = [ok(*m) for m in measured(at)]
            first = held[0] if first is None else first
            k = next((k for k in range(1, POINTS + 1) if held[k] != first), None)
            if k is None:
                return at[-1], at[-1]
            lo, hi = at[k - 1], at[k]
        return lo, hi

    enough = lambda h, _: h >= target_entropy * most - 1e-12
    seldom = lambda _, x: x <= max_epochs * (1 + 1e-12)
    (h1, x1), = measured([1.0])
    a = 1.0 if enough(h1, x1) else narrowed(0.0, 1.0, enough)[0]
    (h, x), = measured([a])
    return a if seldom(h, x) else narrowed(a, 1.0, seldom)[1]


def token_count(text: str = "text"):
    """Words between white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def row_key(docs: DataFrame, seed: int) -> Column:
    """128 bits of hash of every column, as (a, b), the same for copies only. Columns that cannot be hashed count by their text."""
    plain = lambda t: not isinstance(t, (T.MapType, T.VariantType)) and all(map(plain, [t.elementType] if isinstance(t, T.ArrayType) else [f.dataType for f in t] if isinstance(t, T.StructType) else []))
    cols = [F.col(f"`{f.name}`") if plain(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema]
    marked = [x for c in cols for x in (c.isNull(), c)]
    # The halves begin from seeds of their own, so columns that clash in one do not in the other.
    return F.struct(F.xxhash64(F.lit(seed), *marked).alias("a"), F.xxhash64(F.lit(~seed), *marked, F.lit(seed)).alias("b"))


def planned(slim: DataFrame, budget: int | None, target_entropy: float, max_epochs: float) -> DataFrame:
    """(mix_source, mix_weight, mix_full, mix_rest, mix_blocks): whole epochs, tokens beyond these, and blocks of each source."""
    sums = materialise(slim.groupBy("mix_source").agg(F.sum(F.col("mix_tokens") * F.col("mix_n")).alias("t"), F.sum("mix_n").alias("n")))
    total = sums.agg(F.sum("t")).first()[0] or 0
    budget = total if budget is None else min(budget, int(total * max_epochs))
    blocks = F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("long").alias("mix_blocks")
    if not total or not budget:
        return sums.select("mix_source", F.lit(0.0).alias("mix_weight"), F.lit(int(not total or budget > 0)).cast("long").alias("mix_full"), F.lit(0).cast("long").alias("mix_rest"), blocks)
    a = solve_exponent(sums, budget, target_entropy=target_entropy, max_epochs=max_epochs)
    raw = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
    norm = sums.agg(F.sum(raw)).first()[0]
    weighted = sums.withColumn("w", raw / F.lit(norm)).withColumn("quota", F.floor(F.col("w") * F.lit(budget) + 0.5))
    full = F.when(F.col("t") > 0, F.floor(F.col("quota") / F.greatest("t", F.lit(1)))).otherwise(1).cast("long")
    rest = F.when(F.col("t") > 0, F.col("quota") - F.col("t") * full).otherwise(0).cast("long")
    return weighted.select("mix_source", F.col("w").alias("mix_weight"), full.alias("mix_full"), rest.alias("mix_rest"), blocks)


def mix(docs: DataFrame, *, source: str = "source", tokens=None, key=None, budget: int | None = None, target_entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, seed: int = SEED, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` as often as the mix takes each row, with ``mix_epoch`` (from 0), ``mix_block``, ``mix_place``, ``mix_tokens`` and
    ``mix_weight``.

    ``budget``: tokens of the mix; all tokens there are if not given. ``key``: what the seeded orders hash, within a source the same
    for copies only; 128 bits of hash of all columns if not given. Side tables are broadcast up to ``broadcast_rows`` rows, and joined by key beyond.
    """
    docs = docs.drop(*INTERNAL)
    tokens = token_count() if tokens is None else tokens
    key = row_key(docs, seed) if key is None else key
    src = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    marked = docs.withColumns({"mix_source": src, "mix_tokens": tokens, "mix_key": key})
    slim = materialise(marked.groupBy("mix_source", "mix_key").agg(F.first("mix_tokens").alias("mix_tokens"), F.count("*").alias("mix_n")))
    plan = materialise(planned(slim, budget, target_entropy, max_epochs))
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    plan = small(plan)

    # The copies of an item: at most one part a block. Copy j of n <= blocks goes to the block of its own hash.
    n, b = F.col("mix_n"), F.col("mix_blocks")
    hashed = lambda j: F.pmod(F.xxhash64(F.lit(seed + 1), "mix_key", j), b)
    parts = slim.join(plan, "mix_source").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(n, b) - 1)))
    parts = parts.withColumns({
        "mix_block": F.when(n <= b, hashed(F.col("j"))).otherwise(F.col("j")),
        "mix_copies": F.when(n <= b, F.lit(1)).otherwise(F.floor(n / b) + F.when(F.pmod(F.col("j") + F.xxhash64("mix_key"), b) < n % b, 1).otherwise(0)).cast("long"),
    })
    size = F.sum(F.col("mix_tokens") * F.col("mix_copies"))
    per_block = parts.groupBy("mix_source", "mix_block", "mix_rest").agg(size.alias("t"))
    order = W.partitionBy("mix_source").orderBy(F.xxhash64(F.lit(seed + 2), "mix_source", "mix_block"), "mix_block")
    run = per_block.withColumns({"upto": F.sum("t").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "mix_order": F.row_number().over(order)})
    fits = F.col("upto") <= F.col("mix_rest")
    begun = F.col("upto") - F.col("t") < F.col("mix_rest")
    blocks = small(materialise(run.select("mix_source", "mix_block", "mix_order", F.when(fits & (F.col("mix_rest") > 0), "whole").when(begun, "part").otherwise("none").alias("mix_taken"), (F.col("mix_rest") - F.col("upto") + F.col("t")).alias("mix_room"))))

    # Of the block that is taken in part: copies of each item up to the first row that does not fit.
    part = parts.join(blocks.filter("mix_taken = 'part'"), ["mix_source", "mix_block"]).groupBy("mix_source", "mix_block", "mix_key", "mix_tokens", "mix_room").agg(F.sum("mix_copies").alias("c"))
    within = W.partitionBy("mix_source").orderBy("mix_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = part.withColumn("upto", F.sum(F.col("mix_tokens") * F.col("c")).over(within)).withColumn("before", F.col("upto") - F.col("mix_tokens") * F.col("c"))
    whole = F.col("upto") <= F.col("mix_room")
    room = F.when(whole, F.col("c")).otherwise(F.floor((F.col("mix_room") - F.col("before")) / F.greatest("mix_tokens", F.lit(1))))
    held = upto.filter(F.col("before") <= F.col("mix_room")).select("mix_source", "mix_block", "mix_key", room.cast("long").alias("mix_row"))
    held = small(materialise(held.filter("mix_row > 0")))

    def times(df):
        """``df`` of items or their parts with what the last, partial epoch takes of each."""
        df = df.join(blocks, ["mix_source", "mix_block"]).join(held, ["mix_source", "mix_block", "mix_key"], "left")
        last = F.when(F.col("mix_taken") == "whole", F.col("mix_copies")).when(F.col("mix_taken") == "part", F.coalesce("mix_row", F.lit(0))).otherwise(0)
        return df.withColumn("mix_last", last.cast("long"))

    item = ["mix_source", "mix_key"]
    copied = slim.filter("mix_n > 1").select(*item)
    many = materialise(copied)
    n_many = many.count()
    repeated = F.broadcast(many) if n_many <= broadcast_rows else many
    # Single rows: their block follows from their key, so texts stay where they are.
    single = marked.join(repeated, item, "left_anti") if n_many else marked
    single = times(single.join(plan, "mix_source").withColumns({"mix_block": F.pmod(F.xxhash64(F.lit(seed + 1), "mix_key", F.lit(0).cast("long")), b), "mix_copies": F.lit(1).cast("long")}))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_full") + F.col("mix_last") - 1))
    out = single.filter(F.col("mix_full") + F.col("mix_last") > 0).withColumn("mix_epoch", epochs)
    columns = [*docs.columns, "mix_epoch", F.col("mix_order").alias("mix_block"), F.col("mix_key").alias("mix_place"), "mix_tokens", "mix_weight"]
    out = out.select(*columns)
    if not n_many:
        return out
    # Copies: one row of each item is kept, and comes as often as all its copies are taken, a part of them at a time.
    kept = marked.join(repeated, item, "left_semi").dropDuplicates(item)
    counts = times(_grouped(parts.filter("mix_n > 1")))
    kinds = F.array(F.struct(F.col("mix_full").alias("e"), F.lit(0).cast("long").alias("from"), F.col("mix_last").alias("to")))
    wholes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mix_full") - 1), lambda e: F.struct(e.alias("e"), F.lit(0).cast("long").alias("from"), F.col("mix_copies").alias("to")))
    runs = F.filter(F.concat(F.when(F.col("mix_full") > 0, wholes).otherwise(F.array().cast("array<struct<e:bigint,from:bigint,to:bigint>>")), kinds), lambda r: r["to"] > 0)
    runs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(0).cast("long"), r["to"] - 1, F.lit(PART).cast("long")), lambda i: F.struct(r["e"].alias("e"), i.alias("from"), F.least(F.lit(PART), r["to"] - i).alias("c")))))
    dealt = counts.select(*item, "mix_order", "mix_weight", F.explode(runs).alias("mix_run"))
    again = kept.join(dealt, item).repartition(F.xxhash64("mix_key", "mix_order", "mix_run"))
    again = again.withColumn("mix_i", F.explode(F.sequence(F.lit(1), F.col("mix_run.c").cast("int")))).withColumn("mix_epoch", F.col("mix_run.e"))
    return out.unionByName(again.select(*columns))


def _grouped(parts: DataFrame) -> DataFrame:
    """Parts of one item that fell into one block, as one."""
    by = ["mix_source", "mix_block", "mix_key", "mix_weight", "mix_full"]
    return parts.groupBy(*by).agg(F.sum("mix_copies").alias("mix_copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_place.a").alias("place"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight")
    )
