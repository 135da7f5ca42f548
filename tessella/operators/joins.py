"""Joins of mined posts, references, arms and files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def matched_once(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, order: str, usable: Column) -> DataFrame:
    """Each build row with the first probe row of its key that is usable, and what became of it: ``matched``, ``unusable`` (only rows
    that are not usable) or ``unmatched``."""
    best = probe.groupBy(F.col(probe_key).alias("probe_")).agg(F.min_by(F.when(usable, F.struct(*probe.columns)), F.when(usable, F.col(order))).alias("found"), F.count("*").alias("n_"))
    joined = build.join(best, F.col(build_key) == F.col("probe_"), "left")
    stage = F.when(F.col("found").isNotNull(), "matched").when(F.col("n_").isNotNull(), "unusable").otherwise("unmatched")
    return joined.withColumn("match", stage).drop("probe_", "n_")


def accepted_and_best(parents: DataFrame, children: DataFrame, parent_id: str, accepted_id: str, child_parent: str, child_id: str, score: str, usable: Column, least: int = 2) -> DataFrame:
    """Each parent with its accepted child and the best other usable child: highest score, at least ``least``, the earlier on ties."""
    c = children.withColumn("usable_", usable)
    joined = parents.join(c, F.col(parent_id) == F.col(child_parent), "left")
    other = F.col("usable_") & (F.col(child_id) != F.coalesce(F.col(accepted_id), F.lit(-1))) & (F.col(score) >= least)
    own = F.col("usable_") & (F.col(child_id) == F.col(accepted_id))
    return joined.groupBy(parent_id).agg(
        F.max(F.when(own, F.col(child_id))).alias("accepted"),
        F.max_by(F.when(other, F.col(child_id)), F.when(other, F.struct(F.col(score), -F.col(child_id)))).alias("top"),
        F.max(F.when(other, F.col(score))).alias("top_score"),
        F.count(child_id).alias("n_children"),
    )


def with_references(df: DataFrame, refs: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Rows with their reference; ``left_semi`` keeps those that have one, ``left_anti`` those that have none. Adaptive execution
    broadcasts the references if they turn out small."""
    return df.join(refs, on, how)


def paired(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """Two arms on the rows that both have; a missing metric counts as false."""
    take = lambda df, name: df.select(key, F.coalesce(F.col(metric), F.lit(False)).alias(name))
    return take(a, "a").join(take(b, "b"), key)


def similar_sets(left: DataFrame, right: DataFrame, id: str, items: str, threshold: float = 0.9) -> DataFrame:
    """(left_id, right_id, similarity) of sets whose Jaccard similarity reaches the threshold, exactly.

    Equal sets are one class with a member of smallest id. Items are ordered by how rare they are; two sets that similar share one of
    the first ``n - ceil(threshold * n) + 1``, and their sizes differ little. A pair meets in the first item that both prefixes share
    only if what is left of both sets after it can still reach the threshold. Sizes are part of the join's key, in bands that grow
    with the threshold, so that an item that many sets share is split by size.
    """
    def classes(df, name):
        s = F.array_sort(F.array_distinct(F.col(items)))
        return df.withColumn("set_", s).filter(F.size("set_") > 0).groupBy(F.sha1(F.to_json(F.struct("set_"))).alias(f"{name}_key")).agg(F.min(id).alias(f"{name}_id"), F.first("set_").alias(f"{name}_set"), F.count("*").alias(f"{name}_n"))

    a, b = classes(left, "left"), classes(right, "right")
    rare = a.select(F.explode("left_set").alias("item")).unionByName(b.select(F.explode("right_set").alias("item"))).groupBy("item").count()

    def prefixes(df, name):
        each = df.select(f"{name}_id", F.size(f"{name}_set").alias("n"), F.explode(f"{name}_set").alias("item")).join(rare, "item")
        place = F.row_number().over(W.partitionBy(f"{name}_id").orderBy("count", "item"))
        return each.withColumn("p", place).filter(F.col("p") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select(f"{name}_id", F.col("n").alias(f"{name}_size"), F.col("p").alias(f"{name}_p"), "item")

    # Bands of sizes: similar sets are in the same band or in neighbouring ones.
    band = lambda n: F.floor(F.log(n) / F.lit(-math.log(threshold) + 1e-9)).cast("int")
    ours = prefixes(a, "left").withColumn("band", F.explode(F.array(*[band(F.col("left_size")) + d for d in (-1, 0, 1)])))
    theirs = prefixes(b, "right").withColumn("band", band(F.col("right_size")))
    rest = F.least(F.col("left_size") - F.col("left_p"), F.col("right_size") - F.col("right_p")) + F.least("left_p", "right_p")
    enough = rest * (1 + threshold) >= (F.col("left_size") + F.col("right_size")) * threshold - 1e-9
    met = ours.join(theirs, ["item", "band"]).filter((F.col("left_size") >= F.col("right_size") * threshold - 1e-9) & (F.col("right_size") >= F.col("left_size") * threshold - 1e-9) & enough)
    pairs = met.select("left_id", "right_id").distinct().join(a, "left_id").join(b, "right_id")
    sim = F.size(F.array_intersect("left_set", "right_set")) / F.size(F.array_union("left_set", "right_set"))
    return pairs.withColumn("similarity", sim).filter(F.col("similarity") >= threshold).select("left_id", "right_id", "similarity", "left_n", "right_n")


#: Rows of each side that a task compares at a time, at most about, and 64-bit words it holds for it.
ROWS_A_CELL, WORDS_AT_ONCE = 4096, 2_000_000


def bands(threshold: float):
    """(band, bits): the band of sizes of a set of n, so that sets of that Jaccard similarity are in the same band or in neighbouring ones,
    and how many bits a sketch for comparisons within a band has: about one an item."""
    step = max(-math.log(threshold) + 1e-9, 0.05)
    return (lambda n: math.floor(math.log(n) / step)), (lambda band: 64 * math.ceil(math.exp((band + 1) * step) / 64))


def sketch(items, bits: int) -> bytes:
    """Which of so many remainders an odd number of the items has: two sets differ in at least as many items as their sketches in bits."""
    import numpy as np

    return np.packbits(np.bincount((items.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def near_sketches(sets: DataFrame, threshold: float, opened: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id), left the smaller, of sets that may reach the Jaccard similarity: pairs that no sketch rules out, which are all
    that reach it and few others. sets(id long, block, size, band, own, next), ``own`` and ``next`` the sketches of its band and the next.

    Without ``opened`` each set meets the nearest one of each comparison it is in, so there are never more pairs than compared rows; with
    ``opened(id)`` all pairs that hold one of these. Sets of a block and a band are dealt to cells of bounded size, and every two cells
    that may hold a pair are compared in a task; only sketches are shuffled, an eighth of a byte an item and cell, and no pair that fails.
    """
    sets = sets.withColumn("open", F.lit(False)) if opened is None else sets.join(opened.select("id", F.lit(True).alias("open")), "id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    counts = sets.groupBy("block", "band").agg(F.count("*").alias("n"))
    both = counts.withColumn("right_n", F.col("n")).unionByName(counts.select("block", F.col("band") + 1, "n", F.lit(0).cast("long").alias("right_n")).toDF("block", "band", "n", "right_n"))
    grid = both.groupBy("block", "band").agg(F.sum("n").alias("n"), F.sum("right_n").alias("right_n")).filter("right_n > 0 and n > 1")
    cells = lambda n: F.ceil(F.col(n) / ROWS_A_CELL).cast("int")
    grid = grid.select("block", "band", cells("right_n").alias("n_right"), cells("n").alias("n_left"))
    side = lambda band, word, right: sets.select("id", "size", "open", F.lit(right).alias("right"), "block", band.alias("band"), F.col(word).alias("word"))
    rows = side(F.col("band"), "own", True).unionByName(side(F.col("band"), "own", False)).unionByName(side(F.col("band") + 1, "next", False)).join(grid, ["block", "band"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    others = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    each = F.when(F.col("right"), F.transform(others("n_left"), lambda i: F.struct(own("n_right").alias("r"), i.alias("l")))).otherwise(F.transform(others("n_right"), lambda i: F.struct(i.alias("r"), own("n_left").alias("l"))))
    dealt = rows.withColumn("cell", F.explode(each)).select("block", "band", "cell", "id", "size", "open", "right", "word")
    every, share = opened is not None, (1 - threshold) / (1 + threshold)

    def compared(table):
        import numpy as np
        import pyarrow as pa

        column = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        ids, sizes, is_right, is_open = column("id"), column("size").astype(np.int64), column("right").astype(bool), column("open").astype(bool)
        words = np.frombuffer(b"".join(table.column("word").to_pylist()), np.uint64).reshape(len(ids), -1)
        order = np.lexsort((ids, sizes))  # of two rows the left comes first
        rights, lefts, out = order[is_right[order]], order[~is_right[order]], []

        def meet(r, l):
            if not len(r) or not len(l):
                return
            best, at, i = np.full(len(l), 1 << 40), np.full(len(l), -1), 0
            while i < len(r):
                low = np.searchsorted(sizes[l], sizes[r[i]] * threshold - 1e-6)
                a = r[i : i + max(1, WORDS_AT_ONCE // max(1, (len(l) - low) * words.shape[1]))]
                high = np.searchsorted(sizes[l], sizes[a[-1]], "right")
                i, b = i + len(a), l[low:high]
                if not len(b):
                    continue
                x, y = sizes[a][:, None], sizes[b][None]
                apart = np.zeros((len(a), len(b)), np.int64)
                for k in range(words.shape[1]):
                    apart += np.bitwise_count(words[a, k][:, None] ^ words[b, k][None])
                fits = (apart <= (x + y) * share + 1e-6) & (y >= x * threshold - 1e-6) & ((y < x) | (y == x) & (ids[b][None] < ids[a][:, None]))
                if every:
                    u, v = np.nonzero(fits)
                    out.append((ids[b[v]], ids[a[u]]))
                    continue
                apart = np.where(fits, apart, 1 << 40)
                v = apart.argmin(1)
                u = np.flatnonzero(apart[np.arange(len(a)), v] < 1 << 40)
                out.append((ids[b[v[u]]], ids[a[u]]))
                u = apart.argmin(0)
                least = apart[u, np.arange(len(b))]
                nearer = np.flatnonzero(least < best[low:high])
                best[low + nearer], at[low + nearer] = least[nearer], ids[a[u[nearer]]]
            some = np.flatnonzero(best < 1 << 40)
            out.append((ids[l[some]], at[some]))

        if every:
            meet(rights[is_open[rights]], lefts)
            meet(rights[~is_open[rights]], lefts[is_open[lefts]])
        else:
            meet(rights, lefts)
        left, right = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*out) if out else ((), ())))
        return pa.table({"left_id": pa.array(left, pa.int64()), "right_id": pa.array(right, pa.int64())})

    return dealt.groupBy("block", "band", "cell").applyInArrow(compared, "left_id long, right_id long").distinct()


def assign_blocks(needed: DataFrame, blocks: DataFrame, id: str = "id") -> DataFrame:
    """Needed files to code blocks: by hinted base name within a family, the last block wins; what is left over by order, if as many
    files as blocks are left in the family, else the files stay unassigned.

    needed(id, family, name, pos), blocks(id, family, hint, pos, code).
    """
    base = lambda c: F.lower(F.regexp_extract(F.col(c), r"([^/]*)$", 1))
    n, b = needed.withColumn("base_", base("name")), blocks.withColumn("base_", base("hint"))
    hinted = b.filter(F.col("base_").isNotNull() & (F.col("base_") != "")).groupBy(id, "family", "base_").agg(F.max_by(F.struct("pos", "code"), F.col("pos")).alias("b"))
    one = n.join(hinted, [id, "family", "base_"]).select(id, "family", "name", "pos", F.col("b.pos").alias("block_pos"), F.col("b.code").alias("code"))
    rest_n = n.join(one, [id, "family", "name"], "left_anti")
    rest_b = b.join(one.select(id, "family", F.col("block_pos").alias("pos")), [id, "family", "pos"], "left_anti")
    w = W.partitionBy(id, "family").orderBy("pos")
    numbered = lambda df: df.withColumn("k_", F.row_number().over(w)).withColumn("c_", F.count("*").over(W.partitionBy(id, "family")))
    two = numbered(rest_n).select(id, "family", "name", "pos", "k_", "c_").join(numbered(rest_b).select(id, "family", "k_", "c_", F.col("pos").alias("block_pos"), "code"), [id, "family", "k_", "c_"]).select(id, "family", "name", "pos", "block_pos", "code")
    return one.unionByName(two)


def resolve_names(names: DataFrame, files: DataFrame, project: str, name: str = "name", path: str = "path") -> DataFrame:
    """Each name's file in its project: the same path, else the first path in order that ends in it."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    met = names.withColumn("base_", base(name)).join(files.select(project, path).withColumn("base_", base(path)), [project, "base_"])
    fits = met.filter((F.col(path) == F.col(name)) | F.col(path).endswith(F.concat(F.lit("/"), F.col(name))))
    best = fits.groupBy(project, name).agg(F.min_by(path, F.struct(F.col(path) != F.col(name), F.col(path))).alias(path))
    return names.join(best, [project, name], "left")


def author_names(posts: DataFrame, users: DataFrame) -> DataFrame:
    """``author``: the posts' own display name, else that of its owner."""
    u = users.select(F.col("id").alias("user_"), F.col("display_name").alias("name_"))
    return posts.join(u, F.col("owner_user_id") == F.col("user_"), "left").withColumn("author", F.coalesce("owner_display_name", "name_")).drop("user_", "name_")


def zipped(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of two frames by their place within a group; what one side has more is left out. Places are given by an explicit order,
    never by where a row happens to lie."""
    placed = lambda df, order: df.withColumn("place_", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return placed(a, order_a).join(placed(b, order_b), [*keys, "place_"]).drop("place_")
