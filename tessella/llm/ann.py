"""Approximate nearest neighbours by an adaptive scan of dimensions within probed lists.

Vectors are rotated at random, assigned to the nearest of about sqrt(n) centroids (trained on at most ``max_sample`` vectors, the
one bound here), and every vector is indexed. A list is stored in blocks of about ``block`` vectors. A query meets the blocks of
its nearest lists; within a block, rotated coordinates are read in column blocks, and after each a hypothesis test abandons the
candidates whose distance so far shows that they are not among the nearest. The test holds them against one bound that all blocks
of a query share: the k-th distance among the sample's vectors in the query's nearest lists. The lists that a query needs to have
k neighbours at all are held against what is found in them alone. Survivors get their exact distance on the original vectors, and
the exact best of all blocks are kept.

The share of lists to probe is measured on the sample: the least share at which brute force confirms ``target`` recall there.
Neighbours are further apart in a sample than among all vectors, so this errs to the safe side. A query whose lists hold fewer than
k other vectors probes on, in order of centroid distance, until they do. The sample is ordered by id, and every product with the
centroids is made in slices of bounded size; the sample has at most ``MAX_BYTES`` of vectors and is broadcast. There are at most ``max_sample`` / 2 lists: beyond that many squared vectors the
lists, and so the work of a query, grow with the table.

Blocks of vectors meet blocks of queries on an equal key, so a list of any size and any number of queries spread over tasks of
bounded size. Vectors are dealt to blocks by a hash of id and vector; of equal rows of an id with more than ``block`` rows only k
are dealt, since no result can hold more.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; a
query with fewer other vectors gets them all; ties go to the smaller id; repeated candidate rows are candidates each, repeated
query rows are asked once; a null id takes no part; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, table

MAX_SAMPLE, BLOCK, QUERY_BLOCK, TARGET, SEED, SLICE = 20_000, 256, 256, 0.98, 5, 512
MAX_BYTES = 1 << 28


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id).isNotNull() & v.isNotNull()).filter(F.size(v) > 0).filter(good).select(F.col(id).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common.d if common else 0))


class Index:
    """Centroids, rotation, the number of lists to probe, and the sample by its lists."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, n: int, k: int, target: float, seed: int):
        rng = np.random.default_rng(seed)
        self.k, self.dims = k, sample.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(self.dims, self.dims)))[0]
        lists = max(1, min(math.isqrt(n), len(sample) // 2 or 1))
        c = sample[rng.choice(len(sample), lists, replace=False)].copy()
        for _ in range(8):
            near = self._closest(sample, c)
            total, count = np.zeros_like(c), np.bincount(near, minlength=lists)
            np.add.at(total, near, sample)
            c[count > 0] = total[count > 0] / count[count > 0, None]
        self.centroids = c
        lists_of = self._closest(sample, c)
        self.probes = self._probes(sample, lists_of, k, target, rng)
        order = np.argsort(lists_of, kind="stable")
        self.ids, self.sample = ids[order], sample[order]
        self.starts = np.searchsorted(lists_of[order], np.arange(lists + 1))

    @staticmethod
    def _far(x, c):
        return (c**2).sum(1) - 2 * x @ c.T

    def _closest(self, x, c):
        return np.concatenate([self._far(x[i : i + SLICE], c).argmin(1) for i in range(0, len(x), SLICE)])

    def _probes(self, sample, lists, k, target, rng):
        """Lists to probe for the target recall of each sample query's nearest ones."""
        at = rng.choice(len(sample), min(400, len(sample)), replace=False)
        far = (sample**2).sum(1) - 2 * sample[at] @ sample.T
        far[np.arange(len(at)), at] = np.inf
        k = min(k, max(1, len(sample) - 1))
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        order = np.argsort(np.argsort(self._far(sample[at], self.centroids), axis=1), axis=1)
        places = np.sort(np.take_along_axis(order, lists[near], axis=1).ravel())
        return int(places[min(len(places) - 1, math.ceil(target * len(places)) - 1)]) + 1

    def nearest(self, x):
        return self._closest(x, self.centroids).astype(np.int32) if len(x) else np.zeros(0, np.int32)

    def bound(self, id, v, lists):
        """An upper bound of a query's k-th distance, squared: that among the sample's vectors in these lists; infinite if they are
        too few."""
        found, most = np.zeros(0), max(16 * self.k, 256)
        for i in lists:
            a, b = self.starts[i], self.starts[i + 1]
            own = self.sample[a:b][self.ids[a:b] != id]
            found = np.concatenate([found, ((own - v) ** 2).sum(1)])
            if len(found) >= most:
                break
        return float(np.partition(found, self.k - 1)[self.k - 1]) if len(found) >= self.k else math.inf

    def probed(self, ids, x, sizes, need):
        """For each row of ``x`` its nearest lists, ``probes`` of them or as many as hold its ``need`` vectors, and the bound of
        each list: none in those that hold the first ``need`` vectors."""
        lists, bounds = [], []
        for i in range(0, len(x), SLICE):
            order = np.argsort(self._far(x[i : i + SLICE], self.centroids), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            first = 1 + (held < need[i : i + SLICE, None]).sum(1)
            for j, row in enumerate(order):
                m = max(self.probes, first[j])
                bound = self.bound(ids[i + j], x[i + j], row[:m]) if m > first[j] else math.inf
                lists.append(row[:m].astype(np.int32))
                bounds.append([math.inf] * int(min(first[j], m)) + [bound] * int(m - first[j]))
        return lists, bounds


def scan(query: np.ndarray, turned: np.ndarray, k: int, shared: float = math.inf, *, step: int = 16, slack: float = 2.1) -> np.ndarray:
    """Positions in ``turned`` (rotated vectors, as columns by dimension) that may be among the k nearest to a rotated query.
    Without a ``shared`` bound (squared) at least k of them, or all there are; with one, those that may be within it."""
    dims, n = turned.shape
    free = math.isinf(shared)
    if n <= k and free:
        return np.arange(n)
    bound = shared
    if free:
        head = min(n, max(4 * k, 32))
        whole = ((turned[:, :head] - query[:, None]) ** 2).sum(0)
        bound = np.partition(whole, k - 1)[k - 1]
    alive, partial = np.arange(n), np.zeros(n)
    for d in range(0, dims, step):
        e = min(d + step, dims)
        partial = partial + ((turned[d:e][:, alive] - query[d:e, None]) ** 2).sum(0)
        # The share e/dims of a rotated vector's length is near its expectation; beyond the slack the candidate is given up.
        keep = partial * (dims / e) <= bound * ((1 + slack / math.sqrt(e)) ** 2 if e < dims else 1 + 1e-9)
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
        if free and len(alive) < k:  # too many were given up: whole distances for all
            alive, partial = np.arange(n), ((turned - query[:, None]) ** 2).sum(0)
            break
    if len(alive) > k:  # whole distances now: no more than k of them and ties
        bound = np.partition(partial, k - 1)[k - 1]
        alive = alive[partial <= bound * (1 + 1e-9) + 1e-300]
    return alive


def _array(column) -> np.ndarray:
    n = len(column)
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def search(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", is_query=None, k: int = 10, max_sample: int = MAX_SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK, target: float = TARGET, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` selects, among all other rows."""
    import pyarrow as pa

    rows = materialise(usable(vectors, id, vector))
    out = "query_id long, vec_id long, score double"
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    max_sample = max(1, min(max_sample, MAX_BYTES // (16 * dims)))  # twice as many rows are taken at most
    many = materialise(rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("id"))
    if not many.isEmpty():
        copies = rows.join(many, "id", "left_semi").groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
        rows = materialise(rows.join(many, "id", "left_anti").unionByName(copies.select("id", "v", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("id", "v")))
        n = rows.count()
    ask = F.lit(True) if is_query is None else is_query
    share = F.lit(True) if n <= max_sample else F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(1_000_000 * max_sample / n)
    taken = rows.filter(share).orderBy("id", "v").limit(2 * max_sample).collect() or rows.orderBy("id", "v").limit(1).collect()
    index = Index(np.array([r.id for r in taken]), np.array([r.v for r in taken]), n, k, target, seed)
    held_index = vectors.sparkSession.sparkContext.broadcast(index)

    def listing(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held_index.value.nearest(_array(b.column(1))), pa.int32())], names=["id", "v", "list"])

    listed = materialise(rows.mapInArrow(listing, "id long, v array<double>, list int"))
    held = np.zeros(len(index.centroids), np.int64)
    for r in listed.groupBy("list").count().collect():  # a row for each of at most max_sample / 2 lists
        held[r["list"]] = r["count"]

    def probing(batches):
        for b in batches:
            lists, bounds = held_index.value.probed(np.asarray(b.column(0)), _array(b.column(1)), held, np.asarray(b.column(2)) + k) if b.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32())), pa.array(bounds, pa.list_(pa.float64()))], names=["id", "v", "lists", "bounds"])

    # A query's own rows are no candidates, so its lists need to hold k vectors besides these.
    own = rows.join(rows.filter(ask).select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("own"))
    asked = rows.filter(ask).groupBy("id").agg(F.min("v").alias("v")).join(own, "id").select("id", "v", "own")
    probed = asked.mapInArrow(probing, "id long, v array<double>, lists array<int>, bounds array<double>")
    asked = materialise(probed.select("id", "v", F.explode(F.arrays_zip("lists", "bounds")).alias("p")).select("id", "v", F.col("p.lists").alias("list"), F.col("p.bounds").alias("bound")))
    sizes = listed.groupBy("list").agg(F.count("*").alias("n")).join(asked.groupBy("list").agg(F.count("*").alias("m")), "list")
    sizes = F.broadcast(sizes.select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / query_block).cast("int").alias("asks")))  # a row for each of at most max_sample / 2 lists
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, *of: F.pmod(F.xxhash64(F.lit(seed + 1), *of), F.col(c)).cast("int")
    here = listed.join(sizes, "list").withColumn("x", dealt("blocks", "id", "v")).withColumn("y", every("asks")).select("list", "x", "y", "id", "v")
    there = asked.join(sizes, "list").withColumn("y", dealt("asks", "id")).withColumn("x", every("blocks")).select("list", "x", "y", "id", "v", "bound")

    def meet(left, right):
        ids, v = np.asarray(left.column("id")), _array(left.column("v"))
        asks, q, bounds = np.asarray(right.column("id")), _array(right.column("v")), np.asarray(right.column("bound"))
        found = []
        if len(ids) and len(asks):
            rotation = held_index.value.rotation
            turned, turned_q = np.ascontiguousarray((v @ rotation).T), q @ rotation
            for i in range(len(asks)):
                at = scan(turned_q[i], turned, k + int((ids == asks[i]).sum()), bounds[i])
                at = at[ids[at] != asks[i]]
                score = np.sqrt(((v[at] - q[i]) ** 2).sum(1))
                best = np.lexsort((ids[at], score))[:k]
                found.append((np.full(len(best), asks[i]), ids[at][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2]})

    met = here.groupBy("list", "x", "y").cogroup(there.groupBy("list", "x", "y")).applyInArrow(meet, out)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), is_query=F.col("id") % 100 == 0)
