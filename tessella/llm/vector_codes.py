"""Vector code compression: product codes whose nearest entries are found by segment-mean lower bounds.

A vector's components become integers, floor(``scale`` * x), and are cut into ``parts`` equal runs. Each run is coded by the nearest
of ``entries`` codebook entries, in squared Euclidean distance. The distance of a run and an entry is no less than, summed over the
blocks of the run, block length x (difference of means) ** 2 + (difference of the norms of what the means leave) ** 2. Blocks are
halved from the whole run down to two components: entries whose bound exceeds the distance to the entry that looked best are given
up at each level, with a margin for rounding, so no nearest entry is ever lost. What survives gets its exact distance in integers;
ties go to the lower index.

A codebook starts as the runs of the vectors with the smallest ids (then by components). Each round assigns all runs, sums them by
entry within each task, adds up the sums by a shuffle of at most parts x entries rows a task, and takes floor(sum / count); an entry
without runs stays. Only codebooks reach the driver: ``entries`` vectors, whatever the number of rows.

Defined results: rows whose vector is null or holds null or non-finite components take no part, nor do vectors whose length is not
the commonest multiple of ``parts`` among the rest (empty ones never are; ties to the shorter); integers so large that a squared
distance could pass 62 bits are an error; a null id sorts last for the start and is coded like any other; repeated rows are rows
each; a null label is a label of its own; no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

PARTS, ENTRIES, ROUNDS, SCALE, SLICE = 16, 64, 2, 256, 2048
BROADCAST_ROWS = 500_000


def integers(vectors: DataFrame, *, vector: str, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``vectors`` with ``v``, the integer components, in place of ``vector``; only rows that take part. One pass finds the length
    and the largest component."""
    x = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.filter(good & (F.size(x) > 0) & (F.size(x) % parts == 0))
    lengths = kept.groupBy(F.size(x).alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform(x, F.abs))).alias("most"))
    length = lengths.orderBy(F.desc("n"), "d").first()
    if length and (2 * (scale * length["most"] + 1)) ** 2 * length["d"] >= 1 << 62:
        raise ValueError(f"{vector} holds components of up to {length['most']}, whose squared distances need more than 62 bits")
    whole = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    return kept.filter(F.size(x) == (length["d"] if length else 0)).withColumn("v", whole).drop(*[c for c in (vector,) if c != "v"])


def _blocks(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, norm of the rest, length) of each block of ``size`` columns; the last block may be shorter."""
    starts = np.arange(0, x.shape[1], size)
    length = np.diff(np.append(starts, x.shape[1])).astype(np.float64)
    mean = np.add.reduceat(x, starts, axis=1) / length
    rest = x - np.repeat(mean, length.astype(int), axis=1)
    return mean, np.sqrt(np.add.reduceat(rest**2, starts, axis=1)), length


def _bound(a, b, at_a, at_b) -> np.ndarray:
    """Lower bounds of the squared distances of rows ``at_a`` of a and ``at_b`` of b, both as ``_blocks`` gives them."""
    (mean_a, rest_a, length), (mean_b, rest_b, _) = a, b
    out = 0.0
    for j in range(len(length)):
        mean, rest = mean_a[:, j][at_a] - mean_b[:, j][at_b], rest_a[:, j][at_a] - rest_b[:, j][at_b]
        mean *= mean
        mean *= length[j]
        rest *= rest
        mean += rest
        out = mean + out
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of each row's nearest entry, squared distance, exact distances that were computed); integers throughout but for the
    bounds."""
    n, width = x.shape
    code, far, exact = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    sizes = [width]
    while sizes[-1] > 2:
        sizes.append((sizes[-1] + 1) // 2)
    # Bounds lose at most a few units in the last place of the largest square; the margin is a million times that.
    peak = float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    margin = 0.5 + 1e-9 * width * (2 * peak) ** 2
    books = [_blocks(book.astype(np.float64), s) for s in sizes]
    every = np.arange(len(book))
    for i in range(0, n, SLICE):
        own = x[i : i + SLICE]
        rows = [_blocks(own.astype(np.float64), s) for s in sizes]
        low = _bound(rows[0], books[0], np.arange(len(own))[:, None], every[None, :])
        rest = own - book[low.argmin(1)]
        guess = np.einsum("ij,ij->i", rest, rest)
        at, entry = np.nonzero(low <= (guess + margin)[:, None])
        for row, entries in zip(rows[1:], books[1:]):
            keep = _bound(row, entries, at, entry) <= guess[at] + margin
            at, entry = at[keep], entry[keep]
        rest = own[at] - book[entry]
        exact += len(at) + len(own)
        # The given up are further than any that is left; the first of equals is the lower index.
        distance = np.full((len(own), len(book)), np.iinfo(np.int64).max)
        distance[at, entry] = np.einsum("ij,ij->i", rest, rest)
        code[i : i + SLICE] = distance.argmin(1)
        far[i : i + SLICE] = distance.min(1)
    return code, far, exact


def _matrix(column) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def train(rows: DataFrame, *, id: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as (part, entry, component) after ``rounds`` rounds over ``rows`` with their integers ``v``."""
    import pyarrow as pa

    start = rows.orderBy(F.col(id).asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not start:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r.v for r in start], dtype=np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _means(rows, books, pa)
    return books


def _means(rows: DataFrame, books: np.ndarray, pa) -> np.ndarray:
    parts, k, width = books.shape
    held = rows.sparkSession.sparkContext.broadcast(books)  # entries x dimensions integers

    def summed(batches):
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0)).reshape(batch.num_rows, parts, width)
            for p in range(parts):
                code, _, _ = nearest(x[:, p], held.value[p])
                np.add.at(total[p], code, x[:, p])
                count[p] += np.bincount(code, minlength=k)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    sums = rows.select("v").mapInArrow(summed, "part int, entry int, n long, s array<long>")
    wide = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    books = books.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # parts x entries rows at most
        books[r.part, r.entry] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    held.unpersist()
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with (codes array<int>, error long) in place of ``v``."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    parts, _, width = books.shape
    kept = [c for c in rows.columns if c not in ("v", "codes", "error")]
    schema = StructType([*rows.select(*kept).schema.fields, *StructType.fromDDL("codes array<int>, error long").fields])
    held = rows.sparkSession.sparkContext.broadcast(books)

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(batch.num_columns - 1)).reshape(batch.num_rows, parts, width)
                found = [nearest(x[:, p], held.value[p]) for p in range(parts)]
                codes = np.stack([f[0] for f in found], axis=1)
                error = np.sum([f[1] for f in found], axis=0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())), pa.array(error, pa.int64())], names=schema.fieldNames())

    return rows.select(*kept, "v").mapInArrow(coded, schema)


def compress(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, *keep, codes, error), codebooks): each vector's entry by part, and the squared distance that this leaves."""
    rows = integers(vectors.select(id, *keep, vector), vector=vector, parts=parts, scale=scale)
    books = train(rows, id=id, parts=parts, entries=entries, rounds=rounds)
    return encode(rows, books), books


def hex_codes(codes) -> F.Column:
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_rows(table(spark, sf_dir, "embeddings"))


def op11_rows(vectors: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The coded rows with the error of all rows of their label. Sums of labels are broadcast up to ``broadcast_rows`` of them; more
    are joined by shuffling, which adaptive execution splits at a hot label."""
    coded, books = compress(vectors, keep=("label",))
    coded = materialise(coded)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = materialise(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= broadcast_rows:
        sums = F.broadcast(sums)
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", hex_codes(F.col("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


#: Each round is a cross of the runs with the 64 entries of their part.
_ROUND = """
near{k} as (select p.vec_id, p.ord, p.part, arg_min(b.entry, (list_sum(list_transform(list_zip(p.r, b.r), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) as entry,
 min(list_sum(list_transform(list_zip(p.r, b.r), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as far
 from runs p join book{k} b using (part) group by p.vec_id, p.ord, p.part)"""
_NEXT = """,
mean{k} as (select n.part, n.entry, [floor(sum(p.r[1]) / count(*))::bigint, floor(sum(p.r[2]) / count(*))::bigint, floor(sum(p.r[3]) / count(*))::bigint, floor(sum(p.r[4]) / count(*))::bigint] as r
 from near{j} n join runs p using (ord, part) group by n.part, n.entry),
book{k} as (select b.part, b.entry, coalesce(m.r, b.r) as r from book{j} b left join mean{k} m using (part, entry)),"""
OP11_SQL = (
    """with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v, row_number() over (order by vec_id, embedding) as ord
 from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
runs as materialized (select vec_id, ord, part, v[part * 4 + 1:part * 4 + 4] as r from kept, range(16) t(part)),
book0 as (select part, ord - 1 as entry, r from runs where ord <= 64),"""
    + _ROUND.format(k=0) + _NEXT.format(j=0, k=1) + _ROUND.format(k=1) + _NEXT.format(j=1, k=2) + _ROUND.format(k=2)
    + """,
coded as (select vec_id, ord, string_agg(printf('%02x', entry), '' order by part) as code, sum(far)::bigint as error from near2 group by vec_id, ord)
select c.vec_id, c.code, c.error, (sum(c.error) over (partition by k.label))::bigint as label_error,
 (select sha256(string_agg(array_to_string(r, ','), ',' order by part, entry)) from book2) as codebooks_sha256
from coded c join kept k using (ord)"""
)
