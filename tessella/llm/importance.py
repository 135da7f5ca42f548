"""Importance resampling towards a target distribution, over hashed n-grams held as tuples of word ids.

A text's features are its runs of one to ``longest`` words. Each stretch of texts (about ``CHUNK`` words, whole texts) gets an integer
dictionary of its distinct words. Runs are tuples of these ids, built one word at a time: the number of a run's distinct
prefix, paired with the id of its last word, is one integer. Of each distinct tuple the bytes are put together and hashed once, and
bucket or gain go back to the tuple's occurrences through its number. The dictionary is a stretch's own: one for the whole table would
shuffle every distinct run, which in prose are most of them; so only ``buckets`` counts a task leave their place.

Counts of buckets in both tables, added up by a shuffle, give each bucket a gain: the floor of 1000 times the log of the ratio of its smoothed
shares. A second pass sums gains by text, and Gumbel noise from a digest of the id turns taking the highest scores into a draw
without replacement by weight. Ranks are places in an order by ranges of (score, id): each range is sorted by itself, and the driver
adds up the ranges' sizes only, so no task holds more than its range.

Defined results: null and empty texts have no features, weight 0, and are not drawn if a draw needs words; a null id has the noise of
an empty one and comes first among ties; repeated rows are rows each, drawn each; no rows give no rows; an empty target has
shares of smoothing alone; texts are read whole; extra columns are not read.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED, CHUNK = 10_000, 3, 20, 5, 42, 1 << 20
#: Bytes to bytes: A-Z in lower case; what is no digit, letter or part of a character beyond ASCII is a space.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(WORD_BYTES).split()


def tuples(found: list[bytes], ends: np.ndarray, longest: int):
    """For each length up to ``longest``: (positions where a run begins, its number among the distinct runs, their buckets' hashes).

    ``found`` holds the words of texts one after another, ``ends`` where each text ends.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = pa.array(found, pa.large_binary()).dictionary_encode()
    vocabulary, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    end_of = np.repeat(ends, np.diff(ends, prepend=0))
    at, number = np.arange(len(ids)), ids
    spelled, space = vocabulary, pa.scalar(b" ", pa.large_binary())  # the bytes of each distinct run, once
    for size in range(1, longest + 1):
        if size > 1:
            whole = at + size <= end_of[at]
            at, number = at[whole], number[whole]
            pairs = pa.array(number * len(vocabulary) + ids[at + size - 1]).dictionary_encode()
            before, last = np.divmod(pairs.dictionary.to_numpy(), max(1, len(vocabulary)))
            number = pairs.indices.to_numpy().astype(np.int64)
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(before)), vocabulary.take(pa.array(last)), space)
        yield at, number, np.fromiter(map(crc32, spelled.to_numpy(zero_copy_only=False)), np.int64, len(spelled))


def stretches(batches, column: int, size: int = CHUNK):
    """(batch, texts' first place, words, ends) of texts in turn, cut at about ``size`` words; the words of one text stay together."""
    import pyarrow as pa

    for batch in batches:
        texts, found, ends, first = batch.column(column).cast(pa.large_binary()), [], [], 0
        for i in range(batch.num_rows):
            found += words(texts[i].as_py())
            ends.append(len(found))
            if len(found) >= size or i == batch.num_rows - 1:
                yield batch, first, found, np.array(ends)
                found, ends, first = [], [], i + 1


def bucket_counts(docs: DataFrame, *, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Occurrences of all features by bucket."""
    import pyarrow as pa

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, found, ends in stretches(batches, 0):
            for _, number, hashes in tuples(found, ends, longest):
                np.add.at(total, hashes % buckets, np.bincount(number, minlength=len(hashes)))
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain from its counts in both tables."""
    n, s, t = len(source), source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of each row."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType([docs.select(F.col(id).alias("id")).schema[0], *StructType.fromDDL("n_words long, n_features long, weight long").fields])
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weighed(batches):
        for batch, first, found, ends in stretches(batches, 1):
            starts = np.concatenate([[0], ends[:-1]])
            n_words = ends - starts
            weight, n_features = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
            for size, (at, number, hashes) in enumerate(tuples(found, ends, longest), 1):
                worth = held.value[hashes % len(held.value)][number]
                total = np.concatenate([[0], np.cumsum(worth)])
                a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
                weight += total[b] - total[a]
                n_features += np.maximum(n_words - size + 1, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ends)), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]], names=schema.fieldNames())

    return docs.select(F.col(id).alias("id"), text).mapInArrow(weighed, schema)


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest of seed and id."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(first, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], *, among: Column, keep) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3... by ``order`` for the first ``keep(n)`` of the n rows that are ``among``; null for others."""
    # Written first: the ranges are cut from a sample that reads the rows a second time.
    rows = materialise(rows.withColumn("among_", among).withColumn("row_", F.monotonically_increasing_id()))
    placed = rows.repartitionByRange(F.desc("among_"), *order, "row_").sortWithinPartitions(F.desc("among_"), *order, "row_")
    placed = materialise(placed.withColumn("place_", F.monotonically_increasing_id()).withColumn("range_", F.shiftright("place_", 33)))
    sizes = sorted((r["range_"], r["n"], r["m"]) for r in placed.groupBy("range_").agg(F.count("*").alias("n"), F.count_if("among_").alias("m")).collect())  # a row a range
    before, offsets = 0, []
    for part, n, _ in sizes:
        offsets.append((part, before))
        before += n
    least = keep(sum(m for *_, m in sizes))
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "range_ long, before_ long"))
    place = F.col("before_") + F.col("place_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(offsets, "range_").withColumn("rank", F.when(F.col("among_") & (place <= least), place)).drop("among_", "row_", "place_", "range_", "before_")


def resample(docs: DataFrame, target: DataFrame, *, id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): ``percent`` of the rows of at least ``least_words`` words are drawn; ranks are
    theirs, in the order of the draw."""
    gain = gains(bucket_counts(docs, text=text, buckets=buckets, longest=longest), bucket_counts(target, text=target_text, buckets=buckets, longest=longest))
    scored = weigh(docs, gain, id=id, text=text, longest=longest).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return ranked(scored, [F.desc("score"), F.asc("id")], among=F.col("n_words") >= least_words, keep=lambda n: percent * n // 100)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_rows(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
