"""The corpus pipeline: documents that the quality classifier rejects go, boilerplate lines go, one document of each group of near
copies stays, sources are mixed to target weights, and the rest is encoded.

Each stage takes all that its predecessor kept and, but for the last, returns the columns of ``documents``. SQL cannot express the
classifier, the fingerprints, the mix or the encoder, so there is no ORACLE_SQL; each stage has a brute-force test.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import line_dedup, mixing, quality, sentencepiece_codec, simhash
from tessella.llm.common import removed, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (a score under ``quality.CUT``); texts stay as they are. The classifier learns
    from labelled documents only, and scores within the JVM, so no text leaves its row."""
    model = quality.train_on(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(quality.with_statistics(docs.select(*COLUMNS)), model)
    return scored.filter(F.col("score") >= quality.CUT).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are boilerplate within their source; ``n_chars`` follows the text. Documents stay, even if empty."""
    kept = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id."""
    return simhash.drop_near_copies(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by their source's target weight; a document comes once for each epoch that takes it."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text: (doc_id, source, n_tokens, ids). Workers remember fewer words than the operator does by itself, as
    the executors' heaps have grown in the stages before."""
    coded = sentencepiece_codec.encode_texts(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), words=100_000)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the shared folder and read again; what a stage has
    read is removed once its own output is complete."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
