"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracadence.llm import linededup, mixing, neardup, packing, quality
from terracadence.llm.common import read
from terracadence.sources.staging import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go. Null and empty texts are scored like others; rows that repeat are scored alike; an empty table stays empty."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # no column of the input has a name that scoring uses
    scored = quality.score(docs.toDF(*own.values()), model, own["doc_id"], own["text"], own["n_chars"], keep=tuple(v for c, v in own.items() if c != "doc_id"))
    return scored.where("predicted = 1").select(*own.values()).toDF(*own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go from the texts; every document stays, n_chars follows a text that changed.

    Null texts, rows with a null id and empty tables come through as they are; rows that repeat id and text lose the
    same lines.
    """
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    cleaned = linededup.dedup_lines(docs.toDF(*own.values()), own["doc_id"], own["text"])
    n_chars = F.when(F.col("n_removed") > 0, F.length(own["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return cleaned.withColumn(own["n_chars"], n_chars).select(*own.values()).toDF(*own)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays. Texts without words and rows with a null id stay; rows that repeat id and text stay or go together; an empty table stays empty."""
    return neardup.keep_one(docs, percent=80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; those it does not take go, among them texts without words. Null sources are a source of their own; an empty table stays empty."""
    return mixing.take_mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens. A null or empty text is its end id alone; each row is a document, whatever its id; no rows give no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing_sources", mixing_sources),
    ("sequence_packing", sequence_packing),
]

#: A trained model decides in the first stage, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents. Each stage's rows are written to the shared folder and read again; a stage's input goes once its output stands."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark.sparkContext)}/{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)
