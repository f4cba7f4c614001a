"""The corpus pipeline: documents through five of the training-data operators, each stage written and read again.

Null and empty texts are not toxic, are no copies of others, have no passages or secrets, and are packed as one end token. Rows of one id with different texts
are documents of their own throughout; rows equal in both are copies, of which one stays. Null ids are never dropped as copies or cut.
Ties go to the smaller id. Texts are always handled as a whole, however long. Other columns are kept as they are, whatever their names, up to the last stage.
Empty tables give no rows, and without labels nothing is toxic.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import neardup, packing, secrets, substrings, toxicity
from kinloom.llm.common import collect_garbage, shared_folder, small_batches, table

#: A tokenizer, a packing and a hash-based fit can't be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def with_small_batches(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        collect_garbage(spark)  # files that the stage before left
        return stage(spark, docs, sf_dir)

    return run


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@with_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold. Learns from the labelled ones among the documents themselves."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


@with_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


@with_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of fifty words or more that an earlier one has."""
    return recounted(substrings.drop_repeats(docs))


@with_small_batches
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by their kinds."""
    return recounted(secrets.redact(docs))


@with_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids."""
    ranks = packing.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(docs, ranks, public_tokenizers.PATTERN, specials=packing.read_specials(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one keeps is written to the shared folder, read as the next one's input, and then deleted; the last one's stays."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return docs
