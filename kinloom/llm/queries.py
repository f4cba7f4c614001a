"""The queries of the training-data operators: each one applies its operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, shared_folder, table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(crc_mod(F.col("doc_id"), 4) != 2))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.report(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digests(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    # the same vocabulary as byte_bpe_50k.json, as ranks
    ranks = packing.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    specials = packing.read_specials(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, specials=specials).drop("ids")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(crc_mod(F.col("doc_id"), 5) != 0))
    told = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), langid.predict(F.col("text"), model).alias("told"))
    return told.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    vectors = ann.valid(table(spark, sf_dir, "embeddings"))
    return ann.search(ann.index(vectors), vectors.filter("vec_id % 20 = 0"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import trie

    return trie.nodes(trie.spliced(trie.conversations(table(spark, sf_dir, "conversations"))))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.pages_of(warc.assemble(warc.read(spark, folder, blocks=("metadata",))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periods

    return periods.digests(periods.find(table(spark, sf_dir, "documents"), periods.repeat_tail))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_tree, op2_byte_bpe, op3_packing, op4_quality_rules, op5_toxicity, op6_minhash, op7_language_id, op8_hnsw, op9_compact_windows, op10_secret_scans, op11_prefix_trie, op12_warc, op13_periodic_runs)
}
