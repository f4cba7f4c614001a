import numpy as np
from pyspark.sql import functions as F

from kinloom.llm import blocks, grams
from kinloom.llm.common import pack, sample_ids, split_by_filter, tokens, unpack


def test_pack_round_trip():
    a, b, c = np.arange(5, dtype=np.int64), np.zeros(0, np.uint8), np.array([1.5, -2.0])
    got = unpack(pack(a, b, c), np.int64, np.uint8, np.float64)
    assert [x.tolist() for x in got] == [a.tolist(), [], c.tolist()]
    assert [x.tolist() for x in unpack(pack(a, a, a), np.int64, ..., np.int64)] == [a.tolist()] * 3


def test_tokens_are_cut_at_ascii_white_space_only():
    assert tokens("A b\tC\n\x0b\x0c\rd\xa0e É") == ["a".encode(), b"b", b"c", "d\xa0e".encode(), "É".encode()]
    assert tokens(None) == tokens("") == []


def test_filter_keeps_all_ids(spark):
    df = spark.range(500).withColumn("id", F.when(F.col("id") % 50 > 0, F.col("id")))
    for bits in (64, 1 << 16):  # crowded, and roomy
        may, rest = split_by_filter(df, "id", spark.range(100, 120), bits)
        assert {r[0] for r in may.collect()} >= set(range(101, 120)) and may.count() + rest.count() == 500
        assert not {r[0] for r in rest.collect()} & set(range(101, 120)) and rest.filter("id IS NULL").count() == 10
    may, rest = split_by_filter(df, "id", spark.range(0))
    assert may.count() == 0 and rest.count() == 500


def test_sample_is_the_same_with_and_without_the_cut(spark):
    df = spark.range(3000).toDF("doc_id")
    want = [r[0] for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()]
    assert [r[0] for r in sample_ids(df, 40).collect()] == want
    assert sample_ids(df.limit(10), 40).count() == 10


def test_blocks_count_words_once_a_shard(spark):
    texts = ["a b a", "b c", None, "a " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = blocks.cut(docs.coalesce(1), tokens, lambda i: i != 3, block_tokens=4)
    found = {}
    for row in blocks.vocabulary(cut).groupBy("shard").agg(F.collect_list("data").alias("data")).collect():
        words, _, n, used = blocks.shard_words([bytes(x) for x in row["data"]])
        found |= {w: (int(x), int(y)) for w, x, y in zip(words, n, used)}
    assert found == {b"a": (52, 2), b"b": (2, 2), b"c": (1, 1)}


def test_grams_stay_within_words():
    at, of = grams.hashed([b"ab", b"", b"abcd"], (3,), 1 << 10, whole=False)
    assert np.bincount(of, minlength=3).tolist() == [2, 0, 4]
