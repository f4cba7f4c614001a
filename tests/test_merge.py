"""Upserts of streams."""

from pyspark.sql import functions as F

from kinloom.streaming import merge

SCHEMA = "k long, version int, v string"


def test_batches_replayed_and_late(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    merge.start(rows((1, 1, "a"), (2, 1, "b"), (1, 0, "z"), (None, 1, "n")), path, ["k"], ["version"], 3)
    batches = [rows((2, 2, "c"), (3, 1, "d"), (3, 2, "e")), rows((1, 0, "old"), (2, 2, "c"), (None, 2, "m")), rows()]
    for _ in range(2):  # the second one is tried again after all of them
        for number, batch in enumerate(batches):
            merge.merge(batch, number, path, ["k"], ["version"], 3)
        batches = [batches[0], batches[1]]
        merge.merge(batches[1], 1, path, ["k"], ["version"], 3)
    schema = batches[0].schema
    assert {tuple(r) for r in merge.state(spark, path, schema).drop("bucket").collect()} == {(1, 1, "a"), (2, 2, "c"), (3, 2, "e"), (None, 2, "m")}
    assert {tuple(r) for r in merge.state(spark, path, schema, 0).drop("bucket").collect()} == {(1, 1, "a"), (2, 1, "b"), (None, 1, "n")}
    assert {(r.k, r.change, r.batch) for r in merge.changes(spark, path).collect()} == {(2, "changed", 0), (3, "new", 0), (1, "stale", 1), (2, "same", 1), (None, "changed", 1)}
    assert merge.changes(spark, path).count() == 5


def test_a_stream_gives_what_one_batch_gives(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 37).alias("k"), F.col("id").cast("int").alias("version"), F.col("id").cast("string").alias("v"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    merge.start(df.limit(0), str(tmp_path / "t"), ["k"], ["version"], 4)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):  # nothing new the second time
        got = merge.run(stream, str(tmp_path / "t"), ["k"], ["version"], 4)
        assert {(r.k, r.version) for r in got.collect()} == {(k, max(i for i in range(400) if i % 37 == k)) for k in range(37)} and got.count() == 37
    assert merge.changes(spark, str(tmp_path / "t")).select("batch").distinct().count() == 3


def test_owners_rows_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    owners = spark.createDataFrame([(1,), (2,), (4,), (None,), (1,)], "k long")
    merge.start(rows((1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "d"), (None, "e")), path, ["k"], [], 2)
    for _ in range(2):
        merge.replace(rows((1, "x"), (1, "x"), (4, "y"), (3, "not its own"), (None, "z")), owners, 0, path, 2)
        got = sorted(map(repr, (tuple(r) for r in merge.state(spark, path, rows().schema).drop("bucket").collect())))
        assert got == sorted(map(repr, [(1, "x"), (1, "x"), (3, "d"), (3, "d"), (4, "y"), (None, "z")]))
    merge.replace(rows(), spark.createDataFrame([(1,), (3,), (4,), (None,)], "k long"), 1, path, 2)  # nothing is left
    assert merge.state(spark, path, rows().schema).count() == 0
    assert merge.state(spark, path, rows().schema, 1).count() == 6
