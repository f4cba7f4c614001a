"""Upserts of streams into a table of files, and owners' rows replaced as a whole.

The table is cut by a hash of the key into buckets; `batch` and `bucket` are its partitions. A batch rewrites the buckets that its keys are in, under its own
number, and reads of each bucket the newest before it. So a batch that is tried again puts the same rows in the same place, and buckets without news stay
as they are. Beside the table stand the buckets of each batch, written when its rows are, so that half a batch is never read, and what a batch did to each
of its keys. Older files of a bucket stay, for batches that are tried again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.accounts import keep_latest
from ..sources.store import shared_folder

#: The number of the rows that a table starts with.
START = -1


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, number: int, *by: str) -> None:
    df.withColumn("batch", F.lit(number)).write.partitionBy("batch", *by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _put(rows: DataFrame, touched: DataFrame, path: str, number: int) -> None:
    """A batch's rows, and then its buckets; a bucket may be left without rows."""
    _write(rows, path, number, "bucket")
    _write(touched.select(F.col("bucket").cast("int")), f"{path}-buckets", number)


def start(rows: DataFrame, path: str, key: list[str], version: list[str], buckets: int) -> None:
    """A table of the newest row of each key, or without a version of all rows; a key may be null, and is one key then."""
    all_of_them = rows.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    _put((keep_latest(rows, key, version) if version else rows).withColumn("bucket", bucket_of(key, buckets)), all_of_them, path, START)


def state(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The table's rows with their bucket, as they are or as they were before a batch."""
    told = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(told).parquet(path)
    known = spark.read.schema("bucket int, batch int").parquet(f"{path}-buckets")
    newest = (known if before is None else known.filter(F.col("batch") < before)).groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), ["bucket", "batch"]).select(*schema.names, "bucket")


def merge(batch: DataFrame, number: int, path: str, key: list[str], version: list[str], buckets: int) -> None:
    """Merges a batch into the table, and writes (key, change) of each of its keys: new, changed, same (no column differs) or stale (what is there
    has a later version). Rows of one key and version: the batch's wins. Repeats within a batch count once, the newest of them."""
    spark, names = batch.sparkSession, batch.columns
    shared_folder(spark)
    new = keep_latest(batch, key, version).withColumn("bucket", bucket_of(key, buckets)).checkpoint(eager=True)
    old = state(spark, path, batch.schema, number).join(new.select("bucket").distinct(), "bucket", "left_semi")
    side = lambda df, n: df.select(F.struct(*key).alias("key"), F.struct(*names).alias(n), F.col("bucket").alias(f"b_{n}"))
    at = lambda n: F.struct(*[F.col(f"{n}.{v}") for v in version])
    # the key as a struct is never null, so null keys meet as well
    both = side(old, "old").join(side(new, "new"), "key", "full").checkpoint(eager=True)
    later = F.col("new").isNotNull() & (F.col("old").isNull() | (at("new") >= at("old")))
    _put(both.select(F.when(later, F.col("new")).otherwise(F.col("old")).alias("row"), F.coalesce("b_new", "b_old").alias("bucket")).select("row.*", "bucket"), new.select("bucket").distinct(), path, number)
    change = F.when(F.col("old").isNull(), "new").when(~later, "stale").when(F.col("new").eqNullSafe(F.col("old")), "same").otherwise("changed")
    _write(both.filter("new IS NOT NULL").select("key.*", change.alias("change")), f"{path}-changes", number)


def replace(rows: DataFrame, owners: DataFrame, number: int, path: str, buckets: int) -> None:
    """Puts rows in place of all that the owners (a row each, by the columns of the table's key) have; an owner without rows loses its own, and rows of
    others than these owners are not put in. Doing it again under the same number changes nothing."""
    spark, key = rows.sparkSession, owners.columns
    shared_folder(spark)
    told = owners.distinct().withColumn("bucket", bucket_of(key, buckets)).checkpoint(eager=True)
    touched = told.select("bucket").distinct()
    stays = state(spark, path, rows.schema, number).join(F.broadcast(touched), "bucket", "left_semi").alias("row")
    new = rows.withColumn("bucket", bucket_of(key, buckets)).alias("row")
    on = [F.col("row.bucket") == F.col("owner.bucket"), *[F.col(f"row.{k}").eqNullSafe(F.col(f"owner.{k}")) for k in key]]
    put = stays.join(told.alias("owner"), on, "left_anti").select(*rows.columns, "bucket").unionByName(new.join(told.alias("owner"), on, "left_semi").select(*rows.columns, "bucket"))
    _put(put.checkpoint(eager=True), touched, path, number)


def changes(spark: SparkSession, path: str) -> DataFrame:
    """(key, change, batch) of all batches."""
    return spark.read.parquet(f"{path}-changes")


def run(stream: DataFrame, path: str, key: list[str], version: list[str], buckets: int) -> DataFrame:
    """Merges all that a stream has now into the table, batch by batch, and gives the table. Progress is kept beside the table, so a later run goes on."""
    query = stream.writeStream.foreachBatch(lambda batch, number: merge(batch, number, path, key, version, buckets)).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return state(stream.sparkSession, path, stream.schema).drop("bucket")
