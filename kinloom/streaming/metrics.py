"""Call metrics as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder


def hourly(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls an hour and type, with a watermark. calls: ts (timestamp), event_type."""
    w = F.window("ts", "1 hour")
    return calls.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "calls")


def first_seen(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, within the watermark."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives over all that there is now. Batches go to files in the shared folder, as does the stream's state; of mode `complete`
    the last one is the result, of `append` all are."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    batches = []

    def put(batch: DataFrame, number: int) -> None:  # a batch that is tried again takes its own place
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        batches.append(number)

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    found = sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/batch-{n}" for n in (found if mode == "append" else found[-1:])])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of a parquet file or folder as a stream."""
    table = spark.read.parquet(path)
    folder, name = path.rsplit("/", 1)
    single = any(f.rstrip("/").endswith(f"/{name}") for f in table.inputFiles())  # a stream reads folders
    stream = spark.readStream.schema(table.schema)
    stream = stream.option("pathGlobFilter", name).parquet(folder) if single else stream.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))
