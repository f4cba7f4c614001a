"""Reads, writes and rewrites of tables, where a database would update rows in place."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .accounts import keep_latest


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; checkpoints go there as well. Only a local session, whose executors are the
    driver, gets a temporary one if it names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Old rows with new ones in their place, by key; columns that one side lacks are null."""
    return keep_latest(align(old, new), key, version)


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, whatever columns either lacks."""
    return old.unionByName(new, allowMissingColumns=True)


def replace_runs(df: DataFrame, path: str) -> None:
    """Writes runs' rows over what was there of the same runs, and leaves other runs: a rerun changes nothing."""
    df.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def purge(runs: DataFrame, cutoff: Column, finished: tuple[str, ...] = ("resolved", "partial", "failed")) -> DataFrame:
    """Runs that stay when finished ones from before the cutoff go."""
    old = F.col("status").isin(*finished) & (F.col("completed_at") < cutoff)
    return runs.filter(~F.coalesce(old, F.lit(False)))


def merge_patch(old: Column, patch: Column) -> Column:
    """A shallow merge of two maps: the patch's values win."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch)


def compact(values: Column) -> Column:
    """A map without nulls and empty texts."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & (v != ""))


def attempt_outcome(status: Column) -> Column:
    """What an ingestion attempt came to, by its status; null: timed out."""
    return F.when(status.isNull(), "timed_out").when(status < 400, "succeeded").when(status == 404, "not_found").when(status == 429, "rate_limited").otherwise("failed")


def ingestion_summary(attempts: DataFrame, key: str) -> DataFrame:
    """Sources tried, sources that gave something, and those that only failed, for each key. attempts: (key, source, outcome)."""
    ok = F.collect_set(F.when(F.col("outcome") == "succeeded", F.col("source")))
    bad = F.collect_set(F.when(F.col("outcome") != "succeeded", F.col("source")))
    rows = attempts.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("attempted"), F.array_sort(ok).alias("succeeded"), bad.alias("bad"))
    return rows.select(key, "attempted", "succeeded", F.array_sort(F.array_except("bad", "succeeded")).alias("failed"))


def rate_limit(headers: Column, body: Column | None = None) -> Column:
    """Totals, what remains, reset time (epoch seconds) and wait of a response, from header or body fields of any of the platforms."""
    number = lambda *names: F.coalesce(*[F.try_to_number(headers[n], F.lit("9999999999")).cast("long") for n in names])
    own = lambda n: F.get_json_object(body, f"$.{n}").cast("long") if body is not None else F.lit(None).cast("long")
    return F.struct(
        F.coalesce(number("x-ratelimit-limit", "ratelimit-limit"), own("quota_max")).alias("total"),
        F.coalesce(number("x-ratelimit-remaining", "ratelimit-remaining"), own("quota_remaining")).alias("remaining"),
        number("x-ratelimit-reset", "ratelimit-reset").alias("reset_s"),
        F.coalesce(number("retry-after"), own("backoff")).alias("retry_after_s"),
    )


#: Rules that stored rows must meet, by table.
CALL_RULES = {"status_range": "status_code NOT BETWEEN 100 AND 599", "duration": "duration_ms < 0", "remaining": "rate_limit_remaining < 0", "error_without_cause": "status_code IS NULL AND error_message IS NULL"}
RUN_RULES = {"status": "status NOT IN ('running', 'resolved', 'partial', 'failed')", "duration": "duration_ms < 0", "slow": "duration_ms > 4900"}
EVIDENCE_RULES = {"weight_range": "weight < 0 OR weight > 1", "no_account": "account_key IS NULL", "self_pair": "account_key = other_key"}
