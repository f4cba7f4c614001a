"""Roll-ups of runs, API calls and language-model usage; rate windows and retry rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy
from ..functions import text


def run_metrics(runs: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    mean = F.coalesce(F.avg(F.when(F.col("status").isin("resolved", "partial"), F.col("duration_ms"))), F.lit(0.0))
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), n("resolved").alias("resolved_runs"), n("partial").alias("partial_runs"), n("failed").alias("failed_runs"), mean.alias("avg_duration_ms"))


def failed() -> Column:
    return F.col("status_code").isNull() | (F.col("status_code") >= 400) | F.col("error_message").isNotNull()


def call_metrics(calls: DataFrame) -> DataFrame:
    """Each of the fixed sources, called or not."""
    per = calls.groupBy("source").agg(F.count(F.lit(1)).alias("total_calls"), F.count_if(failed()).alias("error_calls"), F.avg("duration_ms").alias("avg_ms"))
    fixed = calls.sparkSession.createDataFrame([(s,) for s in policy.SOURCES], "source string")
    return fixed.join(per, "source", "left").select("source", F.coalesce("total_calls", F.lit(0)).alias("total_calls"), F.coalesce("error_calls", F.lit(0)).alias("error_calls"), F.coalesce("avg_ms", F.lit(0.0)).alias("avg_ms"))


def calls_by_source(calls: DataFrame) -> DataFrame:
    return calls.filter("source <> 'gemini'").groupBy("source").agg(F.count(F.lit(1)).alias("calls"), F.count_if(failed()).alias("failures"), F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 2).alias("avg_ms"), F.max("created_at").cast("string").alias("last_call"))


def latest_call(calls: DataFrame) -> DataFrame:
    return calls.groupBy("source").agg(F.max_by(F.struct("event_id", "status_code"), F.struct("created_at", "event_id")).alias("x")).select("source", "x.event_id", "x.status_code")


def latest_rate_limit(calls: DataFrame) -> DataFrame:
    return calls.filter("source = 'github' AND rate_limit_remaining IS NOT NULL").orderBy(F.desc("created_at"), F.desc("event_id")).limit(1).select("event_id", "rate_limit_remaining")


def llm_usage(turns: DataFrame) -> DataFrame:
    n = text.estimate_tokens(F.col("text"))
    return turns.filter("role = 'assistant'").agg(F.count(F.lit(1)).alias("summaries"), F.coalesce(F.sum(n), F.lit(0)).alias("output_tokens"), F.max(n).alias("longest"))


def json_sums(calls: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return calls.groupBy("source").agg(F.sum(F.coalesce(F.nullif(k, F.lit(0)), F.lit(1))).alias("k_sum"), F.count_if(k.isNull()).alias("k_missing"))


BUCKET_S = 3600


def bucketed(calls: DataFrame, seconds: int) -> DataFrame:
    """calls with `at` (microseconds), in buckets of an hour or of the window if that is longer, so that a source's calls are many tasks' work. A call that a
    bucket's first ones look back to is in it as well, with `own` false."""
    size = max(BUCKET_S, seconds) * 1_000_000
    at = calls.withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")))
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + seconds * 1_000_000) / size)
    return at.withColumn("first", first).withColumn("bucket", F.explode(F.sequence(first, last))).withColumn("own", F.col("bucket") == F.col("first")).drop("first")


def rolling_window(calls: DataFrame, seconds: int = 30) -> DataFrame:
    """Calls of the source in the seconds up to each call."""
    w = Window.partitionBy("source", "bucket").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    return bucketed(calls.select("event_id", "source", "created_at"), seconds).withColumn("in_window", F.count(F.lit(1)).over(w)).filter("own").select("event_id", "source", "in_window")


def spacing(calls: DataFrame, seconds: int = 12) -> DataFrame:
    """Calls that came sooner after the source's one before than they should."""
    before = F.lag("at").over(Window.partitionBy("source", "bucket").orderBy("at", "event_id"))  # one that isn't in the bucket is long enough ago
    gaps = bucketed(calls.select("event_id", "source", "created_at"), seconds).withColumn("gap", F.col("at") - before)
    return gaps.filter(F.col("own") & (F.col("gap") < seconds * 1_000_000)).select("event_id", "source", F.col("gap").alias("gap_us"))


def tumbling(calls: DataFrame) -> DataFrame:
    w = F.window(F.col("created_at").cast("timestamp"), "1 hour")
    return calls.groupBy(w.alias("w"), "source").agg(F.count(F.lit(1)).alias("calls")).select(F.unix_seconds("w.start").alias("start_s"), "source", "calls")


def sliding(calls: DataFrame) -> DataFrame:
    w = F.window(F.col("created_at").cast("timestamp"), "2 hours", "1 hour")
    return calls.groupBy(w.alias("w"), "source").agg(F.count(F.lit(1)).alias("calls")).select(F.unix_seconds("w.start").alias("start_s"), "source", "calls")


def sessions(calls: DataFrame, minutes: int = 10, bucket_minutes: int = 60) -> DataFrame:
    """(start_us, source, calls): runs of a source's calls with gaps under so many minutes. Calls without a time belong to none.

    Islands are found within time buckets (no shorter than the gap), so a source is many tasks' work; only those that reach so near to a bucket's edge that they may go on beyond it,
    two a bucket at most, are stitched in a second pass by source.
    """
    gap, size = minutes * 60_000_000, max(minutes, bucket_minutes) * 60_000_000

    def islands(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("start", "end")
        new = F.coalesce((F.col("start") - F.lag("end").over(w) >= gap).cast("int"), F.lit(1))
        n = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("new", new).withColumn("n", n).groupBy(*keys, "n").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("calls").alias("calls")).drop("n")

    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    each = calls.select("source", at.alias("start"), at.alias("end"), F.lit(1).alias("calls")).filter("start IS NOT NULL").withColumn("bucket", F.floor(F.col("start") / size))
    within = islands(each, "source", "bucket")
    edge = (F.col("start") - F.col("bucket") * size < gap) | ((F.col("bucket") + 1) * size - F.col("end") < gap)
    whole = within.filter(~edge).select("source", "start", "calls").unionByName(islands(within.filter(edge), "source").select("source", "start", "calls"))
    return whole.select(F.col("start").alias("start_us"), "source", "calls")


def error_kind(status: Column) -> Column:
    return F.when(status.isNull(), "timeout").when(status == 404, "not_found").when(status == 429, "rate_limited").when(status >= 400, "api_error")


def retry_plan(calls: DataFrame, attempts: int = 3, longest_s: float = 3.0) -> DataFrame:
    """Type of failure, whether to try again, and the wait before: what the answer asks for, else half a second doubled each time, longest_s at most.
    There is no new try while a quota is spent whose reset is known, nor if a rate-limited answer asks for a longer wait.
    calls may lack rate_limit_remaining, rate_limit_reset and retry_after_s."""
    given = lambda c: F.when(F.col("status_code").isNotNull(), F.col(c)) if c in calls.columns else F.lit(None)
    status, attempt, after = F.col("status_code"), (F.col("event_id") % attempts + 1), given("retry_after_s").cast("double")
    spent = F.coalesce((given("rate_limit_remaining") == 0) & given("rate_limit_reset").isNotNull(), F.lit(False))
    too_long = F.coalesce((status == 429) & (after > longest_s), F.lit(False))
    again = (status.isNull() | status.isin(*policy.RETRY_STATUSES)) & (attempt < attempts) & ~spent & ~too_long
    wait = F.least(F.lit(longest_s), F.coalesce(after, F.lit(0.5) * F.pow(F.lit(2.0), attempt - 1)))
    return calls.filter(failed()).select("event_id", error_kind(status).alias("kind"), again.alias("again"), F.when(again, wait).alias("wait_s"))
