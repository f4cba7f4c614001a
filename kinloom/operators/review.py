"""What a review of ambiguous accounts changes: links, counts of a batch, kinds of failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy
from .resolve import dec

KEPT = ("kept_needs_review", "review_failed_keep_needs_review")


def final_links(linked: DataFrame, outcomes: DataFrame, limits: policy.Policy = policy.DEFAULT) -> DataFrame:
    """(run_id, account_key, decision, relationship, verification, confidence) after the review's outcomes (run_id, account_key, action, score), one at
    most for a link. A promoted link keeps what it has if an accepted one may have it; a score of nothing leaves the confidence; accepted links
    have the threshold's confidence at least."""
    out = linked.join(outcomes.select("run_id", "account_key", "action", "score"), ["run_id", "account_key"], "left")
    up, down = (F.coalesce(F.col("action") == x, F.lit(False)) for x in ("promoted_to_auto_match", "rejected_after_review"))
    one_of = lambda c, values, other: F.when(F.col(c).isin(*values), F.col(c)).otherwise(other)
    decision = F.when(up, "auto_match").when(down, "reject").otherwise(F.col("decision"))
    relation = F.when(up, one_of("relationship", policy.ACCEPTED_RELATIONSHIPS, "secondary")).when(down, "rejected").otherwise(F.col("relationship"))
    verified = F.when(up, one_of("verification", policy.ACCEPTED_VERIFICATIONS, "likely_same_person")).when(down, "rejected").otherwise(F.col("verification"))
    sure = F.when((up | down) & (F.col("score") != 0), F.col("score")).otherwise(F.col("confidence"))
    sure = F.when(decision == "auto_match", F.when(sure.isNotNull(), F.greatest(sure, dec(limits.auto_match)))).otherwise(sure)
    return out.select("run_id", "account_key", decision.alias("decision"), relation.alias("relationship"), verified.alias("verification"), sure.cast("decimal(5,4)").alias("confidence"))


def counters(outcomes: DataFrame) -> DataFrame:
    """Counts of each run's outcomes (run_id, skip_reason, reviewed, error, action); skipped: reason:count by reason."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    reviewed, wrong = F.col("reviewed"), F.col("error").isNotNull()
    per = outcomes.groupBy("run_id").agg(
        n(F.col("skip_reason").isNull()).alias("eligible"), n(F.col("skip_reason").isNotNull()).alias("not_eligible"), n(reviewed).alias("attempted"), n(reviewed & ~wrong).alias("succeeded"), n(wrong).alias("failed"),
        n(F.col("action") == "promoted_to_auto_match").alias("promoted"), n(F.col("action") == "rejected_after_review").alias("rejected"), n(F.col("action").isin(*KEPT)).alias("kept"),
    )
    by = outcomes.filter("skip_reason IS NOT NULL").groupBy("run_id", "skip_reason").agg(F.count(F.lit(1)).cast("string").alias("n"))
    by = by.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "skip_reason", "n"))), ",").alias("skipped"))
    return per.join(by, "run_id", "left").withColumn("skipped", F.coalesce("skipped", F.lit("")))


def _has(message: Column, markers) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(markers)), F.lit(False))


def failure_kind(status: Column, message: Column, name: Column) -> Column:
    """Kind of a failed model call: what can't succeed comes before what may the next time; an exception named as a timeout may."""
    fatal = F.coalesce(status.isin(*policy.FATAL_STATUSES), F.lit(False)) | _has(message, policy.FATAL_MARKERS)
    again = F.coalesce(status.isin(*policy.TRANSIENT_STATUSES), F.lit(False)) | _has(message, policy.TRANSIENT_MARKERS) | _has(name, ("timeout",))
    return F.when(fatal, "non_retryable").when(again, "retryable").otherwise("failed")
