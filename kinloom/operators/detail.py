"""Whole profiles as nested rows: links with their accounts and evidence, conflicts, facts, candidates and warnings of each run.

Each child table is aggregated once, by run or by link, and joined by key; a run's arrays are as long as its accounts and pairs are many, which the caps on
candidates bound. Every run of the requests has a row, also one without accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Warnings of a profile: when, what it says, and the numbers that go with it. A profile that is blocked has one of the first two alone.
WARNINGS = {
    "no_candidates_found": ("n_auto = 0 AND n_accounts = 0", "The search found no public account for this request.", {"reason": "no_candidates_found", "review_candidates": "0"}),
    "profile_needs_review": ("n_auto = 0 AND n_accounts > 0", "No account is trusted yet; look at the candidates before using this profile.", {"reason": "no_auto_match_accounts", "review_candidates": None}),
    "canonical_fields_pending": ("n_auto > 0 AND fields_pending", "The fields wait for a review of the candidates that were kept.", {}),
    "ambiguous_candidates_present": ("n_auto > 0 AND n_review > 0", "Some candidates are kept for review and don't count for any field.", {"review_candidates": None}),
}
#: What is told of an accepted, possible or rejected account.
CANDIDATE = ("account_key", "source", "relationship", "verification", "confidence", "evidence_confidence", "basis", "risk", "is_anchor", "hn_conservative", "reason")


def collected(df: DataFrame, keys: list[str], name: str, fields: list[str], order: list[Column]) -> DataFrame:
    """(keys, name): the rows of each key as an array of structs of fields, in order (ties by the fields)."""
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("row"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["row"]).alias(name))


def _or_empty(df: DataFrame, like: DataFrame, *names: str) -> list[Column]:
    types = dict(like.dtypes)
    return [F.coalesce(n, F.array().cast(types[n])).alias(n) for n in names]


def full_read(requests: DataFrame, linked: DataFrame, accounts: DataFrame, ev: DataFrame, cf: DataFrame, facts: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(run_id, links, conflicts, facts[, summary]): everything that is stored of a run. links are the most confident first, each with its `account` and `evidence`;
    summaries (run_id, created_at, summary), if given: the latest one of each run."""
    link = ["run_id", "account_key"]
    told = collected(ev, link, "evidence", ["signal", "signal_group", "weight", "other_key"], [F.col("signal"), F.col("other_key")])
    own = accounts.select(*link, F.struct("handle", "display_name", "location", "website_url", "profile_url").alias("account"))
    whole = linked.join(own, link, "left").join(told, link, "left")
    whole = whole.select(*[c for c in whole.columns if c != "evidence"], *_or_empty(whole, told, "evidence"))
    children = [
        collected(whole, ["run_id"], "links", ["account_key", "source", "decision", "relationship", "verification", "confidence", "account", "evidence"], [-F.col("confidence"), F.col("account_key")]),
        collected(cf, ["run_id"], "conflicts", ["conflict", "basis", "severity", "penalty", "lk", "rk"], []),
        collected(facts, ["run_id"], "facts", ["account_key", "fact", "value", "confidence"], []),
    ]
    out = requests.select("run_id").distinct()
    for child in children:
        out = out.join(child, "run_id", "left")
    out = out.select("run_id", *[c for child in children for c in _or_empty(out, child, child.columns[1])])
    if summaries is not None:
        out = out.join(summaries.groupBy("run_id").agg(F.max_by("summary", F.struct("created_at", "summary")).alias("summary")), "run_id", "left")
    return out


def reason(explanation: Column) -> Column:
    """Why an account stands where it does: what the request says of it, else the first two sentences of its score."""
    hn = F.col("source") == "hackernews"
    named = F.when(hn, "Named in the request and taken as a claim; sparse profiles of this platform need more support.").otherwise("Named in the request and taken as a claim; ownership isn't verified.")
    return F.when(F.col("is_anchor"), named).otherwise(F.array_join(F.slice(explanation, 1, 2), " "))


def warnings() -> Column:
    """The warnings that hold, in the order of the rules; columns n_auto, n_review, n_accounts and fields_pending."""
    count = F.col("n_review").cast("string")

    def one(code: str, test: str, message: str, details: dict) -> Column:
        known = [x for k, v in details.items() for x in (F.lit(k), count if v is None else F.lit(v))]
        return F.when(F.expr(test), F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), (F.create_map(*known) if known else F.create_map().cast("map<string,string>")).alias("details")))

    return F.array_compact(F.array(*[one(code, *rule) for code, rule in WARNINGS.items()]))


def field_sources(profile: DataFrame, facts: DataFrame, fields: tuple[str, ...] = ("display_name", "location", "bio")) -> DataFrame:
    """(run_id, field_sources): for each field of a profile, the accounts that say just its value."""
    values = profile.select("run_id", F.inline(F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).alias("value")) for f in fields]))).filter("value IS NOT NULL")
    who = facts.join(values, ["run_id", "fact", "value"]).groupBy("run_id", "fact").agg(F.array_sort(F.collect_set("account_key")).alias("accounts"))
    return collected(who, ["run_id"], "field_sources", ["fact", "accounts"], [])


def detail(requests: DataFrame, decided: DataFrame, linked: DataFrame, profile: DataFrame, facts: DataFrame, explanations: DataFrame) -> DataFrame:
    """A row for each run of the requests: the profile's fields, `sources`, `review_candidates` and `rejected_candidates` (arrays, best first), what the fields rest on, the outcome and warnings."""
    link = ["run_id", "account_key"]
    more = decided.select(*link, "basis", "risk", "is_anchor")
    each = linked.join(more, link).join(explanations, link, "left").withColumns({"hn_conservative": F.col("source") == "hackernews", "reason": reason(F.col("explanation"))})
    # one aggregation gives all three lists: those of other decisions are null and left out
    of = lambda decision: F.transform(F.sort_array(F.collect_list(F.when(F.col("decision") == decision, F.struct((-F.col("confidence")).alias("o"), F.struct(*CANDIDATE).alias("row"))))), lambda x: x["row"])
    n = lambda decision: F.count_if(F.col("decision") == decision)
    lists = each.groupBy("run_id").agg(
        of("auto_match").alias("sources"), of("needs_review").alias("review_candidates"), of("reject").alias("rejected_candidates"), n("auto_match").alias("n_auto"), n("needs_review").alias("n_review"), n("reject").alias("n_reject"),
        F.count(F.lit(1)).alias("n_accounts"), F.max("evidence_confidence").alias("max_evidence_confidence"), F.max("confidence").alias("max_decision_confidence"),
    )
    fields = [c for c in ("display_name", "headline", "location", "bio", "website", "skills", "level") if c in profile.columns]
    told = field_sources(profile, facts)
    out = requests.select("run_id").distinct().join(profile.select("run_id", *fields), "run_id", "left").join(lists, "run_id", "left").join(told, "run_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_auto", "n_review", "n_reject", "n_accounts")}
    pending = profile.columns.count("fields_pending")
    out = out.select("run_id", *fields, *_or_empty(out, lists, "sources", "review_candidates", "rejected_candidates"), *_or_empty(out, told, "field_sources"), "max_evidence_confidence", "max_decision_confidence", *[v.alias(k) for k, v in counts.items()])
    out = out.join(profile.select("run_id", "fields_pending"), "run_id", "left").fillna(False, "fields_pending") if pending else out.withColumn("fields_pending", F.lit(False))
    outcome = F.when(F.col("n_auto") > 0, "resolved").when(F.col("n_accounts") == 0, "no_candidates_found").when(F.col("n_review") > 0, "ambiguous_candidates").otherwise("no_confident_match")
    stage = F.when(F.col("n_auto") > 0, "deterministic_built").otherwise("canonical_build_blocked")
    return out.withColumns({"outcome": outcome, "stage": stage, "warnings": warnings()})
