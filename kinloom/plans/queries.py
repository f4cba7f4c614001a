"""One query for each operator, over the tables derived from the star schema."""

from __future__ import annotations

import re
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..operators import detail, discovery, golden, health, packets, resolve, review
from ..sources import accounts as sources
from ..sources import bundles as sources_of
from ..sources import store
from ..streaming import merge, metrics
from . import derive


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _num(df: DataFrame) -> DataFrame:
    """Decimals as doubles, arrays of strings as text: what the comparison with SQL expects."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.array_join(c, ",").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder, so that stages which several others read run once and plans stay small."""
    store.shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: What kept() plans by: Spark doesn't know how a plan that adapts is dealt, and rows that are dealt by run may meet by run and account where they are.
KEPT = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def kept(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint that is known to be dealt and sorted as they are, so that what joins, groups and ranks by that needs no shuffle."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name) for name in KEPT}
    try:
        for name, value in KEPT.items():
            conf.set(name, value)
        return cut(df)
    finally:
        for name, value in before.items():
            conf.set(name, value)


def dealt(df: DataFrame, column: str, *order: str) -> DataFrame:
    """The rows as kept(), dealt by a column and, if an order is given, sorted by it within each partition."""
    # these columns go by other names below and get theirs back on top: a checkpoint that reads views keeps how it is dealt by columns that it no longer has
    own = {c: f"dealt_{n}" for n, c in enumerate(dict.fromkeys((column, *order)))}
    rows = df.withColumnsRenamed(own).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), own[column])
    if order:
        rows = rows.sortWithinPartitions(*[own[c] for c in order])
    return kept(rows.select(*[F.col(own.get(c, c)).alias(c) for c in df.columns]))


class Resolution:
    """The stages of one resolution, each a DataFrame that is worked out when it is first asked for. Requests and accounts are dealt by run once; all
    that follows is work within a run and stays where it is, but for rows that come from a Python worker: of these Spark forgets how they are dealt."""

    def __init__(self, accounts: DataFrame, requests: DataFrame):
        self.raw, self.asked = accounts, requests

    @cached_property
    def requests(self) -> DataFrame:
        return dealt(self.asked, "run_id")

    @cached_property
    def accounts(self) -> DataFrame:
        return dealt(resolve.normalized(self.raw), "run_id", "run_id", "account_key")

    @cached_property
    def pairs(self) -> DataFrame:
        return resolve.pairs(self.accounts)

    @cached_property
    def evidence(self) -> DataFrame:
        return kept(resolve.evidence(self.accounts, self.requests, self.pairs))

    @cached_property
    def conflicts(self) -> DataFrame:
        return dealt(resolve.conflicts(self.pairs), "run_id")

    @cached_property
    def account_scores(self) -> DataFrame:
        return kept(resolve.account_scores(self.accounts, self.evidence))

    @cached_property
    def pair_scores(self) -> DataFrame:
        return kept(resolve.pair_scores(self.pairs, self.evidence, self.conflicts))

    @cached_property
    def decided(self) -> DataFrame:
        return kept(resolve.classify(self.accounts, self.requests, self.evidence, self.account_scores, self.pair_scores))

    @property
    def links(self) -> DataFrame:
        return golden.links(self.decided)

    @cached_property
    def bundles(self) -> DataFrame:
        return kept(golden.bundles(self.links, self.accounts))


def resolution(spark: SparkSession, d: str) -> Resolution:
    return Resolution(derive.accounts(spark, d), derive.requests(spark, d))


QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def health_profile_metrics(spark, d):
    return health.run_metrics(derive.runs(spark, d))


@query
def health_api_calls(spark, d):
    return health.call_metrics(derive.calls(spark, d))


@query
def health_latest_rate_limit(spark, d):
    return health.latest_rate_limit(derive.calls(spark, d))


@query
def health_llm_usage(spark, d):
    return health.llm_usage(_t(spark, d, "conversations"))


@query
def api_metrics_by_source(spark, d):
    return health.calls_by_source(derive.calls(spark, d)).withColumn("last_call", F.substring("last_call", 1, 19))


@query
def latest_call_per_source(spark, d):
    return health.latest_call(derive.calls(spark, d))


@query
def llm_metadata_json_sums(spark, d):
    return health.json_sums(derive.calls(spark, d))


@query
def rolling_rate_window(spark, d):
    return health.rolling_window(derive.calls(spark, d))


@query
def call_spacing_violations(spark, d):
    return health.spacing(derive.calls(spark, d))


@query
def tumbling_activity(spark, d):
    return health.tumbling(derive.calls(spark, d))


@query
def sliding_activity(spark, d):
    return health.sliding(derive.calls(spark, d))


@query
def session_activity(spark, d):
    return health.sessions(derive.calls(spark, d))


@query
def retry_policy(spark, d):
    n = F.col("event_id")
    c = derive.calls(spark, d).withColumns({"rate_limit_remaining": F.col("rate_limit_remaining") % 3, "rate_limit_reset": F.when(n % 2 == 0, n), "retry_after_s": F.when(n % 5 < 3, n % 8)})
    return health.retry_plan(c)


@query
def stream_watermark_counts(spark, d):
    return metrics.run_once(spark, metrics.hourly(metrics.read(spark, f"{d.rstrip('/')}/events.parquet")), "complete")


@query
def stream_dedupe(spark, d):
    seen = metrics.first_seen(metrics.read(spark, f"{d.rstrip('/')}/events.parquet"))
    return metrics.run_once(spark, seen.select("event_id", "event_type"), "append")


@query
def account_keys(spark, d):
    return derive.accounts(spark, d).select("run_id", text.account_key(F.col("source"), F.col("user_id"), F.col("handle")).alias("account_key"))


@query
def upsert_latest_account(spark, d):
    a = derive.accounts(spark, d).select(F.lower("handle").alias("handle_key"), "account_key", F.col("user_id").cast("long").alias("version"))
    return sources.keep_latest(a, ["handle_key"], ["version"])


@query
def raw_record_grouping(spark, d):
    a = derive.accounts(spark, d).withColumn("id", F.col("user_id").cast("long"))
    raw = a.select("id", "source", F.lit("profile").alias("record_type"), F.when(F.col("id") % 3 < 2, F.col("user_id")).alias("user_id"), F.when(F.col("id") % 3 > 0, F.col("handle")).alias("handle"), F.col("id").alias("fetched_at"))
    return sources.grouped(raw).groupBy("source", "account_group").agg(F.count(F.lit(1)).alias("n_records"))


def _bundles(spark, d):
    """What each platform would have answered for the derived accounts, as one JSON document a candidate."""
    n, t = F.col("id"), F.col("topics")
    a = derive.accounts(spark, d).withColumn("id", F.col("user_id").cast("long"))
    site, bio, place, name = F.col("website_url"), F.col("bio"), F.col("location"), F.col("display_name")
    repos = F.transform(t, lambda x, i: F.struct(x.alias("name"), x.alias("language"), (n * (i + 3) % 17).alias("stargazers_count"), F.array(x).alias("topics")))
    github = F.struct(F.struct("id", F.col("handle").alias("login"), name.alias("name"), bio.alias("bio"), place.alias("location"), site.alias("blog"), F.col("profile_url").alias("html_url"), (n % 50).alias("public_repos"), (n % 1000).alias("followers"), (n % 7).alias("following")).alias("profile"), repos.alias("repos"))
    items = lambda *x: F.struct(F.array(*x).alias("items"))
    user = F.struct(n.alias("user_id"), F.coalesce(name, F.lit("n")).alias("display_name"), F.col("profile_url").alias("link"), place.alias("location"), site.alias("website_url"), (n % 3000).alias("reputation"), F.struct((n % 5).alias("bronze")).alias("badge_counts"))
    stack = F.struct(items(user).alias("user"), items(F.struct(F.slice(t, 1, 2).alias("tags"))).alias("answers"), items(F.struct(t.alias("tags")), F.struct(F.slice(t, 2, 1).alias("tags"))).alias("questions"))
    writer = F.struct("id", F.col("handle").alias("username"), name.alias("name"), bio.alias("summary"), place.alias("location"), site.alias("website_url"), F.concat(F.lit("gh"), F.col("run_id").cast("string")).alias("github_username"))
    article = lambda x, tags: F.struct(F.concat(F.lit("On "), x).alias("title"), tags.alias("tag_list"), F.array(F.lit("dev"), x).alias("tags"), (n % 4).alias("comments_count"))
    listed = F.struct(writer.alias("user"), F.transform(t, lambda x: article(x, F.array(x, F.lit("Web")))).alias("articles"))
    joined = F.struct(writer.alias("user"), F.transform(t, lambda x: article(x, F.concat(x, F.lit(", Web,")))).alias("articles"))
    hits = F.transform(t, lambda x, i: F.struct(x.alias("title"), i.cast("string").alias("objectID"), F.array(F.when((n + i) % 2 == 0, "story").otherwise("comment")).alias("_tags"), i.alias("points")))
    reader = F.struct(F.struct(F.col("handle").alias("username"), bio.alias("about"), (n % 100).alias("karma")).alias("user"), F.struct(hits.alias("hits")).alias("activity"))
    source = F.col("source")
    bundle = F.when(source == "github", F.to_json(github)).when(source == "stackoverflow", F.to_json(stack)).when((source == "devto") & (n % 8 == 2), F.to_json(listed)).when(source == "devto", F.to_json(joined)).otherwise(F.to_json(reader))
    return a.select("id", "run_id", "source", F.when(source == "stackoverflow", F.col("user_id")).otherwise(F.col("handle")).alias("identifier"), bundle.alias("bundle"), n.alias("fetched_at"))


@query
def bundle_raw_records(spark, d):
    return sources_of.raw_records(_bundles(spark, d)).withColumn("payload", F.sha2(F.col("payload").cast("binary"), 256))


@query
def normalize_raw_accounts(spark, d):
    made = sources.normalize(cut(sources_of.raw_records(_bundles(spark, d))))
    return _num(made.withColumn("raw_record_ids", F.col("raw_record_ids").cast("array<string>")).select("account_key", "handle", "display_name", "bio", "location", "topics", "profile_url", "activity_payload", "raw_record_ids"))


@query
def payload_hash_duplicates(spark, d):
    return _t(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("payload_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query
def url_normalize(spark, d):
    return _t(spark, d, "pages").select("page_id", text.normalize_url(F.col("url")).alias("url_n"))


@query
def website_domain(spark, d):
    a = derive.accounts(spark, d)
    return a.select("account_key", "run_id", text.domain(F.col("website_url")).alias("domain"))


@query
def profile_fingerprint(spark, d):
    a = derive.accounts(spark, d)
    return a.select("account_key", "run_id", text.fingerprint(F.col("profile_url")).alias("own"), F.array_join(F.transform("outbound_links", text.fingerprint), ",").alias("links"))


@query
def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", F.sha2(F.coalesce(fuzzy.html_to_text(F.col("html")), F.lit("")).cast("binary"), 256).alias("text_hash"))


@query
def outbound_links(spark, d):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return _t(spark, d, "pages").select("page_id", F.size(found).alias("n_links"), F.size(F.array_distinct(found)).alias("n_distinct"))


@query
def keyword_topics_topk(spark, d):
    from pyspark.sql import Window

    each = _t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.topic_words(F.col("text"))).alias("at", "word"))
    g = each.groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("turn") * 1_000_000 + F.col("at")).alias("first_at"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("n"), "first_at")
    return g.withColumn("topic_rank", F.row_number().over(order)).filter("topic_rank <= 20").select("conv_id", "word", "n", "topic_rank")


@query
def bio_keyword_overlap(spark, d):
    r = resolution(spark, d)
    return _num(r.pairs.select("run_id", "lk", "rk", text.overlap(F.col("l.n_words"), F.col("r.n_words")).alias("shared")))


@query
def name_normalize(spark, d):
    return resolve.normalized(derive.accounts(spark, d)).select("account_key", "run_id", "n_name")


@query
def name_compare(spark, d):
    r = resolution(spark, d)
    l, n = F.col("l.n_name"), F.col("r.n_name")  # noqa: E741
    return r.pairs.select("run_id", "lk", "rk", text.names_exact(l, n).alias("exact"), text.names_partial(l, n).alias("part"))


@query
def location_normalize(spark, d):
    a = resolve.normalized(derive.accounts(spark, d))
    return _num(a.select("account_key", "run_id", "n_location", F.array_sort("n_places").alias("places")))


@query
def candidate_name_variants(spark, d):
    return discovery.variants(derive.requests(spark, d))


@query
def candidate_caps(spark, d):
    return discovery.discover(derive.requests(spark, d))


@query
def account_pairs(spark, d):
    return resolution(spark, d).pairs.select("run_id", "lk", "rk")


@query
def evidence_long(spark, d):
    return _num(resolution(spark, d).evidence.select("run_id", "signal", "signal_group", "weight", "account_key", "other_key", "weak"))


@query
def evidence_by_type(spark, d):
    return resolution(spark, d).evidence.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


@query
def conflicts_long(spark, d):
    return _num(resolution(spark, d).conflicts)


@query
def conflict_rollup(spark, d):
    return _num(resolution(spark, d).conflicts.groupBy("conflict", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("penalty").alias("penalty")))


@query
def group_capped_scores(spark, d):
    ev = resolution(spark, d).evidence.filter("other_key IS NULL")
    return _num(resolve.group_scores(ev, ["run_id", "account_key"]))


@query
def account_scores(spark, d):
    return _num(resolution(spark, d).account_scores)


@query
def pair_scores(spark, d):
    return _num(resolution(spark, d).pair_scores)


@query
def score_components(spark, d):
    r = resolution(spark, d)
    return _num(resolve.components(r.evidence, r.conflicts))


@query
def anchors(spark, d):
    return resolve.anchors(resolution(spark, d).evidence)


@query
def blocking_pairs(spark, d):
    return _num(resolution(spark, d).pair_scores.filter("blocking OR rejects").select("run_id", "pair_key", "blocking", "rejects", "blocking_types"))


@query
def classify_decisions(spark, d):
    return _num(resolution(spark, d).decided.select("run_id", "account_key", "decision", "basis", "risk", "evidence_confidence", "decision_confidence", "is_anchor"))


@query
def run_outcomes(spark, d):
    return resolve.run_outcomes(resolution(spark, d).decided)


@query
def source_links(spark, d):
    return _num(resolution(spark, d).links.select("run_id", "account_key", "decision", "relationship", "verification", "confidence"))


@query
def link_constraint_violations(spark, d):
    r = golden.violations(resolution(spark, d).links, golden.LINK_RULES, "run_id", "account_key")
    return r.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query
def canonical_display_name(spark, d):
    r = resolution(spark, d)
    return _num(golden.display_name(r.bundles))


@query
def canonical_location(spark, d):
    r = resolution(spark, d)
    return _num(golden.location(r.bundles))


@query
def canonical_website(spark, d):
    r = resolution(spark, d)
    return _num(golden.website(r.bundles))


@query
def canonical_bio(spark, d):
    r = resolution(spark, d)
    return _num(golden.bio(r.bundles))


@query
def canonical_skills(spark, d):
    r = resolution(spark, d)
    payload = F.when(F.col("run_id") % 2 == 0, F.lit('{"top_languages": {"Rust": 1}, "tags": ["code", "Web", "Rust"], "skills": "Go on;, Zig"}'))
    told = r.accounts.withColumns({"languages": F.when(F.col("run_id") % 3 == 0, "C++; code,"), "activity_payload": payload})
    return golden.skills(golden.bundles(r.links, told))


@query
def canonical_profile(spark, d):
    r = resolution(spark, d)
    return golden.profiles(r.links, r.accounts, r.bundles)


@query
def fallback_summary(spark, d):
    r = resolution(spark, d)
    return golden.fallback_summary(golden.profiles(r.links, r.accounts, r.bundles))


@query
def profile_read_model(spark, d):
    r = resolution(spark, d)
    return golden.read_model(r.links, r.evidence, r.conflicts)


def _nested(df: DataFrame) -> DataFrame:
    """Nested columns as JSON with all fields, decimals in them as doubles: what the comparison with SQL expects."""
    out = []
    for c, t in df.dtypes:
        plain = re.sub(r"decimal[(][0-9]+,[0-9]+[)]", "double", t)
        out.append(F.to_json(F.col(c).cast(plain), {"ignoreNullFields": "false"}).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast(plain).alias(c))
    return df.select(out)


@query
def profile_full_read(spark, d):
    r = resolution(spark, d)
    made = golden.fallback_summary(golden.profiles(r.links, r.accounts, r.bundles)).select("run_id", "summary", F.lit(2).alias("created_at"))
    summaries = made.unionByName(made.select("run_id", F.lit("of an earlier day").alias("summary"), F.lit(1).alias("created_at")))
    return _nested(detail.full_read(r.requests, r.links, r.accounts, r.evidence, r.conflicts, golden.facts(r.bundles), summaries))


@query
def profile_detail(spark, d):
    r = resolution(spark, d)
    facts = golden.facts(r.bundles)
    shown = detail.detail(r.requests, r.decided, r.links, golden.profiles(r.links, r.accounts, r.bundles), facts, resolve.account_explanations(r.accounts, r.account_scores))
    return _nested(shown.drop("fields_pending"))


@query
def profile_link_graph(spark, d):
    return resolve.link_edges(resolve.normalized(derive.accounts(spark, d)))


@query
def review_eligibility(spark, d):
    return golden.review_eligibility(resolution(spark, d).decided)


@query
def review_policy(spark, d):
    o = derive.tables(spark, d, "orders") or spark.table("orders")
    verdict = F.when(F.col("o_orderkey") % 3 == 0, "likely_same_person").when(F.col("o_orderkey") % 3 == 1, "likely_different_person").otherwise("uncertain")
    sure = F.when(F.col("o_orderkey") % 5 < 2, "high").when(F.col("o_orderkey") % 5 < 4, "medium").otherwise("low")
    score = (F.col("o_orderkey") % 100 / 100).cast(resolve.SCORE)
    flag = lambda n: F.col("o_orderkey") % n == 0
    return o.select("o_orderkey", golden.review_action(verdict, sure, score, F.col("o_orderkey") % 4, ~flag(7), flag(11), flag(2)).alias("action"))


@query
def forbidden_claims(spark, d):
    t = _t(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " is a Verified Owner.").when(F.col("p_partkey") % 4 == 1, " is unverified").otherwise(", the account owner")).alias("t"))
    return t.select("p_partkey", text.has_claim(F.col("t")).alias("claims"), text.soften_claims(F.col("t")).alias("softened"))


@query
def endpoint_redaction(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", text.redact_params(F.concat("url", F.when(F.col("url").contains("?"), F.lit("&")).otherwise("?"), F.lit("token=abc&x=1"))).alias("endpoint"))


@query
def evaluation_metrics(spark, d):
    r = resolution(spark, d)
    truth = r.accounts.select("run_id", "account_key", (F.coalesce("display_name", F.lit("")) != "Zzyzx Qwvkj").alias("same"))
    return golden.evaluation(r.decided, truth)


@query
def handle_indel_similarity(spark, d):
    p = resolution(spark, d).pairs.select("run_id", "lk", "rk", F.col("l.n_handle").alias("a"), F.col("r.n_handle").alias("b"))
    return fuzzy.with_indel_ratio(p, "a", "b", "ratio").drop("a", "b")


@query
def name_compatibility(spark, d):
    p = resolution(spark, d).pairs.select("run_id", "lk", "rk", F.col("l.n_name").alias("a"), F.col("r.n_name").alias("b"))
    return fuzzy.by_distinct_pair(p, "a", "b", fuzzy.name_compatibility, "compat").drop("a", "b")


@query
def similar_handles(spark, d):
    return fuzzy.similar_pairs(resolve.normalized(derive.accounts(spark, d)).select(F.when(F.col("run_id") % 2 == 0, F.concat("n_handle", F.lit("_dev"))).alias("value")).filter("value IS NOT NULL"))


@query
def identifier_from_url(spark, d):
    a = derive.accounts(spark, d)
    given = F.when(F.col("run_id") % 4 == 0, F.col("profile_url")).when(F.col("run_id") % 4 == 1, F.concat(F.lit("@"), F.col("user_id"))).when(F.col("run_id") % 4 == 2, "https://github.com/settings").otherwise(F.concat(F.lit("00"), F.col("user_id")))
    return a.select("account_key", "run_id", discovery.identifier(F.col("source"), given).alias("identifier"))


@query
def canonical_facts(spark, d):
    r = resolution(spark, d)
    return _num(golden.facts(r.bundles))


@query
def canonical_avatar(spark, d):
    r = resolution(spark, d)
    pictures = r.accounts.withColumn("avatar_url", F.when(F.substring("account_key", -1, 1) != "8", F.concat(F.lit("https://img.dev/"), F.col("account_key"))))
    return _num(golden.avatar(r.bundles, pictures))


@query
def purge_finished_runs(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "P", "partial").otherwise("running").alias("status"), F.col("o_orderdate").alias("completed_at"))
    return store.purge(o, F.lit("1996-01-01").cast("timestamp_ntz")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query
def json_merge_patch(spark, d):
    o = _t(spark, d, "orders")
    old = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    patch = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.lit("X"))).otherwise(F.create_map(F.lit("note"), F.lit("n")))
    m = store.merge_patch(old, patch)
    return o.select("o_orderkey", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("merged"))


@query
def schema_drift_union(spark, d):
    old = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    new = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return store.align(old, new)


@query
def upsert_accounts(spark, d):
    old = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit(1).alias("version"))
    new = _t(spark, d, "customer").select((F.col("c_custkey") + 7).alias("k"), F.col("c_name").alias("name"), F.lit(2).alias("version"), F.col("c_mktsegment").alias("segment"))
    return store.upsert(old, new, ["k"], ["version"])


@query
def ingestion_summary(spark, d):
    c = derive.calls(spark, d).select((F.col("event_id") % 500).alias("batch"), "source", store.attempt_outcome(F.col("status_code")).alias("outcome"))
    return _num(store.ingestion_summary(c, "batch"))


@query
def rate_limit_headers(spark, d):
    e = _t(spark, d, "events")
    headers = F.create_map(F.lit("x-ratelimit-limit"), F.lit("5000"), F.lit("x-ratelimit-remaining"), F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.col("user_id").cast("string")), F.lit("retry-after"), F.when(F.col("event_id") % 7 == 0, "3"))
    body = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"quota_max": 300, "quota_remaining": '), (F.col("event_id") % 300).cast("string"), F.lit("}")))
    return e.select("event_id", store.rate_limit(headers, body).alias("r")).select("event_id", "r.total", "r.remaining", "r.retry_after_s")


@query
def stored_row_violations(spark, d):
    a = golden.violations(derive.calls(spark, d), store.CALL_RULES, "source").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    b = golden.violations(derive.runs(spark, d), store.RUN_RULES, "status").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return a.withColumn("tab", F.lit("calls")).unionByName(b.withColumn("tab", F.lit("runs")))


@query
def account_explanations(spark, d):
    r = resolution(spark, d)
    e = resolve.account_explanations(r.accounts, r.account_scores)
    return e.withColumn("explanation", F.array_join("explanation", " "))


@query
def pair_explanations(spark, d):
    e = resolve.pair_explanations(resolution(spark, d).pair_scores)
    return e.withColumn("explanation", F.array_join("explanation", " "))


@query
def evidence_of_links(spark, d):
    r = resolution(spark, d)
    return _num(golden.evidence_of_links(r.links, r.evidence).drop("value_a"))


@query
def conflict_sides(spark, d):
    r = resolution(spark, d)
    sides = golden.conflict_sides(r.conflicts, r.accounts)
    return sides.select("run_id", "conflict", "basis", F.inline("sides"))


def _number(key: str = "account_key"):
    return F.element_at(F.split(key, ":"), 2).cast("long")


@query
def review_final_links(spark, d):
    r, n = resolution(spark, d), _number()
    action = F.when(n % 5 < 2, "promoted_to_auto_match").when(n % 5 < 4, "rejected_after_review").otherwise("kept_needs_review")
    outcomes = r.decided.filter((F.col("decision") == "needs_review") & (n % 7 != 0)).select("run_id", "account_key", action.alias("action"), F.when(n % 3 > 0, F.col("evidence_confidence")).otherwise(resolve.dec(0)).alias("score"))
    return _num(review.final_links(r.links, outcomes))


@query
def review_counters(spark, d):
    n, fine = _number(), F.col("skip_reason").isNull()
    error = F.when(fine & (n % 5 == 0), "timed out")
    action = F.when(~fine, None).when(n % 5 == 0, "review_failed_keep_needs_review").when(n % 3 == 0, "promoted_to_auto_match").when(n % 3 == 1, "rejected_after_review").otherwise("kept_needs_review")
    e = golden.review_eligibility(resolution(spark, d).decided)
    return review.counters(e.select("run_id", "skip_reason", fine.alias("reviewed"), error.alias("error"), action.alias("action")))


@query
def model_failure_kinds(spark, d):
    n = F.col("event_id")
    message = F.when(n % 11 == 0, "Quota was used up").when(n % 7 == 0, "Blocked for Safety").when(n % 5 == 0, "the request Timed Out")
    name = F.when(n % 13 == 0, "ReadTimeout").otherwise("Error")
    return derive.calls(spark, d).select("event_id", review.failure_kind(F.col("status_code"), message, name).alias("kind"))


@query
def safe_messages(spark, d):
    t = _t(spark, d, "conversations")
    return t.select("conv_id", "turn", F.sha2(F.coalesce(text.safe_message(F.col("text")), F.lit("")).cast("binary"), 256).alias("message_hash"))


@query
def headlines(spark, d):
    t = _t(spark, d, "part")
    n = F.col("p_partkey")
    given = F.when(n % 7 == 0, F.concat(F.lit("Welcome to "), "p_name")).when(n % 7 == 1, "Hello, programmer!").when(n % 7 == 2, F.concat("p_name", F.lit(". "), "p_type")).when(n % 7 == 3, F.repeat(F.concat("p_name", F.lit(" ")), 12)).when(n % 7 == 4, "Software Developer.").otherwise(F.col("p_name"))
    return t.select("p_partkey", golden.headline(text.clean(given)).alias("headline"))


@query
def raw_record_warnings(spark, d):
    n = F.col("id")
    a = derive.accounts(spark, d).withColumn("id", F.col("user_id").cast("long"))
    kind = F.when(F.col("source") == "github", "profile").otherwise("user")
    user = F.when(n % 6 == 0, "no JSON").when(F.col("source") == "stackoverflow", '{"items": [{"user_id": 1}]}').otherwise('{"id": 1}')
    first = a.select("id", F.when(n % 9 == 0, "elsewhere").otherwise(F.col("source")).alias("source"), kind.alias("record_type"), F.when(n % 10 != 0, F.col("user_id")).alias("user_id"), F.lit(None).cast("string").alias("handle"), user.alias("payload"), n.alias("fetched_at"))
    more = a.filter((n % 5 == 1) & (n % 9 != 0)).select(n, "source", F.when(F.col("source") == "github", "repos").when(F.col("source") == "stackoverflow", "answers").when(F.col("source") == "devto", "articles").otherwise("activity").alias("record_type"), "user_id", F.lit(None).cast("string").alias("handle"), F.lit("[]").alias("payload"), n.alias("fetched_at"))
    return sources.warnings(first.unionByName(more))


@query
def evidence_packets(spark, d):
    r = resolution(spark, d)
    return _nested(packets.packets(r.pair_scores, r.evidence, r.conflicts))


@query
def verdict_breaches(spark, d):
    r = resolution(spark, d)
    made = cut(packets.packets(r.pair_scores, r.evidence, r.conflicts))
    used = F.concat(F.lit('"used_evidence_types": '), F.to_json(packets.allowed_types(made)), F.lit("}"))
    good = lambda more="", why="shared site": F.concat(F.lit('{"recommendation": "uncertain", "confidence": "low", ' + more + '"rationale": ["' + why + '"], '), used)
    n = (F.col("run_id") * 4 + F.ascii(F.substring("lk", 1, 1)) + F.ascii(F.substring("rk", 1, 1))) % 9
    verdict = F.when(n == 0, "  ").when(n == 1, "no verdict {today").when(n == 2, "[1, 2]").when(n == 3, F.replace(good(), F.lit("uncertain"), F.lit("yes"))).when(n == 4, F.concat(F.lit("Here it is: "), good(), F.lit(" Bye.")))
    verdict = verdict.when(n == 5, F.replace(good(), F.lit("]}"), F.lit(', "shoe_size"]}'))).when(n == 6, good(why="A Verified Owner of both")).when(n == 7, good('"mood": 1, ')).when(n == 8, '{"confidence": "high", "rationale": "one text", "used_evidence_types": ["same_website"]}')
    return packets.breaches(made.select(*packets.PAIR, verdict.alias("verdict")), made)


@query
def stream_upsert(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    folder, buckets = f"{store.shared_folder(spark)}/upsert-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    e.repartitionByRange(4, "event_id").write.parquet(f"{folder}/in")
    merge.start(e.limit(0), f"{folder}/users", ["user_id"], ["event_id"], buckets)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return merge.run(stream, f"{folder}/users", ["user_id"], ["event_id"], buckets)


@query
def replaced_runs(spark, d):
    r = resolution(spark, d)
    links = cut(r.links.select("run_id", "account_key", "relationship", "confidence"))
    path, buckets = f"{store.shared_folder(spark)}/links-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    merge.start(links, path, ["run_id"], [], buckets)
    again = links.filter("run_id % 5 = 0 AND run_id % 3 > 0").withColumn("relationship", F.concat(F.lit("again_"), "relationship"))
    for _ in range(2):  # a second try changes nothing
        merge.replace(again, links.filter("run_id % 5 = 0").select("run_id"), 0, path, buckets)
    return _num(merge.state(spark, path, links.schema).drop("bucket"))
