"""Pairs, evidence, conflicts, scores and decisions of many resolution requests at once.

All functions go from DataFrames to DataFrames keyed by run_id. Accounts are normalized once, before pairs are made;
pairs are an equi-join on run_id; evidence and conflicts are unpivoted from one projection of the pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy
from ..functions import fuzzy, text
from . import discovery

SCORE = "decimal(6,4)"


def dec(x) -> Column:
    return F.lit(str(x)).cast(SCORE)


def normalized(accounts: DataFrame) -> DataFrame:
    """Accounts with the derived columns that comparisons read, each worked out once. They are dealt by run first: small files hold many accounts,
    and what reads one of them would do all the work in one task."""
    accounts = accounts.repartition("run_id")
    ascii_name = fuzzy.ascii_fold(text.clean(fuzzy.html_unescape(F.col("display_name"))))
    hn_handle = (F.col("source") == "hackernews") & (F.coalesce(F.lower("display_name") == F.lower("handle"), F.lit(True)))
    return accounts.select(
        "*",
        text.normalize_name(ascii_name).alias("n_name"),
        text.normalize_handle(F.col("handle")).alias("n_handle"),
        text.domain(F.col("website_url")).alias("n_domain"),
        text.normalize_location(F.col("location")).alias("n_location"),
        text.location_tokens(text.normalize_location(F.col("location"))).alias("n_places"),
        text.bio_keywords(fuzzy.ascii_fold(text.strip_tags(fuzzy.html_unescape(F.col("bio"))))).alias("n_words"),
        F.array_distinct(F.filter(F.transform("topics", lambda t: F.lower(F.trim(t))), lambda t: t != "")).alias("n_topics"),
        text.fingerprint(F.col("profile_url")).alias("n_print"),
        F.transform("outbound_links", text.fingerprint).alias("n_links"),
        hn_handle.alias("hn_handle"),
    )


def pairs(accounts: DataFrame) -> DataFrame:
    """Each unordered pair of a run's accounts as structs l and r, the smaller key left."""
    row = F.struct(*accounts.columns)
    left = accounts.select("run_id", F.col("account_key").alias("lk"), row.alias("l"))
    right = accounts.select(F.col("run_id").alias("run_r"), F.col("account_key").alias("rk"), row.alias("r"))
    return left.join(right, (F.col("run_id") == F.col("run_r")) & (F.col("lk") < F.col("rk"))).select("run_id", "lk", "rk", "l", "r")


def _signal(kind: str, test: Column, account: Column, other: Column, value: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("signal"), F.lit(policy.GROUPS[kind]).alias("signal_group"), dec(policy.WEIGHTS[kind]).alias("weight"), account.alias("account_key"), other.alias("other_key"), value.cast("string").alias("value")))


def _unpivot(df: DataFrame, *signals: Column) -> DataFrame:
    """A row for each signal that is told. Nulls go after the rows are made: a lambda within would have all the tests interpreted."""
    return df.select("run_id", F.inline(F.array(*signals))).filter("signal IS NOT NULL")


def request_evidence(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Signals between a request and each of its accounts. Requests are dealt by run first, as a small file of them may stand for much work."""
    asked = requests.repartition("run_id").select(
        F.col("run_id").alias("req_run"),
        text.normalize_name(fuzzy.ascii_fold(text.clean(F.col("name")))).alias("q_name"),
        *[discovery.requested(s, F.col(s)).alias(f"q_{s}") for s in policy.SOURCES],
        F.col("email_hash").alias("q_hash"),
        F.lower("email_domain").alias("q_domain"),
    )
    both = accounts.join(asked, F.col("run_id") == F.col("req_run"))
    own = reduce(lambda c, s: c.when(F.col("source") == s, F.col(f"q_{s}")), policy.SOURCES[1:], F.when(F.col("source") == policy.SOURCES[0], F.col(f"q_{policy.SOURCES[0]}")))
    key, none = F.col("account_key"), F.lit(None).cast("string")
    user_id = F.when(F.col("source") == "stackoverflow", F.regexp_replace(F.trim("user_id"), "^0+(?=[0-9]+$)", "")).otherwise(F.lower(F.trim("user_id")))
    handle = F.lower(F.regexp_replace(F.trim("handle"), "^@+", ""))
    named = ~F.col("hn_handle") & F.col("n_name").isNotNull()
    exact = named & text.names_exact(F.col("q_name"), F.col("n_name"))
    return _unpivot(
        both,
        _signal("input_handle_match", (own == user_id) | (own == F.lower(F.trim("user_id"))) | (own == handle), key, none, own),
        _signal("exact_name_match", exact, key, none, F.col("n_name")),
        _signal("partial_name_match", named & text.names_partial(F.col("q_name"), F.col("n_name")), key, none, F.col("n_name")),
        _signal("email_hint_match", F.col("q_hash") == F.col("email_hash"), key, none, F.col("email_hash")),
        _signal("email_domain_match", F.col("q_domain") == F.lower("email_domain"), key, none, F.lower("email_domain")),
    )


def _points(a: str, b: str) -> Column:
    return F.exists(F.coalesce(F.col(f"{a}.n_links"), F.array()), lambda x: F.coalesce(x == F.col(f"{b}.n_print"), F.lit(False)))


def link_edges(accounts: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, src, dst, n, reciprocal): which profiles (by fingerprint) link to which known ones, in how many accounts, and whether back as well.
    Edges are exploded links, one row for each pair of profiles after a combined count; no pair is made that no link names. Links of a profile to itself don't count."""
    at = list(within)
    out = accounts.select(*at, F.col("n_print").alias("src"), F.explode("n_links").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    edges = out.groupBy(*at, "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    known = accounts.select(*at, F.col("n_print").alias("dst")).filter("dst IS NOT NULL").distinct()
    edges = edges.join(known, [*at, "dst"], "left_semi").select(*at, "src", "dst", "n")
    back = edges.select(*at, F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(True).alias("back"))
    return edges.join(back, [*at, "src", "dst"], "left").select(*at, "src", "dst", "n", F.coalesce("back", F.lit(False)).alias("reciprocal"))


def link_evidence(accounts: DataFrame) -> DataFrame:
    """Signals of accounts that link to each other's profiles, from the edges within a run."""
    slim = accounts.select("run_id", "account_key", "n_print", "n_links")
    ends = slim.filter("n_print IS NOT NULL").select("run_id", "account_key", "n_print")
    named = slim.select("run_id", "account_key", F.explode(F.array_distinct("n_links")).alias("n_print")).filter("n_print IS NOT NULL")
    direct = named.join(ends.withColumnRenamed("account_key", "other_key"), ["run_id", "n_print"]).filter("account_key <> other_key")
    back = direct.select("run_id", F.col("account_key").alias("other_key"), F.col("other_key").alias("account_key"), F.lit(True).alias("back")).distinct()
    both = direct.join(back, ["run_id", "account_key", "other_key"], "left")
    a, b = F.col("account_key"), F.col("other_key")
    return _unpivot(both, _signal("direct_profile_link", F.lit(True), a, b, F.col("n_print")), _signal("reciprocal_profile_link", F.col("back") & (a < b), a, b, F.lit("reciprocal")))


def pair_evidence(paired: DataFrame) -> DataFrame:
    """Signals between two accounts but those of links."""
    lk, rk = F.col("lk"), F.col("rk")
    same_place = F.col("l.n_location") == F.col("r.n_location")
    places = F.array_intersect("l.n_places", "r.n_places")
    words, topics = text.overlap(F.col("l.n_words"), F.col("r.n_words")), text.overlap(F.col("l.n_topics"), F.col("r.n_topics"))
    spaced = reduce(lambda x, y: x | y, (F.coalesce((F.col(f"{s}.source") == "stackoverflow") & F.col(f"{s}.handle").rlike(r"\s"), F.lit(False)) for s in "lr"))
    return _unpivot(
        paired,
        _signal("same_website", F.col("l.n_domain") == F.col("r.n_domain"), lk, rk, F.col("l.n_domain")),
        _signal("similar_handle", ~spaced & fuzzy.handles_similar(F.col("l.n_handle"), F.col("r.n_handle")), lk, rk, F.col("l.n_handle")),
        _signal("same_location", same_place, lk, rk, F.col("l.n_location")),
        _signal("location_overlap", ~same_place & (F.size(places) > 0), lk, rk, F.array_join(F.array_sort(places), ",")),
        _signal("bio_keyword_overlap", F.size(words) > 0, lk, rk, F.array_join(words, ",")),
        _signal("topic_overlap", F.size(topics) > 0, lk, rk, F.array_join(topics, ",")),
    )


def evidence(accounts: DataFrame, requests: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """(run_id, signal, signal_group, weight, account_key, other_key, value, weak): of equal signals the heaviest."""
    all_ = request_evidence(accounts, requests).unionByName(pair_evidence(pairs(accounts) if paired is None else paired)).unionByName(link_evidence(accounts)).repartition("run_id")
    best = F.row_number().over(Window.partitionBy("run_id", "signal", "account_key", "other_key").orderBy(F.desc("weight"), F.asc("value")))
    return all_.withColumn("n", best).filter("n = 1").drop("n").withColumn("weak", F.col("signal").isin(*policy.WEAK_SIGNALS))


def conflicts(paired: DataFrame) -> DataFrame:
    """(run_id, conflict, basis, severity, penalty, lk, rk): contradictions between two accounts."""

    def told(kind: str, name: str, test: Column) -> Column:
        severity, penalty = policy.PENALTIES[kind]
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("conflict"), F.lit(kind).alias("basis"), F.lit(severity).alias("severity"), dec(penalty).alias("penalty"), F.col("lk"), F.col("rk")))

    c = F.col
    hn = (c("l.source") == "hackernews") | (c("r.source") == "hackernews")
    names = c("l.n_name").isNotNull() & c("r.n_name").isNotNull() & ~hn & ~F.coalesce(F.lower("l.display_name") == F.lower("l.handle"), F.lit(False)) & ~F.coalesce(F.lower("r.display_name") == F.lower("r.handle"), F.lit(False))
    compat = fuzzy.name_compatibility(F.when(names, c("l.n_name")), F.when(names, c("r.n_name")))
    tokens = lambda s: F.filter(c(f"{s}.n_topics"), lambda t: ~t.isin(*policy.GENERIC_TOPICS))
    generic = lambda s: F.lower(f"{s}.email_domain").isin(*policy.GENERIC_EMAIL_DOMAINS)
    hashes = c("l.email_hash").isNotNull() & c("r.email_hash").isNotNull()
    same_hash = hashes & (c("l.email_hash") == c("r.email_hash"))
    row = F.array(
        told("name_conflict", "name_conflict", names & (compat == "conflicting")),
        told("website_conflict", "website_conflict", (c("l.n_domain") != c("r.n_domain")) & ~_points("l", "r") & ~_points("r", "l")),
        told("location_conflict", "location_conflict", (c("l.n_location") != c("r.n_location")) & (F.size(F.array_intersect("l.n_places", "r.n_places")) == 0)),
        told("email_hash", "email_conflict", hashes & ~same_hash),
        told("email_domain", "email_conflict", ~hashes & (F.lower("l.email_domain") != F.lower("r.email_domain")) & ~generic("l") & ~generic("r")),
        told("topic_mismatch", "topic_mismatch", ~hn & (F.size(tokens("l")) >= 6) & (F.size(tokens("r")) >= 6) & (F.size(F.array_intersect(tokens("l"), tokens("r"))) == 0)),
    )
    return paired.select("run_id", F.inline(row)).filter("conflict IS NOT NULL")


def group_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best capped weight of each independence group."""
    cap = F.element_at(F.create_map(*[x for g, v in policy.CAPS.items() for x in (F.lit(g), dec(v))]), F.col("signal_group"))
    return rows.groupBy(*keys, "signal_group").agg(F.max(F.least("weight", cap)).alias("applied"), F.count(F.lit(1)).alias("signals"))


def _groups(name: str, of) -> Column:
    return F.array_sort(F.array_intersect(F.col(name), F.array(*map(F.lit, of))))


def account_scores(accounts: DataFrame, ev: DataFrame) -> DataFrame:
    """A score for every account from the request's evidence; zeros without any."""
    best = group_scores(ev.filter("other_key IS NULL"), ["run_id", "account_key"]).groupBy("run_id", "account_key").agg(F.sum("applied").alias("positive"), F.array_sort(F.collect_set("signal_group")).alias("groups"))
    out = accounts.select("run_id", "account_key").join(best, ["run_id", "account_key"], "left")
    positive, groups = F.coalesce(F.col("positive"), dec(0)).cast(SCORE), F.coalesce("groups", F.array().cast("array<string>"))
    out = out.select("run_id", "account_key", positive.alias("positive"), groups.alias("groups"))
    return out.withColumns({"confidence": F.least(dec(policy.DEFAULT.confidence_cap), F.col("positive")).cast(SCORE), "strong_groups": _groups("groups", policy.STRONG_ACCOUNT_GROUPS)})


def pair_scores(paired: DataFrame, ev: DataFrame, cf: DataFrame, limits: policy.Policy = policy.DEFAULT) -> DataFrame:
    """A score for every pair: capped groups less the worst penalty of each conflict type, held between 0 and the cap."""
    both = ev.filter("other_key IS NOT NULL").withColumns({"lk": F.least("account_key", "other_key"), "rk": F.greatest("account_key", "other_key")})
    plus = group_scores(both, ["run_id", "lk", "rk"]).groupBy("run_id", "lk", "rk").agg(F.sum("applied").alias("positive"), F.array_sort(F.collect_set("signal_group")).alias("groups"), F.sum("signals").alias("signals"))
    worst = cf.groupBy("run_id", "lk", "rk", "conflict").agg(F.min("penalty").alias("penalty"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("severity").isin("high", "critical") | (F.col("basis") == "email_hash")).alias("blocks"), F.bool_or(F.col("basis") == "email_hash").alias("hash"))
    minus = worst.groupBy("run_id", "lk", "rk").agg(
        F.greatest(F.sum("penalty"), dec(limits.penalty_floor)).alias("penalty"), F.count(F.lit(1)).alias("conflicts"), F.array_sort(F.collect_set("conflict")).alias("conflict_types"),
        F.array_sort(F.collect_set(F.when(F.col("blocks"), F.col("conflict")))).alias("blocking_types"), F.bool_or("hash").alias("hash_conflict"),
    )
    keys = ["run_id", "lk", "rk"]
    out = paired.select(*keys, ((F.col("l.source") == "hackernews") | (F.col("r.source") == "hackernews")).alias("hn")).join(plus, keys, "left").join(minus, keys, "left")
    none, z = F.array().cast("array<string>"), dec(0)
    out = out.select(
        *keys, "hn", F.coalesce("positive", z).cast(SCORE).alias("positive"), F.coalesce("penalty", z).cast(SCORE).alias("penalty"), F.coalesce("groups", none).alias("groups"), F.coalesce("signals", F.lit(0)).cast("long").alias("signals"),
        F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"), F.coalesce("conflict_types", none).alias("conflict_types"), F.coalesce("blocking_types", none).alias("blocking_types"), F.coalesce("hash_conflict", F.lit(False)).alias("hash_conflict"),
    )
    out = out.withColumn("confidence", F.least(dec(limits.confidence_cap), F.greatest(z, F.col("positive") + F.col("penalty"))).cast(SCORE)).withColumn("strong_groups", _groups("groups", policy.STRONG_PAIR_GROUPS))
    n_of = lambda kinds: F.size(F.array_intersect("conflict_types", F.array(*map(F.lit, kinds))))
    rejects = F.col("hash_conflict") | ((n_of(("name_conflict", "website_conflict")) == 2) & (F.col("confidence") < dec("0.60"))) | ((n_of(policy.REJECT_CONFLICTS) >= 2) & (F.col("confidence") < dec("0.50")))
    weak = (F.size("groups") > 0) & (F.size("strong_groups") == 0)
    return out.withColumns({"weak_only": weak, "blocking": F.size("blocking_types") > 0, "rejects": rejects, "pair_key": F.concat_ws("|", "lk", "rk")})


def _said(*parts: tuple[Column | None, Column]) -> Column:
    """Sentences whose condition holds."""
    return F.array_compact(F.array(*[x if test is None else F.when(test, x) for test, x in parts]))


def _scored(groups: str, none: str) -> Column:
    listed = F.concat(F.lit("Counted groups of evidence: "), F.array_join(groups, ", "), F.lit("."))
    return F.when(F.size(groups) > 0, listed).otherwise(none)


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def account_explanations(accounts: DataFrame, scores: DataFrame, limits: policy.Policy = policy.DEFAULT) -> DataFrame:
    """(run_id, account_key, explanation): a score in sentences."""
    s = scores.join(accounts.select("run_id", "account_key", "source"), ["run_id", "account_key"])
    return s.select("run_id", "account_key", _said(
        (None, F.concat(F.lit("Account "), F.col("account_key"), F.lit(" scored "), _two(F.col("confidence")), F.lit(" for the request."))),
        (None, _scored("groups", "The request itself supports nothing.")),
        ((F.size("groups") > 0) & (F.size("strong_groups") == 0), F.lit("All that counts is weak, which is too little for a match by itself.")),
        (F.col("source") == "hackernews", F.lit("Profiles of this platform say little, so their evidence is taken with care.")),
        (F.col("positive") > dec(limits.confidence_cap), F.lit(f"The sum was more than may count and is held at {limits.confidence_cap}.")),
    ).alias("explanation"))


def pair_explanations(scores: DataFrame, limits: policy.Policy = policy.DEFAULT) -> DataFrame:
    """(run_id, pair_key, hn_requires_strong, explanation): a score in sentences, and whether it takes strong evidence as one side is sparse."""
    return scores.select("run_id", "pair_key", (F.col("hn") & F.col("weak_only")).alias("hn_requires_strong"), _said(
        (None, F.concat(F.lit("Account pair "), F.col("pair_key"), F.lit(" scored "), _two(F.col("confidence")), F.lit("."))),
        (None, _scored("groups", "Nothing links the two accounts.")),
        (F.col("penalty") < 0, F.concat(F.lit("Conflicts took off "), _two(F.abs("penalty")), F.lit("."))),
        (F.size("strong_groups") > 0, F.concat(F.lit("Strong groups among them: "), F.array_join("strong_groups", ", "), F.lit("."))),
        (F.col("weak_only"), F.lit("All links are weak, which is too little for a match by themselves.")),
        (F.col("hn"), F.lit("One of the two profiles says little, so more support is needed.")),
        (F.col("positive") + F.col("penalty") > dec(limits.confidence_cap), F.lit(f"The sum was more than may count and is held at {limits.confidence_cap}.")),
    ).alias("explanation"))


def components(ev: DataFrame, cf: DataFrame) -> DataFrame:
    """Audit rows of the pair scores: evidence and conflicts, applied or discarded within their group or type."""
    keys = ["run_id", "lk", "rk"]
    both = ev.filter("other_key IS NOT NULL").withColumns({"lk": F.least("account_key", "other_key"), "rk": F.greatest("account_key", "other_key")})
    cap = F.element_at(F.create_map(*[x for g, v in policy.CAPS.items() for x in (F.lit(g), dec(v))]), F.col("signal_group"))
    n = F.row_number().over(Window.partitionBy(*keys, "signal_group").orderBy(F.desc(F.least("weight", cap)), "signal", "account_key"))
    plus = both.select(*keys, "signal", F.col("weight").alias("raw"), F.least("weight", cap).cast(SCORE).alias("applied"), F.when(n == 1, "positive_evidence").otherwise("discarded_evidence").alias("kind"))
    n = F.row_number().over(Window.partitionBy(*keys, "conflict").orderBy("penalty", "basis"))
    minus = cf.select(*keys, F.col("conflict").alias("signal"), F.col("penalty").alias("raw"), F.col("penalty").alias("applied"), F.when(n == 1, "conflict_penalty").otherwise("discarded_conflict").alias("kind"))
    return plus.unionByName(minus)


def anchors(ev: DataFrame) -> DataFrame:
    """Accounts that the request names."""
    return ev.filter(F.col("signal").isin("input_handle_match", "email_hint_match")).select("run_id", "account_key").distinct()


def _ends(scores: DataFrame) -> DataFrame:
    """Each pair's score once for each of its accounts."""
    return scores.select("*", F.explode(F.array(F.struct(F.col("lk").alias("account_key"), F.col("rk").alias("other")), F.struct(F.col("rk").alias("account_key"), F.col("lk").alias("other")))).alias("e")).select("*", "e.account_key", "e.other").drop("e")


def classify(accounts: DataFrame, requests: DataFrame, ev: DataFrame, a_scores: DataFrame, p_scores: DataFrame, limits: policy.Policy = policy.DEFAULT) -> DataFrame:
    """(run_id, account_key, source, decision, basis, risk, evidence_confidence, decision_confidence, is_anchor, ...) of every account."""
    auto, review = dec(limits.auto_match), dec(limits.needs_review)
    named = requests.select(F.col("run_id").alias("req_run"), text.normalize_name(fuzzy.ascii_fold(text.clean(F.col("name")))).alias("q_name"))
    marked = anchors(ev).withColumn("is_anchor", F.lit(True))
    # names are compared before anything else is joined: Python workers get few columns, and what comes from them is dealt by run once
    base = accounts.select("run_id", "account_key", "source", "n_name").join(named, F.col("run_id") == F.col("req_run"), "left")
    clash = fuzzy.name_compatibility(F.col("q_name"), F.col("n_name")) == "conflicting"
    base = base.select("run_id", "account_key", "source", clash.alias("clash")).repartition("run_id")
    base = base.join(a_scores.select("run_id", "account_key", F.col("confidence").alias("score"), F.col("groups").alias("a_groups")), ["run_id", "account_key"], "left")
    base = base.join(marked, ["run_id", "account_key"], "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))
    per_run = marked.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_anchors"))
    base = base.join(per_run, "run_id", "left").withColumn("n_anchors", F.coalesce("n_anchors", F.lit(0)))
    whole = F.struct("confidence", "groups", "strong_groups", "signals", "conflicts", "conflict_types", "blocking_types", "weak_only", "blocking", "rejects")
    liking = F.struct("confidence", F.size("strong_groups").alias("a"), F.size("groups").alias("b"), (-F.col("conflicts")).alias("c"), "positive", (-F.abs("penalty")).alias("d"), "pair_key")
    blocked = F.struct(F.size("blocking_types").alias("a"), "rejects", "conflicts", F.abs("penalty").alias("d"), "pair_key")
    troubled = F.struct(F.size("blocking_types").alias("a"), F.abs("penalty").alias("d"), "pair_key")
    to_anchor = F.coalesce("to_anchor", F.lit(False))
    other_identity = a_scores.select("run_id", F.col("account_key").alias("other"), (F.arrays_overlap("groups", F.array(F.lit("name"), F.lit("email")))).alias("other_identity"))
    ends = _ends(p_scores).join(marked.select("run_id", F.col("account_key").alias("other"), F.col("is_anchor").alias("to_anchor")), ["run_id", "other"], "left").join(other_identity, ["run_id", "other"], "left")
    best = ends.groupBy("run_id", "account_key").agg(
        F.max_by(whole, liking).alias("any_pair"),
        F.max_by(whole, F.when(to_anchor, liking)).alias("best"),
        F.max_by(whole, F.when(to_anchor & (F.col("blocking") | F.col("rejects") | ((F.col("conflicts") > 0) & (F.col("confidence") < dec("0.60")))), blocked)).alias("block"),
        F.max_by(F.struct("other_identity", "pair_key"), F.when(to_anchor & (F.col("blocking") | F.col("rejects")), troubled)).alias("trouble"),
        F.bool_or(to_anchor & (F.col("signals") > 0)).alias("corroborated"),
    )
    d = base.join(best, ["run_id", "account_key"], "left")
    c = F.col
    identity = F.arrays_overlap("a_groups", F.array(F.lit("name"), F.lit("email")))
    gate = c("clash") & ~F.coalesce(F.array_contains("a_groups", "email"), F.lit(False))
    conflicting = (c("n_anchors") > 1) & c("trouble").isNotNull() & ~(identity & ~F.coalesce(c("trouble.other_identity"), F.lit(False)))
    top, any_ = F.greatest("score", "best.confidence"), F.greatest(c("score"), F.coalesce(c("any_pair.confidence"), dec(0)))
    can_auto = (c("best.confidence") >= auto) & ~c("best.weak_only") & (F.size("best.groups") >= limits.least_groups) & (F.size("best.strong_groups") > 0) & ~c("best.blocking")
    some = (c("best.confidence") >= review) | (c("score") >= review) | (c("best.signals") > 0) | (c("best.conflicts") > 0)
    both = F.greatest("best.confidence", "block.confidence")
    z = dec(0)
    rules = [  # condition, decision, basis, risk, evidence confidence, decision confidence
        (c("score").isNull(), "reject", "rejected_no_support", "high", z, z),
        (c("is_anchor") & gate, "needs_review", "blocking_conflict_review", "high", c("score"), F.greatest(c("score"), review)),
        (c("is_anchor") & conflicting, "needs_review", "blocking_conflict_review", "high", c("score"), c("score")),
        (c("is_anchor"), "auto_match", "anchor_input", "low", c("score"), F.greatest(c("score"), auto)),
        (gate, "reject", "rejected_conflict", "high", c("score"), c("score")),
        ((c("n_anchors") == 0) & (c("any_pair.blocking") | c("any_pair.rejects")), "reject", "rejected_conflict", "high", any_, any_),
        ((c("n_anchors") == 0) & (c("any_pair.weak_only") | (F.size("any_pair.strong_groups") == 0)), "reject", "rejected_weak_only", "high", any_, any_),
        ((c("n_anchors") == 0) & (any_ >= review), "needs_review", "no_anchor_review", "medium", any_, any_),
        (c("n_anchors") == 0, "reject", "rejected_no_support", "high", any_, any_),
        (c("best").isNull(), "reject", "rejected_no_support", "high", c("score"), z),
        (c("best.rejects"), "reject", "rejected_conflict", "high", c("best.confidence"), c("best.confidence")),
        (c("block").isNotNull() & c("block.rejects"), "reject", "rejected_conflict", "high", c("block.confidence"), c("block.confidence")),
        (c("block").isNotNull(), "needs_review", "blocking_conflict_review", "high", both, both),
        (can_auto, "auto_match", "strong_anchor_pair", "low", c("best.confidence"), c("best.confidence")),
        (some, "needs_review", "ambiguous_anchor_pair", "medium", top, top),
        (F.lit(True), "reject", "rejected_weak_only", "high", top, top),
    ]
    made = lambda dn, bn, rn, e, x: F.struct(F.lit(dn).alias("decision"), F.lit(bn).alias("basis"), F.lit(rn).alias("risk"), e.cast(SCORE).alias("evidence_confidence"), x.cast(SCORE).alias("decision_confidence"))
    tree = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), made(*rest)) for test, *rest in rules])
    d = d.withColumn("t", tree)
    gated = F.coalesce(gate, F.lit(False))
    shown = F.when(gated, F.lit(None)).when(c("is_anchor"), F.lit(None)).when(c("n_anchors") == 0, c("any_pair")).when(c("t.basis").isin("blocking_conflict_review"), c("block")).when(c("best.rejects"), c("best")).when(c("block").isNotNull(), c("block")).otherwise(c("best"))
    d = d.withColumn("shown", shown)
    strs = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    target = F.array(F.lit("target_name_conflict"))
    return d.select(
        "run_id", "account_key", "source", "t.*", "is_anchor", F.when(gated, target).otherwise(strs(c("shown.conflict_types"))).alias("conflict_types"), F.when(gated, target).otherwise(strs(c("shown.blocking_types"))).alias("blocking_types"),
        strs(F.coalesce(c("shown.groups"), c("a_groups"))).alias("groups"), c("shown.strong_groups").alias("strong_groups"), F.coalesce(c("shown.weak_only"), F.lit(False)).alias("weak_only"), F.coalesce(c("shown.signals"), F.lit(0)).alias("signals"),
        (c("is_anchor") & (c("n_anchors") > 1) & ~F.coalesce("corroborated", F.lit(False))).alias("uncorroborated"),
    )


def run_outcomes(decided: DataFrame, limits: policy.Policy = policy.DEFAULT) -> DataFrame:
    """Counts, key lists, confidence level and status of each run."""
    keys = lambda d: F.array_join(F.array_sort(F.collect_list(F.when(F.col("decision") == d, F.col("account_key")))), ",")
    n = lambda d: F.count_if(F.col("decision") == d)
    out = decided.groupBy("run_id").agg(n("auto_match").alias("n_auto"), n("needs_review").alias("n_review"), n("reject").alias("n_reject"), keys("auto_match").alias("auto_keys"), keys("needs_review").alias("review_keys"), F.max(F.when(F.col("decision") == "auto_match", F.col("decision_confidence"))).alias("top"))
    top = F.coalesce("top", dec(0))
    level = F.when(top >= dec(limits.auto_match), "high").when(top >= dec(limits.needs_review), "medium").when(top > 0, "low").otherwise("uncertain")
    return out.withColumns({"confidence_level": level, "status": F.when(F.col("n_auto") > 0, "resolved").otherwise("partial")}).drop("top")
