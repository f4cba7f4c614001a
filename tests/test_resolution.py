from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kinloom import policy
from kinloom.operators import discovery, golden, resolve
from kinloom.plans.queries import Resolution

ACCOUNT = "run_id long, account_key string, source string, user_id string, handle string, display_name string, location string, website_url string, profile_url string, email_hash string, email_domain string, bio string, topics array<string>, outbound_links array<string>"
REQUEST = "run_id long, name string, github string, devto string, hackernews string, stackoverflow string, email_hash string, email_domain string"
URLS = {"github": "https://github.com/{}", "devto": "https://dev.to/{}", "hackernews": "https://news.ycombinator.com/user?id={}", "stackoverflow": "https://stackoverflow.com/users/{}/x"}


def account(source, handle, user_id=None, name=None, location=None, site=None, bio=None, topics=(), links=(), run=1, email_hash=None):
    uid = user_id or handle
    return (run, f"{source}:{uid}".lower(), source, uid, handle, name, location, site, URLS[source].format(uid if source == "stackoverflow" else handle), email_hash, None, bio, list(topics), list(links))


def request(name, run=1, **ids):
    return (run, name, ids.get("github"), ids.get("devto"), ids.get("hackernews"), ids.get("stackoverflow"), ids.get("email_hash"), None)


def resolved(spark, accounts, requests):
    return Resolution(spark.createDataFrame(accounts, ACCOUNT), spark.createDataFrame(requests, REQUEST))


def decisions(r):
    return {x["account_key"]: (x["decision"], float(x["decision_confidence"])) for x in r.decided.collect()}


def test_reciprocal_anchors(spark):
    r = resolved(spark, [account("github", "benhalpern", name="Ben Halpern", links=["https://dev.to/ben"]), account("devto", "ben", name="Ben Halpern", links=["https://github.com/benhalpern"])], [request("Ben Halpern", github="benhalpern", devto="ben")])
    assert all(d == "auto_match" and c >= 0.85 for d, c in decisions(r).values())
    pair = r.pair_scores.first()
    assert pair["confidence"] == Decimal("0.4500") and pair["signals"] == 3
    kinds = [x["kind"] for x in resolve.components(r.evidence, r.conflicts).collect()]
    assert sorted(kinds) == ["discarded_evidence", "discarded_evidence", "positive_evidence"]


def test_website_mismatch_stays_low(spark):
    r = resolved(spark, [account("github", "benhalpern", name="Ben Halpern", site="https://a.dev"), account("devto", "ben", name="Ben Halpern", site="https://b.dev")], [request("Ben Halpern", github="benhalpern", devto="ben")])
    assert [(x["conflict"], x["severity"]) for x in r.conflicts.collect()] == [("website_conflict", "low")]
    assert {d for d, _ in decisions(r).values()} == {"auto_match"}
    assert {x["confidence"] for x in r.account_scores.collect()} == {Decimal("0.4500")}


def test_wrong_anchor(spark):
    r = resolved(spark, [account("github", "simonw", name="Simon Willison"), account("stackoverflow", "Jon Skeet", "22656", name="Jon Skeet")], [request("Jon Skeet", github="simonw", stackoverflow="22656")])
    d = decisions(r)
    assert d["github:simonw"][0] == "needs_review" and d["stackoverflow:22656"][0] == "auto_match"
    row = r.decided.filter("source = 'github'").first()
    assert row["conflict_types"] == ["target_name_conflict"] and row["basis"] == "blocking_conflict_review"


def test_handle_only_is_not_merged(spark):
    r = resolved(spark, [account("github", "amil122", name="Muhammed Amil"), account("hackernews", "amil122", name="amil122")], [request("Muhammed Amil", github="amil122")])
    assert decisions(r)["hackernews:amil122"][0] == "needs_review"
    assert r.pair_scores.first()["weak_only"]


def test_strong_discovery(spark):
    both = dict(name="Muhammed Amil", topics=["python", "fastapi"])
    r = resolved(
        spark,
        [account("github", "amil", site="https://amil.dev", links=["https://dev.to/amil"], bio="AI engineer building FastAPI tools", **both), account("devto", "amil", site="https://www.amil.dev/", links=["https://github.com/amil"], bio="FastAPI developer writing about AI", **both)],
        [request("Muhammed Amil", github="amil")],
    )
    assert decisions(r)["devto:amil"] == ("auto_match", 0.97)


def test_conflict_blocks(spark):
    r = resolved(spark, [account("github", "amil", name="Muhammed Amil", location="Bangalore"), account("devto", "amil", name="David Lee", location="Toronto")], [request("Muhammed Amil", github="amil")])
    assert decisions(r)["devto:amil"][0] != "auto_match"
    assert {x["conflict"] for x in r.conflicts.collect()} == {"name_conflict", "location_conflict"}
    assert r.pair_scores.first()["confidence"] == 0


def test_no_anchor_never_accepts(spark):
    r = resolved(spark, [account("github", "amil", name="Muhammed Amil", links=["https://dev.to/amil"]), account("devto", "amil", name="Muhammed Amil", links=["https://github.com/amil"])], [request("Muhammed Amil")])
    assert {d for d, _ in decisions(r).values()} <= {"needs_review", "reject"}


def test_row_order_does_not_matter(spark):
    rows = [account("github", "amil", name="Muhammed Amil", topics=["a", "b"], run=k) for k in range(5)] + [account("devto", "amil", name="Muhammed Amil", topics=["b", "a"], links=["github.com/amil"], run=k) for k in range(5)]
    asks = [request("Muhammed Amil", run=k, github="amil") for k in range(5)]
    a, b = resolved(spark, rows, asks), resolved(spark, rows[::-1], asks[::-1])
    key = lambda r: sorted(map(str, r.decided.collect()))
    assert key(a) == key(b)


def test_caps_bound_scores():
    caps = {k: Decimal(v) for k, v in policy.CAPS.items()}
    pair = sum(caps[g] for g in ("website", "profile_link", "handle", "location", "bio", "topics"))
    assert pair == Decimal("1.15") and pair - caps["profile_link"] == Decimal("0.70")


def test_golden_record(spark):
    rows = [account("github", "amil", name="Muhammed Amil", site="https://amil.dev", topics=["python", "fast-api"], bio="Backend engineer, likes data."), account("devto", "amil", name="Muhammed Amil", site="me.substack.com", topics=["python"], links=["https://github.com/amil"])]
    r = resolved(spark, rows, [request("Muhammed Amil", github="amil", devto="amil")])
    p = golden.profiles(r.links, r.accounts).first()
    assert (p["display_name"], p["name_strategy"], p["website"], p["skills"]) == ("Muhammed Amil", "repeated_real_name", "https://amil.dev", "Python, FastAPI")
    assert "Muhammed Amil has 2 accepted" in golden.fallback_summary(golden.profiles(r.links, r.accounts)).first()["summary"]
    assert golden.violations(r.links, golden.LINK_RULES, "run_id").count() == 0


def test_blocked_profile(spark):
    r = resolved(spark, [account("github", "simonw", name="Simon Willison")], [request("Linus Torvalds", github="simonw")])
    p = golden.profiles(r.links, r.accounts).first()
    assert p["level"] == "uncertain" and p["display_name"] is None and p["n_accounts"] == 0


def test_discovery(spark):
    asks = spark.createDataFrame([request("Ada Lovelace", 1), request("Ada Lovelace", 2, github="@Ada", stackoverflow="0042")], REQUEST)
    got = {(x["run_id"], x["source"], x["identifier"], x["rank"]) for x in discovery.discover(asks).collect()}
    assert (1, "github", "adalovelace", 60) in got and (1, "hackernews", "ada-lovelace", 30) in got
    assert {x for x in got if x[0] == 2} == {(2, "github", "Ada", 100), (2, "stackoverflow", "42", 100)}
    assert all(sum(1 for y in got if y[:2] == x[:2]) <= 3 for x in got)


def test_empty_tables(spark):
    r = resolved(spark, [], [])
    assert r.decided.count() == 0 and golden.profiles(r.links, r.accounts).count() == 0


@pytest.mark.parametrize("verdict, score, want", [("likely_same_person", "0.80", "promoted_to_auto_match"), ("likely_same_person", "0.70", "kept_needs_review"), ("likely_different_person", "0.80", "kept_needs_review"), ("uncertain", "0.80", "kept_needs_review")])
def test_review_action(spark, verdict, score, want):
    a = golden.review_action(F.lit(verdict), F.lit("high"), resolve.dec(score), F.lit(2), F.lit(True), F.lit(False), F.lit(False))
    assert spark.range(1).select(a).first()[0] == want


def test_request_fields_may_be_profile_urls(spark):
    from pyspark.sql import functions as F

    from kinloom.operators import discovery

    cases = {
        "github": [("https://github.com/Octocat", "octocat"), ("www.github.com/octocat/", "octocat"), ("github.com/octocat/repo", None), ("https://github.com/settings", None), (" @Octo ", "octo"), ("https://example.org/octocat", None), (None, None), ("", None)],
        "stackoverflow": [("https://stackoverflow.com/users/00042/x", "42"), ("0042", "42"), ("https://stackoverflow.com/questions/1", None), ("name", None)],
        "hackernews": [("https://news.ycombinator.com/user?id=PG", "pg"), ("https://hn.algolia.com/user/pg/x", "pg"), ("pg", "pg")],
        "devto": [("https://dev.to/Ben", "ben"), ("dev.to/ben?x=1", "ben"), ("https://dev.to/search", None)],
    }
    for source, rows in cases.items():
        df = spark.createDataFrame([(raw,) for raw, _ in rows], "raw string")
        got = [r[0] for r in df.select(discovery.requested(source, F.col("raw"))).collect()]
        assert got == [want for _, want in rows], source


def test_small_files_become_many_tasks(spark):
    """Accounts and requests that lie in one partition are dealt by run before the work on them."""
    from pyspark.sql import functions as F

    raw = spark.range(0, 40, 1, 1).select((F.col("id") % 10).alias("run_id"), *[F.col("id").cast("string").alias(c) for c in ("account_key", "source", "user_id", "handle", "display_name", "location", "website_url", "profile_url", "email_hash", "email_domain", "bio")], F.array(F.lit("a")).alias("topics"), F.array(F.lit("b")).alias("outbound_links"))
    asked = raw.select("run_id", *[F.col("handle").alias(c) for c in ("name", "github", "devto", "hackernews", "stackoverflow")], "email_hash", "email_domain").dropDuplicates(["run_id"]).coalesce(1)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [run_id" in plan(resolve.normalized(raw))
    assert plan(resolve.request_evidence(resolve.normalized(raw), asked)).count("RepartitionByExpression [run_id") == 2
