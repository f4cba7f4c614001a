"""Reviews, explanations, retry rules and weak texts by hand."""

from pyspark.sql import functions as F

from kinloom.functions import fuzzy, text
from kinloom.operators import golden, health, resolve, review
from kinloom.sources import accounts


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_final_links(spark):
    links = spark.createDataFrame([(1, k, "needs_review", "possible_alias", "needs_review", 0.7) for k in "abcd"] + [(1, "e", "auto_match", "primary", "claimed_by_input", 0.5)], "run_id long, account_key string, decision string, relationship string, verification string, confidence double")
    told = spark.createDataFrame([(1, "a", "promoted_to_auto_match", 0.75), (1, "b", "rejected_after_review", 0.0), (1, "c", "kept_needs_review", 0.9)], "run_id long, account_key string, action string, score double")
    out = [(k, d, r, v, float(c)) for _, k, d, r, v, c in rows(review.final_links(links, told), "account_key")]
    assert out == [
        ("a", "auto_match", "secondary", "likely_same_person", 0.85), ("b", "reject", "rejected", "rejected", 0.7), ("c", "needs_review", "possible_alias", "needs_review", 0.7),
        ("d", "needs_review", "possible_alias", "needs_review", 0.7), ("e", "auto_match", "primary", "claimed_by_input", 0.85),
    ]


def test_counters(spark):
    given = [(1, None, True, None, "promoted_to_auto_match"), (1, None, True, "timed out", "review_failed_keep_needs_review"), (1, "missing_anchor", False, None, None), (1, "missing_anchor", False, None, None), (2, None, True, None, "rejected_after_review")]
    df = spark.createDataFrame(given, "run_id long, skip_reason string, reviewed boolean, error string, action string")
    assert rows(review.counters(df), "run_id") == [(1, 2, 2, 2, 1, 1, 1, 0, 1, "missing_anchor:2"), (2, 1, 0, 1, 1, 0, 0, 1, 0, "")]
    assert review.counters(df.limit(0)).count() == 0


def test_failure_kind(spark):
    df = spark.createDataFrame([(401, "quota", "E"), (None, "Quota spent", "E"), (503, None, "E"), (None, "odd", "ReadTimeout"), (None, None, None)], "s int, m string, n string")
    assert [r[0] for r in df.select(review.failure_kind(F.col("s"), F.col("m"), F.col("n"))).collect()] == ["non_retryable", "retryable", "retryable", "retryable", "failed"]


def test_retry_rules(spark):
    # event_id 0 and 3 are first attempts of three
    df = spark.createDataFrame([(0, 429, None, 0, 9, None), (3, 429, None, 0, None, None), (6, 429, None, 5, 9, 3), (9, 429, None, 5, 9, 4), (12, 503, None, 5, 9, 4), (15, None, "timed out", 0, 9, None), (5, 503, None, 5, 9, None)], "event_id long, status_code int, error_message string, rate_limit_remaining int, rate_limit_reset long, retry_after_s int")
    out = {r.event_id: (r.again, r.wait_s) for r in health.retry_plan(df).collect()}
    assert out == {0: (False, None), 3: (True, 0.5), 6: (True, 3.0), 9: (False, None), 12: (True, 3.0), 15: (True, 0.5), 5: (False, None)}
    assert health.retry_plan(df.select("event_id", "status_code", "error_message")).filter("again").count() == 6


def test_explanations(spark):
    scores = spark.createDataFrame([(1, "hackernews:x", 0.25, ["name"], [], 0.25), (1, "github:y", 0.97, ["email", "name"], ["email"], 1.1)], "run_id long, account_key string, confidence double, groups array<string>, strong_groups array<string>, positive double")
    own = scores.select("run_id", "account_key", F.substring_index("account_key", ":", 1).alias("source"))
    a, b = (r.explanation for r in resolve.account_explanations(own, scores).orderBy("account_key").collect())
    assert a == ["Account github:y scored 0.97 for the request.", "Counted groups of evidence: email, name.", "The sum was more than may count and is held at 0.97."]
    assert len(b) == 4 and b[-1].startswith("Profiles of this platform")


def test_weak_texts(spark):
    given = {"Hi, developer!": None, "Welcome to my page about trains": None, "Builds trains. And more": "Builds trains", "Short": "Short", "Hello world of trains": "Hello world of trains", "x" * 130: "x" * 117 + "...", " ?! ": None}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert [r[0] for r in df.select(golden.headline(text.clean(F.col("t")))).collect()] == list(given.values())


def test_html_and_messages(spark):
    df = spark.createDataFrame([("<p>a&amp;amp;b</p> c&nbsp;d", "bad API-Key"), (None, None), ("", " x" * 400)], "h string, m string")
    a, b, c = df.select(fuzzy.html_to_text(F.col("h")), text.safe_message(F.col("m"))).collect()
    assert a[0] == "a&b c d" and a[1].startswith("Message left out")
    assert tuple(b) == (None, None) and c[0] is None and len(c[1]) == 300


def test_warnings(spark):
    raw = spark.createDataFrame([(1, "github", "profile", "7", None, '{"id": 7}', 1), (2, "github", "repos", "8", None, "[]", 1), (3, "myspace", "profile", "9", None, "{}", 1), (4, "stackoverflow", "user", None, None, '{"items": []}', 1), (5, None, "user", "1", None, "{}", 1)], "id long, source string, record_type string, user_id string, handle string, payload string, fetched_at long")
    out = [(s, g, t, m.split(" ")[0]) for s, g, t, m in rows(accounts.warnings(raw), "source", "account_group", "record_type")]
    assert out == [(None, "raw:5", "user", "Skipped:"), ("github", "id:7", "repos", "Made"), ("github", "id:8", None, "No"), ("myspace", "raw:3", "profile", "Skipped:"), ("stackoverflow", "raw:4", None, "No"), ("stackoverflow", "raw:4", "user", "Neither")]


def test_skill_terms(spark):
    df = spark.createDataFrame([(["a"], "x; y,,z", '{"tags": ["t", "t"], "top_languages": {"Go": 2}, "repo_topics": "p,q", "skills": null}'), (None, None, "no JSON"), (None, None, None)], "topics array<string>, languages string, activity_payload string")
    assert [r[0] for r in df.select(golden.skill_terms(df)).collect()] == [["a", "x", "y", "z", "t", "t", "Go", "p", "q"], [], []]
