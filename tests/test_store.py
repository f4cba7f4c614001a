from pyspark.sql import functions as F

from kinloom.operators import discovery, golden
from kinloom.sources import store


def test_replace_runs_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "links")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "run_id int, v string")
    store.replace_runs(a, path)
    for _ in range(2):
        store.replace_runs(spark.createDataFrame([(2, "z")], "run_id int, v string"), path)
    assert {(r["run_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "x"), (2, "z")}


def test_merge_patch(spark):
    df = spark.range(1).select(store.merge_patch(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"))
    assert df.first()["m"] == {"a": "1", "b": "3"}
    assert spark.range(1).select(store.compact(F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("x"))).alias("m")).first()["m"] == {"b": "x"}


def test_upsert_and_drift(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2, "n"), (3, "d", 2, "m")], "k int, v string, version int, extra string")
    assert {tuple(r) for r in store.upsert(old, new, ["k"], ["version"]).collect()} == {(1, "a", 1, None), (2, "c", 2, "n"), (3, "d", 2, "m")}


def test_failed_sources_leave_out_those_that_succeeded(spark):
    df = spark.createDataFrame([(1, "github", "failed"), (1, "github", "succeeded"), (1, "devto", "not_found")], "run_id int, source string, outcome string")
    r = store.ingestion_summary(df, "run_id").first()
    assert (r["attempted"], r["succeeded"], r["failed"]) == (["devto", "github"], ["github"], ["devto"])


def test_identifiers(spark):
    given = [("github", "https://github.com/Octo/"), ("github", "github.com/settings"), ("github", "github.com/a/b"), ("devto", "@ben"), ("stackoverflow", "https://stackoverflow.com/users/0042/x"), ("stackoverflow", "7a"), ("hackernews", "https://news.ycombinator.com/user?id=pg"), ("github", "-bad"), ("devto", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "i int, s string, raw string")
    got = [r[1] for r in sorted(df.select("i", discovery.identifier(F.col("s"), F.col("raw"))).collect())]
    assert got == ["Octo", None, None, "ben", "42", None, "pg", None, None]


def test_rules(spark):
    df = spark.createDataFrame([(1, 99, 5, None, None), (2, 200, -1, None, None), (3, None, 1, None, None), (4, 200, 1, None, 3)], "id int, status_code int, duration_ms int, error_message string, rate_limit_remaining int")
    assert sorted(tuple(r) for r in golden.violations(df, store.CALL_RULES, "id").collect()) == [(1, "status_range"), (2, "duration"), (3, "error_without_cause")]


def test_rate_limit(spark):
    h = F.create_map(F.lit("x-ratelimit-limit"), F.lit("60"), F.lit("x-ratelimit-remaining"), F.lit("soon"))
    r = spark.range(1).select(store.rate_limit(h, F.lit('{"quota_remaining": 7, "backoff": 2}')).alias("r")).first()["r"]
    assert tuple(r) == (60, 7, None, 2)
