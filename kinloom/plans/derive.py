"""Accounts, requests and call metrics derived from the star schema, in SQL that Spark and DuckDB both run.

Four customers in a row are one resolution request's accounts, one on each platform.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Common table expressions over customer, part, nation, region, events and orders.
ACCOUNTS = """
base AS (
  SELECT cast(floor(c_custkey / 4) AS bigint) AS r, c_custkey % 4 AS k, c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nk FROM customer),
names AS (
  SELECT p_partkey AS pk, p_name AS part_name FROM part),
people AS (
  SELECT b.*, n.part_name AS base_name FROM base b JOIN names n ON n.pk = b.r % 200),
accounts AS (
  SELECT r AS run_id, id, k,
    CASE k WHEN 0 THEN 'github' WHEN 1 THEN 'stackoverflow' WHEN 2 THEN 'devto' ELSE 'hackernews' END AS source,
    cast(id AS string) AS user_id,
    CASE WHEN r % 5 < 2 THEN concat('User', cast(r AS string)) WHEN r % 5 = 2 THEN concat('@u-', cast(id AS string)) ELSE concat('h', cast(id * 7919 % 100003 AS string)) END AS handle,
    CASE WHEN k = 3 AND r % 5 < 2 THEN concat('User', cast(r AS string)) WHEN r % 7 = 3 AND k = 2 THEN 'Zzyzx Qwvkj' WHEN r % 7 = 5 AND k = 1 THEN split_part(base_name, ' ', 1)
      WHEN r % 11 = 4 AND k = 0 THEN NULL ELSE concat('Dr ', base_name) END AS display_name,
    CASE WHEN r % 8 = 7 THEN 'Remote' WHEN r % 3 = 0 THEN concat('Town ', cast(r % 25 AS string), ', Land') WHEN r % 3 = 1 THEN concat('Town ', cast(r % 25 + k AS string), ', Land') WHEN k = 3 THEN NULL ELSE concat('Place', cast(nk AS string)) END AS location,
    CASE WHEN r % 4 = 0 THEN concat('https://www.Site', cast(r AS string), '.dev/') WHEN r % 4 = 1 THEN concat('http://site', cast(r AS string), 'x', cast(k AS string), '.dev/about?utm_source=a') WHEN r % 4 = 2 THEN 'https://github.com/someone' WHEN k % 2 = 1 THEN NULL ELSE concat('me', cast(r AS string), '.substack.com') END AS website_url,
    CASE WHEN r % 9 = 0 THEN concat('hash', cast(r AS string)) WHEN r % 9 = 1 THEN concat('hash', cast(id AS string)) END AS email_hash,
    CASE WHEN r % 10 = 2 THEN concat('mail', cast(r AS string), '.org') WHEN r % 10 = 3 THEN concat('mail', cast(id AS string), '.org') WHEN r % 10 = 4 THEN 'gmail.com' END AS email_domain,
    CASE WHEN r % 6 < 4 THEN concat(lower(segment), '|', replace(base_name, ' ', '|')) ELSE concat('t', cast(id AS string), 'a|t', cast(id AS string), 'b|t', cast(id AS string), 'c|t', cast(id AS string), 'd|t', cast(id AS string), 'e|t', cast(id AS string), 'f') END AS topics_text,
    CASE r % 3 WHEN 0 THEN 'AI engineer building FastAPI tools' WHEN 1 THEN concat('Platform person ', cast(id AS string), ' on Kubernetes') ELSE NULL END AS bio
  FROM people),
linked AS (
  SELECT a.*, lower(concat(source, ':', coalesce(user_id, handle))) AS account_key,
    CASE k WHEN 0 THEN concat('https://github.com/gh', cast(run_id AS string)) WHEN 1 THEN concat('https://stackoverflow.com/users/', cast(id AS string), '/x') WHEN 2 THEN concat('https://dev.to/dt', cast(run_id AS string)) ELSE concat('https://news.ycombinator.com/user?id=hn', cast(run_id AS string)) END AS profile_url,
    CASE WHEN run_id % 6 = 0 AND k = 0 THEN concat('https://dev.to/DT', cast(run_id AS string), '/') WHEN run_id % 6 = 0 AND k = 2 THEN concat('http://www.github.com/gh', cast(run_id AS string), '?ref=x')
      WHEN run_id % 6 = 1 AND k = 0 THEN concat('https://stackoverflow.com/users/000', cast(id + 1 AS string)) WHEN run_id % 6 = 2 AND k = 3 THEN concat('github.com/gh', cast(run_id AS string)) END AS link
  FROM accounts a),
requests AS (
  SELECT r AS run_id, base_name AS name,
    CASE WHEN r % 6 = 1 THEN concat('https://www.GitHub.com/', cast(r * 4 AS string), '/') WHEN r % 6 = 4 THEN concat('github.com/', cast(r * 4 AS string), '?tab=repositories') WHEN r % 3 > 0 THEN cast(r * 4 AS string) END AS github,
    CASE WHEN r % 6 = 5 THEN concat('https://dev.to/', cast(r * 4 + 2 AS string)) WHEN r % 3 = 2 THEN cast(r * 4 + 2 AS string) END AS devto,
    CASE WHEN r % 9 = 0 THEN concat('hash', cast(r AS string)) END AS email_hash,
    CASE WHEN r % 10 = 2 THEN concat('mail', cast(r AS string), '.org') END AS email_domain
  FROM people WHERE k = 0)
"""

CALLS = """
calls AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'github' WHEN 'view' THEN 'stackoverflow' WHEN 'signup' THEN 'devto' WHEN 'purchase' THEN 'hackernews' ELSE 'gemini' END AS source,
    cast(floor(value * 10) AS int) AS duration_ms, ts AS created_at, props,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 429 WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 29 = 0 THEN 503 ELSE 200 END AS status_code,
    CASE WHEN event_id % 19 = 0 THEN 'timed out' END AS error_message,
    CASE WHEN event_id % 7 = 0 THEN cast(user_id AS int) END AS rate_limit_remaining
  FROM events)
"""

RUNS = """
runs AS (
  SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status, cast(floor(o_totalprice / 100) AS int) AS duration_ms FROM orders)
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet").createOrReplaceTempView(n)


def people(spark: SparkSession, sf_dir: str) -> None:
    """Views customer and part. Customers are dealt by key: a small file of them stands for much work, which one task would do."""
    tables(spark, sf_dir, "customer", "part")
    spark.table("customer").repartition("c_custkey").createOrReplaceTempView("customer")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, account_key, source, user_id, handle, display_name, location, website_url, profile_url, email_hash, email_domain, bio, topics, outbound_links)."""
    people(spark, sf_dir)
    return spark.sql(
        f"WITH {ACCOUNTS} SELECT run_id, account_key, source, user_id, handle, display_name, location, website_url, profile_url, email_hash, email_domain, bio, "
        "split(topics_text, '[|]') AS topics, filter(array(link), x -> x IS NOT NULL) AS outbound_links FROM linked"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, name, github, devto, hackernews, stackoverflow, email_hash, email_domain)."""
    people(spark, sf_dir)
    return spark.sql(f"WITH {ACCOUNTS} SELECT run_id, name, github, devto, cast(NULL AS string) AS hackernews, cast(NULL AS string) AS stackoverflow, email_hash, email_domain FROM requests")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(f"WITH {CALLS} SELECT * FROM calls")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "orders")
    return spark.sql(f"WITH {RUNS} SELECT * FROM runs")
