"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from kinloom.plans.oracles import ORACLES
from kinloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["health_api_calls", "rolling_rate_window", "session_activity", "stream_watermark_counts", "url_normalize", "html_to_text", "keyword_topics_topk", "candidate_caps", "pair_scores", "evidence_packets", "verdict_breaches", "stream_upsert", "replaced_runs", "classify_decisions", "canonical_profile", "review_eligibility", "retry_policy", "headlines", "review_final_links", "raw_record_warnings", "conflict_sides", "handle_indel_similarity", "name_compatibility", "similar_handles", "profile_link_graph", "profile_full_read", "profile_detail", "bundle_raw_records", "normalize_raw_accounts"])
def test_query_matches_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    at = [sql.columns.index(c) for c in sorted(df.columns)]
    assert sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in sql.fetchall())


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
