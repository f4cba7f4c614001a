"""Whole profiles, edges of links and the similarity join."""

import random

from pyspark.sql import functions as F

from kinloom.functions import fuzzy
from kinloom.operators import detail, resolve

LINK = "run_id long, account_key string, source string, decision string, relationship string, verification string, confidence decimal(6,4), evidence_confidence decimal(6,4)"


def _links(spark, *rows):
    from decimal import Decimal

    made = [(r, k, k.split(":")[0], d, rel, "v", Decimal(c), Decimal(c)) for r, k, d, rel, c in rows]
    return spark.createDataFrame(made, LINK)


def test_detail_has_a_row_for_each_request_and_its_warnings(spark):
    linked = _links(spark, (1, "github:a", "auto_match", "primary", "0.9"), (1, "devto:b", "needs_review", "possible_alias", "0.6"), (2, "github:c", "needs_review", "possible_alias", "0.7"), (2, "hackernews:d", "reject", "rejected", "0.1"), (4, "github:e", "auto_match", "primary", "0.9"))
    requests = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "run_id long")
    decided = linked.select("run_id", "account_key", F.lit("anchor_input").alias("basis"), F.lit("low").alias("risk"), (F.col("decision") == "auto_match").alias("is_anchor"))
    facts = spark.createDataFrame([(1, "github:a", "bio", "x"), (1, "github:z", "bio", "x"), (1, "github:a", "location", "y")], "run_id long, account_key string, fact string, value string")
    profile = spark.createDataFrame([(1, "A", None, "x", False), (4, "E", None, None, True)], "run_id long, display_name string, location string, bio string, fields_pending boolean")
    told = linked.select("run_id", "account_key", F.array(F.lit("one."), F.lit("two."), F.lit("three.")).alias("explanation"))
    got = {r.run_id: r for r in detail.detail(requests, decided, linked, profile, facts, told).collect()}
    assert {k: (v.outcome, v.stage, [w.code for w in v.warnings]) for k, v in got.items()} == {
        1: ("resolved", "deterministic_built", ["ambiguous_candidates_present"]),
        2: ("ambiguous_candidates", "canonical_build_blocked", ["profile_needs_review"]),
        3: ("no_candidates_found", "canonical_build_blocked", ["no_candidates_found"]),
        4: ("resolved", "deterministic_built", ["canonical_fields_pending"]),
    }
    assert got[1].warnings[0].details == {"review_candidates": "1"} and got[2].warnings[0].details["reason"] == "no_auto_match_accounts"
    assert [(x.account_key, x.hn_conservative, x.reason) for x in got[2].review_candidates + got[2].rejected_candidates] == [("github:c", False, "one. two."), ("hackernews:d", True, "one. two.")]
    assert [(f.fact, f.accounts) for f in got[1].field_sources] == [("bio", ["github:a", "github:z"])] and got[3].sources == [] == got[3].field_sources


def test_full_read_nests_evidence_and_takes_the_latest_summary(spark):
    linked = _links(spark, (1, "github:a", "reject", "rejected", "0.1"), (1, "devto:b", "auto_match", "primary", "0.9"))
    requests = spark.createDataFrame([(1,), (1,), (2,)], "run_id long")
    accounts = spark.createDataFrame([(1, "devto:b", "b", "B", None, None, "u")], "run_id long, account_key string, handle string, display_name string, location string, website_url string, profile_url string")
    ev = spark.createDataFrame([(1, "devto:b", "z", "g", 0.1, "k"), (1, "devto:b", "a", "g", 0.2, None)], "run_id long, account_key string, signal string, signal_group string, weight double, other_key string")
    cf = spark.createDataFrame([], "run_id long, conflict string, basis string, severity string, penalty double, lk string, rk string")
    facts = spark.createDataFrame([(1, "devto:b", "bio", "x", 0.5)], "run_id long, account_key string, fact string, value string, confidence double")
    summaries = spark.createDataFrame([(1, 5, "new"), (1, 3, "old")], "run_id long, created_at int, summary string")
    got = {r.run_id: r for r in detail.full_read(requests, linked, accounts, ev, cf, facts, summaries).collect()}
    assert [(x.account_key, x.account and x.account.handle, [e.signal for e in x.evidence]) for x in got[1].links] == [("devto:b", "b", ["a", "z"]), ("github:a", None, [])]
    assert got[1].summary == "new" and got[1].facts[0].value == "x" and got[1].conflicts == []
    assert (got[2].links, got[2].facts, got[2].summary) == ([], [], None)


def test_link_edges_across_and_within_runs(spark):
    rows = [(1, "a:1", "p1", ["p2", "p2", None]), (2, "b:2", "p2", ["p1", "p2", "gone"]), (2, "c:3", "p3", ["p2"]), (3, "d:4", "p1", ["p2"]), (3, "e:5", None, None)]
    accounts = spark.createDataFrame(rows, "run_id long, account_key string, n_print string, n_links array<string>")
    assert sorted(map(tuple, resolve.link_edges(accounts).collect())) == [("p1", "p2", 3, True), ("p2", "p1", 1, True), ("p3", "p2", 1, False)]
    assert sorted(map(tuple, resolve.link_edges(accounts, ("run_id",)).collect())) == [(2, "p3", "p2", 1, False)]
    assert [(r.signal, r.account_key, r.other_key) for r in resolve.link_evidence(accounts).collect()] == [("direct_profile_link", "c:3", "b:2")]
    two = spark.createDataFrame([(1, "a:1", "p1", ["p2"]), (1, "b:2", "p2", ["p1"])], accounts.schema)
    assert sorted((r.signal, r.account_key) for r in resolve.link_evidence(two).collect()) == [("direct_profile_link", "a:1"), ("direct_profile_link", "b:2"), ("reciprocal_profile_link", "a:1")]


def test_similarity_join_equals_brute_force(spark):
    rnd = random.Random(1)
    values = {"", "ab", "abc", "abd", "x" * 40, "x" * 44, "x" * 50}
    for _ in range(60):
        base = "".join(rnd.choice("abc-1") for _ in range(rnd.randint(3, 40)))
        values.add(base)
        for _ in range(3):
            s = list(base)
            for _ in range(rnd.randint(1, 4)):
                i = rnd.randrange(len(s) + 1)
                s[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "z"])
            values.add("".join(s))
    df = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], "value string")
    for percent in (90, 75):
        want = {(a, b) for a in values for b in values if len(a) >= 3 and len(b) >= 3 and a != b and (len(a), a) < (len(b), b) and fuzzy.indel(a, b) >= percent}
        assert len(want) > 30 and {(r.a, r.b) for r in fuzzy.similar_pairs(df, percent).collect()} == want


def test_a_common_ending_makes_no_candidates(spark):
    rnd = random.Random(2)
    values = {"".join(rnd.choice("abcdefgh12345678") for _ in range(size)) + "_dev" for size in [7] * 150 + [8] * 150 + [22] * 150}
    near = {v[:3] + v[4:] for v in list(values)[:40]} | {v[1] + v[0] + v[2:] for v in list(values)[:40]} | {"zz" + v for v in list(values)[:40]} | {"x" + v[1:] for v in values if len(v) == 11} | {v[:-3] for v in list(values)[:40]} | {"q" + v[:9] + "q" + v[9:] for v in values if len(v) > 20}
    values |= near
    want = {(a, b): fuzzy.indel(a, b) for a in values for b in values if (len(a), a) < (len(b), b) and fuzzy.indel(a, b) >= 90}
    df = spark.createDataFrame([(v,) for v in values], "value string")
    met = fuzzy.meeting_pairs(df).collect()
    assert len(met) == len({(r.a, r.b) for r in met}) and len(want) > 300 and len(met) < len(want) + 50
    assert {(r.a, r.b): r.ratio for r in fuzzy.similar_pairs(df).collect()} == want


def test_long_and_odd_values_have_partners_too(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(1500))
    values = {long, long[:700] + "-" + long[720:], "\U0001f600" * 9 + "a", "\U0001f600" * 9 + "b", "\u00e9" * 12, "\u00e9" * 13, "a" * 9, "   ", "    "}
    want = {(a, b): fuzzy.indel(a, b) for a in values for b in values if (len(a), a) < (len(b), b) and fuzzy.indel(a, b) >= 90}
    df = spark.createDataFrame([(v,) for v in values] + [(None,), ("",)], "value string")
    assert len(want) == 3 and {(r.a, r.b): r.ratio for r in fuzzy.similar_pairs(df).collect()} == want
    alone = spark.createDataFrame([(long * 4,), ("abc",)], "value string")  # nothing is made of a length that no partner has
    assert fuzzy.similar_pairs(alone).count() == 0


def test_pairs_are_worked_out_once_and_joined_back(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, None, "b"), (4, "b", None), (5, None, None), (6, "a", "a")], "i int, a string, b string")
    got = fuzzy.by_distinct_pair(df, "a", "b", fuzzy.indel_ratio, "ratio")
    assert sorted((r.i, r.ratio) for r in got.collect()) == [(1, 0.0), (2, 0.0), (3, None), (4, None), (5, None), (6, 100.0)]
