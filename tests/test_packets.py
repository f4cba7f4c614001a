"""Packets of evidence, and verdicts on them."""

import json

from pyspark.sql import functions as F

from kinloom.operators import packets

SCORES = "run_id long, lk string, rk string, confidence double, weak_only boolean, groups array<string>, strong_groups array<string>, blocking_types array<string>, conflicts long"
GOOD = {"recommendation": "uncertain", "confidence": "low", "rationale": ["a  site"], "used_evidence_types": ["site"]}


def _packets(spark, items=20):
    scores = spark.createDataFrame([(1, "a", "b", 0.5, False, ["website"], [], [], 2), (1, "a", "c", 0.0, True, [], [], [], 0)], SCORES)
    ev = spark.createDataFrame([(1, "b", "a", "site", "website", 0.3), (1, "a", "b", "name", "name", 0.4), (1, "a", None, "input", "input", 0.9), (1, "a", "b", "site", "website", 0.3)], "run_id long, account_key string, other_key string, signal string, signal_group string, weight double")
    cf = spark.createDataFrame([(1, "a", "b", "place", "place", "low", -0.1), (1, "a", "b", "mail", "hash", "high", -0.6)], "run_id long, lk string, rk string, conflict string, basis string, severity string, penalty double")
    return packets.packets(scores, ev, cf, items)


def test_packets_hold_the_strongest_first(spark):
    got = {r.rk: r for r in _packets(spark).collect()}
    assert [(e.signal, e.account_key) for e in got["b"].evidence] == [("name", "a"), ("site", "a"), ("site", "b")]
    assert [c.conflict for c in got["b"].conflicts] == ["mail", "place"] and got["c"].evidence == got["c"].conflicts == []
    got = {r.rk: r for r in _packets(spark, 1).collect()}
    assert [e.signal for e in got["b"].evidence] == ["name"] and [c.conflict for c in got["b"].conflicts] == ["mail"]


def test_clean_list(spark):
    df = spark.createDataFrame([([" a\t b ", None, "", "a b", "cdef", "x"],), (None,), ([],)], "v array<string>")
    assert [r[0] for r in df.select(packets.clean_list(F.col("v"), 2, 3)).collect()] == [["a b", "cde"], [], []]


def test_breaches(spark):
    given = {
        None: [("empty", "")], " \n": [("empty", "")], "what {is": [("no_json", "")], "[1]": [("no_object", "")], "7": [("no_object", "")], "{}": [("shape", "confidence,recommendation")],
        json.dumps(GOOD): [], "so: " + json.dumps(GOOD) + " end": [], json.dumps(GOOD | {"mood": None}): [("unknown_field", "mood")],
        json.dumps(GOOD | {"recommendation": "yes", "confidence": 1, "rationale": "x", "risk_flags": [1]}): [("shape", "confidence,rationale,recommendation,risk_flags")],
        json.dumps(GOOD | {"rationale": list("abcdef")}): [("shape", "rationale")], json.dumps(GOOD | {"rationale": None, "risk_flags": []}): [("shape", "rationale")],
        json.dumps(GOOD | {"risk_flags": ["the VERIFIED owner, so to say"]}): [("claim", "verified owner")], json.dumps(GOOD | {"risk_flags": ["unverified"]}): [],
        json.dumps(GOOD | {"used_evidence_types": ["mail", "zzz", "name", "b"]}): [("unsupported_type", "b,zzz")],
    }
    packet = _packets(spark).filter("rk = 'b'").drop("run_id").crossJoin(spark.range(len(given)).withColumnRenamed("id", "run_id"))
    verdicts = spark.createDataFrame([(i, "a", "b", v) for i, v in enumerate(given)] + [(99, "a", "b", json.dumps(GOOD))], "run_id long, lk string, rk string, verdict string")
    got = {}
    for r in packets.breaches(verdicts, packet).collect():
        got.setdefault(r.run_id, []).append((r.breach, r.detail))
    assert [got.get(i, []) for i in range(len(given))] == list(given.values()) and got[99] == [("unsupported_type", "site")]
