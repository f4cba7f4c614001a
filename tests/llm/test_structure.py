"""Prefix trie, WARC archives and periodic runs against brute force."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinloom.llm import periods, queries, trie, warc

TURNS = "conv_id long, turn long, role string, text string, path string"


def brute_trie(seqs):
    """Nodes of {conv_id: [(role, text), ...]}, as the columns of trie.nodes()."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                kids[tuple(seq[: d - 1])].add(tuple(seq[:d]))
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in own if len(seqs[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids[node]), sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def spliced(rows, every=5, most=9):
    own = defaultdict(list)
    for c, t, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    h = lambda c: zlib.crc32(str(c).encode()) % most
    return {c: own.get(c - (abs(c) % every) * (1 if c >= 0 else -1), [])[: h(c)] + own[c][h(c) :] for c in own}


def as_tuples(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 7), (3, 40)])
def test_trie_equals_brute_force_however_it_is_cut(spark, seed, parts):
    rnd = random.Random(seed)
    rows = []
    for c in range(-4, 120):
        texts = [rnd.choice("ab") if rnd.random() < 0.9 else rnd.choice([None, "", "é" * 5]) for _ in range(rnd.choice([1, 2, 5, 9, 30]))]
        rows += [(c, None if t == 0 else t, rnd.choice(["u", "u", None]), x, "x") for t, x in enumerate(texts)]
    rows += [(c, t, "u", "same", "x") for c in range(200, 260) for t in range(12)] + [(None, 0, "u", "lost", "x")]
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    got = trie.nodes(trie.spliced(trie.conversations(turns)), parts)
    assert as_tuples(got) == brute_trie(spliced(rows))
    plain = defaultdict(list)
    for c, _, role, text, _ in (r for r in rows if r[0] is not None):
        plain[c].append((role or "", text or ""))
    assert as_tuples(trie.nodes(trie.conversations(turns), parts)) == brute_trie(plain)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    turns = spark.createDataFrame([], TURNS)
    assert trie.nodes(trie.conversations(turns)).count() == 0
    empty = spark.createDataFrame([(7, []), (3, [])], "conv_id long, codes array<string>")
    assert as_tuples(trie.nodes(empty)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]


def test_ids_that_end_at_a_node_go_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 40)
    ids = {b"a": list(range(500)), b"b": [5], b"c": [9, 8], b"d": list(range(1000, 1100))}
    ends = spark.createDataFrame([(bytearray(k), i) for k, v in ids.items() for i in v], "node binary, conv_id long").repartition(7)
    got = {bytes(r[0]): r[1] for r in trie.hashed_ends(ends, 5).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in ids.items()}


PAGES = "page_id long, url string, html string, digest string"


def brute_pages(rows, least=0):
    first, out = {}, []
    for i, (p, _u, html, *_) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0)):
        data = (html or "").encode()
        first.setdefault(data, (i, p))
    import base64

    for i, (p, _u, html, *_) in enumerate(rows):
        data = (html or "").encode()
        again = len(data) >= least and first[data][0] != i
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data][1] if again else None))
    return sorted(out, key=repr)


def from_archives(spark, folder):
    found = warc.pages_of(warc.assemble(warc.read(spark, folder)))
    return sorted((tuple(r[n] for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in found.collect()), key=repr)


@pytest.mark.parametrize(("compression", "least"), [("gzip", 0), ("none", 6)])
def test_archives_come_back(spark, tmp_path, compression, least):
    texts = ["<p>a</p>", "", None, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "\r\n\r\n", "é" * 300_000, "<p>a</p>", "\x00\x1f"]
    rows = [(i, None if i % 5 == 0 else f"http://h.example/\r\n{i} é", texts[i % len(texts)], "x") for i in range(60)]
    rows += [(3, "u", "again", "x"), (3, "u", "again", "x"), (3, "u", "again", "x"), (None, None, "<p>a</p>", "x"), (None, "v", "alone", "x")]
    warc.write(spark.createDataFrame(rows, PAGES).repartition(3), f"{tmp_path}/w", least, compression=compression)
    assert from_archives(spark, f"{tmp_path}/w") == brute_pages(rows, least)
    records = warc.read(spark, f"{tmp_path}/w")
    assert records.count() == 3 * len(rows) and records.filter("problem IS NOT NULL OR NOT verified").count() == 0
    bodies = {r[0]: bytes(r[1]).partition(b"\r\n\r\n")[2] for r in records.filter("record_type = 'response'").select("payload_digest", "block").collect()}
    assert {len(x) for x in bodies.values()} >= {0, 600_000, 8}


def test_empty_table_and_contract_of_archives(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"{tmp_path}/w")
    assert from_archives(spark, f"{tmp_path}/w") == []
    spark.createDataFrame([(1, "u", "x", "d"), (2, "u", "x", "d")], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op12_warc(spark, str(tmp_path))
    assert [(c, t) for c, t in got.dtypes] == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    assert sorted((r.page_id, r.refers_to) for r in got.collect()) == [(1, None), (2, 1)]


def by_hand(kind, rid, block=b"", *fields):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"warc-record-id: " + rid, *fields, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    to = lambda x: b"WARC-Concurrent-To: " + x
    good = [
        by_hand(b"warcinfo", b"<i>"),
        by_hand(b"response", b"<r1>", b"HTTP/1.1 200\r\n\r\nbody", b"Content-Type: application/http", b"WARC-Target-URI: a\r\n b", to(b"<q1>"), to(b"<q2>")),  # names its requests itself
        by_hand(b"request", b"<q1>"), by_hand(b"request", b"<q2>"),
        by_hand(b"metadata", b"<m1>", b"about q1", to(b"<q1>")), by_hand(b"metadata", b"<m2>", b"about m1", to(b"<m1>")),  # reached over others
        by_hand(b"request", b"<lost>", b"", to(b"<nowhere>")), by_hand(b"request", b"<q1>"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/one.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in good))
    (tmp_path / "w/cut.warc").write_bytes(by_hand(b"response", b"<r2>", b"whole") + by_hand(b"response", b"<r3>", b"cut off")[:-8])
    (tmp_path / "w/cut.warc.gz").write_bytes(gzip.compress(by_hand(b"response", b"<r4>", random.Random(1).randbytes(5000)))[:-3000])
    (tmp_path / "w/bad.warc").write_bytes(b"no archive\r\n\r\n")
    records = warc.read(spark, f"{tmp_path}/w")
    assert sorted(r[0].rsplit("/", 1)[1] for r in records.filter("problem IS NOT NULL").select("archive").collect()) == ["bad.warc", "cut.warc", "cut.warc.gz"]
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"<r1>", "<r2>", "<nowhere>"}
    assert [x["record_id"] for x in got["<r1>"]["requests"]] == ["<q1>", "<q2>"] and [bytes(x["block"]) for x in got["<r1>"]["metadata"]] == [b"about q1", b"about m1"]
    assert got["<r1>"]["target_uri"] == "a b" and got["<r1>"]["payload_bytes"] == 4 and got["<nowhere>"]["record_type"] is None and got["<r2>"]["requests"] is None


def brute_runs(w):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e, p) for (s, e), p in out.items())


def test_runs_equal_brute_force():
    rnd, many = random.Random(4), 0
    for _ in range(1500):
        n = rnd.randint(0, 120)
        w = [rnd.randrange(rnd.choice([1, 2, 2, 3, 20])) for _ in range(n)]
        for _ in range(rnd.randint(0, 4) if n > 4 else 0):
            i, p = rnd.randrange(n - 2), rnd.randint(1, 30)
            for j in range(i + p, min(n, i + p + rnd.randint(1, n))):
                w[j] = w[j - p]
        want = brute_runs(w)
        assert periods.runs(w) == want
        assert periods.stretches(w, periods.repeated(periods.np.array(w, int), periods.np.array([n]))) == want
        many += len(want)
    assert many > 500


def test_periodic_runs_of_documents(spark, tmp_path):
    rnd = random.Random(2)
    texts = [None, "", " \n", "a " * 40, "x\xa0y " * 7 + "\tz", "A b\nC " * 9 + "q " + "A b\nC " * 9, "long " * 200_000, " ".join(str(i % 5000) for i in range(20_000))]
    texts += [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 90))) for _ in range(120)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "a " * 40, "x"), (None, "b c " * 20, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert [(c, t) for c, t in got.dtypes] == [(c, "bigint") for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [(c, "string") for c in ("runs_sha256", "collapsed_sha256")]
    want = []
    for doc_id, text, _ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = [(0, len(words), 1)] if len(words) == 200_000 else [(0, 20_000, 5000)] if doc_id == 7 and len(set(words)) == 5000 else brute_runs(words)
        found.sort(key=lambda r: (r[0], r[2]))
        best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
        gone = {i for s, e, p in found for i in range(s + p, e)}
        numbers = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.append((doc_id, len(found), *numbers, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 10
    assert periods.digests(periods.find(spark.createDataFrame([], "doc_id long, text string"))).filter(F.lit(True)).count() == 0
