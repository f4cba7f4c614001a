"""Near-duplicates, components, repeated passages and the pipeline, against brute force."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from kinloom.llm import components, neardup, substrings
from kinloom.llm.common import tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long, cls string, kept int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or ""), "c", 0) for i, t in enumerate(texts)], DOC)


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(400, links)
    assert got == {x: want[x] for x in {y for a, b in links if a != b for y in (a, b)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    base = [word() for _ in range(120)]
    for k in range(60):  # a dense ball of near copies, some far from its middle
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 3 + [" ".join(base).upper(), None, "", "  ", "a b", "A B", "b a", "a", texts[0], texts[0]]
    return texts


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    texts = corpus(random.Random(7))
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append({tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(len(texts), links)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, texts), words).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want and [got[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))
    kept = sorted(r["doc_id"] for r in neardup.drop_near_duplicates(docs(spark, texts), words).collect())
    assert kept == sorted(set(want))


def test_difference_join_misses_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 1)
    test_near_duplicates(spark, 4)


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    got = neardup.near_duplicates(docs(spark, ["a b c d e", "a b c d e", "a b c d e"], [7, 7, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("7", "7", True), ("7", "7", True), ("None", "None", True)]
    assert neardup.drop_near_duplicates(docs(spark, ["a b", "a b", "a b"], [7, 7, None])).count() == 2


def test_compact_windows():
    import numpy as np

    rng = np.random.default_rng(1)
    g, of, t = rng.integers(0, 1 << 60, 300, dtype=np.uint64), np.repeat([0, 1, 2], [120, 8, 172]), 10
    got = set(zip(*(x.tolist() for x in substrings.compact_windows(g, of, t))))
    want = set()
    for c in range(300):
        lo = hi = c
        while lo > 0 and of[lo - 1] == of[c] and g[lo - 1] > g[c]:
            lo -= 1
        while hi < 299 and of[hi + 1] == of[c] and g[hi + 1] > g[c]:
            hi += 1
        if hi - lo + 1 >= t:
            want.add((c, lo, hi))
    assert got == want


def passages_corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    make = lambda n: [word() for _ in range(n)]
    shared, near, short = make(60), make(80), make(30)
    edited = list(near)
    edited[40] = "changed"
    texts = [make(100) for _ in range(30)]
    for k in (3, 9, 21, 25):
        texts[k][20:20] = shared
    texts[5][50:50] = near
    texts[12][10:10] = edited
    for k in (6, 7):
        texts[k][0:0] = short
    return texts, shared


def test_repeats(spark):
    texts, shared = passages_corpus(random.Random(11))
    rows = [" ".join(w) for w in texts] + [None, "", "few words"]
    got = substrings.repeats(docs(spark, rows)).collect()
    spans = {(r["doc_id"], r["ref_doc_id"]): (r["start"], r["end"]) for r in got}
    assert {k[0] for k in spans} == {9, 21, 25, 12}
    for k in (9, 21, 25):
        assert spans[k, 3] == (20, 80)
    assert spans[12, 5] == (10, 90)
    assert {r["doc_id"] for r in substrings.report(docs(spark, rows)).collect()} == {3, 5, 9, 12, 21, 25}
    out = {r["doc_id"]: r["text"] for r in substrings.drop_repeats(docs(spark, rows)).collect()}
    assert len(out) == len(rows) and out[3] == rows[3] and out[32] == "few words" and out[30] is None
    assert " ".join(shared) not in out[9] and out[9].split() == texts[9][:20] + texts[9][80:]
    assert substrings.report(docs(spark, [])).count() == 0
    assert substrings.repeats(docs(spark, [rows[3], rows[3], rows[3]], [4, 4, None])).count() == 0


def test_passages_of_common_lines(spark):
    """Passages that two texts share, made of lines that many have: neither the first nor the one before has more than a line of them."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lines = [[word() for _ in range(10)] for _ in range(40)]
    some = lambda: [w for line in rng.sample(lines, 6) for w in line]
    plain = lambda n: [word() for _ in range(n)]
    rows = [plain(5) + [w for line in rng.sample(lines, 20) for w in [*line, word()]] for _ in range(80)]
    for _ in range(40):
        passage = some()
        rows += [plain(20) + passage + plain(20), plain(7) + passage + plain(30)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [rows[k] for k in order]
    first, want = {}, set()
    for i, w in enumerate(rows):
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s : s + 50]), i) != i:
                want |= {(i, k) for k in range(s, s + 50)}
    got = {(r["doc_id"], k) for r in substrings.repeats(docs(spark, [" ".join(w) for w in rows]).repartition(3)).collect() for k in range(r["start"], r["end"])}
    assert len({i for i, _ in want}) >= 40 and want <= got


def test_no_near_copy_misses_its_hits(spark):
    """Passages of 50 words with one changed, a similarity of just over 0.8."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    rows = []
    for _ in range(1500):
        w = [word() for _ in range(50)]
        rows += [w, [*w[:25], word(), *w[26:]]]
    got = {r["doc_id"] for r in substrings.repeats(docs(spark, [" ".join(w) for w in rows])).collect()}
    assert got == set(range(1, 3000, 2))


def test_whole_copies_go(spark):
    t = " ".join(f"w{k}" for k in range(70))
    assert [r["doc_id"] for r in substrings.drop_repeats(docs(spark, [t, t.upper(), t + "\n"])).collect()] == [0]


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    plain = lambda n: " ".join(word() for _ in range(n))
    passage = plain(60)
    texts = [plain(80) for _ in range(60)] + [plain(10) + " worthless scum " + plain(10) for _ in range(60)]
    texts += [texts[3], f"{plain(20)} {passage} {plain(20)}", f"{plain(20)} {passage} {plain(20)}", f"{plain(40)} password=0a1b2c3d4e5f {plain(10)}", None]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs(spark, texts).select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / f"{k}"))
        df = spark.read.parquet(str(tmp_path / f"{k}"))
        seen[name] = {r["doc_id"]: r for r in df.collect()}
    assert set(seen["toxicity"]) == {*range(60), *range(120, 125)}
    assert set(seen["minhash_near_dedup"]) == set(seen["toxicity"]) - {120}
    cut = seen["substring_dedup"]
    assert passage in cut[121]["text"] and passage not in cut[122]["text"] and cut[122]["n_chars"] == len(cut[122]["text"]) and cut[0]["text"] == texts[0]
    assert "0a1b2c3d4e5f" not in seen["secret_scans"][123]["text"]
    assert set(seen["packing"]) == set(cut)
    told = lambda x: sorted((r["doc_id"], r["doc_tokens"], r["n"]) for r in x.groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect())
    assert told(corpus_pipeline.run(spark, str(tmp_path))) == told(df)  # how documents are cut depends on their partitions


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_rows_of_one_id_are_told_apart(spark):
    rng = random.Random(31)
    a, b, c = words_of(rng, 60), words_of(rng, 60), words_of(rng, 90)
    d, e, f = words_of(rng, 40), words_of(rng, 40), words_of(rng, 70)
    rows = [(3, a), (5, f"{a} tail"), (5, b), (6, d), (6, e), (7, f), (7, f"{f} tail"), (7, f), (7, f), (8, None), (8, None), (8, ""), (None, " ")]
    left = [(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()]
    assert sum(i == 7 for i, _ in left) == 1 and {x for x in left if x[0] == 7} <= set(rows)
    assert sorted(map(str, (x for x in left if x[0] != 7))) == sorted(map(str, (x for x in rows if x[0] != 7 and x != (5, f"{a} tail"))))
    # passages: (1, c) has what (2, ...) has as well; the other row of id 2 has it not
    texts = [c, f"{words_of(rng, 20)} {c}", b, b, f"{b} {words_of(rng, 15)}"]
    out = sorted((r["doc_id"], r["text"]) for r in substrings.drop_repeats(docs(spark, texts, [1, 2, 2, 2, 7])).collect())
    want = sorted([(1, c), (2, " ".join(texts[1].split()[:20]) + " "), (2, b), (2, b), (7, " " + " ".join(texts[4].split()[60:]))])
    assert out == want
    # two different texts of one id with a passage in common: one of them keeps it
    out = [r["text"].split() for r in substrings.drop_repeats(docs(spark, [texts[1], f"{c} {words_of(rng, 12)}"], [4, 4])).collect()]
    assert sorted(map(len, out)) in ([12, 110], [20, 102])


HELPERS = """at filter_at filter_key filter_word filter_bits maybe often tag key span_id span_list spans left_over row hash name stays keeper cls n bands component_id n_shingles
kept least root x xt p pt cx cp l r f found need part salt salts lo hi offsets start end ref_doc_id DOC_HASH value shard data""".split()


def test_columns_of_any_name_stay(spark):
    rng = random.Random(32)
    a, b = words_of(rng, 80), words_of(rng, 80)
    df = docs(spark, [a, f"{a} x", b, f"{words_of(rng, 40)} {b}"]).select("doc_id", "text", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in HELPERS], F.lit(1.5).alias("odd `name.with dots"))
    for stage, ids in ((neardup.drop_near_duplicates, {0, 2, 3}), (substrings.drop_repeats, {0, 1, 2, 3})):
        out = stage(df)
        assert out.columns == df.columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == ids and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in HELPERS)
    assert stage(df.limit(0)).columns == df.columns and stage(df.limit(0)).count() == 0
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0
