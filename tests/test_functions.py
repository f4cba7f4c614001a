import pytest
from pyspark.sql import functions as F

from kinloom.functions import fuzzy, text


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_domain(spark):
    given = ["https://github.com/x", "dev.to/x", "https://stackoverflow.com/users/1", "https://news.ycombinator.com/user?id=a", "https://www.amil.dev/", "http://amil.dev", "me.substack.com", "notes", None, "a b.com"]
    assert values(spark, text.domain, given) == [None] * 4 + ["amil.dev", "amil.dev", None, None, None, None]


def test_fingerprint(spark):
    given = ["https://stackoverflow.com/users/00022656/x", "HTTPS://GitHub.com/BenHalpern/", "github.com/benhalpern?utm_source=test", "javascript:alert(1)", "https://exa mple.com", "https://example.com/ben", "https://hn.algolia.com/user/Pg"]
    assert values(spark, text.fingerprint, given) == ["stackoverflow:22656", "github:benhalpern", "github:benhalpern", None, None, None, "hackernews:pg"]


def test_urls(spark):
    assert values(spark, text.extract_urls, ["See https://example.com/path."]) == [["https://example.com/path"]]


def test_locations(spark):
    a = text.normalize_location
    assert values(spark, a, ["Bengaluru, India", "Bangalore", "Remote", " NYC ", None]) == ["bengaluru, india", "bangalore", None, "new york", None]
    tokens = values(spark, lambda c: text.location_tokens(a(c)), ["Bengaluru, India", "Bangalore"])
    assert set(tokens[0]) & set(tokens[1]) == {"bangalore"}


def test_bio_keywords(spark):
    words = values(spark, text.bio_keywords, ["AI engineer building FastAPI tools", "FastAPI developer writing about AI automation", "ML with Node.js, PostgreSQL and k8s", "React.js js C++ go"])
    assert sorted(set(words[0]) & set(words[1])) == ["ai", "fastapi"]
    assert set(words[2]) >= {"ml", "nodejs", "postgres", "kubernetes"}
    assert set(words[3]) == {"react", "javascript", "cpp"}


def test_names(spark):
    df = spark.createDataFrame([("  Muhammed   Amil ", "muhammed amil"), ("John Smith", "John"), ("Christopher Nolan", "Christopher"), ("José Díaz", "Dr Jose Diaz")], "a string, b string")
    n = lambda c: text.normalize_name(fuzzy.ascii_fold(text.clean(F.col(c))))
    got = [tuple(r) for r in df.select(n("a").alias("x"), n("b").alias("y")).select(text.names_exact(F.col("x"), F.col("y")), text.names_partial(F.col("x"), F.col("y"))).collect()]
    assert got == [(True, False), (False, False), (False, True), (True, False)]


@pytest.mark.parametrize(
    "a, b, want",
    [("m amil", "muhammed amil", "compatible"), ("muhammed amil", "muhammed khan", "inconclusive"), ("muhammed amil", "david lee", "conflicting"), ("sarah chen", "robert martin", "conflicting"), ("", "x y", "not_comparable"), ("a b", "c d", "not_comparable"), ("ann lee", "lee ann", "compatible")],
)
def test_compatibility(a, b, want):
    assert fuzzy.compatibility(a, b) == want


def test_indel():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return 200 * row[-1] / (len(a) + len(b))

    assert fuzzy.indel("muhammedamil", "muhammed-amil") == pytest.approx(96.0)
    for a, b in [("abcde", "badce"), ("x", "y"), ("kitten", "sitting"), ("aaaa", "aa")]:
        assert fuzzy.indel(a, b) == pytest.approx(slow(a, b))


def test_handles(spark):
    df = spark.createDataFrame([("muhammedamil", "muhammed-amil"), ("ab", "ab"), ("abc", "abc"), ("abc", "xyz"), (None, "abc")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.handles_similar(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False]


def test_html_and_json(spark):
    assert values(spark, lambda c: text.strip_tags(fuzzy.html_unescape(c)), ["<b>a&amp;b</b>  c", "  ", None]) == ["a&b c", None, None]
    assert values(spark, text.salvage_json, ['{"a":1}', 'so: {"a":1} ok', "none", "{bad"]) == ['{"a":1}', '{"a":1}', None, None]
    assert values(spark, text.estimate_tokens, ["one two three", "", None]) == [4, 0, 0]
    assert values(spark, text.html_escape, ["<a href='x'>&"]) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;"]
