"""Text, URL, name, location and keyword expressions, all on the JVM. Each takes and returns Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policy


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def one_of(c: Column, values) -> Column:
    return c.isin(*values)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once: as columns are trees, each mention of one would repeat all of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    """The first match of anything at all, so that c is mentioned once and the expression stays compiled: let() is interpreted with all within."""
    return F.get(F.regexp_extract_all(c, F.lit("(?s).+"), F.lit(0)), F.lit(0))


def clean(c: Column) -> Column:
    """White space runs as one blank, ends trimmed, blank is null."""
    return blank_to_null(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def strip_tags(c: Column) -> Column:
    return clean(F.regexp_replace(clean(c), "<[^>]+>", " "))


def first_seen(a: Column) -> Column:
    """Array without values equal but for case to an earlier one, nulls and blanks."""
    a = F.filter(F.transform(a, clean), lambda x: x.isNotNull())
    return let(a, lambda y: let(F.transform(y, F.lower), lambda low: F.filter(y, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def top_values(a: Column, limit: int = 10) -> Column:
    """The most frequent values of an array in lower case, ties by first place; blanks don't count."""
    w = F.filter(F.transform(a, lambda x: F.lower(clean(x))), lambda x: x.isNotNull())
    ranked = lambda w: F.array_sort(F.transform(F.array_distinct(w), lambda t: F.struct((-F.size(F.filter(w, lambda y: y == t))).alias("n"), F.array_position(w, t).alias("at"), t.alias("t"))))
    return let(w, lambda w: F.slice(F.transform(ranked(w), lambda s: s["t"]), 1, limit))


def account_key(source: Column, user_id: Column, handle: Column) -> Column:
    return F.lower(F.concat(source, F.lit(":"), F.coalesce(user_id, handle)))


# URLs are cut by RFC 3986's own pattern: parse_url keeps the host's case and fails on bad input.
URL = r"^(https?)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?"


def with_scheme(c: Column) -> Column:
    """A URL with its scheme; null if it has white space, another scheme, or neither scheme nor dot."""
    def scheme(x: Column) -> Column:
        own = F.concat(F.lower(F.regexp_extract(x, "^([A-Za-z]+)", 1)), F.regexp_extract(x, "^[A-Za-z]+(://.*)$", 1))
        return F.when(~x.contains(" "), F.when(F.lower(x).rlike("^https?://"), own).when(x.contains("."), F.concat(F.lit("https://"), x)))

    return let(let(clean(c), lambda x: F.when(x.startswith("//"), F.concat(F.lit("https:"), x)).otherwise(x)), scheme)


def host(url: Column) -> Column:
    """Host of a with_scheme() URL, lower case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL, 2)), r"^www[.]", "")


def query_params(url: Column) -> Column:
    """Kept key=value pairs of the query: no blank values, no tracking; for the one site with ids in queries only the id."""
    pairs = F.filter(F.split(F.regexp_extract(url, URL, 4), "&"), lambda p: p.rlike("^[^=]*=.+$"))
    pairs = F.transform(pairs, lambda p: F.concat(F.lower(F.substring_index(p, "=", 1)), F.lit("="), F.regexp_extract(p, "^[^=]*=(.*)$", 1)))
    pairs = F.filter(pairs, lambda p: ~p.startswith("utm_") & ~one_of(F.substring_index(p, "=", 1), policy.TRACKING_PARAMS))
    return F.when(host(url) == "news.ycombinator.com", F.filter(pairs, lambda p: p.startswith("id="))).otherwise(pairs)


def normalize_url(c: Column) -> Column:
    def whole(url: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, URL, 3), ";[^/]*$", ""), "/+$", "")
        query = let(F.array_join(query_params(url), "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return F.when(F.regexp_extract(url, URL, 2) != "", F.concat(F.regexp_extract(url, URL, 1), F.lit("://"), host(url), path, query))

    return let(with_scheme(c), whole)


def domain(c: Column) -> Column:
    """Host of a personal site; null for platforms and shared hosts."""
    shared = "(^|[.])(" + "|".join(d.replace(".", "[.]") for d in policy.SHARED_DOMAINS) + ")$"
    return let(let(with_scheme(c), host), lambda h: F.when((h != "") & ~one_of(h, policy.PLATFORM_DOMAINS) & ~h.rlike(shared), h))


def fingerprint(c: Column) -> Column:
    """source:id of a profile URL on one of the platforms."""
    def known(url: Column) -> Column:
        parts = F.struct(host(url).alias("h"), F.filter(F.split(F.regexp_extract(url, URL, 3), "/"), lambda p: p != "").alias("path"), F.regexp_extract(F.regexp_extract(url, URL, 4), "(?:^|&)id=([^&]*)", 1).alias("of"))
        return let(parts, by_host)

    def by_host(x: Column) -> Column:
        h, path, of = x["h"], x["path"], x["of"]
        n, first, second = F.size(path), F.lower(F.get(path, 0)), F.get(path, 1)
        return (
            F.when((h == "github.com") & (n == 1), F.concat(F.lit("github:"), first))
            .when((h == "dev.to") & (n == 1), F.concat(F.lit("devto:"), first))
            .when((h == "stackoverflow.com") & (first == "users") & second.rlike("^[0-9]+$"), F.concat(F.lit("stackoverflow:"), F.regexp_replace(second, "^0+(?=[0-9])", "")))
            .when((h == "news.ycombinator.com") & (of != ""), F.concat(F.lit("hackernews:"), F.lower(of)))
            .when((h == "hn.algolia.com") & (first == "user") & (n >= 2), F.concat(F.lit("hackernews:"), F.lower(second)))
        )

    return let(normalize_url(c), known)


EXTRACT_URL = r"(?:https?://)?(?:[A-Za-z0-9-]+[.])+[A-Za-z]{2,}(?:/[^\s<>\"]*)?"


def extract_urls(c: Column, limit: int = 10) -> Column:
    found = F.regexp_extract_all(clean(c), F.lit(EXTRACT_URL), F.lit(0))
    found = F.transform(found, lambda u: normalize_url(F.regexp_replace(u, r"[.,;:!?)\\\"\]}']+$", "")))
    return F.slice(first_seen(found), 1, limit)


def name_tokens(ascii_name: Column) -> Column:
    """Tokens of a name in ASCII (see fuzzy.ascii_fold), without titles."""
    return F.filter(F.regexp_extract_all(F.lower(ascii_name), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~one_of(t, policy.NAME_TITLES))


def normalize_name(ascii_name: Column) -> Column:
    """name_tokens() with blanks between, null if there is none."""
    titles = "(?<![a-z0-9])(?:" + "|".join(policy.NAME_TITLES) + ")(?![a-z0-9])"
    return blank_to_null(F.trim(F.regexp_replace(F.regexp_replace(F.lower(ascii_name), titles, " "), "[^a-z0-9]+", " ")))


def names_exact(left: Column, right: Column) -> Column:
    return F.coalesce(left == right, F.lit(False))


def names_partial(left: Column, right: Column) -> Column:
    """Two meaningful tokens shared by normalized names, or a long one if a name has no other."""
    def judged(x: Column) -> Column:
        one = (F.size(x["s"]) == 1) & (F.length(F.get(x["s"], 0)) >= 8) & ((x["a"] == 1) | (x["b"] == 1))
        return (F.size(x["s"]) >= 2) | one

    def shared(x: Column) -> Column:
        both = F.filter(F.array_intersect(x["a"], x["b"]), lambda t: (F.length(t) > 1) & ~one_of(t, policy.WEAK_NAMES))
        return F.struct(F.size(x["a"]).alias("a"), F.size(x["b"]).alias("b"), both.alias("s"))

    tokens = F.struct(F.array_distinct(F.split(left, " ")).alias("a"), F.array_distinct(F.split(right, " ")).alias("b"))
    return F.coalesce((left != right) & let(let(tokens, shared), judged), F.lit(False))


def normalize_handle(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.lower(F.regexp_replace(clean(c), "^@+", "")), "[^a-z0-9_-]+", ""))


def normalize_location(c: Column) -> Column:
    low = F.regexp_replace(F.regexp_replace(F.lower(clean(c)), "&", " and "), r"[^a-z0-9,\s-]+", " ")
    low = F.regexp_replace(F.regexp_replace(low, r"\s+", " "), "^[ ,]+|[ ,]+$", "")
    low = let(low, lambda x: F.coalesce(F.try_element_at(literal_map(policy.LOCATION_ALIASES), x), x))
    return let(low, lambda x: F.when((x != "") & ~one_of(x, policy.VAGUE_LOCATIONS), x))


def location_tokens(location: Column) -> Column:
    """Tokens of a normalize_location() value."""
    tokens = F.filter(F.split(location, r"[\s,/-]+"), lambda t: (t != "") & ~one_of(t, policy.VAGUE_LOCATIONS))
    return F.array_distinct(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(literal_map(policy.LOCATION_ALIASES), t), t)))


def bio_keyword(word: Column) -> Column:
    alias = lambda k: F.try_element_at(literal_map(policy.BIO_ALIASES), k)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(word), "^[._-]+|[._-]+$", ""), "_", "-"), "-{2,}", "-")
    def known(x: Column) -> Column:
        dotted = let(F.regexp_replace(x, "[.]", ""), lambda y: F.coalesce(alias(y), y))
        return F.coalesce(alias(x), F.when(x.contains("."), dotted).when(x.contains("-"), F.coalesce(alias(F.regexp_replace(x, "-", "")), x)).otherwise(x))

    return let(let(t, known), lambda x: F.when(x.rlike("[a-z0-9]") & ~one_of(x, policy.BIO_STOPWORDS) & ((F.length(x) >= 3) | one_of(x, policy.BIO_SHORT)), x))


def bio_keywords(ascii_text: Column) -> Column:
    def found(low: Column) -> Column:
        phrases = F.array(*[F.when(low.rlike(pattern), F.lit(word)) for pattern, word in policy.BIO_PHRASES.items()])
        words = F.transform(F.regexp_extract_all(low, F.lit("[a-zA-Z][a-zA-Z0-9+#.-]{1,30}"), F.lit(0)), bio_keyword)
        return F.array_distinct(F.filter(F.concat(phrases, words), lambda w: w.isNotNull()))

    return let(F.lower(ascii_text), found)


def topic_words(c: Column) -> Column:
    """Words of a text that may be topics, in order, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(strip_tags(c)), F.lit("[a-zA-Z][a-zA-Z0-9+#.-]{1,30}"), F.lit(0)), lambda w: ~one_of(w, policy.TOPIC_STOPWORDS))


def overlap(a: Column, b: Column, least: int = 2) -> Column:
    """Sorted intersection, empty below `least`."""
    both = F.array_intersect(a, b)
    return F.when(F.size(both) >= least, F.sort_array(both)).otherwise(F.array().cast("array<string>"))


def estimate_tokens(c: Column) -> Column:
    """Greater of 1.6 a word and a quarter of the characters, at least 1; 0 for no text."""
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    return F.when(F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(words * F.lit(16) / F.lit(10)).cast("int"), F.floor(F.length(c) / F.lit(4)).cast("int"))).cast("int")


# Claims that a summary must not make, with what they become, in the order of replacement.
CLAIMS = {
    "officially verified": "evidence-matched",
    "verified identity": "evidence-supported profile match",
    "verified account": "accepted public profile match",
    "verified owner": "accepted public profile match",
    "confirmed identity": "evidence-supported profile match",
    "confirmed account": "accepted public profile match",
    "confirmed owner": "accepted public profile match",
    "confirmed ownership": "accepted public profile match",
    "proven identity": "evidence-supported profile match",
    "proves identity": "suggests a profile match",
    "proved identity": "suggested a profile match",
    "guaranteed same person": "evidence-supported match",
    "definitely the same person": "appears to match",
    "certainly the same person": "appears to match",
    "owns these accounts": "is associated with the accepted public profile data",
    "owns the account": "is associated with the accepted public profile data",
    "account owner": "public profile match",
    "real owner": "public profile match",
    "verified": "evidence-matched",
}


def has_claim(c: Column) -> Column:
    """Whether a claim stands in the text as whole words."""
    return F.lower(c).rlike(r"(?U)(?<!\w)(" + "|".join(CLAIMS) + r")(?!\w)")


def soften_claims(c: Column) -> Column:
    return clean(reduce(lambda x, kv: F.regexp_replace(x, f"(?i){kv[0]}", kv[1]), CLAIMS.items(), c))


def redact_params(c: Column) -> Column:
    """A URL or path without the values of secret parameters."""
    return F.regexp_replace(c, "(?i)([?&](?:" + "|".join(policy.SECRET_PARAMS) + ")=)[^&#]*", "$1REDACTED")


def salvage_json(c: Column) -> Column:
    """The text if it is JSON, else what is from its first to its last brace if that is, else null."""
    inner = let(F.regexp_extract(c, r"(?s)\{.*\}", 0), lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x))
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(inner)


def html_escape(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}.items(), c)


def safe_message(c: Column) -> Column:
    """A failure's message, 300 characters of it at most; one that may tell secrets is replaced."""
    return let(F.trim(c), lambda m: F.when(m.rlike(f"(?i){policy.SENSITIVE_MESSAGE}"), "Message left out: it might hold private data.").otherwise(F.substring(m, 1, 300)))
