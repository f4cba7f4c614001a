"""Candidate identifiers of a request: those that it names, else variants of its name, ranked and capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy
from ..functions import fuzzy, text


def from_url(source: Column, url: Column) -> Column:
    """The identifier that a profile URL of the source holds; null for other pages and hosts."""

    def parts(u: Column) -> Column:
        return F.struct(text.host(u).alias("h"), F.filter(F.split(F.regexp_extract(u, text.URL, 3), "/"), lambda p: p != "").alias("path"), F.regexp_extract(F.regexp_extract(u, text.URL, 4), "(?:^|&)id=([^&]*)", 1).alias("of"))

    def named(x: Column) -> Column:
        first, second, n = F.get(x["path"], 0), F.get(x["path"], 1), F.size(x["path"])
        own = lambda s, h: (source == s) & (x["h"] == h) & (n == 1) & ~F.lower(first).isin(*policy.RESERVED_PATHS[s])
        return (
            F.when(own("github", "github.com") | own("devto", "dev.to"), first)
            .when((source == "hackernews") & (x["h"] == "news.ycombinator.com") & (x["of"] != ""), x["of"])
            .when((source == "hackernews") & (x["h"] == "hn.algolia.com") & (F.lower(first) == "user") & (n >= 2), second)
            .when((source == "stackoverflow") & (x["h"] == "stackoverflow.com") & (F.lower(first) == "users") & second.rlike("^[0-9]+$"), second)
        )

    return text.let(text.let(text.with_scheme(url), parts), named)


def identifier(source: Column, raw: Column) -> Column:
    """What a request's field names: a profile URL's identifier or the value itself, without @ and leading zeros of numbers, if valid."""
    is_url = raw.rlike("(?i)^https?://|//|(github[.]com|dev[.]to|stackoverflow[.]com|news[.]ycombinator[.]com|hn[.]algolia[.]com)/")
    value = text.blank_to_null(F.regexp_replace(F.trim(F.when(is_url, from_url(source, raw)).otherwise(raw)), "^@+", ""))

    def valid(x: Column) -> Column:
        told = None
        for s, pattern in policy.IDENTIFIER_PATTERNS.items():
            test = (source == s) & x.rlike(pattern)
            out = F.regexp_replace(x, "^0+(?=[0-9])", "") if s == "stackoverflow" else x
            told = F.when(test, out) if told is None else told.when(test, out)
        return told

    return text.let(value, valid)


#: Hosts that make a value of a request's field a URL.
HOSTS = {"github": ("github.com",), "devto": ("dev.to",), "hackernews": ("news.ycombinator.com", "hn.algolia.com")}


def requested(source: str, raw: Column) -> Column:
    """What a request's field says for comparison with accounts: a profile URL's identifier, else the value itself, in lower case; null for other pages."""

    def told(x: Column) -> Column:
        page = F.lower(from_url(F.lit(source), x))
        if source == "stackoverflow":
            return F.regexp_replace(F.when(x.rlike("^[0-9]+$"), x).otherwise(page), "^0+(?=[0-9])", "")
        is_url = x.contains("://")
        for h in HOSTS[source]:
            is_url = is_url | F.lower(x).contains(h)
        return F.when(is_url, page).otherwise(F.lower(x))

    return text.let(text.blank_to_null(F.regexp_replace(F.trim(raw), "^@+", "")), told)


def direct(requests: DataFrame) -> DataFrame:
    """(run_id, source, identifier, rank) of identifiers that requests name, valid ones only."""
    order = ("github", "devto", "hackernews", "stackoverflow")
    args = ", ".join(f"'{s}', {s}" for s in order)
    rows = requests.select("run_id", F.expr(f"stack({len(order)}, {args}) AS (source, raw)"))
    return rows.select("run_id", "source", identifier(F.col("source"), F.col("raw")).alias("identifier"), F.lit(100).alias("rank")).filter("identifier IS NOT NULL")


def variants(requests: DataFrame) -> DataFrame:
    """(run_id, at, variant): handles that a name of up to four tokens suggests, in order."""
    def told(t):
        first, last = F.get(t, 0), F.get(t, F.size(t) - 1)
        initial = lambda c: F.substring(c, 1, 1)
        whole = F.array(F.array_join(t, ""), F.array_join(t, "-"), F.array_join(t, "_"))
        more = F.array(F.concat(first, last), F.concat(initial(first), last), F.concat(first, initial(last)))
        return F.array_distinct(F.when(F.size(t) >= 2, F.concat(whole, more)).when(F.size(t) == 1, F.array(first)).otherwise(F.array().cast("array<string>")))

    tokens = F.slice(text.name_tokens(fuzzy.ascii_fold(F.col("name"))), 1, 4)
    return requests.select("run_id", F.posexplode(text.let(tokens, told)).alias("at", "variant"))


#: Rank of a name's first variant, what each further one loses, the least rank, and how many there are.
RANKS = {"github": (60, 5, 40, 99), "devto": (55, 5, 35, 99), "hackernews": (35, 5, 25, 2)}


def from_names(requests: DataFrame) -> DataFrame:
    v = variants(requests)
    parts = [v.filter(F.col("at") < most).select("run_id", F.lit(s).alias("source"), F.col("variant").alias("identifier"), F.greatest(F.lit(low), F.lit(top) - step * F.col("at")).alias("rank")) for s, (top, step, low, most) in RANKS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def discover(requests: DataFrame, limits: policy.Policy = policy.DEFAULT) -> DataFrame:
    """(run_id, source, identifier, rank, place): names only stand in where a request has no identifier."""
    own = direct(requests)
    rest = requests.join(own.select("run_id").distinct(), "run_id", "left_anti")
    every = own.unionByName(from_names(rest))
    once = Window.partitionBy("run_id", "source", F.lower("identifier")).orderBy(F.desc("rank"), "identifier")
    best = Window.partitionBy("run_id", "source").orderBy(F.desc("rank"), "identifier")
    all_ = Window.partitionBy("run_id").orderBy(F.desc("rank"), "source", "identifier")
    out = every.withColumn("n", F.row_number().over(once)).filter("n = 1").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= limits.per_source)
    return out.withColumn("place", F.row_number().over(all_)).filter(F.col("place") <= limits.per_request).drop("n")
