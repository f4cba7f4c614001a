"""What the platforms answered for one candidate, as one JSON document, to raw records: a row for each part, with its payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each platform the parts of its bundle: record type, payload where the part is missing, and URL of the request ({} is the account's name there).
PARTS = {
    "github": (("profile", "{}", "https://api.github.com/users/{}"), ("repos", "[]", "https://api.github.com/users/{}/repos?per_page=30&sort=updated&direction=desc")),
    "stackoverflow": (
        ("user", '{"items":[]}', "https://api.stackexchange.com/2.3/users/{}?site=stackoverflow"),
        ("answers", '{"items":[]}', "https://api.stackexchange.com/2.3/users/{}/answers?site=stackoverflow&pagesize=20&sort=votes"),
        ("questions", '{"items":[]}', "https://api.stackexchange.com/2.3/users/{}/questions?site=stackoverflow&pagesize=20&sort=votes"),
    ),
    "devto": (("user", "{}", "https://dev.to/api/users/by_username?url={}"), ("articles", "[]", "https://dev.to/api/articles?username={}&per_page=30")),
    "hackernews": (("user", "{}", "https://hn.algolia.com/api/v1/users/{}"), ("activity", '{"hits":[]}', "https://hn.algolia.com/api/v1/search_by_date?tags=author_{}&hitsPerPage=30")),
}


def raw_records(bundles: DataFrame) -> DataFrame:
    """Raw records (id, run_id, source, record_type, user_id, handle, request_url, profile_url, payload, http_status, fetched_at) of bundles
    (id, run_id, source, identifier, bundle, fetched_at). Bundles that aren't JSON have empty payloads; unknown platforms give no record."""
    told = bundles.withColumn("v", F.try_parse_json("bundle"))
    text = lambda path: F.try_variant_get("v", path, "string")
    by = lambda **of: F.coalesce(*[F.when(F.col("source") == s, c) for s, c in of.items()])
    named = F.coalesce(by(github=text("$.profile.login"), devto=text("$.user.username"), hackernews=text("$.user.username")), "identifier")
    told = told.withColumn("named", named)
    n = F.col("named")
    shown = F.coalesce(by(github=text("$.profile.html_url"), stackoverflow=text("$.user.items[0].link")), by(github=F.concat(F.lit("https://github.com/"), n), stackoverflow=F.concat(F.lit("https://stackoverflow.com/users/"), n), devto=F.concat(F.lit("https://dev.to/"), n), hackernews=F.concat(F.lit("https://news.ycombinator.com/user?id="), n)))

    def part(k: int, kind: str, empty: str, url: str) -> Column:
        before, after = url.split("{}")
        payload = F.coalesce(F.to_json(F.try_variant_get("v", f"$.{kind}", "variant")), F.lit(empty))
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("record_type"), F.concat(F.lit(before), n, F.lit(after)).alias("request_url"), F.when(payload == "null", empty).otherwise(payload).alias("payload"))

    parts = by(**{s: F.array(*[part(k, *p) for k, p in enumerate(of)]) for s, of in PARTS.items()})
    user = by(github=text("$.profile.id"), stackoverflow=F.col("identifier"), devto=text("$.user.id"), hackernews=n)
    handle = F.when(F.col("source") == "stackoverflow", text("$.user.items[0].display_name")).otherwise(n)
    each = told.select("id", "run_id", "source", user.alias("user_id"), handle.alias("handle"), shown.alias("profile_url"), "fetched_at", F.inline(parts))
    return each.select((F.col("id") * 4 + F.col("k")).alias("id"), "run_id", "source", "record_type", "user_id", "handle", "request_url", "profile_url", "payload", F.lit(200).alias("http_status"), "fetched_at")
