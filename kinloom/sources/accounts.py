"""Raw API payloads to accounts: a registry of one normalizer a platform, over records grouped by account."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import policy
from ..functions import fuzzy, text

GITHUB = "struct<id:bigint,login:string,name:string,bio:string,location:string,company:string,blog:string,html_url:string,avatar_url:string,public_repos:int,followers:int,following:int>"
REPOS = "array<struct<name:string,full_name:string,html_url:string,homepage:string,language:string,stargazers_count:int,fork:boolean,updated_at:string,topics:array<string>>>"
STACK = "struct<items:array<struct<user_id:bigint,display_name:string,link:string,location:string,website_url:string,profile_image:string,reputation:int,badge_counts:map<string,int>,tags:array<string>>>>"
DEVTO = "struct<id:bigint,username:string,name:string,summary:string,location:string,website_url:string,url:string,profile_image:string,profile_image_90:string,github_username:string,twitter_username:string>"
#: Tags come as a list or as one text with commas.
ARTICLES = "array<struct<title:string,url:string,canonical_url:string,published_at:string,positive_reactions_count:int,comments_count:int,tag_list:variant,tags:variant>>"
HN = "struct<username:string,about:string,karma:int,created_at:string>"
HITS = "struct<hits:array<struct<objectID:string,title:string,story_title:string,url:string,created_at:string,points:int,_tags:array<string>>>>"
COLUMNS = ("source", "user_id", "handle", "display_name", "bio", "location", "website_url", "profile_url", "avatar_url", "topics", "outbound_links", "activity_payload", "raw_record_ids")


def runs_of(rows: DataFrame) -> list[str]:
    """The columns that tell apart requests, whose accounts are never put together: run_id, if the rows have it."""
    return [c for c in rows.columns if c == "run_id"]


def grouped(raw: DataFrame) -> DataFrame:
    """Raw records with their account's group within their run: the user id, else the id of the handle's other records, else the handle, else the record."""
    run = runs_of(raw)
    both = raw.filter("user_id IS NOT NULL AND handle IS NOT NULL").groupBy(*[F.col(c).alias(f"of_{c}") for c in run], F.col("source").alias("s"), F.lower("handle").alias("low")).agg(F.max_by("user_id", F.struct("fetched_at", "id")).alias("alias"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in run]
    r = raw.withColumn("low_handle", F.lower("handle")).join(both, [F.col("source") == F.col("s"), F.col("low_handle") == F.col("low"), *same], "left")
    key = F.coalesce(F.concat(F.lit("id:"), F.coalesce("user_id", "alias")), F.concat(F.lit("handle:"), F.col("low_handle")), F.concat(F.lit("raw:"), F.col("id").cast("string")))
    return r.withColumn("account_group", key).drop("s", "low", "low_handle", "alias", *[f"of_{c}" for c in run])


def latest(raw: DataFrame) -> DataFrame:
    """(run_id if raw has it, source, account_group, payloads, raw_record_ids): the last payload of each record type, and the ids of all records."""
    run = runs_of(raw)
    each = grouped(raw).groupBy(*run, "source", "account_group", "record_type").agg(F.max_by("payload", F.struct("fetched_at", "id")).alias("payload"), F.collect_list("id").alias("ids"))
    return each.groupBy(*run, "source", "account_group").agg(F.map_from_entries(F.collect_list(F.struct("record_type", "payload"))).alias("payloads"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("raw_record_ids"))


def _part(kind: str, ddl: str):
    return F.from_json(F.col("payloads")[kind], ddl)


def _links(*urls, limit: int = 20):
    lists = [F.coalesce(u, F.array().cast("array<string>")) for u in urls]
    return F.slice(text.first_seen(F.filter(F.concat(*lists), lambda u: u.isNotNull())), 1, limit)


def _topics(*lists, limit: int = 30):
    return F.slice(F.array_distinct(F.transform(F.filter(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda t: t.isNotNull()), F.lower)), 1, limit)


NO_TEXTS = "array<string>"


def _flat(rows, of):
    """The lists that of() gives for the rows, one after another."""
    return F.flatten(F.transform(rows, lambda x: F.coalesce(of(x), F.array().cast(NO_TEXTS))))


def _activity(**parts):
    """What an account does, as JSON without nulls."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])).alias("activity_payload")


def github(p: DataFrame) -> DataFrame:
    u, r = F.col("u"), F.col("r")
    p = p.withColumns({"u": _part("profile", GITHUB), "r": F.coalesce(_part("repos", REPOS), F.array().cast(REPOS))}).filter("u IS NOT NULL")
    links = _links(F.array(text.normalize_url(u["blog"])), F.transform(r["homepage"], text.normalize_url), text.extract_urls(u["bio"], 5))
    languages = F.transform(r, lambda x: x["language"])
    topics = _topics(languages, _flat(r, lambda x: x["topics"]))
    repo = lambda x: F.struct(text.clean(x["name"]).alias("name"), text.clean(x["full_name"]).alias("full_name"), x["html_url"].alias("html_url"), text.clean(x["language"]).alias("language"), x["stargazers_count"].alias("stars"), x["fork"].alias("fork"), x["updated_at"].alias("updated_at"))
    starred = F.transform(F.slice(F.array_sort(F.transform(r, lambda x, i: F.struct((-F.coalesce(x["stargazers_count"], F.lit(0))).alias("o"), i.alias("i"), repo(x).alias("row")))), 1, 10), lambda s: s["row"])
    done = _activity(public_repos=u["public_repos"], followers=u["followers"], following=u["following"], top_languages=text.top_values(languages), repo_count_fetched=F.size(r), top_repositories=starred)
    return p.select(*runs_of(p), F.lit("github").alias("source"), u["id"].cast("string").alias("user_id"), u["login"].alias("handle"), F.coalesce(text.clean(u["name"]), u["login"]).alias("display_name"), text.clean(u["bio"]).alias("bio"), text.clean(u["location"]).alias("location"), text.normalize_url(u["blog"]).alias("website_url"), text.normalize_url(F.coalesce(u["html_url"], F.concat(F.lit("https://github.com/"), u["login"]))).alias("profile_url"), u["avatar_url"].alias("avatar_url"), topics.alias("topics"), links.alias("outbound_links"), done, "raw_record_ids")


def stackoverflow(p: DataFrame) -> DataFrame:
    items = lambda kind: F.coalesce(_part(kind, STACK)["items"], F.array().cast(STACK[13:-1]))
    p = p.withColumns({"u": F.get(items("user"), 0), "q": items("questions"), "a": items("answers")}).filter("u IS NOT NULL")
    u = F.col("u")
    asked, answered = (_flat(F.col(c), lambda x: x["tags"]) for c in "qa")
    name = text.clean(fuzzy.html_unescape(u["display_name"]))
    done = _activity(reputation=u["reputation"], badge_counts=u["badge_counts"], answers_count_fetched=F.size("a"), questions_count_fetched=F.size("q"), top_question_tags=text.top_values(asked), top_answer_tags=text.top_values(answered))
    return p.select(*runs_of(p), F.lit("stackoverflow").alias("source"), u["user_id"].cast("string").alias("user_id"), name.alias("handle"), name.alias("display_name"), F.lit(None).cast("string").alias("bio"), text.clean(u["location"]).alias("location"), text.normalize_url(u["website_url"]).alias("website_url"), text.normalize_url(F.coalesce(u["link"], F.concat(F.lit("https://stackoverflow.com/users/"), u["user_id"].cast("string")))).alias("profile_url"), u["profile_image"].alias("avatar_url"), _topics(asked, answered).alias("topics"), _links(F.array(text.normalize_url(u["website_url"]))).alias("outbound_links"), done, "raw_record_ids")


def tags_of(v):
    """A VARIANT of tags as an array: a list as it is, a text cut at commas."""
    listed = F.try_variant_get(v, "$", NO_TEXTS)
    cut = F.filter(F.transform(F.split(F.try_variant_get(v, "$", "string"), ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(listed, cut, F.array().cast(NO_TEXTS))


def devto(p: DataFrame) -> DataFrame:
    p = p.withColumns({"u": _part("user", DEVTO), "r": F.coalesce(_part("articles", ARTICLES), F.array().cast(ARTICLES))}).filter("u IS NOT NULL")
    u, r = F.col("u"), F.col("r")
    p = p.withColumn("t", _flat(r, lambda x: F.concat(tags_of(x["tag_list"]), tags_of(x["tags"]))))
    own = F.when(u["github_username"] != "", F.concat(F.lit("https://github.com/"), u["github_username"]))
    links = _links(F.array(text.normalize_url(u["website_url"]), own), text.extract_urls(u["summary"], 5))
    article = lambda x: F.struct(text.clean(x["title"]).alias("title"), x["url"].alias("url"), x["canonical_url"].alias("canonical_url"), x["published_at"].alias("published_at"), x["positive_reactions_count"].alias("positive_reactions_count"), x["comments_count"].alias("comments_count"))
    linked = F.struct(text.clean(u["github_username"]).alias("github"), text.clean(u["twitter_username"]).alias("twitter"))
    done = _activity(articles_count_fetched=F.size(r), top_tags=text.top_values(F.col("t")), recent_articles=F.slice(F.transform(r, article), 1, 10), linked_usernames=linked)
    bio = text.clean(text.strip_tags(fuzzy.html_unescape(u["summary"])))
    return p.select(*runs_of(p), F.lit("devto").alias("source"), F.coalesce(u["id"].cast("string"), u["username"]).alias("user_id"), u["username"].alias("handle"), F.coalesce(text.clean(u["name"]), u["username"]).alias("display_name"), bio.alias("bio"), text.clean(u["location"]).alias("location"), text.normalize_url(u["website_url"]).alias("website_url"), text.normalize_url(F.coalesce(u["url"], F.concat(F.lit("https://dev.to/"), u["username"]))).alias("profile_url"), F.coalesce(u["profile_image"], u["profile_image_90"]).alias("avatar_url"), _topics(F.col("t")).alias("topics"), links.alias("outbound_links"), done, "raw_record_ids")


def hackernews(p: DataFrame) -> DataFrame:
    p = p.withColumns({"u": _part("user", HN), "h": F.coalesce(_part("activity", HITS)["hits"], F.array().cast(HITS[12:-1]))}).filter("u IS NOT NULL")
    u, h = F.col("u"), F.col("h")
    about = text.strip_tags(fuzzy.html_unescape(u["about"]))
    title = lambda x: F.coalesce(text.clean(x["title"]), text.clean(x["story_title"]))
    has = lambda x, tag: F.coalesce(F.array_contains(x["_tags"], tag), F.lit(False))
    counted = text.top_values(_flat(h, lambda x: text.topic_words(title(x))), 20)
    hit = lambda x: F.struct(x["objectID"].alias("object_id"), title(x).alias("title"), x["url"].alias("url"), x["created_at"].alias("created_at"), x["points"].alias("points"), F.when(has(x, "comment"), "comment").when(has(x, "story"), "story").alias("type"))
    n = lambda tag: F.size(F.filter(h, lambda x: has(x, tag)))
    done = _activity(karma=u["karma"], created_at=u["created_at"], activity_count_fetched=F.size(h), comments_count_fetched=n("comment"), stories_count_fetched=n("story"), recent_activity=F.slice(F.transform(h, hit), 1, 10), weak_identity_source=F.lit(True))
    return p.select(*runs_of(p), F.lit("hackernews").alias("source"), u["username"].alias("user_id"), u["username"].alias("handle"), u["username"].alias("display_name"), about.alias("bio"), F.lit(None).cast("string").alias("location"), F.get(text.extract_urls(about, 5), 0).alias("website_url"), F.concat(F.lit("https://news.ycombinator.com/user?id="), u["username"]).alias("profile_url"), F.lit(None).cast("string").alias("avatar_url"), counted.alias("topics"), text.extract_urls(about, 5).alias("outbound_links"), done, "raw_record_ids")


#: What makes accounts of a platform's payloads; further platforms are added here.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {"github": github, "stackoverflow": stackoverflow, "devto": devto, "hackernews": hackernews}


def normalize(raw: DataFrame) -> DataFrame:
    """Accounts of raw records (id, source, record_type, user_id, handle, payload, fetched_at); unknown sources and bad JSON give none. With a run_id,
    records are put together within a run only, and the accounts have it as well: an account that two requests ask for is one of each."""
    last, out = latest(raw), None
    for source, f in NORMALIZERS.items():
        part = f(last.filter(F.col("source") == source)).select(*runs_of(raw), *COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("account_key", text.account_key(F.col("source"), F.col("user_id"), F.col("handle")))


#: The record that an account of a platform can't do without, and the form of its payload.
PRIMARY = {"github": ("profile", GITHUB), "stackoverflow": ("user", STACK), "devto": ("user", DEVTO), "hackernews": ("user", HN)}


def warnings(raw: DataFrame) -> DataFrame:
    """(source, account_group, record_type, message): what normalize() leaves out or has to do without. Records of unknown sources are skipped;
    a group's primary record may be missing or no JSON object; if it is fine, the records that go with it may be missing."""
    known = F.col("source").isin(*PRIMARY)
    none = F.lit(None).cast("string")
    skipped = raw.filter(~F.coalesce(known, F.lit(False))).select("source", F.concat(F.lit("raw:"), F.col("id").cast("string")).alias("account_group"), "record_type", F.lit("Skipped: a record of an unknown platform.").alias("message"))
    told = raw.filter(known)
    alone = grouped(told).filter(F.col("account_group").startswith("raw:")).select("source", "account_group", "record_type", F.lit("Neither user id nor handle, so the record stands alone.").alias("message"))
    last = latest(told)
    valid = lambda s: F.get_json_object(F.col("payloads")[PRIMARY[s][0]], "$.items[0]" if s == "stackoverflow" else "$").startswith("{")
    fine = F.coalesce(*[F.when(F.col("source") == s, F.coalesce(valid(s), F.lit(False))) for s in PRIMARY])
    g = last.withColumn("fine", fine)
    broken = g.filter("NOT fine").select("source", "account_group", none.alias("record_type"), F.lit("No account: its main record is missing or broken.").alias("message"))
    needs = F.coalesce(*[F.when(F.col("source") == s, F.array(*map(F.lit, kinds))) for s, kinds in policy.SECONDARY_RECORDS.items()])
    lacks = g.filter("fine").select("source", "account_group", F.explode(F.array_except(needs, F.map_keys("payloads"))).alias("record_type"))
    lacks = lacks.withColumn("message", F.concat(F.lit("Made without the record "), "record_type"))
    return skipped.unionByName(alone).unionByName(broken).unionByName(lacks)


def keep_latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert as a rewrite: the last row of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("n", n).filter("n = 1").drop("n")
