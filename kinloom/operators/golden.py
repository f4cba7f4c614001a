"""Links between profiles and accounts, and golden records: the value of each field that survives, with its provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import policy
from ..functions import text
from .resolve import SCORE, dec

# Fixed values.
SKILL_LABELS = {
    "ai": "AI", "api": "API", "apis": "APIs", "fastapi": "FastAPI", "javascript": "JavaScript", "typescript": "TypeScript", "postgresql": "PostgreSQL",
    "postgres": "PostgreSQL", "supabase": "Supabase", "python": "Python", "react": "React", "nextjs": "Next.js", "next.js": "Next.js", "nodejs": "Node.js",
    "node.js": "Node.js", "llm": "LLM", "llms": "LLMs", "nlp": "NLP", "ml": "ML", "fast-api": "FastAPI", "hacker-news": "Hacker News",
}
TECH_WORDS = ("python", "fastapi", "ai", "backend", "data", "open source")


def rank_of(c: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), c), F.lit(0))


def links(decided: DataFrame) -> DataFrame:
    """A link row for each decision."""
    d = F.col("decision")
    relation = F.when(d == "reject", "rejected").when(d == "needs_review", "possible_alias").when(F.col("is_anchor"), "primary").otherwise("secondary")
    verified = F.when(d == "reject", "rejected").when(d == "needs_review", "needs_review").when(F.col("is_anchor"), "claimed_by_input").otherwise("likely_same_person")
    return decided.select(
        "run_id", "account_key", "source", "decision", relation.alias("relationship"), verified.alias("verification"), F.col("decision_confidence").cast("decimal(5,4)").alias("confidence"), "evidence_confidence",
        F.size("groups").alias("n_positive"), F.size("conflict_types").alias("n_negative"), (F.size("blocking_types") > 0).alias("has_high_conflict"),
    )


#: Rules that a link must meet.
LINK_RULES = {
    "reject_not_rejected": "decision = 'reject' AND (relationship <> 'rejected' OR verification <> 'rejected')",
    "review_not_alias": "decision = 'needs_review' AND (relationship <> 'possible_alias' OR verification <> 'needs_review')",
    "auto_low_confidence": "decision = 'auto_match' AND confidence < 0.85",
    "auto_high_conflict": "decision = 'auto_match' AND has_high_conflict",
    "auto_few_signals": "decision = 'auto_match' AND verification <> 'claimed_by_input' AND n_positive < 2",
    "confidence_range": "confidence < 0 OR confidence > 1",
}


def violations(df: DataFrame, rules: dict[str, str], *keys: str) -> DataFrame:
    """A row for each broken rule: keys and rule."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return df.select(*keys, F.explode(found).alias("rule"))


def _listed(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;]"), lambda t: F.trim(t)), lambda t: t != "")


def skill_terms(accounts: DataFrame) -> Column:
    """Raw skill terms of an account: its fields of skills, which may be lists, maps (their keys) or texts listing them, and those keys of its activity_payload (JSON)."""
    types, parts = dict(accounts.dtypes), []
    for name in (n for n in policy.SKILL_FIELDS if n in types):
        c = F.col(name)
        parts.append(_listed(c) if types[name] == "string" else F.map_keys(c) if types[name].startswith("map") else c)
    if "activity_payload" in types:
        for key in policy.SKILL_KEYS:
            v = F.get_json_object("activity_payload", f"$.{key}")
            parts.append(text.let(v, lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.startswith("{"), F.json_object_keys(x)).otherwise(_listed(x))))
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.filter(F.coalesce(p, none), lambda t: t != "") for p in parts])


def bundles(linked: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accepted links with their accounts, the confidence of fields, and the rank that settles all ties."""
    own = accounts.select("run_id", "account_key", "handle", "display_name", "location", "website_url", "bio", "topics", "profile_url", skill_terms(accounts).alias("terms"))
    b = linked.filter("decision = 'auto_match'").join(own, ["run_id", "account_key"])
    b = b.withColumns({"field_confidence": F.when(F.col("evidence_confidence") > 0, F.col("evidence_confidence")).otherwise(F.col("confidence")).cast(SCORE), "relation_rank": rank_of(F.col("relationship"), policy.RELATIONSHIP_PRIORITY), "source_rank": rank_of(F.col("source"), policy.SOURCE_PRIORITY)})
    order = Window.partitionBy("run_id").orderBy(F.desc("field_confidence"), F.desc("source_rank"), "account_key")
    return b.withColumn("bundle_rank", F.row_number().over(order))


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def handle_like(name: Column, handle: Column) -> Column:
    short = ~name.contains(" ") & (F.length(name) <= 16) & (name.rlike("[0-9]") | ((F.lower(name) == name) & (F.upper(name) != name)))
    return (name_key(name) == "") | F.coalesce((handle != "") & (name_key(name) == name_key(handle)), F.lit(False)) | short


def _first(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("first_n", F.row_number().over(Window.partitionBy("run_id").orderBy(*order, F.asc("bundle_rank")))).filter("first_n = 1").drop("first_n")


def _sure(name: str) -> Column:
    """The selected row's confidence, as that of the field."""
    return F.least(dec("0.97"), "field_confidence").cast(SCORE).alias(f"{name}_confidence")


def _best_group(df: DataFrame, key: str, *order) -> DataFrame:
    """Rows of each run's best group: order takes the group's aggregates as columns n, conf, rel, prio_g and len. Windows within a run, so that what is
    dealt by run stays where it is; a group's first bundle_rank is its own, so just its rows come first."""
    own = Window.partitionBy("run_id", key)
    g = {"n": F.count(F.lit(1)), "conf": F.max("field_confidence"), "rel": F.max("relation_rank"), "prio_g": F.max("prio"), "len": F.max(F.length("value")), "first_rank": F.min("bundle_rank")}
    ranked = df.withColumns({name: x.over(own) for name, x in g.items()}).withColumn("at", F.rank().over(Window.partitionBy("run_id").orderBy(*order, F.asc("first_rank"))))
    return ranked.filter("at = 1").drop("at", "rel", "prio_g", "len", "first_rank")


def display_name(b: DataFrame) -> DataFrame:
    """(run_id, display_name, name_strategy, name_confidence): the real name most accounts have, else the best handle."""
    named = b.withColumns({"value": text.clean(F.col("display_name")), "prio": rank_of(F.col("source"), policy.NAME_PRIORITY)}).filter("value IS NOT NULL")
    named = named.filter(~handle_like(F.col("value"), F.coalesce("handle", F.lit("")))).withColumn("name_key", name_key(F.col("value")))
    best = _best_group(named, "name_key", F.desc("n"), F.desc("conf"), F.desc("rel"), F.desc("prio_g"), F.desc("len"), F.asc("name_key"))
    best = _first(best, F.desc(F.length("value")), F.desc("field_confidence"), F.desc("relation_rank"), F.desc("prio"), F.asc(F.lower("value")))
    real = best.select("run_id", F.col("value").alias("real"), F.when(F.col("n") > 1, "repeated_real_name").otherwise("best_real_name_by_source_priority").alias("how"), F.least(dec("0.97"), "conf").alias("sure"))
    many = F.count(F.lit(1)).over(Window.partitionBy("run_id", F.lower("handle")))
    handles = _first(b.filter("handle IS NOT NULL AND handle <> ''").withColumn("many", many), F.desc("many"), F.desc("relation_rank"), F.desc("source_rank"), F.desc("field_confidence"), F.desc(F.length("handle")), F.asc(F.lower("handle")))
    handles = handles.select("run_id", "handle", F.least(dec("0.50"), "field_confidence").alias("handle_sure"))
    out = b.select("run_id").distinct().join(real, "run_id", "left").join(handles, "run_id", "left")
    return out.select("run_id", F.coalesce("real", "handle").alias("display_name"), F.coalesce("how", F.lit("fallback_best_handle")).alias("name_strategy"), F.coalesce("sure", "handle_sure", dec(0)).cast(SCORE).alias("name_confidence"))


def location(b: DataFrame) -> DataFrame:
    key = F.regexp_replace(F.trim(F.regexp_replace(F.replace(F.lower("value"), F.lit("."), F.lit("")), ",", " ")), r"\s+", " ")
    placed = b.withColumns({"value": text.clean(F.col("location")), "prio": F.col("source_rank")}).filter("value IS NOT NULL").withColumn("place_key", key)
    best = _best_group(placed, "place_key", F.desc("n"), F.desc("conf"), F.desc("rel"), F.desc("prio_g"))
    return _first(best, F.desc("prio"), F.desc("relation_rank"), F.desc("field_confidence")).select("run_id", F.col("value").alias("location"), _sure("location"))


def website(b: DataFrame) -> DataFrame:
    """The https form of the site that most accounts name; platforms don't count, shared hosts only if nothing else does."""
    cut = lambda n: F.regexp_extract("whole", r"^https?://([^/?#]*)([^?#]*)", n)
    v = b.withColumn("whole", text.let(text.clean(F.col("website_url")), lambda u: F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u)))).filter("whole IS NOT NULL")
    v = v.withColumn("domain", F.regexp_replace(F.lower(cut(1)), "^www[.]", "")).withColumn("value", F.concat(F.lit("https://"), "domain", F.regexp_replace(cut(2), "/+$", "")))
    suffix = lambda names: F.col("domain").rlike("(^|[.])(" + "|".join(n.replace(".", "[.]") for n in names) + ")$")
    v = v.withColumns({"prio": F.col("source_rank"), "generic": suffix((*policy.SHARED_DOMAINS, "carrd.co"))}).filter((F.col("domain") != "") & ~suffix(policy.PLATFORM_DOMAINS))
    fine = F.min("generic").over(Window.partitionBy("run_id"))
    v = v.withColumn("any_fine", fine).filter("generic = any_fine")
    best = _best_group(v, "domain", F.desc("n"), F.desc("conf"), F.desc("rel"), F.desc("prio_g"))
    return _first(best, F.desc("prio"), F.desc("relation_rank"), F.desc("field_confidence")).select("run_id", F.col("value").alias("website"), _sure("website"))


def avatar(b: DataFrame, accounts: DataFrame) -> DataFrame:
    """The picture of the best source."""
    v = b.join(accounts.select("run_id", "account_key", "avatar_url"), ["run_id", "account_key"]).filter("avatar_url IS NOT NULL").withColumn("prio", rank_of(F.col("source"), policy.AVATAR_PRIORITY))
    return _first(v, F.desc("prio"), F.desc("relation_rank"), F.desc("field_confidence")).select("run_id", "avatar_url", _sure("avatar"))


def facts(b: DataFrame) -> DataFrame:
    """(run_id, account_key, fact, value, confidence): what accepted accounts say, each value once."""
    pairs = [F.struct(F.lit(n).alias("fact"), F.col(n).alias("value")) for n in ("display_name", "location", "website_url", "bio")]
    each = F.concat(F.array(*pairs), F.transform("topics", lambda t: F.struct(F.lit("topic").alias("fact"), t.alias("value"))))
    rows = b.select("run_id", "account_key", F.col("field_confidence").alias("confidence"), F.inline(each)).filter("value IS NOT NULL")
    return rows.groupBy("run_id", "account_key", "fact", "value").agg(F.max("confidence").alias("confidence"))


def bio_quality(c: Column) -> Column:
    size = F.when(F.length(c).between(30, 220), 30).when(F.length(c) > 220, 20).otherwise(10)
    tech = reduce(lambda a, w: a | F.lower(c).contains(w), TECH_WORDS[1:], F.lower(c).contains(TECH_WORDS[0]))
    return size + F.when(tech, 20).otherwise(0) + F.when(c.rlike("[.,]"), 10).otherwise(0)


def bio(b: DataFrame) -> DataFrame:
    v = b.withColumns({"value": text.clean(F.col("bio")), "prio": rank_of(F.col("source"), policy.BIO_PRIORITY)})
    v = v.filter((F.length("value") >= 18) & ~F.lower("value").isin(*policy.GENERIC_BIOS) & (F.size(F.array_distinct(F.split(F.lower("value"), " "))) > 2)).withColumn("quality", bio_quality(F.col("value")))
    return _first(v, F.desc("quality"), F.desc("relation_rank"), F.desc("prio"), F.desc("field_confidence"), F.desc(F.length("value"))).select("run_id", F.col("value").alias("bio"), _sure("bio"))


def weak_headline(c: Column) -> Column:
    """Greetings and bare trades say nothing."""
    said = F.regexp_replace(F.regexp_replace(F.lower(c), "^[ ,.!?]+|[ ,.!?]+$", ""), r"(?U)\s+", " ")
    tail = lambda x: F.regexp_replace(x, "^[^ ]+ ", "")
    greeted = lambda x: x.rlike("^(hi|hello)[ ,]") & x.contains(" ") & (tail(x).isin(*policy.WEAK_HEADLINES) | tail(x).rlike("^i('m| am) a developer"))
    return text.let(said, lambda x: (x == "") | x.isin(*policy.WEAK_HEADLINES) | greeted(x) | x.rlike("^welcome( to|!)"))


def headline(c: Column) -> Column:
    """A first sentence of 12 to 120 characters, else a short text as it is, else its first 117 characters and an ellipsis; null where that is weak."""
    first, cut = F.trim(F.substring_index(c, ".", 1)), F.concat(F.rtrim(F.substring(c, 1, 117)), F.lit("..."))
    none = F.lit(None).cast("string")
    short = (F.length(c) <= 120) & ~weak_headline(c)
    return F.when(weak_headline(first), none).when(F.length(first).between(12, 120), first).when(short, c).when(~weak_headline(cut), cut)


def skill_key(c: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[_ ]", "-"), r"[^\p{L}\p{N}.#+-]", ""), "^[-.]+|[-.]+$", "")
    return text.let(cut, lambda x: F.when(F.length(x) >= 2, x))


def skill_label(c: Column) -> Column:
    return F.coalesce(F.try_element_at(text.literal_map(SKILL_LABELS), c), F.when(c.contains("-"), F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1000)))))


def skills(b: DataFrame, limit: int = 30) -> DataFrame:
    """(run_id, skill, weight, n_sources, skill_rank): terms by the sum of 1 + priority / 100 over accounts."""
    each = b.select("run_id", "account_key", "source_rank", F.explode("terms").alias("t")).withColumn("term", skill_key(F.col("t"))).filter(~F.col("term").isin(*policy.GENERIC_SKILLS))
    g = each.groupBy("run_id", "term").agg(F.sum((F.lit(100) + F.col("source_rank")).cast("long")).alias("points"), F.count_distinct("account_key").alias("n_sources"))
    order = Window.partitionBy("run_id").orderBy(F.desc("points"), F.desc("n_sources"), "term")
    return g.withColumn("skill_rank", F.row_number().over(order)).filter(F.col("skill_rank") <= limit).select("run_id", skill_label(F.col("term")).alias("skill"), (F.col("points") / 100).alias("weight"), "n_sources", "skill_rank")


def profiles(linked: DataFrame, accounts: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """A golden record for each run; runs without an accepted account have null fields and level `uncertain`. b: their bundles(), if they are at hand."""
    b = bundles(linked, accounts) if b is None else b
    top = skills(b).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("skill_rank", "skill"))), lambda s: s["skill"]), ", ").alias("skills"))
    per_run = b.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_accounts"), F.max("confidence").alias("top_link"), F.max("evidence_confidence").alias("top_evidence"), F.max("field_confidence").alias("top_field"))
    out = linked.select("run_id").distinct().join(per_run, "run_id", "left")
    for part in (display_name(b), location(b), website(b), bio(b), top, *([avatar(b, accounts)] if "avatar_url" in accounts.columns else [])):
        out = out.join(part, "run_id", "left")
    from_bio = headline(F.col("bio"))
    out = out.withColumn("skills_confidence", F.when(F.col("skills").isNotNull(), F.least(dec("0.97"), "top_field")))
    out = out.withColumn("headline_confidence", F.when(from_bio.isNotNull(), F.col("bio_confidence")).otherwise(F.col("skills_confidence")))
    told = [c for c in out.columns if c.endswith("_confidence")]
    fields = reduce(lambda x, y: x + y, (F.when(F.col(c) >= dec("0.75"), 1).otherwise(0) for c in told))
    high = (F.col("n_accounts") >= 2) & (F.col("top_link") >= dec("0.85")) & (F.col("top_evidence") >= dec("0.60")) & (fields >= 2)
    level = F.when(F.col("n_accounts").isNull(), "uncertain").when(high, "high").otherwise("medium")
    focus = F.concat(F.lit("Developer focused on "), F.array_join(F.slice(F.split("skills", ", "), 1, 3), ", "))
    return out.select("run_id", "display_name", "name_strategy", "location", "website", "bio", F.coalesce(headline(F.col("bio")), focus).alias("headline"), "skills", F.coalesce("n_accounts", F.lit(0)).alias("n_accounts"), level.alias("level"))


def fallback_summary(profile: DataFrame) -> DataFrame:
    """A summary from the record alone."""
    name = F.coalesce("display_name", F.lit("This profile"))
    return profile.select("run_id", F.when(F.col("n_accounts") == 0, "No account could be accepted.").otherwise(F.concat(name, F.lit(" has "), F.col("n_accounts").cast("string"), F.lit(" accepted public accounts"), F.when(F.col("skills").isNotNull(), F.concat(F.lit(" with "), F.array_join(F.slice(F.split("skills", ", "), 1, 3), ", "))).otherwise(""), F.lit("."))).alias("summary"))


def evidence_of_links(linked: DataFrame, ev: DataFrame) -> DataFrame:
    """Evidence rows of accounts that have a link, with the link's relationship, both platforms and the field that is told of."""
    own = linked.select("run_id", "account_key", "relationship", F.col("source").alias("source_a"))
    other = F.substring_index("other_key", ":", 1)
    return ev.join(own, ["run_id", "account_key"]).select("run_id", "account_key", "other_key", "relationship", "signal", F.col("signal_group").alias("field_name"), "weight", "source_a", other.alias("source_b"), F.coalesce("value", "account_key").alias("value_a"))


def conflict_sides(cf: DataFrame, accounts: DataFrame) -> DataFrame:
    """Conflicts with `sides`: what each of the two accounts says, source and target."""
    basis = F.col("basis")
    said = {"name_conflict": F.col("n_name"), "website_conflict": F.col("n_domain"), "location_conflict": F.col("n_location"), "email_hash": F.col("email_hash"), "email_domain": F.lower("email_domain"), "topic_mismatch": F.array_join(F.array_sort("n_topics"), ",")}
    values = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)])
    a = accounts.select("run_id", "account_key", F.struct("source", "account_key", values.alias("said")).alias("own"))
    side = lambda c, name: F.struct(F.lit(name).alias("side"), F.col(f"{c}.source").alias("source"), F.col(f"{c}.account_key").alias("account_key"), F.col(f"{c}.said")[basis].alias("value"))
    both = cf.join(a.select("run_id", F.col("account_key").alias("lk"), F.col("own").alias("l")), ["run_id", "lk"]).join(a.select("run_id", F.col("account_key").alias("rk"), F.col("own").alias("r")), ["run_id", "rk"])
    return both.select("run_id", "conflict", "basis", "severity", "penalty", F.array(side("l", "source"), side("r", "target")).alias("sides"))


def read_model(linked: DataFrame, ev: DataFrame, cf: DataFrame) -> DataFrame:
    """Each run with its links (best first), evidence and conflict counts, as ordered strings."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "account_key", "decision")))
    a = linked.groupBy("run_id").agg(F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["account_key"], x["decision"])), ",").alias("links"))
    b = ev.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))
    c = cf.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_conflicts"))
    return a.join(b, "run_id", "left").join(c, "run_id", "left").select("run_id", "links", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.coalesce("signals", F.lit("")).alias("signals"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))


def review_eligibility(decided: DataFrame, limits: policy.Policy = policy.DEFAULT) -> DataFrame:
    """(run_id, account_key, skip_reason) of what needs review; null reason: eligible."""
    s = F.col("evidence_confidence")
    anchored = F.max(F.col("is_anchor")).over(Window.partitionBy("run_id"))
    d = decided.withColumn("anchored", anchored).filter("decision = 'needs_review'")
    strong = F.size(F.coalesce("strong_groups", F.array().cast("array<string>"))) > 0
    reason = (
        F.when(~F.col("anchored"), "missing_anchor").when((s < dec(limits.review_low)) | (s > dec(limits.review_high)), "score_outside_review_band").when(F.col("weak_only"), "weak_signal_only")
        .when((F.col("source") == "hackernews") & ~strong, "hn_handle_only").when(F.size("blocking_types") > 0, "blocking_conflict").when((F.size("groups") == 0) & ~strong, "no_meaningful_evidence")
    )
    return d.select("run_id", "account_key", reason.alias("skip_reason"))


def review_action(verdict: Column, sure: Column, score: Column, n_groups: Column, strong: Column, blocking: Column, opposing: Column, limits: policy.Policy = policy.DEFAULT) -> Column:
    promote = (verdict == "likely_same_person") & sure.isin("medium", "high") & (score >= dec(limits.review_least)) & (n_groups >= 2) & strong & ~blocking
    return F.when(promote, "promoted_to_auto_match").when((verdict == "likely_different_person") & (blocking | opposing), "rejected_after_review").otherwise("kept_needs_review")


def evaluation(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """Shares of false merges, missed merges and reviews, against (run_id, account_key, same)."""
    j = decided.join(truth, ["run_id", "account_key"])
    n, auto = F.count(F.lit(1)), F.col("decision") == "auto_match"
    return j.agg(n.alias("n"), F.count_if(auto & ~F.col("same")).alias("false_merges"), F.count_if((F.col("decision") == "reject") & F.col("same")).alias("missed_merges"), F.count_if(F.col("decision") == "needs_review").alias("reviews"), F.round(F.count_if(F.col("decision") == "needs_review") / n, 6).alias("review_rate"))
