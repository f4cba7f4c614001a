"""Packets of evidence that a reviewer gets for each pair, and checks of the verdicts that come back as text.

A pair's evidence and conflicts are aggregated once each by pair (there are as many as kinds of signals, so groups are small) and joined by key.
A verdict is read on the JVM; what is wrong with it comes out as rows, one for each breach, so a bad verdict never stops a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import let
from .detail import collected

PAIR = ["run_id", "lk", "rk"]
#: Items of a packet at most, the strongest.
ITEMS = 20

# What a verdict may recommend, how sure it may be, and its lists with their greatest lengths.
RECOMMENDATIONS = ("likely_same_person", "uncertain", "likely_different_person")
CONFIDENCES = ("low", "medium", "high")
LISTS = {"rationale": 5, "risk_flags": 5, "used_evidence_types": 10}


def clean_list(values: Column, items: int = 20, chars: int = 120) -> Column:
    """Texts with single blanks, cut to `chars` characters, without blank and repeated ones, the first `items` of them; null is an empty list."""
    cut = F.transform(values, lambda x: F.substring(text.clean(x), 1, chars))
    return F.coalesce(F.slice(F.array_distinct(F.filter(cut, lambda x: x.isNotNull())), 1, items), F.array().cast("array<string>"))


def packets(pair_scores: DataFrame, ev: DataFrame, cf: DataFrame, items: int = ITEMS) -> DataFrame:
    """(run_id, lk, rk, score, weak_only, groups, strong_groups, blocking_types, evidence, conflicts) of each pair: its strongest signals and its most
    costly conflicts first, ties by name, `items` of each at most. A pair without any has empty lists."""
    between = ev.filter("other_key IS NOT NULL").withColumns({"lk": F.least("account_key", "other_key"), "rk": F.greatest("account_key", "other_key")})
    told = collected(between, PAIR, "evidence", ["signal", "signal_group", "weight", "account_key"], [-F.col("weight"), F.col("signal"), F.col("account_key")])
    against = collected(cf, PAIR, "conflicts", ["conflict", "basis", "severity", "penalty"], [F.col("penalty"), F.col("conflict"), F.col("basis")])
    own = pair_scores.select(*PAIR, F.col("confidence").alias("score"), "weak_only", "groups", "strong_groups", "blocking_types")
    out = own.join(told, PAIR, "left").join(against, PAIR, "left")
    lists = [F.coalesce(F.slice(n, 1, items), F.array().cast(dict(df.dtypes)[n])).alias(n) for n, df in (("evidence", told), ("conflicts", against))]
    names = [clean_list(F.col(n), 10).alias(n) for n in ("groups", "strong_groups", "blocking_types")]
    return out.select(*PAIR, "score", "weak_only", *names, *lists)


def allowed_types(packet: DataFrame) -> Column:
    """What a verdict on a packet may refer to."""
    return F.array_union("evidence.signal", "conflicts.conflict")


def read_verdict(c: Column) -> Column:
    """A struct of what a verdict's text says: `kind` (empty, no_json, no_object or object), `fields`, `recommendation`, `confidence`, the lists of
    LISTS cleaned, and `shape`, the names of the parts that aren't what they should be. JSON within other text counts."""

    def told(v: Column, json: Column) -> Column:
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        kind = F.when(text.clean(c).isNull(), "empty").when(v.isNull(), "no_json").when(is_object, "object").otherwise("no_object")
        one = lambda n: F.try_variant_get(v, f"$.{n}", "string")
        many = lambda n: F.try_variant_get(v, f"$.{n}", "array<string>")
        kind_of = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
        wrong = [F.when(~F.coalesce(one(n).isin(*of) & (kind_of(n) == "STRING"), F.lit(False)), F.lit(n)) for n, of in (("recommendation", RECOMMENDATIONS), ("confidence", CONFIDENCES))]
        wrong += [F.when(~F.coalesce(kind_of(n).isin("ARRAY<STRING>", "ARRAY<VOID>") & ((F.size(many(n)) == 0) | (kind_of(n) == "ARRAY<STRING>")) & (F.size(many(n)) <= most), F.lit(True)), F.lit(n)) for n, most in LISTS.items()]
        fields = F.map_keys(F.from_json(F.when(is_object, json), "map<string,string>"))
        lists = [clean_list(many(n), most, 1 << 30).alias(n) for n, most in LISTS.items()]
        return F.struct(kind.alias("kind"), F.coalesce(fields, F.array().cast("array<string>")).alias("fields"), one("recommendation").alias("recommendation"), one("confidence").alias("confidence"), *lists, F.array_compact(F.array(*wrong)).alias("shape"))

    return let(text.salvage_json(c), lambda json: let(F.try_parse_json(json), lambda v: told(v, json)))


def breaches(verdicts: DataFrame, packet: DataFrame) -> DataFrame:
    """(run_id, lk, rk, breach, detail): what is wrong with each verdict (run_id, lk, rk, verdict); sound ones have no row.

    A verdict that is empty, no JSON or no object has that breach alone. Else a row for each of: `shape` (a part that is missing or isn't of its kind, one of the
    fixed words or short enough), `unknown_field`, `claim` (it says that an identity is proven) and `unsupported_type` (a name that the packet doesn't
    have), with the names in `detail`. A verdict on a pair without a packet supports no type.
    """
    known = ("recommendation", "confidence", *LISTS)
    read = verdicts.join(packet.select(*PAIR, allowed_types(packet).alias("allowed")), PAIR, "left").select(*PAIR, "allowed", read_verdict(F.col("verdict")).alias("v"))
    said = F.lower(F.concat_ws(" ", "v.recommendation", "v.confidence", *[f"v.{n}" for n in LISTS]))
    claim = F.regexp_extract(said, "(?<![a-z0-9])(" + "|".join(sorted(text.CLAIMS, key=len, reverse=True)) + ")(?![a-z0-9])", 1)
    names = lambda a: F.array_join(F.array_sort(a), ",")
    extra = F.array_except("v.fields", F.array(*map(F.lit, known)))
    unsupported = F.array_except("v.used_evidence_types", F.coalesce("allowed", F.array().cast("array<string>")))
    row = lambda breach, test, detail: F.when(test, F.struct(F.lit(breach).alias("breach"), detail.alias("detail")))
    whole = F.col("v.kind") == "object"
    rows = F.array(
        F.when(~whole, F.struct(F.col("v.kind").alias("breach"), F.lit("").alias("detail"))),
        row("shape", whole & (F.size("v.shape") > 0), names(F.col("v.shape"))), row("unknown_field", F.size(extra) > 0, names(extra)),
        row("claim", whole & (claim != ""), claim), row("unsupported_type", whole & (F.size(unsupported) > 0), names(unsupported)),
    )
    return read.select(*PAIR, F.inline(F.array_compact(rows)))
