"""The few functions that Spark has no expression for, as Arrow-batched UDFs; rows that don't need them skip them."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text


def indel(a: str, b: str) -> float:
    """200 * LCS / (|a| + |b|), with the common subsequence's length by bit rows."""
    if not a or not b:
        return 0.0 if a or b else 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _token(a: str, b: str) -> bool:
    return a == b or (len(a) == 1 and b.startswith(a)) or (len(b) == 1 and a.startswith(b))


def initials_align(left: list[str], right: list[str]) -> bool:
    """Each token of one name goes to the first free one of the other that is it or its initial; one pair at least is of full tokens."""
    if len(left) != len(right):
        return False
    free, full = list(right), 0
    for t in left:
        found = next((u for u in free if _token(t, u)), None)
        if found is None:
            return False
        free.remove(found)
        full += len(t) > 1 and len(found) > 1
    return full > 0


def compatibility(left: str | None, right: str | None) -> str:
    """How two normalized names go together."""
    if not left or not right:
        return "not_comparable"
    a, b = left.split(), right.split()
    if all(len(t) == 1 for t in a) or all(len(t) == 1 for t in b):
        return "not_comparable"
    if left == right:
        return "exact"
    if len(a) == 1 or len(b) == 1:
        return "inconclusive"
    if set(a) == set(b) or initials_align(a, b):
        return "compatible"
    if set(a) & set(b):
        return "inconclusive"
    close = indel(" ".join(sorted(set(a))), " ".join(sorted(set(b))))
    if close >= 82:
        return "weakly_compatible"
    long = min(sum(len(t) > 1 for t in x) for x in (a, b)) >= 2
    return "conflicting" if long and close < 72 else "inconclusive"


def _per_pair(f, kind: str):
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(left, right):
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out)

    return lambda a, b: F.pandas_udf(run, kind)(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _per_pair(lambda x, y: indel(x or "", y or ""), "double")(a, b))


def handles_similar(a: Column, b: Column) -> Column:
    """Normalized handles of three characters or more, equal or with a ratio of 90; the length rules most out before the UDF."""
    long = (F.length(a) >= 3) & (F.length(b) >= 3)
    near = 20 * F.least(F.length(a), F.length(b)) >= 9 * (F.length(a) + F.length(b))
    needs = long & near & (a != b)
    ratio = indel_ratio(F.when(needs, a), F.when(needs, b))
    return F.coalesce((long & (a == b)) | (needs & (ratio >= 90)), F.lit(False))


def name_compatibility(a: Column, b: Column) -> Column:
    return _per_pair(compatibility, "string")(a, b)


def by_distinct_pair(df: DataFrame, a: str, b: str, of, name: str) -> DataFrame:
    """df with a column name: of(a, b), worked out once for each distinct unordered pair of values and joined back (null with null, too)."""
    low, high = F.least(a, b), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(a, b))
    keyed = df.withColumns({"pair_low": low, "pair_high": high})
    told = keyed.select(F.col("pair_low").alias("low"), F.col("pair_high").alias("high")).distinct().withColumn(name, of(F.col("low"), F.col("high")))
    return keyed.join(told, F.col("pair_low").eqNullSafe(F.col("low")) & F.col("pair_high").eqNullSafe(F.col("high")), "left").select(*df.columns, name)


def with_indel_ratio(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the ratio of columns a and b, null if one is. Rows stay where they are; only those of unequal values pass a Python worker, which knows repeated pairs."""
    differ = F.coalesce(F.col(a) != F.col(b), F.lit(False))
    same = df.filter(~differ).withColumn(name, F.when(F.col(a) == F.col(b), 100.0))
    return same.unionByName(df.filter(differ).withColumn(name, indel_ratio(F.col(a), F.col(b))))


def _edits(n: Column, m: Column, percent: int) -> Column:
    """Insertions and deletions at most between texts of lengths n and m at a ratio of percent or more; the parity is that of m - n."""
    most = F.floor((100 - percent) * (n + m) / 100).cast("int")
    return most - (most + m - n) % 2


def _without(s: Column, size: Column, k: Column) -> Column:
    """What is left of a text of that size without k (0 to 2) of its characters, each way once."""
    drop = lambda x, i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, size))
    one = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: drop(s, i))
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.transform(F.sequence(i, F.greatest(size - 1, i)), lambda j: drop(drop(s, i), j))))
    return F.when(k == 0, F.array(s)).otherwise(F.array_distinct(F.when(k == 1, one).otherwise(two)))


def _parts(sized: DataFrame, percent: int) -> DataFrame:
    """A row for each part k of the shorter text (length n) of lengths n and m, and for each number t of characters that its counterpart in the longer one may have more.

    d edits are dealt to p parts, so one part has e = d / p at most. Few edits are left to large parts, two each: up to d = 2 a text is one part. Longer texts
    have parts with one edit, those of a low ratio, whose parts would be small, parts that stay whole.
    """
    n, m, d, p, k, t, at, size = (F.col(c) for c in ("n", "m", "d", "p", "k", "t", "at", "size"))
    third, half = F.floor(d / 3) + 1, F.floor(d / 2) + 1
    cut = sized.withColumn("d", _edits(n, m, percent)).filter(d >= F.greatest(m - n, F.lit(1)))
    cut = cut.withColumn("p", F.when(d <= 5, third).when(n >= 6 * half, half).otherwise(d + 1).cast("int")).withColumn("e", F.floor(d / p).cast("int"))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(0), p - 1))).withColumn("t", F.explode(F.sequence(-F.col("e"), F.col("e")))).filter((F.abs(t) + F.abs(m - n - t) <= d) & ((p > 1) | (t == m - n)))
    return cut.withColumn("at", F.floor(n * k / p).cast("int")).withColumn("size", F.floor(n * (k + 1) / p).cast("int") - at).filter(size + t >= 0)


def meeting_pairs(values: DataFrame, percent: int = 90, least: int = 3) -> DataFrame:
    """(a, b, known): all pairs that similar_pairs() tells and candidates that are to be verified, a before b by length, then order; the ratio where it is known.

    The shorter value is cut into parts, of which one is within two edits of a passage of the longer one, not more places off than there are edits (see _parts). Two passages
    within two edits leave the same text without as many characters, so what is left of parts is joined with what is left of passages: values that have an ending in common don't
    meet by that alone, unless a whole part is the same. Pairs that may be two edits apart at most are known by that.
    """
    # a number of partitions is named, as few values make many rows, which partitions put together by size would leave to one task
    dealt = values.select("value").filter(F.length("value") >= least).repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value")
    v = dealt.distinct().withColumn("size", F.length("value"))
    own, n, m, d, p, k, t, s, at, size = (F.col(c) for c in ("size", "n", "m", "d", "p", "k", "t", "s", "at", "size"))
    both = F.when((t == 0) & (F.col("e") == 2), 1).otherwise(0)  # equal sizes: a character goes on either side
    lengths = F.broadcast(v.groupBy(own.alias("other")).agg((F.count(F.lit(1)) > 1).alias("several")))

    def of(side: tuple[str, str, str], first: Column, last: Column) -> DataFrame:
        """Each value with the lengths that its partners may have and some value has."""
        each = v.select("value", "size", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("other")).join(lengths, "other").filter((own != F.col("other")) | F.col("several"))
        return each.select(F.col("value").alias(side[0]), own.alias(side[1]), F.col("other").alias(side[2]))

    short = _parts(of(("a", "n", "m"), own, F.floor(own * (200 - percent) / percent)), percent)
    short = short.select("a", "n", "m", "d", "p", "k", "t", F.explode(_without(F.substring("a", at + 1, size), size, F.greatest(-t, both))).alias("left"))
    long = _parts(of(("b", "m", "n"), F.ceil(own * percent / (200 - percent)), own), percent).withColumn("s", F.explode(F.sequence(-d, d)))
    long = long.filter((F.abs(s) + F.abs(t) + F.abs(m - n - s - t) <= d) & ((k > 0) | (s == 0)) & ((k < p - 1) | (s + t == m - n)) & (at + s >= 0) & (at + s + size + t <= m))
    long = long.select("b", "n", "m", "k", "t", F.explode(_without(F.substring("b", at + s + 1, size + t), size + t, F.greatest(t, both))).alias("left"))
    met = short.join(long, ["n", "m", "k", "t", "left"]).filter((n < m) | (F.col("a") < F.col("b"))).select("a", "b", F.when(p == 1, 200.0 * ((n + m - d) / 2) / (n + m)).alias("known"))
    return met.distinct()


def similar_pairs(values: DataFrame, percent: int = 90, least: int = 3) -> DataFrame:
    """(a, b, ratio) of the distinct values (column value, at least so long) with an Indel ratio of percent or more, a before b by length, then order. Each candidate is verified once."""
    left_open = F.col("known").isNull()
    ratio = F.coalesce("known", indel_ratio(F.when(left_open, F.col("a")), F.when(left_open, F.col("b"))))
    return meeting_pairs(values, percent, least).select("a", "b", ratio.alias("ratio")).filter(F.col("ratio") >= percent)


def _fold(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def ascii_fold(c: Column) -> Column:
    """Letters without accents, other characters beyond ASCII dropped."""
    beyond = c.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, F.pandas_udf(_fold, "string")(F.when(beyond, c))).otherwise(c)


def _unescape(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else html.unescape(t), na_action="ignore")


def html_unescape(c: Column) -> Column:
    some = c.contains("&")
    return F.when(some, F.pandas_udf(_unescape, "string")(F.when(some, c))).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Text without tags; entities are read before tags go and after."""
    return text.clean(html_unescape(F.regexp_replace(text.clean(html_unescape(c)), "<[^>]+>", " ")))
