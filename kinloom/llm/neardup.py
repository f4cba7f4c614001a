"""MinHash near-duplicates.

A document's set is that of its distinct shingles of `words` words (A-Z lower-cased); one of fewer words is one shingle, one
without words has none and links to nothing. Two documents are linked if their sets' intersection is at least `percent` of
their union; a group is what links connect.

1. Equal sets are one class. Only classes go on, each with BANDS bands of ROWS universal-hash minima.
2. In a bucket (classes with an equal band) every class is paired with one pivot, the class with the most bucket mates in all, so that
   large groups agree on few pivots and a bucket of n makes n - 1 pairs.
3. Pairs are confirmed on the full sets. Links give components (alternating stars).
4. A class that isn't linked to its pivot may still be to others of the pivot's group. Up to SMALL of them are tried; larger groups are joined by
   the rarest of their differences from the pivot, which misses no link (see rest_by_difference). Links found join the components.

So no link between bucket mates is lost, and large groups never make all pairs.

A true link at the least similarity of 0.8 shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS = 5e-6.

Null and empty texts have no shingles. A null id takes no part (component null, kept). Rows with one id are told apart by their texts,
and each gets its row. Where only one row of a group is to stay, it is that of the smallest id, of several with it the one with the smallest hash of
its text, and of equal rows any. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from .common import Ids, as_rows, batches, checkpoint, collect_garbage, flagged, mix64, split_by_filter, text_hash, tokens

ROWS, BANDS = 6, 40
#: Classes of a group that are tried one by one, and steps of the prefix filter of larger ones.
SMALL, LEVELS = 6, 9
_RNG = np.random.default_rng(20240501)
MULTIPLY = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
#: Words gathered before their shingles are hashed, and shingles that are hashed at once (they stay in the cache).
CHUNK, AT_ONCE = 300_000, 1 << 15
#: Classes of one pivot in one salt of it.
PER_SALT, PARTS = 500, 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(ids: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a sequence of 64-bit word hashes."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    if len(ids) < words:
        return np.array([xxhash.xxh3_64_intdigest(ids.tobytes(), 77)], np.uint64)
    key = mix64(ids[: len(ids) - words + 1])
    for j in range(1, words):
        key = mix64(key * _GOLD + ids[j : len(ids) - words + 1 + j])
    return np.unique(key)


def sets(it, words: int):
    """(id, set) of each row, a chunk at a time."""
    held, seen, n = [], Ids(), 0

    def done():
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
        return [(i, shingles(hashes[p], words)) for i, p in held]

    for batch in it:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column("text")):
            w = tokens(text.as_py())
            held.append((doc_id, np.fromiter(map(seen.__getitem__, w), np.int64, len(w))))
            n += len(w)
            if n >= CHUNK or len(held) >= 20_000:
                yield done()
                held, seen, n = [], Ids(), 0
    if held:
        yield done()


def minima(found: list[np.ndarray]) -> np.ndarray:
    """Minima of each hash function over each (non-empty) set."""
    flat = np.concatenate(found)
    starts = np.cumsum([0, *map(len, found[:-1])])
    out = np.empty((len(found), len(MULTIPLY)), np.uint64)
    work = np.empty_like(flat)
    for k, (a, b) in enumerate(zip(MULTIPLY, ADD)):
        np.multiply(flat, a, out=work)
        np.add(work, b, out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def bands(found: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key for each band of each set; keys of different bands differ."""
    m = minima(found).reshape(len(found), BANDS, ROWS)
    key = mix64(np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(found), 1)) * _GOLD)
    for r in range(ROWS):
        key = mix64(key * _GOLD + m[:, :, r])
    return key.view(np.int64)


def class_of(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, hash, n, cls, bands) of each row, hash that of the text; cls and bands null without shingles."""

    def rows(it):
        for chunk in sets(it, words):
            part, size = [], 0
            for k, (i, s) in enumerate(chunk):
                part.append(((i["doc_id"], i["hash"]), s))
                size += len(s)
                if size >= AT_ONCE or k == len(chunk) - 1:
                    keys = iter(bands(full) if (full := [s for _, s in part if len(s)]) else ())
                    for (i, h), s in part:
                        yield (i, h, len(s), class_of(s), next(keys)) if len(s) else (i, h, 0, None, None)
                    part, size = [], 0

    named = docs.select(F.struct("doc_id", text_hash(F.col("text")).alias("hash")).alias("name"), "text")
    return named.mapInArrow(lambda it: batches(rows(it), _SIGNED), "doc_id long, hash long, n long, cls long, bands array<long>")


_SETS = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("items", pa.list_(pa.int64()))])


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, n, items) of the wanted classes (doc_id, cls)."""

    def rows(it):
        for chunk in sets(it, words):
            for _, s in chunk:
                if len(s):
                    yield class_of(s), len(s), s.view(np.int64)

    may, _ = split_by_filter(docs, "doc_id", wanted.select("doc_id"))
    own = may.join(wanted.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    made = own.mapInArrow(lambda it: batches(rows(it), _SETS, 200), "cls long, n long, items array<long>")
    return made.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def with_sets(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (x, p) with sizes and sets, nx, np, sx and sp. A p of many pairs is salted from the first, see salted()."""
    left, salts = salted(pairs)
    right = items.join(salts, items["cls"] == salts["p"]).select("p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("n").alias("np"), F.col("items").alias("sp"))
    return left.join(items.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("items").alias("sx")), "x").join(right, ["p", "salt"])


def salted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs with a salt of their p, PER_SALT of them in one, and (p, salts). Pairs are counted and joined by parts of a p, so that those of a
    common one never meet in one task."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(PARTS)).cast("int"))
    salts = pairs.groupBy("p", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("p").agg(F.ceil(F.sum("n") / PER_SALT).cast("int").alias("salts"), F.collect_list("part").alias("parts"))
    told = pairs.join(salts.select("p", "salts", F.explode("parts").alias("part")), ["p", "part"])
    return told.withColumn("salt", F.pmod(F.xxhash64("x", F.lit(1)), F.col("salts")).cast("int")).drop("salts", "part"), salts.select("p", "salts")


def confirm(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(x, p, linked) of pairs: whether the full sets are similar enough."""
    both = with_sets(pairs, items).withColumn("common", F.size(F.array_intersect("sx", "sp")).cast("long"))
    return both.select("x", "p", (100 * F.col("common") >= percent * (F.col("nx") + F.col("np") - F.col("common"))).alias("linked"))


def links_of(tested: DataFrame) -> DataFrame:
    return tested.filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))


def rest_by_difference(group: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of a pivot's group, x not linked to the pivot, that could be linked. group: (x, p, comp).

    Where x lacks A and adds B to the pivot's set, and y likewise, their intersection follows from the S differences that both
    have: the pair is linked if (100 + percent) * S >= W(x) + W(y) - (100 - percent) * |pivot|, with W = 100 * |A| + percent * |B|.
    As W(x) > (100 - percent) * |pivot| for an x that isn't linked, most of y's differences must be x's too, so one of y's rarest must
    (a prefix filter). The more x is away from the pivot, the fewer of y's come into question: LEVELS.
    """
    ratio = 100 + percent
    tag = lambda a, b, n: F.transform(F.array_except(a, b), lambda e: F.xxhash64(e, F.lit(n)))
    own = with_sets(group, items).withColumns({"lacks": tag("sp", "sx", 0), "adds": tag("sx", "sp", 1)})
    own = own.withColumn("w", 100 * F.size("lacks") + percent * F.size("adds")).withColumn("e", F.col("w") - (100 - percent) * F.col("np"))
    own = checkpoint(own.select("p", "x", "comp", "w", "e", F.concat("lacks", "adds").alias("d")))
    each = own.select("p", "x", F.explode("d").alias("t"))
    often = each.groupBy("p", "t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    shared = each.join(often, ["p", "t"]).groupBy("p", "x").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("ts"))
    # differences that no other has come first in the order and find nothing
    own = own.join(shared, ["p", "x"]).withColumn("alone", F.size("d") - F.size("ts")).withColumn("n", F.size("d"))
    least = F.array(*[F.lit(1 if k == 0 else ratio << (k - 1)) for k in range(LEVELS)])
    prefix = F.transform(least, lambda e: F.col("n") - F.ceil((F.col("w") + e) / ratio) + 1)
    y = own.select("p", F.col("x").alias("y"), F.col("comp").alias("yc"), "alone", prefix.alias("prefix"), F.posexplode("ts").alias("at", "ft"))
    y = y.select("p", "y", "yc", F.col("ft.t").alias("t"), F.explode(F.filter(F.transform("prefix", lambda n, k: F.when(n > F.col("alone") + F.col("at"), k)), lambda k: k.isNotNull())).alias("level"))
    level = F.size(F.filter(least, lambda e: e <= F.col("e"))) - 1
    x = own.filter("e > 0").select("p", "x", F.col("comp").alias("xc"), level.alias("level"), F.explode("ts").alias("ft")).select("p", "x", "xc", "level", F.col("ft.t").alias("t"))
    return x.join(y, ["p", "t", "level"]).filter("x <> y AND xc <> yc").select("x", "y").distinct()


def further_pairs(tested: DataFrame, comp: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, p) of classes of one pivot's group that may be linked although they aren't in one component (node, root) yet.
    A function of its own, as the files of its shuffles go with its variables."""
    # what isn't linked to the pivot may be to another class of its group
    at = tested.join(comp, tested["x"] == comp["node"], "left").select("x", "p", "linked", F.coalesce("root", "x").alias("comp"))
    at = at.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(PARTS)).cast("int"))
    size = at.groupBy("p", "part").agg(F.count(F.lit(1)).alias("size"), F.count_if(~F.col("linked")).alias("unlinked")).groupBy("p").agg(F.sum("size").alias("size"), F.sum("unlinked").alias("unlinked"), F.collect_list("part").alias("parts")).filter("size > 1 AND unlinked > 0")
    at = checkpoint(at.join(size.select("p", "size", F.explode("parts").alias("part")), ["p", "part"]).drop("part"))
    small = at.filter(F.col("size") <= SMALL)
    few = small.filter("NOT linked").select("p", "x", F.col("comp").alias("xc")).join(small.select("p", F.col("x").alias("y"), F.col("comp").alias("yc")), "p").filter("x <> y AND xc <> yc").select("x", "y")
    many = rest_by_difference(at.filter(F.col("size") > SMALL).select("x", "p", "comp"), items, percent)
    more = few.unionByName(many).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("p")).distinct()
    return checkpoint(more)


def groups(docs: DataFrame, words: int = 4, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The rows' (doc_id, hash, n, cls), and (cls, component_id, keeper) of the classes: the smallest id, and with it the smallest hash of a text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = checkpoint(signatures(docs, words))
    classes = signed.filter("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min(F.struct("doc_id", "hash")).alias("least"), F.first("bands").alias("bands"))
    each = classes.select("cls", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    rows = checkpoint(each.join(shared, "key"))
    members = rows.groupBy("cls").agg(F.sum("c").alias("mates"))
    classes = classes.select("cls", F.col("least.doc_id").alias("doc_id"), "least")
    items = checkpoint(full_sets(docs, members.join(classes.drop("least"), "cls"), words))
    rows = rows.join(members, "cls")
    first = rows.groupBy("key").agg(F.max(F.struct("mates", F.xxhash64("cls").alias("h"), "cls")).alias("first")).select("key", F.col("first.cls").alias("p"))
    pairs = checkpoint(rows.join(first, "key").filter("cls <> p").select(F.col("cls").alias("x"), "p").distinct())
    tested = checkpoint(confirm(pairs, items, percent))
    comp = components.components(links_of(tested))
    more = further_pairs(tested, comp, items, percent)
    collect_garbage(docs.sparkSession)
    found = links_of(confirm(more, items, percent))
    comp = components.components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    labelled = classes.join(comp, classes["cls"] == comp["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("keeper"))
    return signed.select("doc_id", "hash", "n", "cls"), labelled.select("root", "cls").join(least, "root").select("cls", F.col("keeper.doc_id").alias("component_id"), "keeper")


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; component_id is the smallest id of its group."""
    rows, classes = groups(docs, words, percent)
    out = rows.join(classes, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group; rows of null ids and rows without a word stay, whatever their ids."""
    signed, classes = groups(docs, words, percent)
    own = signed.filter("doc_id IS NOT NULL AND cls IS NOT NULL").groupBy("doc_id", "hash", "cls").agg(F.count(F.lit(1)).alias("n"))
    told = own.join(classes, "cls").select("doc_id", "hash", (F.struct("doc_id", "hash") == F.col("keeper")).alias("stays"), "n")
    told = checkpoint(told.filter("NOT stays OR n > 1").select("doc_id", "hash", "stays"))
    name = F.xxhash64("doc_id", "hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text").cast("string")).alias("hash"), as_rows(docs))
    rows = flagged(rows, F.when(F.col("doc_id").isNotNull(), name), told.select(name.alias("name")), "maybe")  # only rows that may go or repeat one are shuffled
    may = rows.filter("maybe").join(told, ["doc_id", "hash"], "left")
    once = may.filter("stays").dropDuplicates(["doc_id", "hash"])
    return rows.filter("NOT maybe").select("row").unionByName(may.filter("stays IS NULL").select("row")).unionByName(once.select("row")).select("row.*")
