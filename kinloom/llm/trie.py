"""A prefix trie of conversations, built as a Patricia tree and then expanded.

A turn is a code of 20 bytes (16 of a SHA-256 over role and text, 4 for the text's length), a conversation the string of its turns' codes. Equal
conversations become one row with their number and smallest id. The distinct ones are sorted over range partitions; a task reads its
partition in order with a stack of the points on the current path. Points are made only where conversations branch, end or are leaves,
and at the root; the edge to a point holds the lengths of all turns on it. A point that a
partition shares with others has to be a point in each of them: a first pass gives the depths at which a partition's first and last
conversations part from the others of it, and from these small lists follow the depths at which they part from all earlier and later partitions.
A node is owned by the first partition that has it, so all counts of a point are sums over partitions. Points' counts, leaves and sums come
from the compressed tree; the unary nodes on an edge get theirs from the point below by suffix sums over the edge.

Conversations travel as codes, without texts; each is one row of 20 bytes a turn. The driver holds two lists of depths a partition.
The ids that end at a node are sorted by range and hashed as a stream, so that no task holds them all.

Turns are ordered by turn (null first), then by role and the hash of the text. Null roles and texts are empty. Turns of a null conv_id belong to no conversation.
Repeated turns count as often as they are there. Without conversations there is no node; other columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, checkpoint, shuffle_partitions

WIDTH, HASH = 20, 16
#: Bytes of ids that go on as one row.
PIECE = 1 << 20
#: Rows of two 16-byte names that are broadcast at most.
BROADCAST = 1 << 18
POINTS = pa.schema([(x, pa.binary()) for x in ("node", "parent")] + [(x, pa.int64()) for x in ("depth", "n_convs", "conv_id", "n_leaves", "n_children", "all_bytes", "own_bytes")] + [("edge", pa.list_(pa.int64())), ("shared", pa.bool_())])
POINTS_DDL = "node binary, parent binary, depth long, n_convs long, conv_id long, n_leaves long, n_children long, all_bytes long, own_bytes long, edge array<long>, shared boolean"


def code(role: Column, text: Column) -> Column:
    """A turn's code, in hexadecimal digits."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    told = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.substring(told, 1, 2 * HASH), F.lpad(F.lower(F.hex(F.octet_length(text))), 2 * (WIDTH - HASH), "0"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id long, codes array<string>) of turns (conv_id, turn, role, text), in order."""
    one = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), code(F.col("role"), F.col("text")).alias("code"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "code")))
    return one.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["code"]).alias("codes"))


def key(codes: Column) -> Column:
    return F.unhex(F.array_join(codes, ""))


def name(path: bytes) -> bytes:
    """A node's name, by the codes on its path."""
    return hashlib.sha256(path).digest()[:HASH]


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // WIDTH


def partings(sorted_: DataFrame) -> dict[int, tuple[int, list[int], list[int]]]:
    """For each partition that has rows: how many turns its first conversation shares with the last one before it, and the depths at which its first
    and last conversations part from conversations of earlier and later partitions."""

    def run(it):
        first = last = None
        left: set[int] = set()
        right: list[int] = []
        part = None
        for batch in it:
            for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first is None:
                    part, first, last = p, k, k
                    continue
                n = common_turns(last, k)
                right = [*(x for x in right if x < n), n]
                left.add(min(n, *left) if left else n)
                last = k
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": last, "whole": min(left, default=len(first) // WIDTH), "left": sorted(left), "right": right}], schema=pa.schema([("part", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("whole", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]))

    ends = checkpoint(sorted_.select("part", "key").mapInArrow(run, "part long, first binary, last binary, whole long, left array<long>, right array<long>"))
    # one row a partition is all that this window orders; tasks compare the keys and only depths go to the driver
    paired = ends.select("part", "first", F.lag("last").over(Window.orderBy("part")).alias("prior"), "whole", "left", "right")

    def compare(it):
        for batch in it:
            rows = [{k: r[k] for k in ("part", "whole", "left", "right")} | {"gap": -1 if r["prior"] is None else common_turns(r["prior"], r["first"])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("gap", pa.int64()), ("whole", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]))

    told = sorted(paired.mapInArrow(compare, "part long, gap long, whole long, left array<long>, right array<long>").collect())
    earlier: list[set[int]] = [set()]
    for before_, now in zip(told, told[1:]):
        earlier.append({now.gap, *(min(now.gap, x) for x in before_.right), *(min(now.gap, before_.whole, x) for x in earlier[-1])})
    later: list[set[int]] = [set()]
    for now, after in zip(told[-2::-1], told[:0:-1]):
        later.append({after.gap, *(min(after.gap, x) for x in after.left), *(min(after.gap, after.whole, x) for x in later[-1])})
    return {r.part: (max(r.gap, 0), sorted(x), sorted(y)) for r, x, y in zip(told, earlier, reversed(later))}


class Point:
    __slots__ = ("depth", "n", "least", "leaves", "children", "all", "own")

    def __init__(self, depth: int):
        self.depth, self.n, self.least, self.leaves, self.children, self.all, self.own = depth, 0, None, 0, 0, 0, 0

    def add(self, n: int, least: int) -> None:
        self.n, self.least = self.n + n, least if self.least is None else min(self.least, least)


def points_of(rows, gap: int, earlier: list[int], later: list[int]):
    """Points of one partition's (key, n, least conv_id), in order, as tuples of POINTS."""
    shared_right, stack, before, sums = max(later, default=-1), [Point(0)], b"", None
    first, on_first = None, 0  # turns that the current path shares with the first one

    def close(depth: int, at_end: bool):
        while stack[-1].depth > depth:
            x = stack.pop()
            if stack[-1].depth < depth:
                stack.append(Point(depth))
            up, foreign = stack[-1], min(on_first, gap)
            yield made(x, up, at_end, foreign)
            a, d = up.depth, x.depth
            up.add(x.n, x.least)
            up.leaves += x.leaves
            up.children += a + 1 > foreign
            up.all += x.all + x.n * int(sums[d] - sums[a])
            up.own += x.own + int(sums[d] - sums[min(max(a, foreign), d)])

    def made(x: Point, up: Point | None, at_end: bool, foreign: int) -> tuple:
        d = x.depth
        edge = [0] if up is None else (sums[d] - sums[up.depth : d]).tolist()
        return name(before[: d * WIDTH]), None if up is None else name(before[: up.depth * WIDTH]), d, x.n, x.least, x.leaves, x.children, x.all, x.own, edge, d <= foreign or (at_end and d <= shared_right) or up is None

    for path, n, least in rows:
        if first is None:
            first, on_first = path, len(path) // WIDTH
            stack += [Point(d) for d in earlier if d > 0]
        else:
            shares = common_turns(before, path)
            if shares * WIDTH < len(before):
                ended(stack, before)
            yield from close(shares, False)
            on_first = min(on_first, shares)
        before, depth = path, len(path) // WIDTH
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(path, np.uint8).reshape(-1, WIDTH)[:, HASH:].astype(np.int64) @ (256 ** np.arange(WIDTH - HASH - 1, -1, -1)))])
        if stack[-1].depth < depth:
            stack.append(Point(depth))
        stack[-1].add(n, least)
    if first is None:
        return
    if shared_right * WIDTH < len(before):
        ended(stack, before)
    for depth in reversed(later):
        yield from close(depth, True)
    yield from close(0, True)
    yield made(stack[0], None, True, 0)


def ended(stack: list[Point], path: bytes) -> None:
    """The path that ends here isn't continued: its last node is a leaf."""
    assert stack[-1].depth * WIDTH == len(path)
    stack[-1].leaves += 1


def compressed(paths: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Points of the Patricia tree of paths (key, n, conv_id; distinct keys), checkpointed: sums over partitions, edges as suffix sums of lengths.
    And how many points partitions share at most."""
    dealt = paths.repartitionByRange(parts, "key").sortWithinPartitions("key")
    sorted_ = checkpoint(dealt.select(F.spark_partition_id().cast("long").alias("part"), "key", "n", "conv_id"))
    told = partings(sorted_)

    def run(it):
        def rows():
            for batch in it:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        found = rows()
        head = next(found, None)
        if head is not None:
            chain = (r[1:] for r in _after(head, found))
            yield from batches(points_of(chain, *told[head[0]]), POINTS)

    points = checkpoint(sorted_.mapInArrow(run, POINTS_DDL))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "n_children", "all_bytes", "own_bytes")]
    few = points.filter("shared").groupBy("node").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "edge")], F.min("conv_id").alias("conv_id"), *sums)
    columns = ["node", "parent", "depth", "edge", "conv_id", "n_convs", "n_leaves", "n_children", "all_bytes", "own_bytes", "shared"]
    whole = checkpoint(few.withColumn("shared", F.lit(True)).select(columns).unionByName(points.filter("NOT shared").select(columns)))
    return whole, 1 + sum(len(x) + len(y) for _, x, y in told.values())


def _after(head, rest):
    yield head
    yield from rest


def hashed_ends(ends: DataFrame, parts: int) -> DataFrame:
    """(node, ends_sha256) of ends (node binary, conv_id): over the ids in ascending order, joined by commas."""
    ddl = "node binary, part long, seq long, ids binary, whole boolean"
    schema = pa.schema([("node", pa.binary()), ("part", pa.int64()), ("seq", pa.int64()), ("ids", pa.binary()), ("whole", pa.bool_())])

    def pieces(it):
        """Ids of a node that surely is in this partition alone and has few are hashed; others go on as pieces."""

        def rows():
            node, goes_on, part, seq, text, size = None, True, 0, 0, [], 0  # the first node may be in the partition before, too
            for batch in it:
                for p, k, i in zip(*(c.to_pylist() for c in batch.columns)):
                    if k != node:
                        if node is not None:
                            ids = ",".join(text).encode()
                            yield node, part, seq, ids if goes_on else hashlib.sha256(ids).hexdigest().encode(), not goes_on
                            goes_on = False
                        node, part, seq, text, size = k, p, 0, [], 0
                    text.append(str(i))
                    size += len(text[-1]) + 1
                    if size >= PIECE:
                        yield node, part, seq, ",".join(text).encode(), False
                        seq, text, size, goes_on = seq + 1, [], 0, True
            if node is not None:  # the last node may be in the next partition, too
                yield node, part, seq, ",".join(text).encode(), False

        yield from batches(rows(), schema, 200)

    def whole(it):
        def rows():
            node, digest, started = None, None, False
            for batch in it:
                for k, ids in zip(*(c.to_pylist() for c in batch.columns)):
                    if k != node:
                        if node is not None:
                            yield node, digest.hexdigest()
                        node, digest, started = k, hashlib.sha256(), False
                    if ids:
                        digest.update(b"," * started + ids)
                        started = True
            if node is not None:
                yield node, digest.hexdigest()

        yield from batches(rows(), pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))

    dealt = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    cut = checkpoint(dealt.select(F.spark_partition_id().cast("long"), "node", "conv_id").mapInArrow(pieces, ddl))
    rest = cut.filter("NOT whole").repartition(parts, "node").sortWithinPartitions("node", "part", "seq").select("node", "ids").mapInArrow(whole, "node binary, ends_sha256 string")
    return cut.filter("whole").select("node", F.col("ids").cast("string").alias("ends_sha256")).unionByName(rest)


def nodes(convs: DataFrame, parts: int | None = None) -> DataFrame:
    """The trie of conversations (conv_id, codes), a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = parts or shuffle_partitions(convs.sparkSession)
    keyed = checkpoint(convs.select("conv_id", key(F.col("codes")).alias("key")))
    points, shared = compressed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")), parts)
    ends = hashed_ends(keyed.select(F.unhex(F.substring(F.sha2("key", 256), 1, 2 * HASH)).alias("node"), "conv_id"), parts)

    # a node has more children than fit a partition only if partitions share it
    above = points.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "shared")
    wide, rest = above.filter("shared").drop("shared"), above.filter("NOT shared").drop("shared")
    found = points.drop("shared").join(F.broadcast(wide) if shared <= BROADCAST else wide, "parent", "left")
    deep = found.filter("parent_conv_id IS NULL AND parent IS NOT NULL").drop("parent_conv_id").join(rest, "parent")
    found = found.filter("parent_conv_id IS NOT NULL OR parent IS NULL")
    told = found.unionByName(deep).join(ends, "node", "left")

    each = told.select("*", F.posexplode("edge").alias("at", "bytes"))
    last, top = F.col("at") == F.size("edge") - 1, F.col("at") == 0
    return each.select(
        "conv_id",
        (F.col("depth") - F.size("edge") + 1 + F.col("at")).alias("depth"),
        F.when(top, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("all_bytes") - F.col("own_bytes") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def spliced(convs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, codes) with heads exchanged: conversation c begins with the first h turns of conversation c - c % every and goes on with its own after its first
    h, where h is crc32(c as text) % most."""
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = convs.filter(c % every == 0).select(c.alias("base"), F.slice("codes", 1, most - 1).alias("head"))
    joined = convs.select(c, "codes", (c - c % every).alias("base")).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("codes", h + 1, F.greatest(F.size("codes"), F.lit(1)))).alias("codes"))
