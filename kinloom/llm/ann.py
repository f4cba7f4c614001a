"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Vectors go to shards of about SHARD rows by a hash of their id. A shard keeps each distinct vector once, with all ids that have
it, and lifts it by one coordinate so that the largest inner product becomes the smallest distance. Levels are drawn
geometrically; each level links its nodes to diverse near ones (found by blocked products within the shard, whose size is bounded) and
back, as flat neighbour arrays. A beam goes down the levels for many queries at once. Shards' results are merged by exact scores
in double precision.

Vectors and queries are scaled by powers of two before they are squared or rounded to single precision. Vectors whose length is far from a shard's median
(by SHORT or LONG powers of two), which single precision could not tell apart beside the others, aren't nodes but are looked at by every query. A product that overflows is infinite, whatever its parts.

Null or zero vectors, vectors with null or non-finite components, null ids and vectors of another length than the most frequent
one take no part. Of rows with one id the smallest vector stands for them. Ties go to the smaller id. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pack, unpack

SHARD, QUERIES = 8_192, 4_096
#: Recall of the 20 nearest in a full shard is 0.95 or more with these (see the tests).
LINKS, NEAR, EF, EF_DOWN, AT_ONCE = 24, 96, 192, 16, 256
#: Powers of two that a node's length may be below or above its shard's median.
SHORT, LONG = -8, 4
FOUND = "query_id long, vec_id long, score double"


def select_links(x: np.ndarray, limit: int, near: int = NEAR, block: int = 256) -> np.ndarray:
    """Neighbours of each row of x, padded with -1: of its nearest, those that are nearer to it than to one taken before; then back links."""
    n = len(x)
    k = min(near, n - 1)
    links = np.full((n, limit), -1, np.int32)
    if k < 1:
        return links
    sq = (x**2).sum(1)
    edges = []
    for a in range(0, n, block):
        rows = np.arange(a, min(a + block, n))
        d = sq[None, :] - 2 * (x[rows] @ x.T)
        d[np.arange(len(rows)), rows] = np.inf
        cand = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(d, axis=1)[:, :k]
        dist = np.take_along_axis(d, cand, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1) + sq[rows][:, None]
        v = x[cand]
        between = sq[cand][:, :, None] + sq[cand][:, None, :] - 2 * np.einsum("bid,bjd->bij", v, v, optimize=True)
        taken = np.zeros(cand.shape, bool)
        for j in range(k):
            taken[:, j] = ~(taken[:, :j] & (between[:, j, :j] < dist[:, j : j + 1])).any(1) & (taken[:, :j].sum(1) < limit)
        rank = np.where(taken, 0, k) + np.arange(k)  # diverse ones, then the nearest others up to half the room
        first = np.argsort(rank, axis=1, kind="stable")[:, : max(limit // 2, 1)]
        keep = taken.copy()
        np.put_along_axis(keep, first, True, 1)
        i, j = np.nonzero(keep)
        edges.append((rows[i], cand[i, j], dist[i, j]))
    u, v, d = (np.concatenate(e) for e in zip(*edges))
    own = np.zeros(len(u), np.int8)
    u, v, d, own = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([d, d]), np.concatenate([own, own + 1])
    order = np.lexsort((d, own, u))
    u, v = u[order], v[order]
    pair = u.astype(np.int64) * n + v
    _, firsts = np.unique(pair, return_index=True)  # a link that goes both ways counts once
    once = np.zeros(len(u), bool)
    once[firsts] = True
    u, v = u[once], v[once]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    ok = rank < limit
    links[u[ok], rank[ok]] = v[ok]
    return links


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times powers of two, so that each one's largest component is from 1/2 to 1, and the powers."""
    power = np.frexp(np.abs(x).max(1))[1]
    return np.ldexp(x, -power[:, None]), power


def log_length(x: np.ndarray) -> np.ndarray:
    """Logarithm to base 2 of the rows' lengths; no row is zero."""
    y, power = scaled(x)
    return power + np.log2((y**2).sum(1)) / 2


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with a vector in double precision; where a part overflows, those of scaled vectors."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (x * q).sum(1)
        odd = ~np.isfinite(out)
        if odd.any():
            (y, a), (p, b) = scaled(x[odd]), scaled(q[None])
            out[odd] = np.ldexp((y * p).sum(1), a + b)
    return out


class Graph:
    """levels: (nodes, links) from the base up; links number the nodes of the whole graph."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x, levels

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        norms = (vectors.astype(np.float64) ** 2).sum(1)
        scale = np.sqrt(norms.max(initial=0)) or 1.0
        lift = np.sqrt(np.maximum(scale**2 - norms, 0))
        x = (np.column_stack([vectors, lift]) / scale).astype(np.float32)
        level = (-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(LINKS)).astype(int)
        levels = []
        for k in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= k).astype(np.int32)
            near = select_links(x[nodes], LINKS * (2 if k == 0 else 1))
            links = np.full((len(x) if k == 0 else len(nodes), near.shape[1]), -1, np.int32)
            links[:] = np.where(near >= 0, nodes[near], -1)
            levels.append((nodes, links))
        return cls(x, levels)

    def beam(self, q: np.ndarray, start: np.ndarray, level: int, ef: int, step: int = 4) -> np.ndarray:
        """Rows of q with start nodes: their ef best nodes on a level, best first, -1 where fewer."""
        nodes, links = self.levels[level]
        row = np.zeros(len(self.x), np.int32)
        row[nodes] = np.arange(len(nodes))
        m, at = len(q), np.arange(len(q))
        visited = np.zeros((m, len(self.x) + 1), bool)
        ids = np.full((m, ef), -1, np.int32)
        score = np.full((m, ef), -np.inf, np.float32)
        done = np.zeros((m, ef), bool)
        w = start.shape[1]
        ids[:, :w] = start
        score[:, :w] = np.where(start >= 0, np.einsum("qd,qwd->qw", q, self.x[start]), -np.inf)
        visited[at[:, None], start] = True
        active = at
        while len(active):
            s = np.where(done[active], -np.inf, score[active])
            best = np.argsort(-s, axis=1, kind="stable")[:, :step]
            live = np.take_along_axis(s, best, 1) > -np.inf
            active, best, live = active[live[:, 0]], best[live[:, 0]], live[live[:, 0]]
            if not len(active):
                break
            found = []
            for j in range(best.shape[1]):
                nb = links[row[ids[active, best[:, j]]]]
                nb = np.where(live[:, j : j + 1] & (nb >= 0) & ~visited[active[:, None], nb], nb, -1)
                visited[active[:, None], nb] = True
                found.append(nb)
                done[active, best[:, j]] = True
            nb = np.concatenate(found, 1)
            near = np.where(nb >= 0, np.einsum("qd,qwd->qw", q[active], self.x[nb], optimize=True), -np.inf)
            all_ids, all_score = np.concatenate([ids[active], nb], 1), np.concatenate([score[active], near], 1)
            all_done = np.concatenate([done[active], np.zeros(nb.shape, bool)], 1)
            top = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
            ids[active], score[active], done[active] = (np.take_along_axis(y, top, 1) for y in (all_ids, all_score, all_done))
        order = np.argsort(-score, axis=1, kind="stable")
        return np.where(np.take_along_axis(score, order, 1) > -np.inf, np.take_along_axis(ids, order, 1), -1)

    def search(self, q: np.ndarray, ef: int = EF) -> np.ndarray:
        """The ef nodes found for each row of q; all nodes if there are no more."""
        if len(self.x) <= ef:
            return np.tile(np.arange(len(self.x), dtype=np.int32), (len(q), 1))
        q = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        out = []
        for a in range(0, len(q), AT_ONCE):
            part = q[a : a + AT_ONCE]
            start = np.full((len(part), 1), self.levels[-1][0][0], np.int32)
            for level in range(len(self.levels) - 1, 0, -1):
                start = self.beam(part, start, level, EF_DOWN)
            out.append(self.beam(part, start, 0, ef))
        return np.concatenate(out)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    length = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("embedding") == (length["n"] if length else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def index(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(shard, data) of valid() vectors, checkpointed: ids, vectors and the graph's flat arrays."""
    shards = max(1, -(-vectors.count() // shard_rows))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        distinct, back = np.unique(x, axis=0, return_inverse=True)
        back = back.reshape(-1)
        length = log_length(distinct)
        middle = np.sort(length)[len(length) // 2]
        node = (length >= middle + SHORT) & (length <= middle + LONG)
        graph = Graph.build(np.ldexp(distinct[node], -int(np.round(middle))))
        order = np.argsort(back, kind="stable")  # ids of a vector together, in ascending order
        flat = [a for nodes, links in graph.levels for a in (nodes, links)]
        data = pack(np.array([x.shape[1], len(graph.levels)], np.int64), pdf["vec_id"].to_numpy(np.int64)[order], np.bincount(back, minlength=len(distinct)).astype(np.int64), distinct, graph.x, node.astype(np.int32), *flat)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "data": [data]})

    sharded = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return checkpoint(sharded.groupBy("shard").applyInPandas(build, "shard int, data binary"))


def _load(data: bytes):
    parts = unpack(data, np.int64, np.int64, np.int64, np.float64, np.float32, ..., np.int32)
    dim, levels = parts[0].tolist()
    ids, counts, vectors, x, node = parts[1], parts[2], parts[3].reshape(-1, dim), parts[4].reshape(-1, dim + 1), parts[5]
    graph = Graph(x, [(parts[6 + 2 * k], parts[7 + 2 * k].reshape(len(x) if k == 0 else len(parts[6 + 2 * k]), -1)) for k in range(levels)])
    return ids, counts, vectors, np.flatnonzero(node), np.flatnonzero(node == 0), graph


def search(index_: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each of valid() queries but the query's own id."""
    groups = max(1, -(-queries.count() // QUERIES))
    last = index_.agg(F.max("shard")).first()[0]
    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    indexed = index_.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, counts, vectors, node, apart, graph = _load(left["data"].iloc[0])
            ends = np.cumsum(counts)
            q = np.stack(right["embedding"].to_numpy()).astype(np.float64)
            for query, vector, nodes in zip(right["vec_id"].tolist(), q, graph.search(scaled(q)[0], max(ef, k + 1))):
                nodes = np.concatenate([node[nodes[nodes >= 0]], apart])
                score = products(vectors[nodes], vector)
                best = np.argsort(-score, kind="stable")
                cut = np.sort(score)[::-1][min(k, len(score) - 1)]  # k others at least are as near as this
                found = [(-s, i) for j in best.tolist() if (s := float(score[j])) >= cut for i in ids[ends[nodes[j]] - counts[nodes[j]] : ends[nodes[j]]][: k + 1].tolist() if i != query]
                for s, i in sorted(found)[:k]:
                    out["query_id"].append(query)
                    out["vec_id"].append(i)
                    out["score"].append(-s)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = indexed.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(find, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
