"""Blocked global dictionary joins.

A token-level join of a corpus would shuffle one row for each token. Here each task gathers whole documents
into a block of bounded size, numbers the block's distinct words and cuts that vocabulary into shards by a hash
of the word. So a word goes through the shuffle once for each block it is in, however often it occurs there:
a word that makes up a third of the corpus costs as many entries as there are blocks. A shard's task sees each of
its distinct words from all blocks, works out what is asked once for each word, and returns an array for each
block. The block then puts its documents together again by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, checkpoint, cut_words, join_words, pack, release, shards_for, unpack

SCHEMA = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])
DDL = "route long, block long, shard int, data binary"
#: A block is closed at so many tokens (it holds one document more at most).
BLOCK_TOKENS = 1_500_000


def _block(number: int, ids: list, flags: list, parts: list, seen: Ids, shards: int, hashed: bool) -> Iterator[tuple]:
    words = list(seen)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    tokens = np.concatenate(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    all_n = np.bincount(tokens, minlength=len(words))
    used_n = np.bincount(tokens[np.repeat(np.array(flags, bool), lengths)], minlength=len(words))
    # by shard, frequent words first: a token is its shard and a mostly small place in it, which pack well byte by byte
    order = np.lexsort((-all_n, shard))
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words)) - bounds[shard[order]]
    planes = [plane for x, n in ((shard[tokens], 2), (place[tokens], 4)) for plane in (x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, b] for b in range(n))]
    yield number, -1, pack(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), lengths, bounds.astype(np.int64), *planes, np.array(flags, np.uint8), hashes[order] if hashed else hashes[:0])
    all_n, used_n = all_n[order], used_n[order]
    for s in range(shards):
        a, b = bounds[s], bounds[s + 1]
        if a < b:
            yield number, s, pack(*join_words([words[i] for i in order[a:b].tolist()]), all_n[a:b].astype(np.uint32), used_n[a:b].astype(np.uint32))


def cut(docs: DataFrame, split: Callable[[str | None], list[bytes]], used: Callable[[object], bool] | None = None, block_tokens: int = BLOCK_TOKENS, hashed: bool = False, keep: bool = True) -> DataFrame:
    """(route, block, shard, data) of documents (doc_id, text). keep: checkpointed, for use in several queries; else one query
    may use it twice, as both per_shard() and join_back() group all of it by route, so the same shuffle serves both. Shard -1 has a block's documents as
    (ids, null ids, lengths, bounds of shards, tokens' shards and places by byte, what used() said, hashes of the vocabulary if hashed); the others have a vocabulary's part as
    (lengths, bytes, tokens in all, tokens in documents whose id passes used())."""
    shards = shards_for(docs)

    def run(it):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

        def rows():
            nonlocal number
            ids, flags, parts, seen, n = [], [], [], Ids(), 0
            for batch in it:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    words = split(text.as_py())
                    parts.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                    ids.append(doc_id)
                    flags.append(used is None or used(doc_id))
                    n += len(words)
                    if n >= block_tokens or len(ids) >= block_tokens // 4:
                        yield from _block(number, ids, flags, parts, seen, shards, hashed)
                        number, n = number + 1, 0
                        ids, flags, parts, seen = [], [], [], Ids()
            if ids:
                yield from _block(number, ids, flags, parts, seen, shards, hashed)

        for block, shard, data in rows():
            row = (shard if shard >= 0 else -1 - block, block, shard, data)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SCHEMA)], schema=SCHEMA)
        release()

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DDL)
    return checkpoint(made) if keep else made


def open_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, None where null, lengths, tokens, what used() said of each document, and hashes of the vocabulary."""
    ids, null, lengths, bounds, *planes, flags, hashes = unpack(data, np.int64, np.uint8, np.int64, np.int64, *[np.uint8] * 7, np.uint64)
    shard = planes[0] + (planes[1].astype(np.int64) << 8)
    tokens = bounds[shard] + sum(p.astype(np.int64) << 8 * b for b, p in enumerate(planes[2:]))
    return [None if n else i for i, n in zip(ids.tolist(), null)], lengths, tokens, flags.astype(bool), hashes


def vocabulary(blocks: DataFrame) -> DataFrame:
    return blocks.filter("shard >= 0")


def shard_words(data: list[bytes]) -> tuple[list[bytes], list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct words of a shard, each block's places in them, and their two counts over all blocks."""
    seen, places, all_n, used_n = Ids(), [], [], []
    for blob in data:
        lengths, raw, a, u = unpack(blob, np.uint32, np.uint8, np.uint32, np.uint32)
        words = cut_words(lengths, raw)
        places.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
        all_n.append(a)
        used_n.append(u)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    count = lambda x: np.bincount(at, np.concatenate(x), len(seen)).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    return list(seen), places, count(all_n), count(used_n)


def per_shard(blocks: DataFrame, work: Callable[[list[bytes], np.ndarray, np.ndarray], Callable[[np.ndarray], bytes]]) -> DataFrame:
    """(block, shard, data): work(words, count, used) runs once for each shard; what it returns makes a block's data from its places."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["shard"].iloc[0] < 0:
            return pdf[:0]
        words, places, all_n, used_n = shard_words(list(pdf["data"]))
        give = work(words, all_n, used_n)
        return pd.DataFrame({"route": -1 - pdf["block"], "block": pdf["block"], "shard": pdf["shard"], "data": [give(p) for p in places]})

    return blocks.groupBy("route").applyInPandas(run, DDL)


def join_back(blocks: DataFrame, answers: DataFrame, work: Callable[..., pd.DataFrame], ddl: str) -> DataFrame:
    """Each block with the answers of its shards in order: work(ids, lengths, tokens, answers), and the hashes of the vocabulary if cut() kept them."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or left["shard"].iloc[0] >= 0:
            return pd.DataFrame({field.split()[0]: pd.Series([], dtype=object) for field in ddl.split(", ")})
        ids, lengths, tokens, _, hashes = open_block(left["data"].iloc[0])
        more = (hashes,) if len(hashes) else ()
        return work(ids, lengths, tokens, [right["data"].iloc[i] for i in np.argsort(right["shard"].to_numpy())], *more)

    return blocks.groupBy("route").cogroup(answers.groupBy("route")).applyInPandas(run, ddl)
