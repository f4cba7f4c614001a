"""Byte-level BPE encoding and decoding by a rank file.

Global distinct-word shuffle: pre-tokens go with their positions into blocks, each distinct pre-token of the
corpus is encoded once in its shard, the ids join back to the blocks and are put together by position. Decoding
looks ids up in the token-byte table, whose size is that of the vocabulary.

Null and empty texts have no ids. Rows are kept as they are, repeated ids and null ids too; other columns are dropped.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import pack, unpack

#: Fixed: Unicode's White_Space, which is what \s means to the encoder's own splitter.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def splitter(pattern: str):
    """The pattern with \\s spelled out, as regex's own \\s has four control characters more."""
    spelled = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    found = regex.compile(spelled).findall
    return lambda text: [m.encode("utf-8", "surrogatepass") for m in found(text)] if text else []


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_tokens: int = blocks.BLOCK_TOKENS) -> DataFrame:
    """(doc_id, ids array<int>) of each row of documents."""
    state: dict = {}

    def split(text):
        if "split" not in state:
            state["split"] = splitter(pattern)
        return state["split"](text)

    def work(words, _all, _used):
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        of = [encoding.encode_single_token(w) if w in ranks else None for w in words]
        of = [[x] if x is not None else encoding._encode_single_piece(w) for x, w in zip(of, words)]
        n = np.fromiter(map(len, of), np.int64, len(of))
        flat = np.fromiter((i for x in of for i in x), np.uint32, int(n.sum()))
        start = np.cumsum(n) - n

        def give(places):
            return pack(n[places].astype(np.uint32), flat[spread(start[places], n[places])])

        return give

    def back(ids, lengths, tokens, answers):
        parts = [unpack(a, np.uint32, np.uint32) for a in answers]
        n = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
        flat = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint32)])
        start = np.cumsum(n) - n
        ends = np.cumsum(lengths)
        out = []
        for a, b in zip(ends - lengths, ends):
            t = tokens[a:b]
            out.append(flat[spread(start[t], n[t])].astype(np.int32))
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "ids": out})

    cut = blocks.cut(docs, split, block_tokens=block_tokens, keep=False)
    return blocks.join_back(cut, blocks.per_shard(cut, work), back, "doc_id long, ids array<int>")


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices start[i] ... start[i] + n[i] - 1, one run after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + n, n)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids; null for null. An id outside the table fails."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token

    @F.arrow_udf("binary")
    def joined(x: pa.Array) -> pa.Array:
        flat, ends = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(x.value_lengths().fill_null(0).to_numpy()).tolist()
        return pa.array([None if m else b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b, m in zip([0, *ends], ends, x.is_null().to_pylist())], pa.binary())

    return joined(ids)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Ids and decoded bytes of each document as lengths and SHA-256."""
    ids = encode(docs, ranks, pattern).withColumn("decoded", decode(F.col("ids"), ranks))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
