"""Cost-balanced packing of documents into training sequences.

The cost of a piece is estimated as LINEAR * length + QUADRATIC * length**2 (attention). A group of documents, closed at
GROUP tokens, opens the sequences that its tokens fill: full ones, and for what is left over one for each power of two in it,
as such lengths are not padded. Pieces go in descending cost to the sequence of the lowest cost with room for them; a document
longer than a sequence is cut into full pieces first, and a piece that fits nowhere is cut to fill the cheapest sequence.
So no group has any padding.

Tokens of a document: its text's ids as the tokenizers library gives them (a special token's string in a text is that token), then END. Null and empty texts are that one id. Repeated and null ids are packed as they come.
A group's documents come from one partition, and no row is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

SEQUENCE, END = 2048, 1
LINEAR, QUADRATIC = 1.0, 1 / 2048
GROUP = 1_000_000
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(ranks: dict[bytes, int], pattern: str, specials: dict[str, int] | None = None):
    encoding, specials = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials or {}), specials or {}

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        return encoding.encode(text, allowed_special="all") if any(x in text for x in specials) else encoding.encode_ordinary(text)

    return encode


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def read_specials(path: str) -> dict[str, int]:
    """Strings and ids of the tokens that a tokenizer's file adds to its vocabulary."""
    with open(path) as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


def capacities(total: int, size: int) -> list[int]:
    """Room of the sequences that so many tokens fill without padding."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def place(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    room = capacities(sum(lengths), size)
    used, spent = [0] * len(room), [0.0] * len(room)
    heap = []  # pieces in descending length: (-length, document, start)
    for k, n in enumerate(lengths):
        heap += [(-min(size, n - a), k, a) for a in range(0, n, size)]
    heapq.heapify(heap)
    open_ = np.array(room, np.int64)
    costs = np.zeros(len(room))
    out = []
    while heap:
        n, k, a = heapq.heappop(heap)
        n = -n
        fits = np.flatnonzero(open_ >= n)
        if not len(fits):  # cut it to fill the cheapest sequence that has room
            fits = np.flatnonzero(open_ > 0)
            s = int(fits[costs[fits].argmin()])
            heapq.heappush(heap, (-(n - int(open_[s])), k, a + int(open_[s])))
            n = int(open_[s])
        else:
            s = int(fits[costs[fits].argmin()])
        out.append((k, a, n, s, used[s]))
        used[s] += n
        open_[s] -= n
        costs[s] += cost(n)
    return out


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, size: int = SEQUENCE, end: int = END, group: int = GROUP, specials: dict[str, int] | None = None) -> DataFrame:
    """A row for each piece, with its ids."""

    def rows(it):
        encode, number = encoder(ranks, pattern, specials), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

        def packed(held):
            nonlocal number
            for k, a, n, s, at in place([len(x) for _, x in held], size):
                doc_id, ids = held[k]
                part = ids[a : a + n]
                yield doc_id, a, n, part.view(np.int32), zlib.crc32(part.tobytes()), len(ids), number + s, at
            number += sum(len(x) for _, x in held) // size + size.bit_length()

        held, total = [], 0
        for batch in it:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), end], dtype="<u4")
                held.append((doc_id, ids))
                total += len(ids)
                if total >= group:
                    yield from packed(held)
                    held, total = [], 0
        if held:
            yield from packed(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: batches(rows(it), _ROWS), DDL)
