"""Periodic runs in the words of a text, after Kolpakov and Kucherov.

A run is a stretch of words with smallest period q, at least max(LEAST, 2 * q) long, that no neighbouring word extends. Words of a run match
those q further over max(q, LEAST - q) words or more, so all of them lie in sequences of LEAST / 2 words that the text has more than once: texts
are cut at the other words first, by sorted hashes of a batch, and most have nothing left. Equal hashes of unequal sequences only leave more.
Each stretch that is left is worked out by itself: a suffix automaton gives its LZ factors (the longest prefix of the rest that begins earlier, overlaps allowed,
or a new word) and their earlier places. Main's algorithm finds the runs that touch the boundary before a factor and end in it: by longest common extensions (Z arrays)
for each period, within the factor and twice the former one and this one before it, which no such run exceeds. What isn't maximal there belongs to a later boundary or is
no run. Runs strictly inside a factor are copied from its earlier place, in ascending order, so copies of copies follow.
Time and memory are linear in a text's words, in one task; nothing is shuffled.

Words are what ASCII white space separates, as they are. Null and empty texts have no words and no runs. Rows are kept one by one, whatever their ids, with their
other columns dropped; a null id counts as an empty text for the checksum. Without rows there is no result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, mix64, release

LEAST = 12
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def factors(w: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, earlier start or -1) of the LZ factors of w, by its suffix automaton."""
    after: list[dict[int, int]] = [{}]
    longest, link, first_end = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(after)
        after.append({})
        longest.append(i + 1)
        link.append(0)
        first_end.append(i)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(after)
                after.append(after[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                first_end.append(first_end[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    i, n = 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            to = after[state].get(w[j])
            if to is None or first_end[to] >= j:  # it doesn't end earlier
                break
            state, j = to, j + 1
        if j == i:
            yield i, 1, -1
            i += 1
        else:
            yield i, j - i, first_end[state] - (j - i) + 1
            i = j


def z_array(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of s and its rest from there."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def at_boundary(w: list[int], lo: int, b: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of stretches of w[lo:hi] that touch b and are at least two periods long, as far as they reach in there."""
    t, u = w[lo:b], w[b:hi]
    m, n = len(t), len(u)
    ahead = z_array([*u, -1, *t, *u])  # common prefixes with u: of its own rests, and of those of t + u
    behind = z_array([*t[::-1], -1, *u[::-1], *t[::-1]]) if m else []  # common suffixes with t, likewise
    for p in range(1, n + 1):  # the next period begins at b + p
        right = ahead[p] if p < n else 0
        left = min(behind[m + 1 + n - p], m) if m else 0  # of t and w[..b + p]
        if left + right >= p and left + right + p >= LEAST:
            yield b - left, b + p + right, p
    for p in range(1, m + 1):  # the former one at b - p
        right = min(ahead[n + 1 + m - p], n)
        left = behind[p] if p < m else 0
        if left + right >= p and left + right + p >= LEAST:
            yield b - p - left, b + right, p


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of w that are LEAST long or more, ascending."""
    n, found, former = len(w), {}, 0  # the least period of each
    starts: dict[int, list[tuple[int, int]]] = {}

    def add(s: int, e: int, p: int) -> None:
        if (s, e) not in found:
            starts.setdefault(s, []).append((s, e))
            found[s, e] = p
        elif p < found[s, e]:
            found[s, e] = p

    for b, length, earlier in (*factors(w), (n, 0, -1)):  # the end is a boundary, too
        hi, back = b + length, 2 * former + length
        if b and min(back, b) + length >= LEAST:
            for s, e, p in at_boundary(w, max(0, b - back), b, hi):
                if (s == 0 or w[s - 1] != w[s - 1 + p]) and (e == n or w[e] != w[e - p]):
                    add(s, e, p)
        if earlier >= 0 and found and length > LEAST + 1:
            by = b - earlier
            for s in range(earlier + 1, earlier + length - LEAST):
                for run in starts.get(s, ()):
                    if run[1] < earlier + length:
                        add(s + by, run[1] + by, found[run])
        former = length
    return sorted((s, e, p) for (s, e), p in found.items())


def repeated(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words of several texts (numbers; where each text ends) lie in sequences of LEAST / 2 words that their text has more than once."""
    k, n = LEAST // 2, len(words)
    covered = np.zeros(n + 1, np.int64)
    if n < k:
        return covered[:n] > 0
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    x = mix64(words.astype(np.uint64) + np.uint64(1))
    h = mix64(text[: n - k + 1].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15 + 2) + x[i : n - k + 1 + i]
    h = mix64(h)
    at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
    order = at[np.argsort(h[at])]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered[order[twice]] += 1
    np.subtract.at(covered, order[twice] + k, 1)
    return np.cumsum(covered[:n]) > 0


def stretches(words: list[int], covered: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of a text: those of its covered stretches."""
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()
    return [(a + s, a + e, p) for a, z in zip(edges[::2], edges[1::2]) if z - a >= LEAST for s, e, p in runs(words[a:z])]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The text without the words that follow the first period of a run they are in."""
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, [s + p for s, _, p in found], 1)
        np.subtract.at(drop, [e for _, e, _ in found], 1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def find(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of documents (doc_id, text): their runs by start, then period, and the text without repetitions.
    prepare(doc_id, words) may give other words."""

    def run(it):
        for batch in it:
            ids, words = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1)):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words.append(prepare(doc_id, own) if prepare and own else own)
            codes = []
            for own in words:
                seen = Ids()
                codes.append([seen[x] for x in own])
            ends = np.cumsum([len(x) for x in codes])
            covered = repeated(np.fromiter((c for x in codes for c in x), np.int64, int(ends[-1]) if len(ends) else 0), ends)
            found = [stretches(x, covered[e - len(x) : e]) for x, e in zip(codes, ends.tolist())]
            told = [[{"start": s, "length": e - s, "period": p} for s, e, p in sorted(x, key=lambda r: (r[0], r[2]))] for x in found]
            columns = [ids, [len(x) for x in words], told, [collapsed(*x) for x in zip(words, found)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DDL)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text by checksum gets a tail that repeats."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * -(-(n - a) // p))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """The columns of op13 from what find() gives: the longest run (ties: smallest start, then period) and hashes of all."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return told.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
