"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Each word gives its hashed character n-grams and itself to a bag of BUCKETS hashed features. The raw multinomial counts the
features of all documents, the target those of all trusted ones, whose texts are found by a join of ids. A document's
score is the mean of log(target / raw) over its features, so that length doesn't count. A fixed share (LOST) of the trusted documents
falls short of a score; the threshold is as far below that as that is below their median. Every document is held against it.

Null and empty texts have no words: all counts and the score are 0 and the base rules reject them. Repeated and null ids are kept.
With no trusted document the ratio is 0 everywhere and only the base rules reject.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import Ids, batches, checkpoint, flagged, mix64

BUCKETS, SIZES = 1 << 16, (1, 2, 3)
LOST = 0.003
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: Words that are gathered before the work on distinct ones is done.
CHUNK = 500_000
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
SPACES = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))
CHARACTERS = ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)) & ~SPACES


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more. ids: a 64-bit hash of each word."""
    m = len(ids) - window + 1
    if m < 2:
        return 0
    key = np.zeros(m, np.uint64)
    for j in range(window):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + m])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\r\v\f"):
            n += line in seen
            seen.add(line)
    return n


def _chunks(it):
    """(ids, texts, word numbers of each, distinct words) of about CHUNK words at a time."""
    ids, texts, parts, seen, n = [], [], [], Ids(), 0
    for batch in it:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            words = text.encode().split()
            ids.append(doc_id)
            texts.append(text)
            parts.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
            n += len(words)
            if n >= CHUNK or len(ids) >= CHUNK // 4:
                yield ids, texts, parts, list(seen)
                ids, texts, parts, seen, n = [], [], [], Ids(), 0
    if ids:
        yield ids, texts, parts, list(seen)


def _counts(it):
    sums = np.zeros(BUCKETS)
    for _, _, parts, words in _chunks(it):
        at, of = grams.hashed(words, SIZES, BUCKETS)
        n = np.bincount(np.concatenate(parts), minlength=len(words))
        sums += np.bincount(at, n[of], BUCKETS)
    used = np.flatnonzero(sums)
    if len(used):
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "n": sums[used].astype(np.int64)})


def _counted(docs: DataFrame) -> np.ndarray:
    """How often each bucket's features are found, and half a count. The driver gets a row for each bucket."""
    rows, out = docs.mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas(), np.full(BUCKETS, 0.5)
    out[rows["bucket"]] += rows["n"]
    return out


def ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, over all documents and all those with a trusted doc_id. Texts that a filter of ids rules out aren't shuffled;
    the ids are never broadcast, as they grow with the documents."""
    may = flagged(docs, F.col("doc_id"), trusted, "maybe").filter("maybe").drop("maybe")
    target = _counted(may.join(trusted.hint("merge"), "doc_id", "left_semi"))
    if target.sum() == BUCKETS / 2:
        return np.zeros(BUCKETS)
    raw = _counted(docs)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def percentiles(values: DataFrame, shares: tuple[float, ...]) -> list[float] | None:
    """Exact percentiles, between two values as Spark's percentile() has them, of the one column of doubles; null without any. The values are
    sorted by ranges and those at the ranks picked from their partitions, so no task has them all."""
    c = values.columns[0]
    ordered = checkpoint(values.orderBy(c))
    counts = dict(ordered.groupBy(F.spark_partition_id().alias("part")).count().collect())
    total = sum(counts.values())
    if not total:
        return None
    spots = [share * (total - 1) for share in shares]
    ranks, name, before = sorted({int(f(x)) for x in spots for f in (np.floor, np.ceil)}), {}, 0
    for part in sorted(counts):  # a row's id: its partition in the upper bits, its place there in the lower 33
        name |= {(part << 33) + k - before: k for k in ranks if before <= k < before + counts[part]}
        before += counts[part]
    found = {name[r["at"]]: r[c] for r in ordered.withColumn("at", F.monotonically_increasing_id()).filter(F.col("at").isin(*name)).collect()}
    return [found[int(np.floor(x))] + (x - np.floor(x)) * (found[int(np.ceil(x))] - found[int(np.floor(x))]) for x in spots]


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("score", pa.float64())])


def _scores(ratio: np.ndarray):
    def rows(it):
        for ids, texts, parts, words in _chunks(it):
            at, of = grams.hashed(words, SIZES, BUCKETS)
            total, n = np.bincount(of, ratio[at], len(words)), np.bincount(of, minlength=len(words))
            keys = mix64(np.arange(1, len(words) + 1, dtype=np.uint64))
            for doc_id, text, p in zip(ids, texts, parts):
                c = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
                score = float(total[p].sum() / n[p].sum()) if len(p) else 0.0
                yield doc_id, len(p), int(c[CHARACTERS].sum()), int(c[SYMBOLS].sum()), repeated_lines(text), repeated_words(keys[p]), score

    return lambda it: batches(rows(it), _ROWS)


def judge(docs: DataFrame, labels: DataFrame, lost: float = LOST) -> DataFrame:
    """Counts, score, base_failed and kept of each document. Trusted: quality 1 in labels (doc_id, quality)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    scored = checkpoint(docs.mapInArrow(_scores(ratios(docs, trusted)), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    at = percentiles(scored.filter("NOT base_failed").join(trusted, "doc_id", "left_semi").select("score"), (lost, 0.5))
    least = float("-inf") if at is None else at[0] - (at[1] - at[0])
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))
