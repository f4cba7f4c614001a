"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed character n-grams and of itself; a window is the mean of its words; two
classes are told apart by a linear softmax over it, so a misspelt word shares most of its vectors with the word meant.
A text's bag holds each of its words once, in order of first use, and its score is that of the most toxic window of WINDOW of
them: a few words in a very long text count, and a harmless word doesn't add up by being repeated. In training,
a text stands for its most toxic window, by log odds of the n-grams at first and by the model itself in later rounds, and a clean one for any other as well.
n-grams of fewer than LEAST texts take no part, as each text's own rare words would be learnt by heart. A fit on two thirds of the sample tells how far the bias has to
be lowered for the clean texts of the last third.

The fit takes at most SAMPLE labelled texts of each class (by a hash of the id) of at most SAMPLE_CHARS characters each.
Labels without a document, or documents without a label, do not matter to it. Null and empty texts get 0.
Rows, repeated and null ids included, are all scored. With fewer than two classes in the sample the score is 0 everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import Ids, release, sample_ids, tokens

BUCKETS, SIZES, DIM = 1 << 16, (5, 7), 8
WINDOW, STEP = 2, 1
SAMPLE, SAMPLE_CHARS = 1_500, 60_000
#: Buckets of fewer texts than LEAST stay at nothing, and embeddings shrink by DECAY a step, as else each text's own rare words are learnt by heart.
LEAST, DECAY, ROUNDS, EPOCHS = 4, 1e-3, 6, 2
THRESHOLD, ALARMS = 0.3, 0.02


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over n words."""
    start = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    return start, np.minimum(start + WINDOW, n)


def bag(text: str | None, seen: Ids) -> np.ndarray:
    """Numbers of a text's distinct words in order of first use."""
    words = dict.fromkeys(tokens(text))
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


class Model:
    """Per-bucket logits (embedding times the softmax's direction), and the bias."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias

    def heights(self, parts: list[np.ndarray], words: list[bytes]) -> list[float]:
        """Logits of the most toxic windows, minus infinity without words."""
        each, out = grams.means(words, self.logits, SIZES), []
        for p in parts:
            if not len(p):
                out.append(-np.inf)
                continue
            a, b = windows(len(p))
            s = np.concatenate([[0.0], np.cumsum(each[p])])
            out.append(float(((s[b] - s[a]) / np.maximum(b - a, 1)).max()) + self.bias)
        return out

    def score(self, parts: list[np.ndarray], words: list[bytes]) -> list[float]:
        return [1 / (1 + np.exp(-z)) if z > -700 else 0.0 for z in self.heights(parts, words)]


def support(at: np.ndarray, first: np.ndarray, parts: list[np.ndarray], labels: np.ndarray, step: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """How many clean and toxic texts have each bucket, a few texts at a time. at, first: buckets of each word; parts: words of each text."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for k in range(0, len(parts), step):
        w = np.concatenate(parts[k : k + step])
        n = first[w + 1] - first[w]
        text = np.repeat(np.repeat(np.arange(k, k + len(parts[k : k + step])), [len(p) for p in parts[k : k + step]]), n)
        pairs = np.unique(text * BUCKETS + at[np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        for y in (0, 1):
            seen[y] += np.bincount(pairs[labels[pairs // BUCKETS] == y] % BUCKETS, minlength=BUCKETS)
    return seen[0], seen[1]


def log_odds(clean: np.ndarray, toxic: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smoothed log odds of the buckets' text counts, over their standard error; 0 for those of too few texts."""
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    z = np.log((toxic + 0.5) / (n1 - toxic + 0.5)) - np.log((clean + 0.5) / (n0 - clean + 0.5))
    z /= np.sqrt(1 / (toxic + 0.5) + 1 / (n1 - toxic + 0.5) + 1 / (clean + 0.5) + 1 / (n0 - clean + 0.5))
    return np.where(clean + toxic >= LEAST, z, 0)


def gradients(e, v, c, f, of, share, y):
    """Mean loss of windows, the buckets in use, and the gradients of their embeddings, of the softmax and of its bias. f, of, share: a bucket, its window
    and its weight there; y: the windows' classes."""
    x = np.stack([np.bincount(of, e[f, d] * share, len(y)) for d in range(e.shape[1])], 1).astype(np.float32)
    z = x @ v + c
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).mean()
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    gx = p @ v.T
    used, back = np.unique(f, return_inverse=True)
    ge = np.stack([np.bincount(back, gx[of, d] * share, len(used)) for d in range(e.shape[1])], 1).astype(np.float32)
    return loss, used, ge, x.T @ p, p.sum(0)


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS, epochs: int = EPOCHS, decay: float = DECAY, seed: int = 1) -> Model:
    labels = np.array(labels)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -1e4)
    rng, seen = np.random.default_rng(seed), Ids()
    parts = [bag(t, seen) for t in texts]
    words = list(seen)
    at, n = [], []  # buckets of each word, one word after another
    for k in range(0, len(words), 20_000):
        part, of = grams.hashed(words[k : k + 20_000], SIZES, BUCKETS)
        at.append(part[np.argsort(of, kind="stable")].astype(np.int32))
        n.append(np.bincount(of, minlength=len(words[k : k + 20_000])))
    at, first = np.concatenate(at or [np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(np.concatenate(n or [np.zeros(0, np.int64)]))]).astype(np.int64)
    doc, lo, hi = [], [], []  # windows
    base, flat = 0, np.concatenate(parts)
    for k, p in enumerate(parts):
        a, b = windows(len(p))
        doc.append(np.full(len(a), k))
        lo.append(a + base)
        hi.append(b + base)
        base += len(p)
    doc, lo, hi = map(np.concatenate, (doc, lo, hi))
    bounds = np.searchsorted(doc, np.arange(len(parts) + 1))
    clean, toxic = support(at, first, parts, labels)
    known = clean + toxic >= LEAST
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32) * known[:, None]
    v = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    c = np.zeros(2, np.float32)
    se, sv, sc = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def step(chosen: np.ndarray) -> None:
        nonlocal e, v, c
        n = hi[chosen] - lo[chosen]
        w = flat[np.repeat(lo[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        of_w = np.repeat(np.arange(len(chosen)), n)
        k = first[w + 1] - first[w]
        f = at[np.repeat(first[w] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        share = np.repeat(1 / (np.maximum(n, 1)[of_w] * k), k).astype(np.float32)
        _, used, ge, gv, gc = gradients(e, v, c, f, np.repeat(of_w, k), share, labels[doc[chosen]])
        se[used] += ge**2
        e[used] = (e[used] - 0.3 * ge / np.sqrt(se[used])) * (1 - decay) * known[used, None]
        sv[:] += gv**2
        v -= 0.1 * gv / np.sqrt(sv)
        sc[:] += gc**2
        c -= 0.1 * gc / np.sqrt(sc)

    for r in range(rounds):
        # a text stands for its most toxic window, by log odds at first; clean texts also for any other
        w = _of_words(log_odds(clean, toxic, labels), at, first) if r < 1 else _of_words(e @ (v[:, 1] - v[:, 0]), at, first)
        s = np.concatenate([[0.0], np.cumsum(w[flat])])
        z = (s[hi] - s[lo]) / np.maximum(hi - lo, 1)
        top = np.lexsort((z, doc))[bounds[1:] - 1]
        other = bounds[:-1] + (rng.random(len(parts)) * np.diff(bounds)).astype(np.int64)
        chosen = np.concatenate([top, other[labels == 0]])
        for _ in range(epochs):
            for chunk in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 128)):
                step(chunk)
    return Model((e @ (v[:, 1] - v[:, 0])).astype(np.float32), float(c[1] - c[0]))


def fit_held(texts: list[str], labels: list[int], seed: int = 1) -> Model:
    """A fit whose bias is lowered as far as one without a third of the texts needs it to report a share of ALARMS of that third's clean ones at most."""
    model, apart, labels = fit(texts, labels, seed=seed), np.random.default_rng(seed).random(len(texts)) < 1 / 3, np.array(labels)
    clean = np.flatnonzero(apart & (labels == 0))
    if not len(clean) or len(set(labels[~apart].tolist())) < 2:
        return model
    other, seen = fit([t for t, out in zip(texts, apart) if not out], labels[~apart].tolist(), seed=seed), Ids()
    parts = [bag(texts[k], seen) for k in clean]
    z = np.quantile(np.maximum(other.heights(parts, list(seen)), -1e9), 1 - ALARMS)
    return Model(model.logits, model.bias - max(0.0, float(z) - float(np.log(THRESHOLD / (1 - THRESHOLD)))))


def _of_words(buckets: np.ndarray, at, first) -> np.ndarray:
    """Means of the buckets' values over the words."""
    s = np.concatenate([[0.0], np.cumsum(buckets[at].astype(np.float64))])
    return (s[first[1:]] - s[first[:-1]]) / np.maximum(np.diff(first), 1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic). Only the sample's texts go to the driver."""
    label = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = None
    for y in (0, 1):
        part = sample_ids(label.filter(F.col("toxic") == y), sample)
        ids = part if ids is None else ids.unionByName(part)
    ids = docs.sparkSession.createDataFrame(ids.collect(), "doc_id long, toxic int")  # 2 * sample rows at most
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.length("text") <= chars).join(F.broadcast(ids), "doc_id")
    rows = sorted(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect())
    texts, marks = [r["text"] for r in rows], [r["toxic"] for r in rows]
    del rows
    model = fit_held(texts, marks)
    release()
    return model


def score(text: Column, model: Model) -> Column:
    """Toxicity of a text, from 0 to 1."""

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        out, parts, seen, n = [], [], Ids(), 0
        for t in x:
            parts.append(bag(t.as_py(), seen))
            n += len(parts[-1])
            if n >= 300_000:
                out += model.score(parts, list(seen))
                parts, seen, n = [], Ids(), 0
        out += model.score(parts, list(seen))
        release()
        return pa.array(out, pa.float64())

    return scored(text)
