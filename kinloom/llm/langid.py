"""Language identification by a string kernel.

The kernel of two texts counts the byte n-grams (sizes SIZES, blended) that both have, divided by the geometric mean of
how many each has. LANDMARKS labelled texts, some of each language, span a Nyström space, in which kernel ridge regression is fitted for each
language against the rest on at most SAMPLE labelled texts of each language (by a hash of the id; fewer of each where there are so many languages that these
were more than SAMPLES in all, but one at least). As the kernel is linear in a text's n-gram
presences, the landmarks' coefficients are folded into a weight for each n-gram, and batches of presence rows are multiplied by them.

Null texts and texts without a letter are `und` with score 0, as are all texts where no language was learnt. The score is the
best language's share after a softmax. Repeated and null ids are kept. Every language of the training rows can be predicted, whatever its texts' lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES = (1, 2, 3)
SAMPLE, SAMPLES, LANDMARKS, RIDGE, SHARPNESS = 400, 20_000, 300, 1e-2, 6.0
#: Characters of a landmark or training text; a longer one stands for itself by so many characters in a row, from a place that its id's hash gives.
SAMPLE_CHARS = 20_000
SPACE = 1 << 24
LETTER = regex.compile(r"\p{L}")


def codes(text: str) -> np.ndarray:
    """Codes of a text's n-grams, with repeats; sizes 1 and 2 are told from 3 by zero bytes before them."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int32)
    parts = [b]
    if len(b) > 1:
        parts.append(b[:-1] << 8 | b[1:])
    if len(b) > 2:
        parts.append(b[:-2] << 16 | b[1:-1] << 8 | b[2:])
    return np.concatenate(parts)


class Model:
    """Weights of known n-grams for each language; `known` maps an n-gram's code to its row."""

    def __init__(self, langs: list[str], codes_: np.ndarray, weights: np.ndarray):
        self.langs, self.codes, self.weights, self.known = langs, codes_, weights, None

    def __getstate__(self):
        return {**self.__dict__, "known": None}

    def predict(self, texts: list[str | None], at_once: int = 64) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return lang, score
        if self.known is None:
            self.known = np.full(SPACE, len(self.codes), np.int32)
            self.known[self.codes] = np.arange(len(self.codes))
        told = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        for a in range(0, len(told), at_once):
            part = told[a : a + at_once]
            presence, n = np.zeros((len(part), len(self.codes) + 1), np.float32), np.zeros(len(part))
            for i, k in enumerate(part):
                c = codes(texts[k])
                presence[i, self.known[c]] = 1
                c.sort()
                n[i] = 1 + np.count_nonzero(c[1:] != c[:-1])
            z = presence[:, :-1] @ self.weights / np.sqrt(n)[:, None]
            p = np.exp(SHARPNESS * (z - z.max(1, keepdims=True)))
            best, p = z.argmax(1), p / p.sum(1, keepdims=True)
            for i, k in enumerate(part):
                lang[k], score[k] = self.langs[best[i]], float(p[i, best[i]])
        return lang, score


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 1) -> Model:
    keep = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
    names = sorted({langs[k] for k in keep})
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    sets = [np.unique(codes(texts[k])) for k in keep]
    y = np.array([[1.0 if langs[k] == name else -1.0 for name in names] for k in keep])
    order, each = np.random.default_rng(seed).permutation(len(keep)), max(2, -(-landmarks // len(names)))
    own = np.array([names.index(langs[k]) for k in keep])[order]
    chosen = np.sort(np.concatenate([order[own == j][:each] for j in range(len(names))]))
    vocabulary = np.unique(np.concatenate([sets[k] for k in chosen]))

    def rows(which) -> np.ndarray:
        m = np.zeros((len(which), len(vocabulary)), np.float32)
        for i, k in enumerate(which):
            at = np.searchsorted(vocabulary, sets[k])
            at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == sets[k])]
            m[i, at] = 1 / np.sqrt(len(sets[k]))
        return m

    z = rows(chosen)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    ok = values > 1e-6 * values.max()
    root = vectors[:, ok] / np.sqrt(values[ok])  # K_zz ** -1/2
    x = np.concatenate([rows(range(a, min(a + 256, len(keep)))) @ z.T for a in range(0, len(keep), 256)]) @ root
    alpha = root @ np.linalg.solve(x.T @ x + ridge * len(keep) * np.eye(x.shape[1]), x.T @ y)
    return Model(names, vocabulary.astype(np.int64), (z.T @ alpha).astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, samples: int = SAMPLES) -> Model:
    """docs (doc_id, text, lang). Two scans, whatever the number of languages: one counts them, one takes the sample."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    count = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not count:
        return fit([], [])
    sample = max(1, min(sample, samples // len(count)))
    # a bound on hashes that leaves about twice the sample of each language, so that neither the sort nor its task gets all rows of one
    bounds = docs.sparkSession.createDataFrame([(lang, min((1 << 63) - 1, int((min(1, (2 * sample + 20) / n) - 0.5) * 2**64))) for lang, n in sorted(count.items())], "lang string, bound long")
    key = F.xxhash64("doc_id")
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.length("text") - F.lit(chars - 1)).cast("int") + 1
    docs = docs.withColumn("text", F.when(F.length("text") > chars, F.substring("text", place, F.lit(chars))).otherwise(F.col("text")))
    near = docs.join(F.broadcast(bounds), "lang").filter(key <= F.col("bound"))  # a row for each language
    once = near.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.*")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id"))
    rows = sorted(once.withColumn("n", first).filter(F.col("n") <= sample).select("doc_id", "text", "lang").collect())
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(text: Column, model: Model) -> Column:
    """struct(lang, score) of a text."""

    def told(x: pa.Array) -> pa.Array:
        lang, score = model.predict(x.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return F.arrow_udf(told, "struct<lang:string,score:double>")(text)
