"""LM scoring by a probabilistic suffix tree over tokens.

Tokens are words (A-Z lower-cased), then one end for each text; a token that isn't in training is the symbol "unknown".
A sequence of up to DEPTH + 1 tokens is a candidate if training has it LEAST times, whatever the size of the corpus, so the tree
grows with it. A candidate is a context, and a state of the tree if the distribution
of its next symbol diverges from that of its suffix, count * KL(context || suffix) >= DIVERGENCE * ln(N), or if a longer
state ends in it. Contexts don't reach back beyond their text.

The root gives a token (c - D) / N and "unknown" what is left, D * V / N, with absolute discounting (D = n1 / (n1 + 2 * n2) by
the tokens found once and twice, half where either is missing). A state s gives a candidate's last token (count + MU * P_suffix) / (count(s) + MU) and shares out the rest as its suffix does.
Each token is scored by the longest state that its history ends in. The distribution over the V + 1 symbols sums to 1.

Counts run over all training documents: words are counted by blocks and shards (see blocks), longer sequences a length at a time, by
64-bit hashes: a block sends a shard each distinct sequence whose two parts are candidates once, with its count, and gets back which ones
are candidates and how often they are found. So a block works out the probabilities of its own candidates by itself; for each candidate, one block adds to the sums of
its context by which that is tested. The states are a table partitioned by hash; to score, a block asks the shards for the contexts that it has. Neither
the driver nor a broadcast holds any of it.

Null and empty texts are one end. Repeated and null ids are kept. Without training documents every token is unknown, with probability 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import checkpoint, collect_garbage, crc_mod_py, dealt, mix64, pack, shards_for, tokens, unpack

#: No word has this byte.
STOP = b"\n"
#: LEAST: no share of the training tokens is asked of a candidate; its count decides.
DEPTH, LEAST, DIVERGENCE, MU = 3, 3, 2.0, 4.0
#: Kinds of answers to a block, beside its candidates of two tokens or more (by their number of contexts' tokens).
WORDS, VALUES = 0, DEPTH + 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[bytes]:
    return [*tokens(text), STOP]


def find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of x in a sorted array, -1 where it isn't."""
    if not len(sorted_):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def back_by(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each position's predecessor in its text, -1 at the first."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = -1
    return out


def shards_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """Each hash's shard, which grows with the hash."""
    return ((codes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, ascending, a place of each, and the number of the value at each place."""
    order = np.argsort(codes)
    sorted_ = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    number = np.empty(len(codes), np.int64)
    number[order] = np.cumsum(new) - 1
    return sorted_[new], order[new], number


def steps(codes: np.ndarray) -> np.ndarray:
    """Ascending hashes as the bytes of their differences, high ones together, as most of those are 0."""
    return np.ascontiguousarray(np.diff(codes, prepend=codes[:0] if not len(codes) else np.zeros(1, np.uint64)).view(np.uint8).reshape(-1, 8).T).ravel()


def from_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


class Block:
    """A block's tokens and what shards answered: the words' counts in training and, by length, which sequences are candidates."""

    def __init__(self, data: bytes, answers: pd.DataFrame, mask: np.uint64):
        self.ids, self.lengths, self.tokens, self.used, self.hashes = blocks.open_block(data)
        self.hashes, self.mask = self.hashes & mask, mask
        self.first = np.cumsum(self.lengths) - self.lengths
        got = answers.sort_values("shard")
        self.answers: dict[int, list[bytes]] = {}
        for shard, answer in zip(got["shard"], got["data"]):
            self.answers.setdefault(shard >> 16, []).append(answer)
        self.count = np.concatenate([unpack(x, np.uint32)[0] for x in self.answers.get(WORDS, ())] or [np.zeros(0, np.uint32)])

    def lengths_of(self, depth: int):
        """For each length of sequence from two tokens on: (places where one ends, distinct hashes, each one's first place, the number of
        the hash at each place, hashes of the parts without the first or last token at any place)."""
        word = self.hashes[self.tokens]
        ok, code = (self.count >= LEAST)[self.tokens], word
        for k in range(1, depth + 1):
            before = back_by(np.where(ok, 1, -1), self.first) > 0
            at = np.flatnonzero(before & ok)
            own, where, number = distinct(mix64(code[at - 1] * _GOLD + word[at]) & self.mask)
            yield at, own, at[where], number, code
            if k < depth:
                kept = self.kept(k)[0][number] > 0
                ok, code = np.zeros(len(word), bool), code.copy()
                ok[at[kept]], code[at[kept]] = True, own[number[kept]]

    def kept(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct sequence of k + 1 tokens, whether it is a candidate (2: this block reports it), and its count if it is."""
        parts = [unpack(x, np.uint8, np.int64) for x in self.answers.get(k, ())]
        kept, n = (np.concatenate([x[j] for x in parts] or [np.zeros(0, d)]) for j, d in ((0, np.uint8), (1, np.int64)))
        count = np.zeros(len(kept), np.int64)
        count[kept > 0] = n
        return kept, count

    def contexts(self, lengths: list) -> tuple[np.ndarray, list[int]]:
        """Hashes of the candidates of up to DEPTH tokens that the block has, by length, and where each length ends."""
        parts = [self.hashes[self.count >= LEAST], *(x[1][self.kept(k)[0] > 0] for k, x in enumerate(lengths, 1) if k < DEPTH)]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts]).tolist()

    def learn(self, lengths: list, total: int, discount: float):
        """For each length from two tokens on: which of its distinct sequences are candidates (2: reported here), counts and probabilities of their
        last tokens; and counts and probabilities at each place of the sequences that are one token shorter."""
        n = np.where(self.count >= LEAST, self.count, 0)[self.tokens].astype(np.float64)
        p = np.maximum(n - discount, 1e-9) / max(total, 1)
        for k, (at, _, where, number, _) in enumerate(lengths, 1):
            kept, count = self.kept(k)
            own = (count + MU * p[where]) / (n[where - 1] + MU)
            yield kept, count, own, n, p
            if k < DEPTH:
                n, p = np.zeros(len(n)), np.zeros(len(p))
                n[at], p[at] = count[number], np.where(kept > 0, own, 0)[number]

    def sums(self, total: int, discount: float) -> pd.DataFrame:
        """What the candidates that this block reports add to the sums of their contexts, and the hashes of these and of their suffixes."""
        lengths, out = list(self.lengths_of(DEPTH)), []
        for k, ((kept, count, _, n, p), (_, _, where, _, code)) in enumerate(zip(self.learn(lengths, total, discount), lengths), 1):
            mine = np.flatnonzero(kept == 2)
            at = where[mine]
            ctx, first, which = distinct(code[at - 1])
            c, ctx_n, low = count[mine].astype(np.float64), n[at - 1], p[at]
            add = lambda x: np.bincount(which, x, len(ctx))
            shorter = [lengths[j][4][at[first] - 1].view(np.int64) for j in range(k - 2, -1, -1)]
            shorter += [np.zeros(len(ctx), np.int64)] * (DEPTH - 1 - len(shorter))
            out.append(pd.DataFrame({"k": np.full(len(ctx), k, np.int32), "ctx": ctx.view(np.int64), **{f"suf{j}": x for j, x in enumerate(shorter)}, "ctx_n": ctx_n[first], "seen": add(c), "seen_low": add(low), "kl": add(c * np.log(c / ctx_n / low))}))
        return pd.concat(out)

    def score(self, root: np.ndarray, total: int, discount: float) -> np.ndarray:
        """log10 probability at each position; root: that of the tokens alone."""
        lengths = list(self.lengths_of(DEPTH))
        codes, ends = self.contexts(lengths)
        values = np.full(len(codes), np.nan)
        got = [unpack(x, np.uint8, np.float32) for x in self.answers.get(VALUES, ())]
        told = np.full(sum(len(x[0]) for x in got), np.nan)
        told[np.concatenate([x[0] for x in got] or [np.zeros(0, np.uint8)]) > 0] = np.concatenate([x[1] for x in got] or [np.zeros(0)])
        values[np.argsort(codes, kind="stable")] = told
        passing = np.full(len(self.count), np.nan)
        passing[self.count >= LEAST] = values[: ends[0]]
        left, logp = [passing[self.tokens]], [None]
        for k, ((kept, _, own, _, _), (at, _, _, number, _)) in enumerate(zip(self.learn(lengths, total, discount), lengths), 1):
            out = np.full(len(self.tokens), np.nan)
            out[at] = np.where(kept > 0, np.log10(own), np.nan)[number]
            logp.append(out)
            if k < DEPTH:
                passing = np.full(len(kept), np.nan)
                passing[kept > 0] = values[ends[k - 1] : ends[k]]
                out = np.full(len(self.tokens), np.nan)
                out[at] = passing[number]
                left.append(out)
        out, alive = np.zeros(len(self.tokens)), np.ones(len(self.tokens), bool)
        for k in range(DEPTH, 0, -1):  # states of k tokens before the position
            passed = np.concatenate([[np.nan], left[k - 1][:-1]])
            passed[self.first] = np.nan
            at = alive & ~np.isnan(passed)
            hit = at & ~np.isnan(logp[k])
            out[hit] += logp[k][hit]
            alive &= ~hit
            out[at & ~hit] += passed[at & ~hit]
        out[alive] += root[alive]
        return out


def mask_for(shards: int) -> np.uint64:
    """Bits of a hash that go through shuffles: 48 for up to 1,024 shards (64 GB), 8 more for each 256 times as many, so that one sequence in
    some 10,000 at most shares its hash with another, whatever the input."""
    return np.uint64((1 << 64) - (1 << max(0, 16 - 8 * max(0, -(-((shards - 1).bit_length() - 10) // 8)))))


def ask(cut: DataFrame, answers: DataFrame, work, ddl: str, mask: np.uint64) -> DataFrame:
    """work(block, its number) of each block, with what shards have answered so far."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({field.split()[0]: pd.Series([], dtype=object) for field in ddl.split(", ")})
        return work(Block(left["data"].iloc[0], right, mask), left["block"].iloc[0])

    return cut.filter("shard < 0").groupBy("route").cogroup(answers.groupBy("route")).applyInPandas(run, ddl)


def to_shards(number: int, shards: int, codes: np.ndarray, *more: np.ndarray) -> pd.DataFrame:
    """Sorted hashes and what goes with them, packed by shard."""
    ends = np.searchsorted(shards_of(codes, shards), np.arange(shards + 1)).tolist()
    parts = [(s, pack(steps(codes[a:b]), *(x[a:b] for x in more))) for s, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
    return pd.DataFrame({"route": [s for s, _ in parts], "block": number, "shard": [s for s, _ in parts], "data": [x for _, x in parts]})


def candidates(cut: DataFrame, answers: DataFrame, k: int, shards: int) -> DataFrame:
    """Answers to blocks on their sequences of k + 1 tokens."""

    def send(block: Block, number: int) -> pd.DataFrame:
        *_, (at, own, _, which, _) = block.lengths_of(k)
        n = np.bincount(which, np.repeat(block.used, block.lengths)[at], len(own))
        return to_shards(number, shards, own, n.astype(np.uint32))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(from_steps(x), n) for x, n in (unpack(d, np.uint8, np.uint32) for d in pdf["data"])]
        own, first, which = distinct(np.concatenate([x[0] for x in parts]))
        n = np.bincount(which, np.concatenate([x[1] for x in parts])).astype(np.int64)
        kept = (n[which] >= LEAST).astype(np.uint8)
        kept[first] *= 2
        ends = np.cumsum([len(x[0]) for x in parts]).tolist()
        data = [pack(kept[a:b], n[which[a:b]][kept[a:b] > 0]) for a, b in zip([0, *ends], ends)]
        return pd.DataFrame({"route": -1 - pdf["block"], "block": pdf["block"], "shard": pdf["shard"] | k << 16, "data": data})

    return ask(cut, answers, send, blocks.DDL, mask_for(shards)).groupBy("route").applyInPandas(count, blocks.DDL)


def states(cut: DataFrame, answers: DataFrame, total: int, discount: float, shards: int) -> DataFrame:
    """(ctx, value) of each state: its hash, and log10 of the factor by which it passes on what it has no candidate for."""
    c, sufs = F.col, [f"suf{j}" for j in range(DEPTH - 1)]
    ddl = f"k int, ctx long, {', '.join(f'{x} long' for x in sufs)}, ctx_n double, seen double, seen_low double, kl double"
    found = ask(cut, answers, lambda block, _number: block.sums(total, discount), ddl, mask_for(shards))
    at = found.groupBy("k", "ctx").agg(*[F.first(x).alias(x) for x in sufs], F.first("ctx_n").alias("ctx_n"), F.sum("seen").alias("seen"), F.sum("seen_low").alias("seen_low"), F.sum("kl").alias("kl"))
    at = at.withColumns({"rest": F.greatest(c("ctx_n") - c("seen"), F.lit(0.0)), "rest_low": F.greatest(1 - c("seen_low"), F.lit(1e-12))})
    kl = c("kl") + F.when(c("rest") > 0, c("rest") * F.ln(c("rest") / c("ctx_n") / c("rest_low"))).otherwise(0.0)
    left = F.log10((c("rest") + MU * c("rest_low")) / (c("ctx_n") + MU) / c("rest_low"))
    at = checkpoint(at.select("k", "ctx", *sufs, left.cast("float").alias("value"), (kl >= DIVERGENCE * float(np.log(max(total, 2)))).alias("diverges")))
    # the suffixes of a state are states: k - 1 of them
    own = at.filter("diverges").select(F.explode(F.concat(F.array("ctx"), F.slice(F.array(*sufs), F.lit(1), c("k") - 1))).alias("ctx")).distinct()
    return at.join(own, "ctx", "left_semi").select("ctx", "value")


def values(cut: DataFrame, answers: DataFrame, states_: DataFrame, shards: int) -> DataFrame:
    """Answers to blocks: of the contexts that a block has, by hash, which are states, and the values of those."""
    # written, so that the blocks' shuffle is gone before the next one
    asked = checkpoint(ask(cut, answers, lambda block, number: to_shards(number, shards, np.sort(block.contexts(list(block.lengths_of(DEPTH - 1)))[0])), blocks.DDL, mask_for(shards)))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({x: pd.Series([], dtype=object) for x in ("route", "block", "shard", "data")})
        code, value = right["ctx"].to_numpy(np.int64).view(np.uint64), right["value"].to_numpy(np.float32)
        order = np.argsort(code)
        code, value = code[order], value[order]
        at = [find(code, from_steps(unpack(d, np.uint8)[0])) for d in left["data"]]
        return pd.DataFrame({"route": -1 - left["block"], "block": left["block"], "shard": left["shard"] | VALUES << 16, "data": [pack((x >= 0).astype(np.uint8), value[x[x >= 0]]) for x in at]})

    told = states_.withColumn("route", F.shiftright(F.shiftrightunsigned("ctx", 32) * F.lit(shards), 32))
    return asked.groupBy("route").cogroup(told.groupBy("route")).applyInPandas(look, blocks.DDL)


def words_of(cut: DataFrame) -> DataFrame:
    """(hash, n) of each word in training documents."""
    import xxhash

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, _, _, used = blocks.shard_words(list(pdf["data"]))
        keep = np.flatnonzero(used)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) for i in keep.tolist()), np.uint64, len(keep))
        return pd.DataFrame({"hash": hashes.view(np.int64), "n": used[keep]})

    return blocks.vocabulary(cut).groupBy("route").applyInPandas(run, "hash long, n long")


def score(docs: DataFrame, trains=lambda doc_id: crc_mod_py(doc_id, 10) != 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents (doc_id, text); trains(doc_id): learns from it."""
    shards = shards_for(docs)
    cut = dealt(blocks.cut(docs, split, trains, hashed=True, keep=False), "route")  # so that blocks stay where they are while answers come and go
    words = checkpoint(words_of(cut))
    told = words.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    n, v, n1, n2 = (int(x or 0) for x in told)
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def work(_words, _all, used):
        return lambda places: pack(used[places].astype(np.uint32))

    answers = dealt(blocks.per_shard(blocks.vocabulary(cut), work), "route")
    cut = checkpoint(cut.filter("shard < 0"))
    del words
    collect_garbage(cut.sparkSession)  # the vocabularies' files go
    for k in range(1, DEPTH + 1):
        answers = answers.unionByName(dealt(candidates(cut, answers, k, shards), "route"))
    made = checkpoint(states(cut, answers, n, discount, shards))
    answers = answers.unionByName(dealt(values(cut, answers, made, shards), "route"))
    del made
    collect_garbage(cut.sparkSession)

    def back(block: Block, _number: int) -> pd.DataFrame:
        c = block.count.astype(np.float64)
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        root = np.log10(np.where(c > 0, c - discount, discount * v) / n) if n else np.zeros(len(c))
        logp = block.score(root[block.tokens], n, discount)
        sums = lambda x: np.add.reduceat(x, block.first) if len(block.first) else np.zeros(0)  # noqa: E731  every document has a token
        return pd.DataFrame(
            {
                "doc_id": pd.array(block.ids, "Int64"),
                "held_out": [not trains(i) for i in block.ids],
                "n_tokens": block.lengths,
                "n_known": sums((c > 0).astype(np.int64)[block.tokens]),
                "train_tokens": np.full(len(block.ids), n, np.int64),
                "base_score": sums(base[block.tokens]),
                "score": sums(logp),
            }
        )

    return ask(cut, answers, back, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", mask_for(shards))
