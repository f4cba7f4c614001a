"""Secret scans: three rules, and strings that a primed compressor finds new in a sensitive context.

A candidate is a long run of key-like characters shortly after a word such as "password".
Its marginal compressed bytes are those of zstandard, primed with a dictionary of words and identifiers and given the text around
the candidate (without other copies of it, so one given twice is as new as one given once), with the candidate less those without it. They are held against those of random characters of the
same number in the same place, so that neither the context nor the length counts. A candidate that costs the share NOVELTY of these or more is
reported as kind `novel`: random strings do, identifiers made of known words don't. Spans of the rules stay, whatever the novelty.

Null and empty texts have no spans. Every row is scanned as a whole; repeated and null ids are kept, other columns dropped
(redact() keeps all columns).
"""

from __future__ import annotations

import functools
import hashlib
import importlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What makes a context sensitive, and how far before a candidate it counts.
SENSITIVE = re.compile(r"(?ai:passw(?:or)?d|pwd|secret|token|api[_-]?key|private[_-]?key|credential|bearer|signature)")
REACH = 48
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Characters of surrounding text on each side that the compressor sees, and the share of random characters' bytes that counts as new.
AROUND, NOVELTY = 256, 0.91
#: How a text is compressed, and what goes before it: words that the dictionary has, so that no block stays uncompressed, and bytes of all values alike, which keep
#: literals as they are. So a new character costs a byte in any context, and a known word some three bytes.
SETTINGS = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=7, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False)
DIGITS = bytes(b"0123456789abcdefghijklmnopqrstuvwxyz"[k % 36] for k in range(256))
START, PLAIN = 512, b"".join(hashlib.sha512(bytes([k])).digest() for k in range(16))
#: Where names come from, and what a name's words are.
MODULES = ("argparse", "ast", "asyncio", "base64", "collections", "concurrent.futures", "configparser", "csv", "ctypes", "datetime", "email", "email.message", "errno", "hashlib", "hmac", "html", "http", "http.client", "http.cookies", "imaplib", "inspect", "io", "json", "locale", "logging", "logging.handlers", "multiprocessing", "os", "pathlib", "pickle", "platform", "select", "shutil", "signal", "smtplib", "socket", "socketserver", "sqlite3", "ssl", "string", "subprocess", "sys", "tarfile", "threading", "typing", "unittest", "urllib.parse", "urllib.request", "uuid", "warnings", "xml.dom.minidom", "xml.sax", "zipfile")
LETTERS, CAMEL = re.compile("[a-z]{4,}"), re.compile("(?<=[a-z0-9])([A-Z])")
#: Primes the compressor, beside words(): identifiers and words of code and configuration files.
IDENTIFIERS = (
    "import from return class function public private static final void const let var string integer boolean null true false "
    "self this new async await try catch except finally raise throw if else elif for while in range len print def lambda "
    "username user_id password secret token api_key access_key client_id client_secret authorization bearer credential "
    "config settings environment database connection host port localhost example.com https://www. http:// /usr/local/bin /etc/ "
    "SELECT FROM WHERE INSERT INTO VALUES UPDATE DELETE CREATE TABLE PRIMARY KEY AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY "
    "request response headers content-type application/json charset=utf-8 status message error timestamp version 1.0.0 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 11111111 xxxxxxxx XXXXXXXX YOUR_API_KEY changeme "
)


#: Bytes of the dictionary.
DICTIONARY = 64 << 10


@functools.cache
def words() -> str:
    """Words of code and prose, most frequent last, where the compressor's references are cheapest: those of Python's own language reference, which is part of each
    installation, and of the names in some modules of its standard library, with IDENTIFIERS at the end."""
    import pydoc_data.topics as reference

    count = Counter(w for t in reference.topics.values() for w in LETTERS.findall(t.lower()))
    for module in MODULES:
        count.update(w for name in dir(importlib.import_module(module)) for w in LETTERS.findall(CAMEL.sub(r"_\1", name).lower()))
    kept, size = [], 0
    for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        size += len(w) + 1
        if size + len(IDENTIFIERS) > DICTIONARY:
            break
        kept.append(w)
    return " ".join(reversed(kept)) + " " + IDENTIFIERS.lower()


class Novelty:
    """Case doesn't count: it makes words look new that aren't, and random strings stay as new without it."""

    def __init__(self, identifiers: str | None = None):
        known = words() if identifiers is None else identifiers
        primed = zstandard.ZstdCompressionDict(known.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=SETTINGS)
        self.compress = zstandard.ZstdCompressor(compression_params=SETTINGS, dict_data=primed).compress
        self.start = PLAIN + known[:START].encode()

    def of(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes a character, as a share of those of random characters in the same place."""
        own = text[start:end]
        # cut where a copy may reach over the edge, after the copies are out
        before, after = text[max(0, start - AROUND - len(own)) : start].replace(own, ""), text[end : end + AROUND + len(own)].replace(own, "")
        around = self.start + (before[-AROUND:] + after[:AROUND]).lower().encode()
        without, random = len(self.compress(around)), hashlib.shake_128(own.encode()).digest(len(own)).translate(DIGITS)
        marginal = lambda x: len(self.compress(around + x)) - without
        return marginal(own.lower().encode()) / max(marginal(random), 1)


def find(text: str | None, novelty: Novelty) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in KINDS."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    nears = [m.end() for m in SENSITIVE.finditer(text)]
    if not nears:
        return [(KINDS[k], a, b) for a, k, b in sorted(spans)]
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    ends, taken = [b for _, b in runs], []  # what the rules' spans cover, ascending and apart
    for a, _, b in sorted(spans):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts, seen = [a for a, _ in taken], -1  # seen: end of the last candidate that was looked at
    for near in nears:
        for a, b in runs[(first := bisect_right(ends, near)) : first + 2 + REACH // LEAST]:
            a = max(a, near)  # of a run that the word is in, what follows it
            if a > near + REACH:
                break
            at = bisect_left(starts, b)
            if b - a < LEAST or a < seen or at and taken[at - 1][1] > a:
                continue
            seen = b
            if novelty.of(text, a, b) >= NOVELTY:
                spans.append((a, 3, b))
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _spans(text: pa.Array) -> pa.Array:
    novelty = Novelty()
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(t.as_py(), novelty)] for t in text], _SPANS)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row of documents."""
    return docs.select(F.col("doc_id").cast("long"), F.arrow_udf(_spans, SPANS)(F.col("text").cast("string")).alias("spans"))


def _redacted(text: pa.Array) -> pa.Array:
    novelty = Novelty()

    def clean(t: str | None) -> str | None:
        out, at = [], 0
        for kind, a, b in find(t, novelty):
            if b > at:
                out += [t[at : max(a, at)], f"[{kind}]"] if a >= at else []
                at = b
        return "".join(out) + t[at:] if at else t

    out = pa.array([clean(t.as_py()) for t in text], pa.string())
    release()
    return out


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with each secret in `text` replaced by its kind in brackets."""
    return docs.withColumn("text", F.arrow_udf(_redacted, "string")(F.col("text").cast("string")))


def digests(docs: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scan(docs).select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(told(F.filter("spans", lambda x: x["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
