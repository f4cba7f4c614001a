"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper to lower case, A-Z only, for UTF-8 bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def small_batches(spark: SparkSession) -> None:
    """Texts are long: the rows that go to a Python worker at once are held to 4 MB, unless the session already asks for less."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    number, unit = re.fullmatch(r"(-?[0-9]+)([kmgt]?)b?", spark.conf.get(name).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= most:
        spark.conf.set(name, str(most))


def release() -> None:
    """Gives freed memory back to the system, as idle Python workers keep theirs beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session, whose executors are the driver, gets a temporary
    one if it names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder. Spark deletes the files with the last reference if it is set up to.

    What only led up to it, shuffle files above all, goes with the driver's next garbage collection, which is asked for here:
    iterations would pile theirs up on the executors' disks until the driver's heap happens to fill.
    """
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df
    collect_garbage(spark)
    return out


def dealt(df: DataFrame, column: str) -> DataFrame:
    """df dealt out by a column into the session's shuffle partitions, as a checkpoint that keeps this: what groups by the column next to it needs
    no shuffle. Spark doesn't know how a plan that adapts is dealt out, so this one doesn't."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    try:
        conf.set(name, "false")
        return checkpoint(df.repartition(shuffle_partitions(df.sparkSession), column))
    finally:
        conf.set(name, before)


def collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of input that a shard stands for at most, where the session asks for fewer shards.
SHARD_BYTES = 64 << 20


def shards_for(df: DataFrame) -> int:
    """Shards of what df is cut into: the session's shuffle partitions, more if what df reads is large for them (by Spark's own estimate)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 55)  # the others aren't known
    return min(max(shuffle_partitions(df.sparkSession), size // SHARD_BYTES), 1 << 16)


def as_rows(df: DataFrame) -> Column:
    """All columns as one struct: whatever they are called, they can't clash with an operator's own. Back with select("row.*")."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row")


#: Bits of a filter; the broadcast table has FILTER_BITS / 64 rows at most, whatever the number of keys.
FILTER_BITS = 1 << 24


def flagged(df: DataFrame, key: Column, keys: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """df with a boolean column: whether key (a long of df's) may be in keys (one column of longs); false surely isn't, null isn't.

    A filter of fixed size keeps most rows that a join with keys would drop out of its shuffle; it doesn't replace the join.
    df's own columns mustn't be named as the helpers below; see as_rows().
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = keys.select(place(F.col(keys.columns[0])).alias("at")).select(F.shiftright("at", 6).alias("filter_word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    words = checkpoint(at.groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits")))
    told = df.withColumn("filter_at", F.when(key.isNotNull(), place(key))).withColumn("filter_key", F.shiftright("filter_at", 6))
    told = told.join(F.broadcast(words), F.col("filter_key") == F.col("filter_word"), "left")
    return told.select(*df.columns, F.coalesce(F.expr("shiftright(filter_bits, cast(filter_at & 63 AS int)) & 1L") == 1, F.lit(False)).alias(name))


def split_by_filter(df: DataFrame, column: str, ids: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose column may be in ids (one column of longs), and those whose column surely isn't, nulls among them."""
    told = flagged(df.select(as_rows(df), F.col(f"`{column}`").cast("long").alias("key")), F.col("key"), ids, "maybe", bits)
    return told.filter("maybe").select("row.*"), told.filter("NOT maybe").select("row.*")


def text_hash(text: Column) -> Column:
    """A 64-bit hash of a text; what is null hashes alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def told_apart(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text, ...) with a column tag: 0, or a hash of the text if other rows (may) have the same id, so that
    (doc_id, tag) names a text. Ids that occur once aren't shuffled with their texts."""
    often = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    told = flagged(docs, F.col("doc_id"), often, "often")
    return told.select(*docs.columns, F.when(F.col("often"), F.pmod(text_hash(F.col("text")), F.lit((1 << 31) - 1)).cast("int") + 1).otherwise(F.lit(0)).alias("tag"))


def sample_ids(ids: DataFrame, n: int) -> DataFrame:
    """The n rows of ids (doc_id, distinct) with the smallest hashes. Where there are many more, most go before the sort,
    so that tasks don't send the driver n rows each."""
    key, total = F.xxhash64("doc_id"), ids.count()
    if total > 4 * n:
        part = ids.filter(key < F.lit(int((2 * n / total - 0.5) * 2**64)))
        if part.count() >= n:
            ids = part
    return ids.orderBy(key, "doc_id").limit(n)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def crc_mod_py(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8; bytes.split() splits at the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


class Ids(dict):
    """Numbers its keys in order of first use."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; unpack() needs their dtypes."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    """The arrays of pack(); the dtype after an ellipsis is that of all further ones."""
    raw = zstandard.ZstdDecompressor().decompress(bytes(blob))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    if ... in dtypes:
        dtypes = (*dtypes[:-2], *[dtypes[-1]] * (n - len(dtypes) + 2))
    at, out = 8 * (n + 1), []
    for size, dtype in zip(sizes, dtypes, strict=True):
        out.append(np.frombuffer(raw, dtype, int(size) // np.dtype(dtype).itemsize, at))
        at += int(size)
    return out


def planes(x: np.ndarray, width: int = 4) -> np.ndarray:
    """Non-negative numbers under 256 ** width as bytes, all low ones first: high ones are mostly 0 and pack well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()


def from_planes(x: np.ndarray, width: int = 4) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = x.reshape(width, -1).T
    return out.view("<u8").ravel()


def join_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as lengths and one byte array."""
    return np.fromiter(map(len, words), np.uint32, len(words)), np.frombuffer(b"".join(words), np.uint8)


def cut_words(lengths: np.ndarray, data: np.ndarray) -> list[bytes]:
    raw, ends = data.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def batches(rows, schema: pa.Schema, size: int = 2000):
    """Tuples as record batches."""
    rows = iter(rows)
    while True:
        part = [r for _, r in zip(range(size), rows)]
        if not part:
            release()
            return
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
