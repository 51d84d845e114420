"""Shared helpers: stored intermediate tables, Arrow columns, stable hashes, byte words."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only in a local session where it is unset, as in
    tests.  A cluster without the setting is refused."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="hazeline-"))
        found = sc.getCheckpointDir()
    return found


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows written once to the shared folder and read back: lineage is cut, lost executors cost nothing.

    The folder is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value) -> Callable[[], object]:
    """Ships a value of bounded size to the executors once; the returned function makes it there.

    Classes travel by value, so executors need no installation of this package.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


word_hash = xxhash.xxh64_intdigest


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd uint64 multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


class WordHashes:
    """Hashes of byte words.  A text has so many rare words that hashing all costs less than remembering some."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(word_hash, words), np.uint64, len(words))


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def hashes_at(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As ``WordHashes`` for words that lie in an array of bytes, all at once: XXH64 step by step, each step for the words
    that are long enough.  The few of 32 bytes or more are hashed one by one."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight, four = (np.ndarray(len(data) + 1, t, padded, strides=(1,)) for t in ("<u8", "<u4"))
    out = sizes.astype(np.uint64) + p5
    for at in (0, 8, 16):
        on = np.flatnonzero(sizes >= at + 8)
        lane = turned(eight[starts[on] + at] * p2, 31) * p1
        out[on] = turned(out[on] ^ lane, 27) * p1 + p4
    on = np.flatnonzero(sizes & 4)
    out[on] = turned(out[on] ^ four[starts[on] + (sizes[on] & ~7)].astype(np.uint64) * p1, 23) * p2 + p3
    for left in (1, 2, 3):
        on = np.flatnonzero((sizes & 3) >= left)
        out[on] = turned(out[on] ^ data[starts[on] + (sizes[on] & ~3) + (left - 1)].astype(np.uint64) * p5, 11) * p1
    out = (out ^ out >> np.uint64(33)) * p2
    out = (out ^ out >> np.uint64(29)) * p3
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(sizes >= 32).tolist():
        out[i] = word_hash(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return out


class Marks:
    """A set of 64-bit hashes as a bitmap of fixed size: never misses a member, and holds some others the fuller it is."""

    def __init__(self, members: DataFrame):
        """``members`` has one column of hashes.  At most 2**21 words of 64 bits reach the driver, whatever their number."""
        h = F.col(members.columns[0])
        words = members.groupBy(F.shiftrightunsigned(h, 43).alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
        self.words = np.zeros(1 << 21, np.uint64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64, copy=False).view(np.uint64)
        return (self.words[(h >> np.uint64(43)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; with fewer words, of the whole sequence; without words, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for j, s in enumerate(seeds(width, 77)):
        out += mix(hashes[j : n - width + 1 + j] + np.uint64(j)) * s
    return mix(out + np.uint64(width))


def pieces(batch: pa.RecordBatch, column: str, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of a string or binary column; a larger row comes alone.
    Behind each slice the memory that Arrow holds in reserve goes back to the system: workers wait with it otherwise."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in slices(lengths, size):
        for i in range(a, b, rows):
            yield batch.slice(i, min(rows, b - i))
            pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` total size each, single larger rows alone."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def lists(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the length of each row's list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def with_columns(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added, or put in place of those of the same name."""
    keep = [n for n in batch.schema.names if n not in more]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + list(more.values()), keep + list(more))


def schema_with(df: DataFrame, more: str) -> str:
    """DDL of the frame's columns plus ``more``, in the order ``with_columns`` gives."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(more)
    kept = [f for f in df.schema.fields if f.name not in added.names]
    return StructType(kept + added.fields)


def thinned(df: DataFrame, hashed: Column, most: int, total: int) -> DataFrame:
    """Roughly the ``most`` rows with the smallest hashes of ``total``, so that a later exact limit moves few rows."""
    share = min(1.0, 1.5 * (most + 20) / max(1, total))
    return df if share == 1.0 else df.filter(F.shiftrightunsigned(hashed, 1) < int(share * (MASK >> 1)))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """``docs`` with their ``label``, for at most ``most // 2`` keys of each label by hash order.

    Only keys are sampled; they are so few that they reach the documents by broadcast.
    """
    own = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias(label)).dropDuplicates([key])
    sizes = {r[0]: r[1] for r in own.groupBy(label).count().collect()}
    order = F.xxhash64(F.lit("sample"), F.col(key))
    parts = [thinned(own.filter(F.col(label) == y), order, most // 2, sizes.get(y, 0)).orderBy(order, key).limit(most // 2) for y in (0, 1)]
    return docs.join(F.broadcast(parts[0].unionByName(parts[1])), key)
