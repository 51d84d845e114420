"""Near-duplicate documents by HyperMinHash sketches.

A document's set holds its distinct word shingles.  Each of ``BUCKETS`` buckets hashes the set anew and keeps only the
leading-zero count of the smallest hash and the mantissa bits behind it.  Rows of registers form bands; documents that
share a band are compared by a Jaccard estimate corrected for chance collisions of registers, and then on full sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import WordHashes, mix, pieces, seeds, shingles, stored, texts
from hazeline.llm.components import components
from hazeline.llm.similar import links

BUCKETS, ROWS, MANTISSA = 252, 6, 10
SLICE = 256  # pairs whose chance of equal registers is worked out at once


def sketcher(buckets: int = BUCKETS, mantissa: int = MANTISSA) -> Callable[[np.ndarray], np.ndarray]:
    """Maps a non-empty uint64 set to its registers: leading zeros above, ``mantissa`` bits below, in 16 bits."""
    s = seeds(2 * buckets, 8)
    flip, times = (s[:buckets] >> np.uint64(32)).astype(np.uint32)[:, None], (s[buckets:] >> np.uint64(31)).astype(np.uint32)[:, None] | np.uint32(1)

    def registers(own: np.ndarray) -> np.ndarray:
        low = np.full(buckets, 0xFFFFFFFF, np.uint32)
        small = (own >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(small), 512):
            h = small[None, i : i + 512] ^ flip
            h *= times
            np.minimum(low, h.min(axis=1), out=low)
        zeros = 32 - np.frexp(low.astype(np.float64))[1]
        tail = (low.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        return ((zeros << mantissa) | (tail >> np.uint64(32 - mantissa)).astype(np.int64)).astype(np.uint16)

    return registers


def chance(n: np.ndarray, m: np.ndarray, mantissa: int = MANTISSA) -> np.ndarray:
    """Probability that a register of two unrelated sets of sizes n and m is equal by chance."""
    fine = min(3, mantissa)
    parts = 1 - np.arange(2**fine + 1) / 2 ** (fine + 1)
    edges = 2.0 ** -np.arange(32)[:, None] * parts[None, :]  # cells of each octave, from large hashes to small

    def cells(k):
        below = (1 - edges[None]) ** np.asarray(k, float)[:, None, None]
        return below[:, :, 1:] - below[:, :, :-1]

    n, m = np.asarray(n), np.asarray(m)
    out = np.zeros(len(n))
    for i in range(0, len(n), SLICE):  # a whole batch at once would hold a hundred MB in the worker
        out[i : i + SLICE] = (cells(n[i : i + SLICE]) * cells(m[i : i + SLICE])).sum((1, 2))
    return out / 2 ** (mantissa - fine)


def set_builder(width: int) -> Callable[[list[str]], list[np.ndarray]]:
    """Builds sorted shingle sets: A-Z lowered, words between ASCII white space, shorter texts as one shingle."""
    hashes = WordHashes()

    def build(rows: list[str]) -> list[np.ndarray]:
        return [np.unique(shingles(hashes(t.encode().lower().split()), width)) for t in rows]

    return build


def signatures(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Per row: set size, digest of the set, registers, and one key per band of registers."""
    bands = BUCKETS // ROWS

    def work(batches):
        build, registers, salts = set_builder(width), sketcher(), seeds(ROWS, 5)
        place = mix(np.arange(bands, dtype=np.uint64) + np.uint64(99))
        for batch in (p for b in batches for p in pieces(b, text)):
            ids, n, digest, sig, keys = batch.column(key), [], [], [], []
            for t in texts(batch.column(text)):
                own = build([t])[0]
                n.append(len(own))
                if not len(own):
                    digest.append(None), sig.append(None), keys.append(None)
                    continue
                digest.append(xxhash.xxh128_digest(own.tobytes()))
                r = registers(own)
                sig.append(r.tobytes())
                rows = mix(r.reshape(bands, ROWS).astype(np.uint64) + np.uint64(1)) * salts
                keys.append(mix(rows.sum(1) + place).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n", "digest", "sig", "bands"])

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias(text))
    return rows.mapInArrow(work, "id bigint, n bigint, digest binary, sig binary, bands array<bigint>")


def estimate(items: DataFrame, least: int) -> Callable[[DataFrame], DataFrame]:
    """Keeps pairs whose corrected Jaccard estimate is at most six standard errors below the bound."""
    floor = least / 100 - 6 * ((least / 100) * (1 - least / 100) / BUCKETS) ** 0.5

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sa", "sb"))
            equal = (x == y).mean(1)
            c = chance(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array((equal - c) / (1 - c) >= floor))

    def keep(pairs: DataFrame) -> DataFrame:
        sides = [items.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab"]
        return pairs.join(sides[1], "b").join(sides[0], "a").mapInArrow(work, "a bigint, b bigint")

    return keep


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, least: int = 80) -> DataFrame:
    """One row per document: ``key, n_shingles, component_id, kept``.

    Documents whose shingle sets have ``100 * intersection >= least * union`` are linked; ``component_id`` is the
    smallest key that links reach, ``kept`` tells whether it is the row's own.  Rows with equal sets are folded into
    the smallest key first.  Texts without words, null texts included, have an empty set and stand alone.  A row with
    a null key links with nothing, has a null ``component_id`` and is kept.  Repeated rows each give a row; rows of one
    key with different texts are one vertex.  An empty table gives an empty result.
    """
    every = stored(signatures(df, key, text, width).withColumn("row", F.monotonically_increasing_id()))
    full = every.filter("id is not null and n > 0")
    classes = stored(full.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first")).select("digest", "first.*"))
    items = stored(full.join(classes.select("row"), "row", "left_semi").select("id", "n", "sig", "bands"))
    contents = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("content"))
    found = links(items, contents, lambda: set_builder(width), least, estimate(items, least))
    copies = full.join(classes.select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b")
    at = stored(components(found.unionByName(copies.filter("a <> b"))))
    out = every.join(at, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      (F.col("id").eqNullSafe(F.col("component"))).alias("kept"))
