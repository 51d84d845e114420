"""Byte-level BPE over whole texts.

Each match of the pre-token pattern is encoded on its own.  First tier: a minimal perfect hash finds pre-tokens
that are vocabulary entries as a whole.  Second tier: a heap of adjacent pairs over linked bytes merges the rest.
Vocabulary and hash are built once on the driver (their size is that of the rank file) and reach tasks by broadcast.
"""

from __future__ import annotations

import base64
import heapq
import sys
import types
import uuid
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hazeline.llm.common import lists, mix, schema_with, sent, slices, texts, with_columns

SLICE_CHARS, SLICE_IDS = 1_000_000, 250_000
CACHED_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def hash_pieces(pieces: list[bytes]) -> np.ndarray:
    """64-bit hashes of many byte strings at once: polynomials over their bytes."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max(initial=0)), 0x100000001B3, np.uint64))
    sums = np.zeros(len(pieces), np.uint64)
    filled = sizes > 0
    if filled.any():
        sums[filled] = np.add.reduceat(mix(flat) * powers[place], starts[filled])
    return mix(sums + sizes.astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash by hash and displace: ``n`` keys to ``n`` slots, one small integer per bucket of keys.

    A bucket's integer moves all its keys to free slots; single keys left at the end store their slot itself.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        bucket, base, step = self.parts(hash_pieces(keys)) if n else (np.zeros(0, np.int64),) * 3
        members: dict[int, list[int]] = {}
        for k, b in enumerate(bucket.tolist()):
            members.setdefault(b, []).append(k)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(n, -1, np.int64)
        taken, base, step, free = bytearray(n), base.tolist(), step.tolist(), 0
        for b, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                while taken[free]:
                    free += 1
                slots, shift = [free], -free - 1
            else:
                shift = 0
                while True:
                    slots = [(base[k] + shift * step[k]) % n for k in own]
                    if len(set(slots)) == len(own) and not any(taken[s] for s in slots):
                        break
                    shift += 1
            self.shift[b] = shift
            for k, s in zip(own, slots):
                taken[s] = 1
                self.slot_key[s] = k

    def parts(self, h: np.ndarray):
        return ((h >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64), (h & np.uint64(0xFFFFF)).astype(np.int64), (
            (h >> np.uint64(20)) & np.uint64(0xFFFFF)).astype(np.int64) | 1

    def slots(self, pieces: list[bytes]) -> np.ndarray:
        """A slot for each piece; for one that is no key, the slot of some other key."""
        bucket, base, step = self.parts(hash_pieces(pieces))
        shift = self.shift[bucket]
        return np.where(shift < 0, -shift - 1, (base + shift * step) % self.n)


class Vocabulary:
    """Ranks with their perfect hash, and the bytes of every id for decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.keys = list(ranks)
        self.hash = PerfectHash(self.keys)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        top = int(self.ids.max(initial=-1)) + 1
        self.size = np.full(top, -1, np.int64)
        by_id = {i: k for k, i in ranks.items()}
        for i, k in by_id.items():
            self.size[i] = len(k)
        self.start = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)

    def whole(self, pieces: list[bytes]) -> list[int]:
        """First tier: ids of pieces that are entries, -1 for others."""
        if not pieces or not self.keys:
            return [-1] * len(pieces)
        found = self.hash.slot_key[self.hash.slots(pieces)].tolist()
        keys, ids = self.keys, self.ids
        return [int(ids[k]) if keys[k] == p else -1 for k, p in zip(found, pieces)]

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: always the lowest rank first, ties from the left."""
        get, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        base = n + 1
        heap = []
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                heap.append((r * base + i) * base + i + 2)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            code, end = divmod(pop(heap), base)
            i = code % base
            mid = after[i]
            if mid < 0 or mid >= n or after[mid] != end:
                continue
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                to = after[end]
                r = get(piece[i:to])
                if r is not None:
                    push(heap, (r * base + i) * base + to)
            j = before[i]
            if j >= 0:
                r = get(piece[j:end])
                if r is not None:
                    push(heap, (r * base + j) * base + end)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids; an id that is no entry raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or (self.size[ids] < 0).any()):
            raise ValueError("id outside the vocabulary")
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes) + np.repeat(self.start[ids], sizes)
        flat = self.blob[place].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Encoder:
    """Encodes lists of texts; pieces seen before come from a bounded cache."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.find = vocabulary, regex.compile(vocabulary.pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known, self.flat, self.sizes = {}, array("i"), array("i")
        self.ids, self.count, self.start = (np.zeros(0, np.int64),) * 3

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        for p, b, i in zip(pieces, raw, self.vocabulary.whole(raw)):
            own = [i] if i >= 0 else self.vocabulary.merged(b)
            self.known[p] = len(self.sizes)
            self.sizes.append(len(own))
            self.flat.extend(own)
        self.ids, self.count = np.array(self.flat, np.int64), np.array(self.sizes, np.int64)
        self.start = np.cumsum(self.count) - self.count

    def __call__(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows, and how many each row has."""
        if len(self.known) > CACHED_PIECES:
            self.forget()
        pieces, ends = [], []
        for t in rows:
            pieces += self.find(t)
            ends.append(len(pieces))
        known = self.known
        new = [p for p in pieces if p not in known]
        if new:
            self.learn(list(dict.fromkeys(new)))
        codes = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.count[codes]
        upto = np.cumsum(sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(upto - sizes, sizes) + np.repeat(self.start[codes], sizes)
        total = np.concatenate([[0], upto])[np.array([0, *ends])]
        return self.ids[place], np.diff(total)


def of_worker(kind: str, key: str, make):
    """State kept between a Python worker's tasks of one query; functions sent by value start with fresh globals in
    every task.  One state of each kind is held: that of the query that ran last."""
    home = sys.modules.setdefault("_hazeline_worker_state", types.ModuleType("_hazeline_worker_state")).__dict__
    if home.get(kind, ("", None))[0] != key:
        home.pop(kind, None)
        home[kind] = (key, make())
    return home[kind][1]


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``, the token ids of the whole text.  A null or empty text has an empty list; other columns and
    repeated rows stay; a column named like ``ids`` is replaced.  Long texts are single rows of any length."""
    held = sent(df.sparkSession, vocabulary)
    key = f"bpe_{uuid.uuid4().hex}"

    def work(batches):
        encoder = of_worker("encoder", key, lambda: Encoder(held()))
        for batch in batches:
            rows = texts(batch.column(text))
            for a, b in slices([len(t) for t in rows], SLICE_CHARS):
                flat, sizes = encoder(rows[a:b])
                yield with_columns(batch.slice(a, b - a), {ids: lists(flat.astype(np.int32), sizes, pa.int32())})

    return df.mapInArrow(work, schema_with(df, f"`{ids}` array<int>"))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes the ids stand for; a null or empty list gives empty bytes, an unknown id raises."""
    held = sent(df.sparkSession, vocabulary)

    key = f"bpe_{uuid.uuid4().hex}"

    def work(batches):
        known = of_worker("vocabulary", key, held)
        for batch in batches:
            column, raw = batch.column(ids), []
            sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            flat, at = column.flatten().to_numpy(zero_copy_only=False), 0
            for a, b in slices(sizes.tolist(), SLICE_IDS):
                n = int(sizes[a:b].sum())
                raw += known.decode(flat[at : at + n].astype(np.int64), sizes[a:b])
                at += n
            yield with_columns(batch, {out: pa.array(raw, pa.binary())})

    return df.mapInArrow(work, schema_with(df, f"`{out}` binary"))
