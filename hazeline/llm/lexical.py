"""Ranked lexical search over posting lists that are blocked by geometry.

Documents are dealt into segments of bounded size.  In a segment every posting list is clustered by the similarity of
its documents, and each block stores the coordinatewise maximum of its documents' term impacts.  A query takes its lists
from the rarest to the most frequent.  A document is met first in the list of its rarest query term, so a block is
bounded by its summary over this term and the more frequent ones only, and summaries hold no others.  A block
is skipped when this bound is below the tenth best score so far, and no more lists are read once even the segment's own
maxima are.  Documents of other blocks are scored in full.  All arithmetic is exact, so nothing is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import lists, sent, stored

BLOCK, SEGMENT_DOCS, SEGMENT_POSTINGS, DIMENSIONS = 128, 4096, 800_000, 64
QUERY_TERMS, QUERY_ROWS = 500_000, 2_000  # of one block of queries
# Upper case becomes lower case, and every byte outside a term a space.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = ("segment bigint, term int, docs array<int>, impacts array<int>, ends array<int>, coords array<int>, maxima array<int>, "
         "coord_ends array<int>, keys array<bigint>")
ARRAYS = ("docs", "impacts", "ends", "coords", "maxima", "coord_ends", "keys")


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TERMS).split()


def query_blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, dict[bytes, int]]]]:
    """The items with their term counts, in blocks of bounded size; only one block is held at a time."""
    block, held = [], 0
    for key, raw in items.select(item, F.encode(text, "UTF-8")).toLocalIterator(prefetchPartitions=False):
        counts = Counter(terms_of(bytes(raw))) if raw is not None else Counter()
        if counts:
            block.append((key, counts))
            held += len(counts)
        if held >= QUERY_TERMS or len(block) >= QUERY_ROWS:
            yield block
            block, held = [], 0
    if block:
        yield block


def forward(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document: ``key``, its number ``n`` of terms, and ids and counts of those in the vocabulary, by id."""
    held = sent(docs.sparkSession, vocabulary)

    def work(batches):
        known = held()
        for batch in batches:
            sizes, ids, counts, lengths = [], [], [], []
            for raw in batch.column("text").cast(pa.binary()):
                words = terms_of(raw.as_py()) if raw.is_valid else []
                own = sorted(Counter(known[w] for w in words if w in known).items())
                sizes.append(len(words)), lengths.append(len(own))
                ids += [i for i, _ in own]
                counts += [c for _, c in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(sizes, pa.int64()), lists(ids, lengths, pa.int32()), lists(counts, lengths, pa.int32())], ["key", "n", "ids", "counts"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, "key bigint, n bigint, ids array<int>, counts array<int>")


def weights(rows: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of each vocabulary term, the number of documents with terms, and the number of all their terms."""
    n_docs, n_terms = rows.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = np.zeros(size, np.int64)
    for term, df in rows.select(F.explode("ids").alias("term")).groupBy("term").count().collect():
        out[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out, n_docs, n_terms


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the half-open ranges, one range after the other."""
    sizes = ends - starts
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return np.arange(int(sizes.sum())) + shift


def segment_rows(number: int, keys: np.ndarray, lengths: np.ndarray, cols: np.ndarray, impacts: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """The blocked lists of one segment, one row per term, after a row (term -1) with the documents' keys."""
    size = np.bincount(cols, minlength=len(weight))
    owner = np.repeat(np.arange(len(keys)), lengths)
    vectors = np.zeros((len(keys), DIMENSIONS), np.float32)
    signs = np.where(cols * 0x9E3779B1 >> 7 & 1, 1, -1)
    np.add.at(vectors.reshape(-1), owner * DIMENSIONS + cols % DIMENSIONS, (signs * impacts * (weight[cols] / 1e9)).astype(np.float32))
    places = np.argsort(cols, kind="stable")
    at = np.concatenate(([0], np.cumsum(size)))
    long = np.flatnonzero(size > BLOCK)
    long = long[np.lexsort((long, size[long]))]  # the rarest first
    column = np.full(len(weight), -1)
    column[long] = np.arange(len(long))
    full = np.zeros((len(keys), len(long)), np.int32)
    wide = column[cols] >= 0
    full[owner[wide], column[cols[wide]]] = impacts[wide]
    rows = {"docs": [], "impacts": [], "ends": [], "coords": [], "maxima": [], "coord_ends": [], "keys": [keys]}
    found = np.flatnonzero(size)
    none = np.zeros(0, np.int64)
    for t in found.tolist():
        own = places[at[t] : at[t + 1]]
        docs = owner[own]
        if len(docs) <= BLOCK:
            parts = (np.array([len(docs)]), none, none, none)
        else:
            centres = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK)).astype(int)]
            near = np.argmax(vectors[docs] @ vectors[centres].T, axis=1)
            by = np.argsort(near, kind="stable")
            own, docs, near = own[by], docs[by], near[by]
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(near) > 0) | (np.arange(1, len(near)) % (2 * BLOCK) == 0))))
            high = np.maximum.reduceat(full[docs, column[t] :], starts, axis=0)
            b, c = np.nonzero(high)
            parts = (np.append(starts[1:], len(docs)), long[column[t] + c], high[b, c], np.cumsum(np.bincount(b, minlength=len(high))))
        for name, part in zip(("docs", "impacts", "ends", "coords", "maxima", "coord_ends"), (docs, impacts[own], *parts)):
            rows[name].append(part)
    columns = [pa.array([number] * (len(found) + 1), pa.int64()), pa.array(np.concatenate(([-1], found)), pa.int32())]
    for name in ARRAYS:
        parts = rows[name] + [none] * len(found) if name == "keys" else [none] + rows[name]
        columns.append(lists(np.concatenate(parts), [len(p) for p in parts], pa.int64() if name == "keys" else pa.int32()))
    return pa.RecordBatch.from_arrays(columns, ["segment", "term", *ARRAYS])


def index(rows: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Blocked lists of every document of ``forward`` with a key and a term of the vocabulary.  Rows of a segment follow
    one another; after storing, deal them by ``segment`` and sort within partitions."""
    from pyspark import TaskContext

    held = sent(rows.sparkSession, weight)

    def work(batches):
        own, base, made = held(), TaskContext.get().partitionId() << 32, 0
        kept: list[tuple] = []

        def segment():
            keys, lengths, cols, impacts = (np.concatenate(c) for c in zip(*kept))
            kept.clear()
            return segment_rows(base + made, keys, lengths, cols, impacts, own)

        docs = postings = 0
        for batch in batches:
            keys, sizes = batch.column("key").to_numpy(False), batch.column("n").to_pylist()
            long = np.array([25 + (75 * n * n_docs) // max(1, n_terms) for n in sizes], np.int64)
            ids, counts = batch.column("ids"), batch.column("counts")
            lengths = np.diff(ids.offsets.to_numpy())
            cols, tf = ids.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
            impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(long, lengths))
            begins = np.cumsum(lengths) - lengths
            good = np.flatnonzero((lengths > 0) & batch.column("key").is_valid().to_numpy(False))
            while len(good):
                room = np.cumsum(lengths[good])
                n = max(1, min(SEGMENT_DOCS - docs, int(np.searchsorted(room, SEGMENT_POSTINGS - postings, "right"))))
                take, good = good[:n], good[n:]
                span = ranges(begins[take], begins[take] + lengths[take])
                kept.append((keys[take].astype(np.int64), lengths[take], cols[span], impacts[span]))
                docs, postings = docs + len(take), postings + len(span)
                if docs >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS or len(good):
                    yield segment()
                    made, docs, postings = made + 1, 0, 0
        if kept:
            yield segment()

    return rows.mapInArrow(work, INDEX)


class Best:
    """The ``k`` best documents of one query: highest score, then smallest key; repeated rows count on their own."""

    def __init__(self, k: int):
        self.k, self.keys, self.scores, self.floor = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor
        if not good.any():
            return
        keys, scores = np.concatenate((self.keys, keys[good])), np.concatenate((self.scores, scores[good]))
        order = np.lexsort((keys, -scores))[: self.k]
        self.keys, self.scores = keys[order], scores[order]
        if len(order) == self.k:
            self.floor = int(self.scores[-1])


class Segment:
    """The lists of one segment as read from the index, searched one query after the other."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        terms = table.column("term").to_numpy()
        flat, at = {}, {}
        for name in ARRAYS:
            column = table.column(name).chunk(0)
            flat[name], at[name] = column.flatten().to_numpy().astype(np.int64), column.offsets.to_numpy() - column.offsets[0].as_py()
        self.flat, self.at = flat, at
        self.keys = flat["keys"]
        self.row = {t: i for i, t in enumerate(terms.tolist()) if t >= 0}
        self.size = np.diff(at["docs"])
        self.top = {t: int(flat["impacts"][at["docs"][i] : at["docs"][i + 1]].max()) for t, i in self.row.items()}
        by_doc = np.argsort(flat["docs"], kind="stable")
        self.cols, self.impacts = np.repeat(terms, self.size)[by_doc], flat["impacts"][by_doc]
        self.ends = np.cumsum(np.bincount(flat["docs"], minlength=len(self.keys)))
        self.begins = np.concatenate(([0], self.ends[:-1]))

    def part(self, name: str, i: int) -> np.ndarray:
        return self.flat[name][self.at[name][i] : self.at[name][i + 1]]

    def score(self, docs: np.ndarray, pull: np.ndarray) -> np.ndarray:
        span = ranges(self.begins[docs], self.ends[docs])
        edges = np.concatenate(([0], np.cumsum(self.ends[docs] - self.begins[docs])[:-1]))
        return np.add.reduceat(pull[self.cols[span]] * self.impacts[span], edges)

    def search(self, terms: list[tuple[int, int]], pull: np.ndarray, best: Best) -> int:
        """Adds this segment's documents to ``best``; returns how many were scored.  ``pull`` is all zeros on entry and exit."""
        mine = sorted((self.size[self.row[t]], t, w) for t, w in terms if t in self.row)
        rest = np.cumsum([w * self.top[t] for _, t, w in reversed(mine)])[::-1].tolist()
        seen = np.zeros(len(self.keys), bool)
        later = pull.copy()
        for _, t, w in mine:
            pull[t] = later[t] = w
        scored = 0
        for (_, t, _), bound in zip(mine, rest):
            if bound < best.floor:
                break
            i = self.row[t]
            docs, ends = self.part("docs", i), self.part("ends", i)
            bounds = np.full(len(ends), bound)
            if self.at["coord_ends"][i + 1] > self.at["coord_ends"][i]:
                edges = np.concatenate(([0], self.part("coord_ends", i)[:-1]))
                bounds = np.add.reduceat(later[self.part("coords", i)] * self.part("maxima", i), edges)
            begins = np.concatenate(([0], ends[:-1]))
            for b in np.argsort(-bounds, kind="stable").tolist():
                if bounds[b] < best.floor:
                    break
                own = docs[begins[b] : ends[b]]
                own = own[~seen[own]]
                if len(own):
                    seen[own] = True
                    scored += len(own)
                    best.add(self.keys[own], self.score(own, pull))
            later[t] = 0
        for _, t, _ in mine:
            pull[t] = 0
        return scored


def searched(blocks: DataFrame, queries: list[list[tuple[int, int]]], size: int, k: int) -> DataFrame:
    """Each task's ``k`` best documents of each query: ``(query, key, score)``.  A query is its terms and their weights."""
    held = sent(blocks.sparkSession, queries)

    def work(batches):
        own = held()
        best, pull = [Best(k) for _ in own], np.zeros(size, np.int64)

        def run(parts):
            segment = Segment(pa.Table.from_batches(parts))
            for terms, b in zip(own, best):
                segment.search(terms, pull, b)

        parts, now = [], None
        for batch in batches:
            at = batch.column("segment").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if parts and at[a] != now:
                    run(parts)
                    parts = []
                now = at[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            run(parts)
        sizes = [len(b.keys) for b in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), sizes), pa.int64()), pa.array(np.concatenate([b.keys for b in best]), pa.int64()),
             pa.array(np.concatenate([b.scores for b in best]), pa.int64())], ["query", "key", "score"])

    return blocks.mapInArrow(work, "query bigint, key bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """The ``k`` highest-scoring documents of each item, scores above 0: ``item, rank, key, score``; equal scores by key.

    Every row of ``items`` is a query of its own, repeated ones too; one without terms gives no rows.  Items are taken in
    blocks of bounded size, each against all documents.  Null texts have no terms.  Documents without a key count in the
    statistics and are not ranked; repeated rows are documents of their own.  Other columns play no part.  An empty table
    on either side gives an empty result.
    """
    spark, out = docs.sparkSession, None
    kinds = f"`{item}` {items.schema[item].dataType.simpleString()}, rank int, `{key}` bigint, score bigint"
    for block in query_blocks(items, item, text):
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, counts in block for w in counts))}
        rows = stored(forward(docs, key, text, vocabulary))
        weight, n_docs, n_terms = weights(rows, len(vocabulary))
        queries = [[(vocabulary[w], int(weight[vocabulary[w]]) * c) for w, c in counts.items() if weight[vocabulary[w]] > 0] for _, counts in block]
        found = searched(index(rows, weight, n_docs, n_terms), queries, len(vocabulary), k)
        order = [F.desc("score"), "key"]
        near = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*order))).filter(F.col("rank") <= k)
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"query bigint, `{item}` {items.schema[item].dataType.simpleString()}")
        best = best.withColumnRenamed("key", key).join(names, "query").select(item, "rank", key, "score")
        out = stored(best) if out is None else out.unionByName(stored(best))
    return spark.createDataFrame([], kinds) if out is None else out
