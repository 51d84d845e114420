"""Duplicates, neighbours, mixing, the pipeline and the registered queries."""

from __future__ import annotations

import hashlib
import os
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from hazeline.llm import mixing, neardup, neighbours, paragraphs
from hazeline.llm.common import Marks, WordHashes, hashes_at, mix
from hazeline.llm.components import components
from hazeline.llm.queries import ORACLE, QUERIES
from tests.compare import oracle_rows, same

SF = "/root/testdata/sf0.001"
present = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def roots(ids, edges):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (500, 499), (500, 499)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_texts(seed=3):
    rng = np.random.default_rng(seed)
    out = [None, "", " \n ", "a", "A", "b c", "B  c", "b c d"]
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(40):
            own = list(base)
            for _ in range(int(rng.integers(0, 9))):
                own[int(rng.integers(60))] = f"w{rng.integers(0, 400)}"
            out.append(" ".join(own))
    return out + out[10:14]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    texts = near_texts()
    df = spark.createDataFrame([(3 * i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    got = {r.doc_id: r for r in neardup.near_duplicates(df, width=width).collect()}
    sets = {3 * i: shingle_set(t, width) for i, t in enumerate(texts)}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, edges)
    assert len(got) == len(texts)
    for i, c in want.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), c, c == i)


def test_near_duplicates_of_odd_keys(spark):
    df = spark.createDataFrame([(None, "p q r"), (1, "p q r"), (1, "p q r"), (2, "p q r"), (2, "x y z"), (9, "x y z")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (9, 1, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_chance_of_equal_registers():
    rng, registers = np.random.default_rng(5), neardup.sketcher(252, 2)
    equal = [np.mean(registers(rng.integers(0, 2**63, n).astype(np.uint64)) == registers(rng.integers(0, 2**63, m).astype(np.uint64)))
             for n, m in [(50, 70)] * 60]
    assert np.mean(equal) == pytest.approx(neardup.chance(np.array([50]), np.array([70]), 2)[0], rel=0.15)


def test_chance_of_a_whole_batch_needs_little_memory():
    rng = np.random.default_rng(5)
    n, m = rng.integers(1, 2000, 10_000), rng.integers(1, 2000, 10_000)
    tracemalloc.start()
    got = neardup.chance(n, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    assert all(got[i] == neardup.chance(n[i : i + 1], m[i : i + 1])[0] for i in range(0, 10_000, 997))


def windows_by_hand(text):
    """Distinct paragraphs of a text, straight from the definition."""
    words = (text or "").encode().lower().split()
    own = WordHashes()(words)
    n = len(words)
    if n <= paragraphs.WORDS:
        return {tuple(words): 0} if n else {}
    pairs = [int(mix(own[i : i + 1] * np.uint64(0x9E3779B97F4A7C15) + own[i + 1 : i + 2])[0]) for i in range(n - 1)]
    places = set()
    for i in range(max(1, n - 1 - paragraphs.STRETCH + 1)):
        part = pairs[i : i + paragraphs.STRETCH]
        places.add(i + part.index(min(part)))
    places = {p for p in places if p + paragraphs.WORDS <= n} | ({0, n - paragraphs.WORDS} if n < paragraphs.STRETCH + paragraphs.WORDS else set())
    out = {}
    for p in sorted(places):
        out.setdefault(tuple(words[p : p + paragraphs.WORDS]), p)
    return out


def shingles_of(words, width=5):
    return {words[i : i + width] for i in range(max(1, len(words) - width + 1))} if words else set()


def passage_texts():
    """Embedded, wrapped, re-cased and edited copies of passages among unrelated prose, short texts and junk."""
    rng = np.random.default_rng(8)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passages = [prose(n) for n in (51, 60, 90)]
    texts, holders = [None, "", "short line", "Short  LINE", "x " * 3000, "x " * 5000], set()
    for k in range(36):
        own = list(passages[k % 3])
        if k % 4 == 3:
            own[int(rng.integers(len(own)))] = "éditée"
        sep = " " if k % 2 else "\n"
        middle = sep.join(w.upper() if k % 5 == 0 else w for w in own) if k % 3 else " ".join(w + ("\n" if i % 10 == 9 else "") for i, w in enumerate(own))
        holders.add(len(texts))
        texts.append(" ".join(prose(int(rng.integers(0, 80)))) + "\n\n" + middle + " " + " ".join(prose(int(rng.integers(0, 80)))))
    return texts + [" ".join(prose(100)) for _ in range(20)], holders


def test_repeated_passages_equal_brute_force(spark):
    texts, holders = passage_texts()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, start long, digest string").repartition(3)
    got = paragraphs.repeated_passages(df).collect()
    windows = [(i, w, p) for i, t in enumerate(texts) for w, p in windows_by_hand(t).items()]
    sets = {w: shingles_of(w) for _, w, _ in windows}
    kinds = {w: k for k, w in enumerate(sets)}
    edges = [(kinds[a], kinds[b]) for a in sets for b in sets if kinds[a] < kinds[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    at = roots(kinds.values(), edges)
    sizes = defaultdict(list)
    for i, w, p in windows:
        sizes[at[kinds[w]]].append((i, p))
    want = {x for group in sizes.values() if len({i for i, _ in group}) > 1 for x in group}
    found = {(r.doc_id, r.place) for r in got}
    assert found <= want and len(found) >= 0.97 * len(want)  # banding may miss a pair at the bound
    exact = {i for n, i in enumerate(sorted(holders)) if n % 4 != 3}
    assert exact <= {r.doc_id for r in got} <= holders | {2, 3, 4, 5} and len(holders - {r.doc_id for r in got}) <= 3
    firsts = defaultdict(list)
    for r in got:
        assert texts[r.doc_id][r.start : r.end].split() == texts[r.doc_id].split()[r.place : r.place + r.n_words]
        firsts[r.cluster].append(((r.doc_id, r.place), r.kept))
    assert all([k for _, k in sorted(group)] == [True] + [False] * (len(group) - 1) for group in firsts.values())
    cut = {r.doc_id: r.text for r in paragraphs.without_repeats(df, paragraphs.repeated_passages(df)).collect()}
    assert cut[0] is None and cut[2] == texts[2] and cut[3] == "" and cut[4] == texts[4] and len(cut[len(texts) - 1]) == len(texts[-1])
    assert sum(len(cut[i].split()) < len(texts[i].split()) - 14 for i in holders) >= len(holders) - 3
    assert paragraphs.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [80, 60])
def test_sets_at_the_bound_share_a_band(least):
    rng = np.random.default_rng(12)
    for _ in range(3000):
        n = int(rng.integers(1, 13))
        a = rng.integers(0, 2**63, n)
        b = np.unique(np.concatenate((rng.choice(a, int(rng.integers(1, n + 1)), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 4))))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= least * (n + len(b) - both):
            x, y = (np.sort(s)[: paragraphs.fewest_keys(np.array([len(s)]), least)[0]] for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_sets_at_the_bound_share_a_pair():
    """All sizes and all orders of the members that only one of two sets holds."""
    assert paragraphs.paired(60, 12) is None and paragraphs.paired(80, 14) is None
    small, large = paragraphs.paired(80, 12)
    for n, m in ((n, m) for n in range(2, 13) for m in range(n, 13)):
        both = -(-80 * (n + m) // 180)
        if both > n:
            continue
        rng = np.random.default_rng(n * 13 + m)
        for _ in range(200):
            every = rng.permutation(n + m - both)
            a, b = sorted(every[:n].tolist()), sorted(every[n - both :].tolist())
            pairs = [{(x, y) for x in s[:k] for y in s[:k] if x < y} for s, k in ((a, 3), (b, 3), (a, 2), (b, 4))]
            assert pairs[0] & pairs[1] or n in small and m in large and pairs[2] & pairs[3]


def test_all_similar_paragraphs_of_short_texts_are_found(spark):
    """Pairs at the bound, with a word changed at an end, and texts that repeat their own words: none is missed."""
    rng = np.random.default_rng(11)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    pairs = []
    for _ in range(400):
        own = prose(16)
        pairs.append((own, [*own[:15], "other"] if rng.integers(2) else ["other", *own[1:]]))
    for _ in range(20):  # ten shingles repeated twice, all of them in the other text
        own = prose(10)
        pairs.append((own + own[:6], ["left", *own, *own[:4], "right"]))
    pairs += [(w, w) for w in (prose(9), prose(3), ["alone"], ["x"] * 16)]
    df = spark.createDataFrame([(2 * i + j, " ".join(t)) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string").repartition(3)
    got = paragraphs.repeated_passages(df).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(d, d % 2 == 0) for d in range(2 * len(pairs))}
    assert len(got) == 2 * len(pairs) and len({r.cluster for r in got}) == len(pairs)


def test_a_shared_run_of_47_words_always_shares_a_paragraph():
    rng = np.random.default_rng(3)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    for _ in range(300):
        run = prose(paragraphs.STRETCH + paragraphs.WORDS - 1)
        texts = [" ".join(prose(int(rng.integers(0, 90))) + run + prose(int(rng.integers(0, 90)))).encode() for _ in range(2)]
        a, b = (set(tuple(w[p : p + paragraphs.WORDS]) for p in at.tolist()) for w, _, at in (paragraphs.paragraphs_of(t, WordHashes()) for t in texts))
        assert a & b


def test_words_of_many_texts_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(12)
    kinds = ["ab", "Çà", "x\x1cy", "\u00a0", "日本", "w" * 31, "W" * 32, "z" * 70, *[f"k{i}" for i in range(40)]]
    gaps = [" ", "\n", " \t ", "\r\x0b\x0c"]
    texts = [None, "", " \n", "one", "  two words ", " ".join(["a"] * 60), "é " * 47]
    texts += ["".join(kinds[rng.integers(len(kinds))] + gaps[rng.integers(4)] for _ in range(n)) for n in (*range(1, 60), 200, 400)]
    raws = [None if t is None else t.encode() for t in texts]
    words = paragraphs.Words(raws)
    assert words.lowered.split() == [w for r in raws for w in (r or b"").lower().split()]
    assert (words.hashes == WordHashes()(words.lowered.split())).all()
    first, last, _ = words.paragraphs()
    got = [(int(words.text[a]), int(a - words.begins[words.text[a]]), int(b - a + 1)) for a, b in zip(first, last)]
    assert got == [(i, p, len(w)) for i, t in enumerate(texts) for w, p in windows_by_hand(t).items()]
    for (i, place, n), start, end in zip(got, *words.spans(first, last)):
        assert texts[i][start:end].encode().split() == raws[i].split()[place : place + n]
    sets = words.sets(first, last, 5)
    assert [len(np.unique(s)) for s in sets] == [len(shingles_of(tuple(raws[i].lower().split()[p : p + n]))) for i, p, n in got]

    # The numpy steps are those of a slice, not of each of its texts: the time went into them.
    calls = []
    monkeypatch.setattr(paragraphs, "mix", lambda x: calls.append(1) or mix(x))
    counts = []
    for n in (2, 200):
        calls.clear()
        many = paragraphs.Words([" ".join(f"w{x}" for x in rng.integers(0, 999, 80)).encode() for _ in range(n)])
        found = many.paragraphs()
        many.sets(found[0], found[1], 5)
        paragraphs.runs_of(many, 15, 5)
        counts.append(len(calls))
    assert counts[0] == counts[1]


def test_hashes_of_all_words_at_once_equal_the_single_ones():
    words = [bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)) for n in [*range(80), 5, 31, 32, 1000]]
    sizes = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    assert (hashes_at(data, np.cumsum(sizes) - sizes, sizes) == WordHashes()(words)).all()
    assert not len(hashes_at(data[:0], sizes[:0], sizes[:0]))


def runs_by_hand(texts, size):
    """Runs of ``size`` words that two texts hold, with the places of their first occurrences, straight from the definition."""
    at = defaultdict(dict)
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        for p in range(len(words) - size + 1):
            at[tuple(words[p : p + size])].setdefault(i, p)
    return [sorted(places.items()) for places in at.values() if len(places) > 1]


def runs_found(got, texts, size):
    """The same from the rows of the operator; of equal runs the first one is kept."""
    at = defaultdict(list)
    for r in got:
        words = texts[r.doc_id].encode().lower().split()
        assert texts[r.doc_id][r.start : r.end].encode().lower().split() == words[r.place : r.place + r.n_words]
        for p in range(r.place, r.place + r.n_words - size + 1):
            at[tuple(words[p : p + size])].append(((r.doc_id, p), r.kept))
    assert all([k for _, k in sorted(g)] == [True] + [False] * (len(g) - 1) for g in at.values())
    return sorted(sorted(p for p, _ in g) for g in at.values())


@pytest.mark.parametrize("size", [paragraphs.RUN, 5, 8])
def test_runs_at_every_place_equal_brute_force(spark, size):
    texts = passage_texts()[0]
    texts += [texts[6], " ".join(texts[-1].split()[:size]), texts[7].replace(" ", "\u00e9 ", 3)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, start long, digest string").repartition(3)
    got = paragraphs.repeated_runs(df, words=size).collect()
    assert runs_found(got, texts, size) == sorted(runs_by_hand(texts, size))
    clusters = defaultdict(list)
    for r in got:
        clusters[r.cluster].append((r.doc_id, r.kept))
    assert all(min(g)[1] and len({d for d, kept in g if kept}) == 1 for g in clusters.values())
    assert paragraphs.repeated_runs(df.limit(0), words=size).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_runs_of_a_seed_go_on_in_the_next_batch(spark, rows):
    rng = np.random.default_rng(7)
    start = [f"s{i}" for i in range(12)]
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 2, 4)] + start + [f"w{x}" for x in rng.integers(0, 2, 4)]) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = paragraphs.repeated_runs(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert runs_found(got, texts, paragraphs.RUN) == sorted(runs_by_hand(texts, paragraphs.RUN))


def test_runs_of_rows_with_equal_or_null_keys_keep_one(spark):
    run = " ".join(f"w{i}" for i in range(16))
    df = spark.createDataFrame([(None, run), (4, "a " + run), (4, run + " b"), (None, None)], "doc_id long, text string")
    got = paragraphs.repeated_runs(df).collect()
    assert sum(r.n_words - 14 for r in got) == 6 and len({r.cluster for r in got}) == len([r for r in got if r.kept])
    kept = [r for r in got if r.kept]
    assert {r.doc_id for r in kept} == {4} and sum(r.n_words - 14 for r in kept) == 2
    twice = paragraphs.repeated_runs(spark.createDataFrame([(1, f"{run} {run}")], "doc_id long, text string"))
    assert twice.count() == 0


def test_short_shared_runs_are_found_wherever_they_stand(spark, tmp_path):
    """Shared runs of 16 to 46 words need not hold an anchored paragraph."""
    rng = np.random.default_rng(4)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, spots = [], []
    for k in range(60):
        run = prose(16 + k % 31)
        for _ in range(2):
            before = prose(int(rng.integers(40, 90)))
            spots.append(set(range(len(before), len(before) + len(run))))
            rows.append((len(rows), " ".join(before + run + prose(int(rng.integers(40, 90))))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    covered = defaultdict(set)
    for r in QUERIES["op9_paragraph_dedup"](spark, str(tmp_path)).collect():
        covered[r.doc_id] |= set(range(r.place, r.place + r.n_words))
    assert all(spots[i] <= covered[i] and len(covered[i] - spots[i]) <= 2 for i in range(len(rows)))


@pytest.mark.parametrize("n", range(1, 20))
def test_least_over_neighbours(n):
    values = np.random.default_rng(n).integers(0, 50, 40).astype(np.uint64)
    assert paragraphs.least_over(values, n).tolist() == [min(values[i : i + n]) for i in range(41 - n)]
    assert not len(paragraphs.least_over(values[: n - 1], n))


def test_paragraph_pairs_are_compared_in_slices_as_by_sets(spark):
    rng = np.random.default_rng(6)
    base = rng.permutation(40).astype(np.uint64).reshape(4, 10)
    sets = [np.unique(np.concatenate((base[i % 4][: 10 - i % 3], rng.integers(0, 40, int(rng.integers(0, 3))).astype(np.uint64)))) for i in range(60)]
    contents = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "id long, content binary")
    pairs = [(a, b) for a in range(60) for b in range(60) if a != b]
    got = paragraphs.verified(spark.createDataFrame(pairs, "a long, b long"), contents, None, 80).collect()
    want = {(a, b) for a, b in pairs if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


@pytest.mark.parametrize("miss, most", [(0.01, 8), (0.05, 3), (0.15, 2)])
def test_band_tuning(miss, most):
    bands, rows = paragraphs.tuned(80, miss, most)
    assert (1 - 0.8**rows) ** bands <= miss and bands <= most
    assert all((1 - 0.8 ** (rows + 1)) ** b > miss for b in range(1, most + 1))


def test_marks_hold_every_member(spark):
    rng = np.random.default_rng(5)
    own = rng.integers(-(2**63), 2**63 - 1, 5000)
    marks = Marks(spark.createDataFrame([(int(x),) for x in own], "h bigint"))
    assert marks(own).all() and marks(rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01
    assert not Marks(spark.createDataFrame([], "h bigint"))(own).any()


@pytest.mark.parametrize("held", [32 << 20, 1000])
def test_neighbours_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(neighbours, "HELD_BYTES", held)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] + [1.0] * 6), (404, []), (None, x[0].tolist()), (405, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df.filter("vec_id % 10 = 0"), df, k=5, query_size=7, block_size=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    c = neighbours.exact(np.repeat(y, 300, 0), np.tile(y, (300, 1))).reshape(300, 300)
    for q in range(0, 300, 10):
        want = sorted(((-c[q, j], j) for j in range(300) if j != q))[:5]
        assert got[q] == [(j, -s) for s, j in want]
    assert set(got) == set(range(0, 300, 10))
    few = neighbours.nearest(df.filter("vec_id = 10"), df.filter("vec_id < 3"), k=5)
    assert few.count() == 3 and neighbours.nearest(df.limit(0), df).count() == 0


def poured(budget, nodes):
    """Repeated proportional sharing among nodes that are not full."""
    given = {n: 0.0 for n in nodes}
    live = {n for n, (c, w) in nodes.items() if w > 0}
    while live and budget - sum(given.values()) > 1e-9:
        rest, total = budget - sum(given.values()), sum(nodes[n][1] for n in live)
        for n in list(live):
            given[n] += min(rest * nodes[n][1] / total, nodes[n][0] - given[n])
        live = {n for n in live if nodes[n][0] - given[n] > 1e-9}
    return given


@pytest.mark.parametrize("share, epochs", [(0.3, 1), (0.9, 2), (3.0, 2)])
def test_mixing_equals_brute_force(spark, share, epochs):
    rng = np.random.default_rng(6)
    rows = [(i, ["web", "print", None][i % 3], "en" if rng.random() < 0.8 else "de", f"s{rng.integers(0, 3)}", int(rng.integers(0, 50)), 7) for i in range(600)]
    rows.append((601, "web", "xx", "s0", None, 7))
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n long, epoch long")
    weights = [{"web": 3, "none": 2}, {"en": 5}, {"s1": 2}]
    got = sorted((r.doc_id, r.epoch) for r in mixing.mixed(df, ["domain", "lang", "source"], weights, "n", "doc_id", share=share, epochs=epochs).collect())
    leaves = defaultdict(list)
    for r in rows:
        leaves[r[1] or "none", r[2], r[3]].append((r[0], r[4] or 0))
    capacity = {k: epochs * sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(capacity.values()) // epochs
    budgets = {(): min(float(int(total * share + 1e-9)), total * epochs)}
    for depth in range(3):
        nxt = {}
        for parent, b in budgets.items():
            names = {k[: depth + 1] for k in leaves if k[:depth] == parent}
            nodes = {n: (sum(c for k, c in capacity.items() if k[: depth + 1] == n), weights[depth].get(n[-1], 1)) for n in names}
            nxt |= poured(b, nodes)
        budgets = nxt
    want = []
    for leaf, docs in leaves.items():
        own = sum(n for _, n in docs)
        quota = int(budgets[leaf] + 1e-6)
        whole = quota // own if own else 0
        order = sorted(docs, key=lambda d: (hashlib.md5(f"17:{whole}:{d[0]}".encode()).hexdigest(), d[0]))
        run = 0
        for i, n in order:
            run += n
            want += [(i, e) for e in range(whole)] + ([(i, whole)] if run <= quota - whole * own and whole < epochs else [])
    assert got == sorted(want)
    assert mixing.mixed(df.limit(0), ["domain"], [{}], "n", "doc_id").count() == 0


@present
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, name):
    df = QUERIES[name](spark, SF)
    assert same(df.columns, [tuple(r) for r in df.collect()], *oracle_rows(SF, ORACLE[name])) == ""


@present
def test_queries_are_registered_and_cover_whole_tables(spark):
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in QUERIES} and set(QUERIES) <= set(driver.queries()) and "pipeline" in driver.queries()
    count = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    for name, t in (("op1_bpe_tokens", "documents"), ("op3_page_text", "pages"), ("op5_toxicity_cnn", "documents"), ("op10_bottom_k", "documents")):
        assert QUERIES[name](spark, SF).count() == count[t]


@present
def test_fingerprint_query_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op10_bottom_k"](spark, SF).collect()}

    def near(a, b):
        a, b = (frozenset(zip(*[t.split()[i:] for i in range(5)])) if len(t.split()) >= 5 else frozenset([tuple(t.split())] if t.split() else []) for t in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        m = len(t) // 4
        edited = t[: len(t) - m] + u[:m]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - near(t, edited)) < 0.2 and abs(got[i].near_next - near(t, u)) < 0.1


@present
def test_pipeline_equals_its_stages_checked_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    quality_, single, clean, mix_, tokens = kept[1:]
    assert all(x.columns == docs.columns for x in kept[1:-1]) and tokens.columns[: len(docs.columns)] == docs.columns
    sets = {r.doc_id: shingle_set(r.text, 5) for r in quality_.collect()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in single.collect()} == {i for i, c in roots(sets, edges).items() if i == c}
    assert clean.count() == single.count() and mix_.subtract(clean).count() == 0
    assert clean.filter(F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+")).count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {r.doc_id for r in tokens.collect()}


def test_wide_vectors_keep_their_bounds():
    """Sums of products of thousands of dimensions are still whole numbers, so no neighbour is lost."""
    rng = np.random.default_rng(2)
    q, c = np.sign(rng.normal(size=(5, 4096))), np.sign(rng.normal(size=(300, 4096)))
    c[7] = q[0]
    c[9] = -q[1]
    ids, found, scores = neighbours.tile_best(np.arange(1000, 1005), q, np.arange(300), c, 3)
    cos = q @ c.T / 4096
    for i in range(5):
        best = sorted(range(300), key=lambda j: (-cos[i, j], j))[:3]
        assert found[ids == 1000 + i].tolist() == best and scores[ids == 1000 + i] == pytest.approx(cos[i, best])
