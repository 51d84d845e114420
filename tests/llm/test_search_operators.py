"""Secret scan, spelling variants and lexical ranking against brute force, and their edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hazeline.llm import lexical, pii, secret_scan, spelling
from hazeline.llm.common import MASK

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
DOCUMENTED = {  # published test keys
    "xprv": "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi",
    "age": "AGE-SECRET-KEY-1GFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPQ4EGAEX",
    "nsec": "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5",
}


def closed(prefix: str, rng: random.Random) -> str:
    """A token of 36 characters behind its prefix, the last six its checksum."""
    body = "".join(rng.choice(secret_scan.BASE62) for _ in range(30))
    value, tail = zlib.crc32(body.encode()), ""
    while len(tail) < 6:
        tail, value = secret_scan.BASE62[value % 62] + tail, value // 62
    return prefix + body + tail


def searched_base(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24])


def found_in(text: str) -> list[tuple[int, int, int]]:
    raw = text.encode()
    return secret_scan.in_code_points(raw, secret_scan.byte_spans(raw, secret_scan.prefilter()))


def test_base_secrets_equal_plain_search():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "akia", "AKIAQ", "ABCDEFGH01234567",
             "0123456789abcdef", "beef", "é", "日本", "ſecret", "Key", "x", "a.b/c", "\n", "_", "token=password=", "ſ"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in found_in(text) if s[1] < 3] == searched_base(text), text


def test_checksums_decide():
    rng = random.Random(6)
    for kind, key in [*DOCUMENTED.items(), *[("github", closed(f"gh{c}_", rng)) for c in "pousr"], ("npm", closed("npm_", rng))]:
        text = f"café {key}, then"
        number = secret_scan.KINDS.index(kind)
        assert [s for s in found_in(text) if s[1] == number] == [(5, number, 5 + len(key))]
        for i in (len(key) - 1, len(key) - 20):
            wrong = key[:i] + ("Q" if kind == "age" and key[i] != "Q" else "q" if key[i] != "q" else "p" if kind != "age" else "P") + key[i + 1 :]
            assert not [s for s in found_in(wrong) if s[1] == number], wrong
        assert not [s for s in found_in(key + "7") if s[1] == number]


def test_secret_scan_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é token = abcdef", "x"), (3, "é token = abcdef", "x"), (4, "a" * 2_000_000, None),
            (None, "token=" * 200_000 + " " * 100_000 + "secret", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in secret_scan.find(df).collect()}
    assert out[1] == out[2] == [] and out[3] == [("assign", 2, 16, True)] and out[4] == [("hex", 0, 2_000_000, True)]
    assert out[None] == [("assign", 0, 1_200_000, True)]
    assert secret_scan.find(df).count() == 6 and secret_scan.find(df.limit(0)).count() == 0
    masked = pii.mask(secret_scan.find(df.filter("doc_id = 3")))
    assert [r.text for r in masked.collect()] == ["é <assign>"] * 2


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


@pytest.mark.parametrize("letters, shortest", [("abcdé", 6), ("abc", 4)])
def test_variants_equal_brute_force(spark, letters, shortest):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(shortest, shortest + 3))): rng.choice([5, 6, 30, 150, 151, 800]) for _ in range(60)}
    for w in [*words] * 3:
        i = rng.randrange(len(w))
        words[w[:i] + rng.choice(letters) + w[i + rng.randrange(2) :]] = rng.choice([5, 6, 30, 150, 151, 800])
    out = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), shortest).collect()
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    want = {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}
    assert {tuple(r) for r in out} == want and len(out) == len(words)
    assert any(form[w] and form[form[w]] for w in words)  # chains of two steps occur


def test_every_cut_shares_what_its_bound_says():
    rng = random.Random(2)
    for trial in range(60):
        letters, longest = "abcd"[: 2 + trial % 3], 3 + trial % 2
        grams = spelling.Grams(["".join(rng.choice(letters) for _ in range(rng.randint(3, longest))) for _ in range(trial)], longest)
        for _ in range(150):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(2 * longest, 2 * longest + 5)))
            i, c = rng.randrange(len(w)), rng.choice(letters)
            for v in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]):
                long, short = (grams.cut(x) for x in (v, w))
                least = [len(cut) - grams.affected(x, cut) for x, cut in ((v, long), (w, short))]
                shared = set(long) if len(v) == len(w) else set(long) | {(p - 1, g) for p, g in long}
                assert min(least) >= 1 and len(shared & set(short)) >= max(least)


def test_word_counts_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "Ärger ÄRGER a-b"), (3, "x" * 50_000), (3, "Über×÷ über")], "doc_id long, text string")
    got = {r.word: r.n for r in spelling.word_counts(df, "doc_id", "text").collect()}
    assert got == {"Ärger": 2, "a": 1, "b": 1, "x" * 50_000: 1, "Über×÷": 1, "über": 1}
    run = next(w for w in (f"w{chr(97 + i % 26)}{chr(97 + i // 26)}ord" for i in range(676)) if zlib.crc32(f"7:{w}".encode()) % 199 == 0)
    at = zlib.crc32(f"7:{run}".encode()) % len(run)
    one = spark.createDataFrame([(7, run)], "doc_id long, text string")
    assert [r.word for r in spelling.word_counts(one, "doc_id", "text", spelling.lost_letter).collect()] == [run[:at] + run[at + 1 :]]
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).count() == 0
    long = spark.createDataFrame([("ab" * 5000, 5), ("ab" * 4999 + "b", 25)], "word string, n long")
    assert {(r.word[-2:], r.n_near, r.form_n) for r in spelling.variants(long).collect()} == {("ab", 1, 25), ("bb", 1, None)}
    with pytest.raises(ValueError):
        spelling.near_pairs(empty, 3)
    with pytest.raises(ValueError):
        spelling.variants(empty, times=1)


def ranked_plainly(docs, items, k=10):
    own = [(key, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower().decode()))) for key, t in docs]
    n_docs, n_terms = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, t in items:
        q = Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower().decode()))
        scores = []
        for key, c in own:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, times in q.items() if w in c)
            if s > 0 and key is not None:
                scores.append((-s, key))
        out += [(item, i + 1, key, -s) for i, (s, key) in enumerate(sorted(scores)[:k])]
    return out


def made_up_corpus(rng, rows, words):
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(f"w{w}" for w in rng.choices(range(words), weights, k=rng.randint(0, 60)))) for i in range(rows)]


def test_ranking_equals_brute_force(spark):
    rng = random.Random(9)
    docs = made_up_corpus(rng, 700, 300) + [(None, "w1 w299"), (700, None), (5, "W1 É日 w2"), (5, "W1 É日 w2"), (701, "w298 " * 3000)]
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(40, None), (41, ""), (41, "É日 É日"), (41, "É日 É日"), (None, "w7")]
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    by = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted([tuple(r) for r in got], key=by) == sorted(ranked_plainly(docs, items), key=by)


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = random.Random(10)
    docs, items = made_up_corpus(rng, 60, 50), [(i, f"w{i} w{i + 1} w1") for i in range(9)]
    monkeypatch.setattr(lexical, "QUERY_ROWS", 4)
    frame = spark.createDataFrame(docs, "key long, text string").selectExpr("key doc_id", "text", "'x' query", "1 score", "2 n", "3 rank")
    got = lexical.ranked(frame, spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(ranked_plainly(docs, items, 3))


def test_ranking_of_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, queries in ((none, items), (some, items.limit(0))):
        got = lexical.ranked(docs, queries)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_segments_skip_blocks_and_stay_exact():
    """Every block bound holds for each of its documents, some blocks are skipped, and the best are those of a full scan."""
    rng = np.random.default_rng(4)
    size, n = 200, 3000
    topics = rng.permuted(np.tile(1 / (np.arange(size) + 1.0), (12, 1)), axis=1)
    rows = [np.unique(rng.choice(size, 25, p=topics[i % 12] / topics[i % 12].sum())) for i in range(n)]
    weight = rng.integers(1, 9000, size)
    keys, lengths, cols = rng.permutation(n), np.array([len(r) for r in rows]), np.concatenate(rows)
    impacts = rng.integers(1, 10**6, len(cols))
    batch = lexical.segment_rows(3, keys, lengths, cols, impacts, weight)
    full = np.zeros((n, size), np.int64)
    full[np.repeat(np.arange(n), lengths), cols] = impacts
    segment = lexical.Segment(pa.Table.from_batches([batch]))
    for t, i in segment.row.items():
        docs, coords, maxima = segment.part("docs", i), segment.part("coords", i), segment.part("maxima", i)
        assert sorted(docs) == np.flatnonzero(full[:, t]).tolist()
        begin = first = 0
        for end, last in zip(segment.part("ends", i), segment.part("coord_ends", i)):
            assert (full[docs[begin:end]][:, coords[first:last]].max(0) == maxima[first:last]).all()
            begin, first = end, last
    scored, pull = 0, np.zeros(size, np.int64)
    for q in range(30):
        terms = [(int(t), int(weight[t])) for t in np.unique(rng.choice(size, 8, p=topics[q % 12] / topics[q % 12].sum()))]
        best = lexical.Best(10)
        scored += segment.search(terms, pull, best)
        scores = sum(full[:, t] * w for t, w in terms)
        want = sorted((-s, k) for s, k in zip(scores.tolist(), keys.tolist()) if s > 0)[:10]
        assert [(-s, k) for s, k in zip(best.scores.tolist(), best.keys.tolist())] == want and not pull.any()
    assert scored < 0.8 * 30 * n


def test_scores_fit_64_bits():
    assert 10**9 * 10**7 < MASK >> 1
