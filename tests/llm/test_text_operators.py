"""Tokens, fingerprints, personal data, pages, quality and toxicity: small tables, brute force and round trips."""

from __future__ import annotations

import base64
import hashlib
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hazeline.llm import bpe, pages, pii, quality, sketch, toxicity
from hazeline.llm.queries import RANKS, vocabulary
from hazeline.llm.tagger import Tagger

ODD = [None, "", " ", "a", "one  two\n\tthree", "naïve ☃ 東京 \U0001f600", "x" * 5000, "'s 't 12345 !!?? \x1c\x85\xa0 end  ", "same", "same"]


@pytest.fixture(scope="module")
def known():
    return vocabulary(public_tokenizers.path(RANKS))


def documents(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(rows)], "doc_id long, text string, ids string, spans string")


def test_perfect_hash_is_minimal_and_perfect(known):
    slots = known.hash.slots(known.keys)
    assert sorted(slots.tolist()) == list(range(len(known.keys)))
    assert known.whole([b"the", b"no such piece"]) == [known.ranks[b"the"], -1]


def test_bpe_equals_the_public_encoder(spark, known):
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(documents(spark), known), known).orderBy("doc_id").collect()
    assert len(out) == len(ODD)
    for r, t in zip(out, ODD):
        assert list(r.ids) == other.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode()
    assert bpe.encode(documents(spark, []), known).count() == 0


def test_bpe_of_every_kind_of_character(known):
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "".join(f"a{chr(c)}1 " for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    ids, sizes = bpe.Encoder(known)([text])
    assert ids.tolist() == other.encode_ordinary(text) and sizes.tolist() == [len(ids)]


def test_decoding_an_unknown_id_raises(known):
    with pytest.raises(ValueError):
        known.decode(np.array([10**6]), np.array([1]))


def words(t, n=5):
    w = (t or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_sketches_are_exact_when_they_hold_all(spark):
    a, b = "a b c d e f g h", "a b c d e f x y z"
    df = spark.createDataFrame([(a, b), (None, ""), ("p q", "p q"), ("p q", "p r")], "a string, b string")
    s, t = sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))
    got = df.select(sketch.resemblance(s, t).alias("r"), sketch.containment(s, t).alias("c"), sketch.distinct_count(s).alias("n"),
                    (sketch.merge(s, t) == sketch.merge(t, s)).alias("m")).collect()
    for r, (x, y) in zip(got, [(a, b), (None, ""), ("p q", "p q"), ("p q", "p r")]):
        x, y = words(x), words(y)
        assert r.r == pytest.approx(len(x & y) / len(x | y) if x | y else 1) and r.n == len(x) and r.m
        assert r.c == pytest.approx(len(x & y) / len(x) if x else 1)


def test_sketches_estimate_and_merge_over_groups(spark):
    rng = np.random.default_rng(1)
    own = [" ".join(map(str, rng.integers(0, 9, 3000))) for _ in range(4)]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(own)], "g int, text string").withColumn("sketch", sketch.sketch(F.col("text"), 256))
    for r in sketch.merge_groups(df, ["g"], k=256).withColumn("n", sketch.distinct_count(F.col("sketch"), 256)).collect():
        true = len(set().union(*[words(t) for t in own[r.g :: 2]]))
        assert len(r.sketch) == 256 and abs(r.n - true) < 0.25 * true


def test_the_next_row_wraps_and_crosses_ranges(spark):
    ids = [5, 1, 9, 9, 30, 2, 77, -4]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = sorted((r.doc_id, r.next_text) for r in sketch.with_next(df, "doc_id", ["text"], parts=4).collect())
    order = sorted(ids)
    assert got == sorted(zip(order, [f"t{i}" for i in order[1:] + order[:1]]))
    assert sketch.with_next(df.limit(0), "doc_id", ["text"]).count() == 0
    assert sketch.with_next(df.limit(1), "doc_id", ["text"]).first().next_text == "t5"


def test_base_spans_equal_plain_searching():
    rng = np.random.default_rng(2)
    pieces = ["a.b@c.de", "x@y", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "@", ".", " ", "word", "12", "-", "a@b@c.d.e", "+", "٣٤", "1.2.3.4.5.6.7.8"]
    plain = [(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             (2, r"[0-9]([\x20-]?[0-9])+", pii.is_card), (3, r"\+[0-9][\x20().0-9-]+[0-9]", pii.is_phone)]
    for _ in range(800):
        text = "".join(pieces[i] for i in rng.integers(0, len(pieces), 12))
        assert pii.base_spans(text) == sorted((m.start(), k, m.end()) for k, p, ok in plain for m in re.finditer(p, text) if ok(m.group())), text


def test_gradients_of_the_tagger():
    model, rng = Tagger(2, width=3, hidden=2), np.random.default_rng(0)
    ids, gold = rng.integers(0, 120, (2, 5)), np.array([[0, 1, 2, 0, 3], [3, 4, 4, 0, 0]])
    _, g = model.gradients(ids, gold)
    for name, value in model.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), value.shape)
        was, losses = value[at], []
        for step in (1e-5, -1e-5):
            value[at] = was + step
            losses.append(model.gradients(ids, gold)[0])
        value[at] = was
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-7), name


def test_tagger_finds_what_the_base_misses(spark):
    model = Tagger(4)
    losses = model.fit(*pii.training_windows([], 600), 120)
    assert np.mean(losses[-10:]) < 0.3 * losses[0]
    text = "call the +1 (555) 123-4567 4111111111111111 or"
    got = pii.find(documents(spark, [text, None, "", "no digits here"]), model).orderBy("doc_id").collect()
    assert pii.base_spans(text) == [] and [len(r.spans) for r in got[1:]] == [0, 0, 0]
    assert {(s.kind, text[s.start : s.end], s.base) for s in got[0].spans} >= {("card", "4111111111111111", False)}
    clean = pii.mask(pii.find(documents(spark, [text]), model)).first()
    assert "4111111111111111" not in clean.text and "<card>" in clean.text
    assert pii.masked("ab@c.de x", [(0, 7, "email"), (3, 5, "ip")]) == "<email> x"


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">home page</a></li>
</ul></nav><div class="ad">buy this now or never ok</div>{open}<h1>Head &amp; line</h1><p>First  words <b>of it<br><p>Second part with
more words than that.</p><div class="comment-list"><p>I say this is bad</p></div><form><p>Your name</p></form><p>Third part.</p>{close}
<footer>&copy; some site</footer></body></html>"""


def test_page_text(spark):
    rows = [PAGE.format(open="<article>", close="</article>"), None, "", "plain words without any tags", "<p>" + "word " * 50 + "</p>", "<div class='a' <p>x"]
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(rows)], "page_id long, url string, html string, text string")
    got = [r.text for r in pages.extracted(df, pages.train(df)).orderBy("page_id").collect()]
    assert got[0] == "Head & line\n\nFirst words of it\n\nSecond part with more words than that.\n\nThird part."
    assert got[1] == "" and got[2] == "" and got[3] == rows[3] and got[4] == ("word " * 50).strip()
    assert pages.extracted(df.limit(0), pages.train(df.limit(0))).count() == 0


@pytest.mark.parametrize("around", [
    '<article class="post hentry comments-open">{}</article>', '<body class="single no-sidebar"><article>{}</article></body>', '<p title="a hidden gem">{}</p>',
    '<div aria-hidden="false"><p>{}</p></div>', '<p data-id="menu">{}</p>', '<div class="notice-board"><p>{}</p></div>', "<div class=content data-x='a class=\"ad\"'>{}</div>"])
def test_articles_are_not_lost_to_attributes(around):
    body = " ".join(f"word{i % 7}" for i in range(80))
    weights = pages.Weights(Counter({("main", True): 900, ("side", False): 300, ("link", False): 100, ("p", True): 900}), Counter())
    page = "<html><nav><a href='/'>home</a></nav>" + around.format(body) + "<div class='comment-list'>what a day</div><footer>the end</footer></html>"
    assert pages.main_text(weights, page) == body


def test_words_in_menus_forms_and_comments_stay_out():
    weights = pages.Weights(Counter({("main", True): 900, ("side", False): 300, ("link", False): 100, ("p", True): 900}), Counter())
    body = " ".join(f"word{i % 7}" for i in range(60))
    for side in ("<div class='ad'>{}</div>", "<div id=cookie-banner>{}</div>", "<section hidden>{}</section>", "<aside>{}</aside>", "<ul class='share-buttons'><li>{}</ul>", "<div role='navigation'>{}</div>"):
        assert pages.main_text(weights, f"<article><p>{body}</p>{side.format('never say this')}<p>{body}</p></article>") == body + "\n\n" + body, side


def test_deep_pages_take_time_in_proportion():
    weights = pages.Weights(Counter({("main", True): 9, ("p", True): 9}), Counter())
    for page in ("<div>" * 80_000 + "some words here", "<b>" + "<div>" * 40_000 + "</b>" * 40_000, "<p>" + "<i>" * 40_000 + "</u>" * 40_000, "<a>x" * 40_000):
        begun = time.perf_counter()
        pages.main_text(weights, page)
        assert time.perf_counter() - begun < 5


def made(n=240):
    rng = np.random.default_rng(4)
    vocabulary_ = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(200)]
    texts, marks = [], []
    for i in range(n):
        own = list(rng.choice(vocabulary_, 40))
        if i % 3 == 0:
            own[int(rng.integers(40))] = "nasty"
        texts.append(" ".join(own)), marks.append(int(i % 3 == 0))
    return texts, marks


def test_toxicity_learns_a_word_and_scores_anything(spark):
    texts, marks = made()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, m, None) for i, m in enumerate(marks) if i % 2], "doc_id long, toxic int, other string")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model).orderBy("doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(m) for r, m in zip(got, marks)]) > 0.95
    for empty in (model, toxicity.train(docs, labels.limit(0))):
        assert all(0 <= r.score <= 1 for r in toxicity.scored(documents(spark).withColumn("score", F.lit(9)), empty).collect())


def test_cotraining_tells_junk_and_scores_anything(spark):
    texts, _ = made()
    texts = [t if i % 4 else re.sub(r"\w+", lambda m: m.group().upper() + "!!", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, len(texts), 3)], "doc_id long, quality int")
    got = quality.scored(docs, quality.train(docs, labels)).orderBy("doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (i % 4 > 0) for i, r in enumerate(got)]) > 0.95
    assert quality.train(docs, labels.filter("quality = 1")) is None
    odd = documents(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    for model in (None, quality.train(docs, labels)):
        assert all(0 <= r.score <= 1 for r in quality.scored(odd, model).collect())
