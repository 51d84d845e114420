"""Stages of the corpus pipeline on odd tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from hazeline.llm import common, pii

SF = "/root/testdata/sf0.001"
present = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
CLASHING = "score double, domain string, tokens string, epoch string, _n string, _order string, _place string, component string, spans string, id string"


@present
@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables_keep_the_columns(spark, stage):
    docs = spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
    out = stage(spark, docs, SF)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == 0


@present
def test_stages_keep_nulls_and_clashing_columns(spark):
    prose = "The grey river runs past the old mill and on to the sea, " * 3
    rows = [(1, prose), (2, prose), (3, None), (None, prose), (4, ""), (4, None), (5, "x " * 60_000 + "call +49 (0) 171 555 0199 or a@b.example.org"), (5, "y z")]
    more = (0.25, "d", "t", "e", "n", "o", "p", "c", "s", "i")
    docs = spark.createDataFrame([(k, t, None, None, 0, *more) for k, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
    single = corpus_pipeline.one_of_each(spark, docs, SF)
    got = {(r.doc_id, r.text if r.text is None else r.text[:3]): tuple(r)[5:] for r in single.collect()}
    assert set(got) == {(1, "The"), (3, None), (None, "The"), (4, None), (5, "x x")} and set(got.values()) == {more}
    clean = corpus_pipeline.without_personal_data(spark, single, SF)
    by = {r.doc_id: r for r in clean.collect()}
    assert by[3].text is None and by[3].n_chars is None and by[5].text.endswith("call <phone> or <email>") and by[5].n_chars == len(by[5].text)
    assert all(tuple(r)[5:] == more for r in by.values())
    mix = corpus_pipeline.mixed_sources(spark, clean, SF)
    assert mix.columns == docs.columns and {tuple(r)[5:] for r in mix.collect()} <= {more}
    tokens = {r.doc_id: r for r in corpus_pipeline.token_ids(spark, clean, SF).collect()}
    assert tokens[3].n_tokens == 0 and tokens[5].n_tokens == len(tokens[5].ids) > 60_000


def test_redaction_equals_find_and_mask(spark):
    texts = [None, "", "mail a.b@c.example.org, host 10.0.0.1", "nothing here", "é" * 9000 + " +1 (555) 010-9999", "4111 1111 1111 1111"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    model = pii.train(docs, windows=100, steps=5)
    two = {r.doc_id: r.text for r in pii.mask(pii.find(docs, model)).collect()}
    one = {r.doc_id: r.text for r in pii.redacted(docs, model).collect()}
    assert one == two and one[2] == "mail <email>, host <ip>" and one[0] is None


def test_slices_are_bounded_and_whole():
    import pyarrow as pa

    rows = ["a" * n for n in (10, 10, 0, 100, 5, 5, 5)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(range(8))], ["t", "i"])
    parts = list(common.pieces(batch, "t", rows=2, size=20))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(8))
    assert all(p.num_rows <= 2 and (p.num_rows == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= 20) for p in parts)
