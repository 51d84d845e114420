"""Trained operators on the held-out fifth of the labels."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name, label, verdict, least, recall", [
    ("op4_quality_cotraining", "quality", "kept", 0.93, 0.8), ("op5_toxicity_cnn", "toxic", "predicted", 0.93, 0.5)])
def test_held_out_labels_are_met(spark, name, label, verdict, least, recall):
    out = driver.queries()[name](spark, SF).select("doc_id", "held_out", F.col(verdict).cast("int").alias("said"), "score")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("truth"))
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) >= 40 and all(0 <= r.score <= 1 and r.said == (r.score >= 0.5) for r in rows)
    assert sum(r.said == r.truth for r in rows) / len(rows) >= least
    rare = 1 if sum(r.truth for r in rows) * 2 < len(rows) else 0
    held = [r for r in rows if r.truth == rare]
    assert sum(r.said == rare for r in held) / len(held) >= recall
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
