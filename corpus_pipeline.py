"""A training corpus from raw documents: five stages, each one of the library's operators.

Every stage takes what its predecessor kept and returns rows with the columns of documents; the last adds token ids.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

from hazeline.llm import bpe, mixing, neardup, pii, quality  # noqa: E402
from hazeline.llm.common import stored, table  # noqa: E402
from hazeline.llm.queries import RANKS, TREE, WEIGHTS, vocabulary, with_domain  # noqa: E402


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    """The columns the stages work on; all others as one struct, so that no helper column can meet a caller's."""
    rest = [c for c in docs.columns if c not in OWN]
    return docs.select(*[c for c in OWN if c in docs.columns], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_caller") if rest else F.lit(None).cast("string").alias("_caller"))


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order."""
    return df.select(*[F.col(c) if c in OWN else F.col("_caller")[c].alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.  It is fitted on the labels of documents at hand; without
    labels of both kinds all stay.  Null texts count as empty, repeated rows are judged alike."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality.scored(packed(docs), model).filter("score >= 0.5"), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, five-word shingles, Jaccard 0.8 or more: that with the smallest
    id; of rows of one id that with the smallest text (null first).  Documents with a null id are kept."""
    classes = neardup.near_duplicates(docs.select("doc_id", "text"), width=5, least=80)
    kept = classes.filter("kept and doc_id is not null").select("doc_id").distinct()
    own = packed(docs)
    first = Window.partitionBy("doc_id").orderBy("text", *[c for c in own.columns if c in OWN[2:]])
    named = own.filter("doc_id is not null").withColumn("_place", F.row_number().over(first)).filter("_place = 1")
    return unpacked(named.join(kept, "doc_id", "left_semi").drop("_place").unionByName(own.filter("doc_id is null")), docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the new text, null where that is null."""
    clean = pii.redacted(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of all words, divided over domains, languages and sources; no document twice."""
    out = mixing.mixed(with_domain(packed(docs)), TREE, WEIGHTS, "tokens", "doc_id", share=0.5, epochs=1)
    return unpacked(out, docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``ids`` and ``n_tokens``, in place of columns of these names; a null text has none."""
    out = bpe.encode(docs, vocabulary(public_tokenizers.path(RANKS)))
    return out.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("tokens", token_ids),
]
ORACLE_SQL = None  # trained stages cannot be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again.  The written
    tables go when the application ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
