"""Inputs of fits, which read the same rows many times."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written once to the reliable checkpoint folder, so a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local session may do without: it gets a
    temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", "") and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hazeline-checkpoint-"))
    return df.checkpoint()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over all cores, or over the session's shuffle partitions if these are more: fits do much work per row, and
    small inputs arrive coalesced into few partitions."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Equal-length number lists of an Arrow batch as rows of a matrix, without touching single rows."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
