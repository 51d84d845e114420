"""Tables in and out: delimited text with explicit schemas, parquet, and the report and model files."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hazeline.functions.text import clean_names

CORRUPT = "_corrupt_record"


def read_delimited(
    spark: SparkSession, path: str, schema: str | T.StructType, *, sep: str = ",", drop: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Delimited text with a header, clean names and without the ``drop`` columns.

    The schema is given, never inferred, so only the header lines are read twice.  Columns are found by their header
    name, in each file on its own: files of a folder may order them differently and have others besides, which are left
    out.  A listed column that a file lacks raises.  Malformed lines are kept in ``corrupt_record``.  Gzip files cannot be split: ``partitions`` spreads their rows after the scan.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wanted = {f.name: f for f in schema.fields}
    groups: dict[tuple[str, ...], list[str]] = {}
    for url in spark.read.text(path).inputFiles():
        file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(url)).toString()
        header = header_of(spark, file, sep)
        if header is None:  # an empty file
            continue
        if absent := sorted(wanted.keys() - set(header)):
            raise ValueError(f"{file} has no columns {absent}")
        groups.setdefault(header, []).append(file)
    parts = []
    for header, files in groups.items():
        listed = [wanted.get(c, T.StructField(c or f"_{i}", T.StringType())) for i, c in enumerate(header)]
        own = T.StructType([*listed, T.StructField(CORRUPT, T.StringType())])
        part = (
            spark.read.schema(own).option("header", True).option("sep", sep)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(files)
        )
        parts.append(part.select(*[f"`{c}`" for c in (*wanted, CORRUPT)]))
    if not parts:
        parts = [spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))]
    df = reduce(DataFrame.union, parts)
    if partitions:
        df = df.repartition(partitions)
    return clean_names(df).drop(*drop)


def header_of(spark: SparkSession, file: str, sep: str) -> tuple[str, ...] | None:
    """Column names in a file's first line, packed files included; None for an empty file.  Nothing behind it is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    stream = path.getFileSystem(conf).open(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return None if line is None else tuple(next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep), ()))


def read_grid(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Grid days from a folder partitioned by ``date``; only the partitions in range are listed and read."""
    df = spark.read.parquet(path)
    if first:
        df = df.filter(df["date"] >= first)
    return df.filter(df["date"] <= last) if last else df


def write_table(df: DataFrame, path: str, *, compression: str = "zstd", by: Sequence[str] = ()) -> None:
    """Parquet table, optionally partitioned."""
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_grid_days(df: DataFrame, path: str) -> None:
    """One partition per day; days already there and not in ``df`` stay as they are.

    The rebalance hint lets Spark merge small days into one task and split a large one over several.
    """
    (
        df.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date").parquet(path)
    )


def write_report(df: DataFrame, path: str) -> None:
    """CSV report with a header; the order of a sorted report is kept across its part files."""
    df.write.mode("overwrite").option("header", True).csv(path)
