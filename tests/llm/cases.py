"""Rows that every text operator must take: nulls, empty and long texts, ties, repeats and a clashing extra column."""

from pyspark.sql import SparkSession

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("keep_id", StringType()), StructField("length", StringType()), StructField("bin", StringType())])

LONG = " ".join(f"w{i % 977} x{i * 7919 % 10007}" for i in range(30000))


def texts() -> list[tuple[int | None, str | None]]:
    return [
        (1, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over the lazy dog"), (3, ""), (4, None), (5, "   \n\t "),
        (6, LONG), (7, "Ünï cödé 中文 🙂 don't 123"), (None, "no id here"), (9, "Released under the MIT License."), (9, "Released under the MIT License."),
        (10, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (11, "!" * 300), (12, "a" * 3000), (13, "The quick brown fox jumps over the lazy dog"),
    ]


def frame(spark: SparkSession, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None, "s", None, "k", None, "b") for i, t in rows], SCHEMA)
