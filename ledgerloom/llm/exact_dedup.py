"""Exact deduplication by two-pass Bloom filtering.

Hashes that may be repeated are found by ledgerloom.llm.bloom; only their rows shuffle, to be grouped by
SHA-256. All other rows pass straight through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bloom import flagged
from ledgerloom.llm.store import working_name, written


def _split(df: DataFrame, sha: str, max_filter_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash is surely unique, and rows whose hash may be repeated."""
    flag = working_name(df, "again")
    seen = flagged(df, df.select(sha), F.col(sha), df.count(), flag, max_filter_bytes)
    return seen.where(~F.col(flag)).drop(flag), seen.where(F.col(flag)).drop(flag)


def _groups(candidates: DataFrame, sha: str, id_col: str) -> DataFrame:
    """of, keep, size: one row per hash, written, as Spark splits a hot hash's partition only in a join of two plain exchanges."""
    groups = candidates.groupBy(F.col(sha).alias("of")).agg(F.max(id_col).alias("keep"), F.count(F.lit(1)).alias("size"))
    return written(groups, "groups")


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, empty and very long ones too; null counts as empty. The row with the largest id
    stays; a null id is smaller than any other, and keep_id is null only where every id of the group is. Rows repeated
    with the same id and text count as rows of their group, and each of them is reported as kept. An empty table
    gives no rows; extra columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha"))
    once, maybe = _split(own, "sha", max_filter_bytes)
    alone = once.select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    joined = maybe.join(_groups(maybe, "sha", "id"), F.col("sha") == F.col("of"))
    several = joined.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(several)


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """docs without all but one row of each group of equal texts: the one with the largest id.

    A null text counts as empty, and a null id is smaller than any other. Of rows that also share that id, any one
    stays. Columns, also extra ones of any name, are those of docs; an empty table stays empty.
    """
    sha, of, keep, size = (working_name(docs, x) for x in ("sha", "of", "keep", "size"))
    once, maybe = _split(docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), sha, max_filter_bytes)
    best = _groups(maybe, sha, id_col).toDF(of, keep, size)
    stay = maybe.join(best, (F.col(sha) == F.col(of)) & F.col(id_col).eqNullSafe(F.col(keep)))
    return once.unionByName(stay.select(*once.columns).dropDuplicates([sha])).select(*docs.columns)
