"""Importance resampling towards a target distribution, by bucketed counts of word runs.

A task reads its texts into tries of words (ledgerloom.llm.word_trie): a node is a run of one to `depth` words and holds
its count and the CRC-32 of its spelling, from which its bucket follows. Each task gives the totals of its buckets, at
most `buckets` rows, and these are summed. The gain of a bucket is the log ratio of its smoothed shares in the target and
in the documents. A second walk over the tries has the gains at the nodes; a document's weight is the sum along the paths
that its places take. Gumbel noise from a hash of the id turns the heaviest weights plus noise into a draw without
replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.numbering import numbered
from ledgerloom.llm.store import scratch, written
from ledgerloom.llm.word_trie import tries
from ledgerloom.llm.words import ALNUM, Words, buffer, filled, slices

#: Bytes of text whose words are found at once, where a text isn't longer itself.
_SLICE = 2 << 20


def bucket_totals(texts: DataFrame, buckets: int = 10_000, depth: int = 3) -> DataFrame:
    """bucket, n: how many runs of 1 to depth words of texts (one column) fall in each bucket that has any. Repeats count; nulls have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            column = filled(batch.column(0))
            for a, b in slices(column, _SLICE):
                for level in tries(Words(*buffer(column.slice(a, b - a)), ALNUM), depth):
                    np.add.at(totals, level.crc % np.uint32(buckets), level.count())
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(totals[met])], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000, depth: int = 3) -> np.ndarray:
    """The gain of each bucket, in thousandths: floor(1000 ln of its share in target over that in docs), one added to each count.

    The driver gets the totals: at most `buckets` rows of each table, whatever their size.
    """
    counts = []
    for df in (docs, target):
        n = [0] * buckets
        for bucket, found in bucket_totals(df.select(text_col), buckets, depth).collect():
            n[bucket] = found
        counts.append(n)
    s, t = counts
    of, to = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((float(y + 1) * of) / (float(x + 1) * to))) for x, y in zip(s, t, strict=True)], np.int64)


_WEIGHED = "id long, n_words long, n_features long, weight long"


def weighed(docs: DataFrame, gains: np.ndarray, text_col: str = "text", id_col: str = "doc_id", depth: int = 3) -> DataFrame:
    """id, n_words, n_features and weight of each row: the gains of its runs summed. Nothing shuffles."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = filled(batch.column(1))
            for a, b in slices(column, _SLICE):
                words = Words(*buffer(column.slice(a, b - a)), ALNUM)
                weight = np.zeros(b - a, np.int64)
                for level in tries(words, depth):
                    gain = gains[level.crc % np.uint32(len(gains))]
                    np.add.at(weight, words.doc[level.place], gain[level.node])
                features = sum(np.maximum(words.count - k, 0) for k in range(depth))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.count), pa.array(features), pa.array(weight)], names=[x.split()[0] for x in _WEIGHED.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(walk, _WEIGHED)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, depth: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id_col, n_features, weight, score, rank.

    Of the documents with at least least_words words, percent in a hundred (rounded down) are drawn: those of the highest
    scores, ties to the smaller id. rank is 1, 2, 3 ... among them, and null for all others. A null text has no words and
    weighs 0; so does an empty one. A null id is hashed as an empty one and comes first in ties; rows that repeat an id
    are rows of their own, and rank next to each other where their texts weigh the same. Texts of any length are read
    whole, in blocks of words. An empty table gives no rows, and an empty target one without any counts. Extra columns
    are ignored.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        gains = bucket_gains(docs, target, text_col, buckets, depth)
        weights = weighed(docs, gains, text_col, id_col, depth)
        h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("long")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
        scored = written(weights.withColumn("score", F.col("weight") + noise), "scored")
        able = F.col("n_words") >= least_words
        drawn = scored.where(able).count() * percent // 100
        order = [able.desc(), F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("weight").desc(), F.col("n_features")]
        placed = numbered(scored, order, "place")
        rank = F.when(F.col("place") < drawn, F.col("place") + 1)
        return keep(placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank")), "resampled")
