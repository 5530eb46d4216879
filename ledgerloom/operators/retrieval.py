"""Vector retrieval over stores: cosine scores, top-k within and across stores, thresholds, reranking and context.

Any number of queries is searched against all chunks, exactly: chunks and queries are dealt into blocks, every block of
one meets every block of the other in a task of bounded size, and only the k best of each block go on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision, a row each; rows that are null, zero, of another length or not finite are NaN."""
    rows = column.to_pylist()
    size = max((len(r) for r in rows if r is not None), default=0)
    out = np.full((len(rows), size), np.nan)
    for i, r in enumerate(rows):
        if r is not None and len(r) == size and None not in r:
            out[i] = r
    with np.errstate(all="ignore"):
        return out / np.sqrt((out**2).sum(1))[:, None]


def searched(chunks: DataFrame, queries: DataFrame, k: int, per_store: bool = False, digits: int = 6, block: int = 8192) -> DataFrame:
    """query_id, vec_id, store, score: for each query (query_id, query_vector) at least the k best chunks (vec_id, store, embedding), of each store if per_store.

    Scores are cosines, rounded; vectors without one, such as null or zero ones, have a null score, which counts as 0.
    A task holds about `block` chunks and as many queries.
    """
    n, q = chunks.count(), queries.count()
    rows, asks = max(1, -(-n // block)), max(1, -(-q // block))
    dealt = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = chunks.select("vec_id", "store", "embedding", dealt("vec_id", rows).alias("__row"), every(asks).alias("__ask"))
    right = queries.select("query_id", "query_vector", dealt("query_id", asks).alias("__ask"), every(rows).alias("__row"))
    kinds = dict(chunks.dtypes) | dict(queries.dtypes)
    schema = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, store {kinds['store']}, score double"

    def compare(found: pa.Table, asked: pa.Table) -> pa.Table:
        picked: list[tuple[int, np.ndarray, np.ndarray]] = []
        if found.num_rows and asked.num_rows:
            x, wanted, ids = _matrix(found["embedding"]), _matrix(asked["query_vector"]), found["vec_id"].to_numpy()
            stores = np.unique(np.array([str(s) for s in found["store"].to_pylist()]), return_inverse=True)[1] if per_store else np.zeros(len(ids), np.int64)
            for at in range(0, len(wanted), 256):
                part = wanted[at : at + 256]
                scores = np.round(part @ x.T, digits) if part.shape[1] == x.shape[1] else np.full((len(part), len(x)), np.nan)
                for i, row in enumerate(scores):
                    order = np.lexsort((ids, -np.nan_to_num(row), stores))
                    begin = np.concatenate(([True], stores[order][1:] != stores[order][:-1]))
                    place = np.arange(len(order)) - np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
                    best = order[place < k]
                    picked.append((at + i, best, row[best]))
        rows_of = np.concatenate([np.full(len(b), i) for i, b, _ in picked]) if picked else np.zeros(0, np.int64)
        chosen = np.concatenate([b for _, b, _ in picked]) if picked else np.zeros(0, np.int64)
        values = np.concatenate([s for *_, s in picked]) if picked else np.zeros(0)
        return pa.table({"query_id": asked["query_id"].take(pa.array(rows_of)), "vec_id": found["vec_id"].take(pa.array(chosen)), "store": found["store"].take(pa.array(chosen)), "score": pa.array(values, mask=np.isnan(values))})

    return left.groupBy("__row", "__ask").cogroup(right.groupBy("__row", "__ask")).applyInArrow(compare, schema)


def with_fallback(found: DataFrame, others: DataFrame) -> DataFrame:
    """Each query's results; of queries without any, those of another retriever with the same columns."""
    return found.unionByName(others.join(found.select("query_id").distinct(), "query_id", "left_anti"))


def bm25(docs: DataFrame, key: str, text: str, terms: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, pattern: str = "[a-z]+") -> DataFrame:
    """query_id, key, score, rank: the k best documents for each query's terms (query_id, term), by Okapi BM25 over all documents.

    Texts are cut into words once; only words that some query asks for become postings, (key, term, tf, len), and these
    are all that shuffles, next to the sum and the number of the documents' lengths.
    """
    from ledgerloom.operators.hierarchy import bounded

    words = docs.select(F.col(key), F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0)).alias("__words"))
    lengths = words.select(F.col(key), F.size("__words").alias("len"), "__words")
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("mean"))
    wanted = bounded(terms.select("term").distinct())
    postings = lengths.select(key, "len", F.explode("__words").alias("term")).join(wanted, "term", "left_semi").groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    met = postings.join(df, "term").join(F.broadcast(stats)).join(bounded(terms), "term")  # stats is one row
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = met.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def top_k(found: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each group with their rank; null scores count as 0, ties go to the smaller vec_id."""
    order = Window.partitionBy(*by).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def union_store_top_k(found: DataFrame, k: int) -> DataFrame:
    """The k best of each store, and of these the k best: what reaches the second step is bounded by the stores."""
    return top_k(top_k(found, k, ("query_id", "store")).drop("rank"), k)


def threshold_else_all(found: DataFrame, least: float) -> DataFrame:
    """Results from the threshold on; all of a query's results where none reaches it."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return found.withColumn("__best", best).where((F.col("score") >= least) | (F.col("__best") < least)).drop("__best")


def reranked(found: DataFrame, scorer: Callable[[DataFrame], DataFrame], n: int = 3) -> DataFrame:
    """The n best by a scorer that adds `rerank_score`; equals keep their order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scorer(found).withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= n)


def context(found: DataFrame, key: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Texts of each key in order, joined; blank ones left out."""
    rows = found.where(F.trim(text) != "")
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), separator).alias("context"))
