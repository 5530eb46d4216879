"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is indexed. The share of the lists that a
query visits, those whose centroids have the largest product with it, is measured on some of the queries themselves,
whose nearest rows are found by brute force: the smallest that holds enough of these. In the lists, tables of the query's
products with each codebook give approximate scores, and only the best few of each block are scored exactly: four times
as many, and again, until the same queries find enough.

A block is a group of lists, or a part of a large one, against a group of queries: at most `most_rows` vectors and as
many queries. A query is sent once to each block that has a list it visits, not once to each list. Queries that met too
few candidates visit all lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import scratch, written


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            total = np.bincount(near, x[:, j], k)
            centres[count > 0, j] = total[count > 0] / count[count > 0]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centres**2).sum(1)
    for at in range(0, len(x), rows):
        out[at : at + rows] = (norms - 2 * x[at : at + rows] @ centres.T).argmin(1)
    return out


class Quantiser:
    """Coarse centroids, and one codebook for each run of `width` components of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, width: int = 2, codes: int = 256, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres = kmeans(sample, lists, rounds, rng)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = [(a, min(a + width, sample.shape[1])) for a in range(0, sample.shape[1], width)]
        self.books = [kmeans(rest[:, a:b], min(codes, max(1, len(sample))), rounds, rng) for a, b in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = nearest(x, self.centres)
        rest = x - self.centres[near]
        return near, np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def approximate(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Scores of each query against each coded vector of list `at`: one table look-up for each codebook."""
        out = np.repeat((queries @ self.centres[at])[:, None], len(codes), 1)
        for j, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (queries[:, a:b] @ book.T)[:, codes[:, j]]
        return out


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, summed component by component in order."""
    out = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        out += queries[:, j] * vectors[:, j]
    return out


def _usable(vector: Column, size: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _unpacked(column, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _true_nearest(index: DataFrame, ids: np.ndarray, asks: np.ndarray, size: int, kind: str, k: int) -> np.ndarray:
    """The k nearest of a few queries among all rows, by brute force: place in asks, vec_id and list, a row each.

    Each task keeps the best k of its rows for each query.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, 4))] * len(asks)
        for batch in batches:
            own, near, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _unpacked(batch.column(2), kind, batch.num_rows).astype(np.float64)
            for at in range(0, len(x), 4096):
                some, scores = own[at : at + 4096], asks @ x[at : at + 4096].T
                order = np.argsort(some, kind="stable")  # so that ties go to smaller ids
                for i in range(len(asks)):
                    met = order[some[order] != ids[i]]
                    top = met[_best(scores[i, met], k)]
                    rows = np.concatenate((held[i], np.stack((some[top].view(np.float64), near[at + top].astype(np.float64), scores[i, top], np.full(len(top), float(i))), 1)))
                    held[i] = rows[np.lexsort((rows[:, 0].copy().view(np.int64), -rows[:, 2]))[:k]]
        rows = np.concatenate(held)
        if len(rows):
            columns = (rows[:, 3].astype(np.int32), rows[:, 0].copy().view(np.int64), rows[:, 1].astype(np.int32), rows[:, 2].copy())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "vec_id", "list", "score"])

    each = index.select("vec_id", "list", "vector").mapInArrow(scan, "place int, vec_id long, list int, score double")
    best = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    rows = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("place", "vec_id", "list").collect()  # k for each of a few queries
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, 3)


def needed_lists(quantiser: Quantiser, asks: np.ndarray, nearest_rows: np.ndarray, recall: float) -> int:
    """The smallest number of lists, those whose centroids are nearest to a query, that hold `recall` of the nearest rows given."""
    order = np.argsort(-(asks @ quantiser.centres.T), 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    needed = np.sort(place[nearest_rows[:, 0], nearest_rows[:, 2]])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else len(quantiser.centres)


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest of scores, the first of equal ones; all if there are fewer."""
    if len(scores) <= most:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - most)[len(scores) - most]
    above = np.flatnonzero(scores > edge)
    return np.concatenate((above, np.flatnonzero(scores == edge)[: most - len(above)]))


def _laid(sizes: dict[int, int], lists: int, most_rows: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """The lists of each block, and each list's first block and number of blocks: small lists share one, large ones are split."""
    blocks, places, room = [], [], 0
    for at in range(lists):
        n = sizes.get(at, 0)
        parts = -(-n // most_rows)
        if parts > 1 or n > room or not blocks:
            places.append((len(blocks), max(1, parts)))
            blocks += [[at] for _ in range(max(1, parts))]
            room = 0 if parts > 1 else most_rows - n
        else:
            blocks[-1].append(at)
            places.append((len(blocks) - 1, 1))
            room -= n
    return blocks, places


def _search(index: DataFrame, queries: DataFrame, asks: int, sizes: dict[int, int], quantiser: Quantiser, size: int, kind: str, k: int, probes: int, rerank: int, most_rows: int) -> DataFrame:
    """Scored candidates (query_id, vec_id, score): the best k of each block, at least."""
    lists = len(quantiser.centres)
    blocks, places = _laid(sizes, lists, most_rows)
    groups = max(1, -(-asks // most_rows))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column(1), size), batch.column(0)
            for at in range(0, len(x), 1024):
                part = x[at : at + 1024]
                products = part @ quantiser.centres.T
                edge = np.partition(products, lists - probes, 1)[:, lists - probes]
                edge -= 1e-9 * np.abs(edge)  # what is read again must not fall below by rounding
                seen = products >= edge[:, None]
                packed = _packed(part.astype(kind))
                for block, held in enumerate(blocks):
                    rows = pa.array(np.flatnonzero(seen[:, held].any(1)))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block, np.int32)), ids.slice(at, 1024).take(rows), packed.take(rows), pa.array(edge).take(rows)], names=["block", "query_id", "query", "edge"])

    # one row a list, of which there are no more than max_lists
    where = F.broadcast(index.sparkSession.createDataFrame([(at, first, parts) for at, (first, parts) in enumerate(places)], "list int, first int, parts int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    left = index.join(where, "list").select((F.col("first") + part).alias("block"), each.alias("ask_block"), "list", "vec_id", "codes", "vector")
    right = queries.select("vec_id", "vector").mapInArrow(visit, "block int, query_id long, query binary, edge double").withColumn("ask_block", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))

    def compare(key: tuple[pa.Scalar, ...], vectors: pa.Table, asked: pa.Table) -> pa.Table:
        n, q = vectors.num_rows, asked.num_rows
        out: list[list[np.ndarray]] = [[], [], []]
        if n and q:
            ids, near, query_ids, edges = (t[c].to_numpy() for t, c in ((vectors, "vec_id"), (vectors, "list"), (asked, "query_id"), (asked, "edge")))
            order = np.lexsort((ids, near))
            ids, near, codes = ids[order], near[order], _unpacked(vectors["codes"], "u1", n)[order]
            x, wanted = _unpacked(vectors["vector"], kind, n)[order], _unpacked(asked["query"], kind, q).astype(np.float64)
            held, begin = np.unique(near, return_index=True)
            end = [*begin[1:].tolist(), n]
            for at in range(0, q, 128):
                these = wanted[at : at + 128]
                seen = these @ quantiser.centres[held].T >= edges[at : at + 128, None]
                rough = np.full((len(these), n), -np.inf)
                for j, own in enumerate(held.tolist()):
                    rows = np.flatnonzero(seen[:, j])
                    if len(rows):
                        rough[rows, begin[j] : end[j]] = quantiser.approximate(these[rows], own, codes[begin[j] : end[j]])
                rough[query_ids[at : at + 128, None] == ids] = -np.inf
                for i in range(len(these)):
                    met = np.flatnonzero(rough[i] > -np.inf)
                    met = met[np.argsort(ids[met], kind="stable")]  # so that ties go to smaller ids
                    row = np.sort(met[_best(rough[i, met], rerank)])
                    score = exact_scores(np.broadcast_to(these[i], (len(row), size)), x[row].astype(np.float64))
                    top = np.lexsort((ids[row], -score))[:k]
                    for column, values in zip(out, (np.full(len(top), query_ids[at + i]), ids[row[top]], score[top]), strict=True):
                        column.append(values)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({name: np.concatenate(c) if c else np.zeros(0, t) for name, c, t in zip(("query_id", "vec_id", "score"), out, kinds, strict=True)})

    keys = ("block", "ask_block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")


def _tuned(index: DataFrame, some: pa.Table, sizes: dict[int, int], quantiser: Quantiser, size: int, kind: str, k: int, recall: float, rerank: int, most_rows: int) -> tuple[int, int]:
    """How many lists a query visits and how many candidates of a block are scored exactly, so that the queries given (vec_id, vector) find `recall` of their nearest."""
    if not some.num_rows:
        return len(quantiser.centres), rerank
    ids, asks = some["vec_id"].to_numpy(), _matrix(some["vector"].combine_chunks(), size)
    true = _true_nearest(index, ids, asks, size, kind, k)
    probes = needed_lists(quantiser, asks, true, recall)
    wanted = {(int(ids[place]), vec_id) for place, vec_id, _ in true.tolist()}
    asked = index.sparkSession.createDataFrame(some)
    while rerank < most_rows:
        found = _search(index, asked, len(ids), sizes, quantiser, size, kind, k, probes, rerank, most_rows)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        got = {(r[0], r[1]) for r in found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id").collect()}  # k for each of these queries
        if len(got & wanted) >= (recall - 0.01) * len(wanted):
            break
        rerank *= 4
    return probes, rerank


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 20, recall: float = 0.95, probe_share: float | None = None, rerank: int = 160, max_sample: int = 20_000, max_asks: int = 256, max_lists: int = 4096, least_rows: int = 4096, most_rows: int = 131_072, vector_col: str = "embedding", id_col: str = "vec_id"
) -> DataFrame:
    """The k nearest found of each row that `queries` picks, among all other rows: query_id, rank, vec_id, score.

    Nearest is the largest inner product; ties go to the smaller id. Fitted on at most max_sample vectors, those with
    the least hashes of their ids; about as many lists as the square root of the rows, at most max_lists. A query
    visits probe_share of the lists, and of a block's candidates the best `rerank` by approximate score are scored
    exactly. Where no share is given, both are measured: of at most max_asks queries, with the least hashes of their
    ids, the k nearest among all rows are found by brute force, and the share is that which holds `recall` of them: small
    for clustered vectors, and more than half for directions without clusters (README has figures); then rerank grows
    until these queries find that many, less 0.01, or all candidates are scored exactly. Blocks have least_rows to most_rows
    rows and queries, 64 blocks in between. Vectors that are null, zero, of another length than the commonest, or hold
    null or non-finite components take no part, nor do rows with a null id. Repeated rows are candidates each, but no
    row is a candidate of a query with its id. An empty table gives no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asks")).where("vec_id is not null")
    schema = "query_id long, rank int, vec_id long, score double"
    common = own.where("vector is not null").groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["size"]
    own = own.where(_usable(F.col("vector"), size))
    total, asks = own.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    if not total:
        return spark.createDataFrame([], schema)
    sample = _matrix(own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("vector").toArrow()["vector"].combine_chunks(), size)
    quantiser = Quantiser(sample, max(1, min(max_lists, round(total**0.5))))
    lists = len(quantiser.centres)
    rows = min(most_rows, max(least_rows, total // 64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                near, codes = quantiser.encode(part)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0).slice(at, 4096), _packed(codes), _packed(part.astype(kind))], names=["list", "vec_id", "codes", "vector"])

    with scratch(spark) as keep:
        index = written(own.select("vec_id", "vector").mapInArrow(encode, "list int, vec_id long, codes binary, vector binary"), "index")
        # one row a list, of which there are no more than max_lists
        sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
        asking = own.where("asks")
        if probe_share is not None:
            probes = min(lists, max(1, -int(-probe_share * lists // 1)))
        else:
            some = asking.groupBy("vec_id").agg(F.first("vector").alias("vector")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_asks).toArrow().combine_chunks()
            probes, rerank = _tuned(index, some, sizes, quantiser, size, kind, k, recall, rerank, rows)
        found = written(_search(index, asking, asks, sizes, quantiser, size, kind, k, probes, rerank, rows), "found")
        enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1)).select(F.col("query_id").alias("vec_id"))
        few = written(asking.join(enough, "vec_id", "left_anti"), "few")
        count = few.count()
        if count:
            rest = _search(index, few, count, sizes, quantiser, size, kind, k, lists, rows, rows)
            found = found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        return keep(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
