"""A quality classifier: a factorisation machine over hashed words and structure statistics of the text.

No metadata is used: lang, source and doc_id are barred, and n_chars, all that is left of the columns, follows from the text.

A document's features are its words, hashed to WORD_BUCKETS columns with values of unit length, and one column for the
bin of each statistic of its structure, its length among them. The score is

    sigmoid(w0 + sum_j w_j x_j + 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2)),

the last term being all pairwise interactions in time linear in the features. It is fitted on a bounded sample of
labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ledgerloom.llm.words import SPACED, Words, buffer, filled, slices

WORD_BUCKETS, BINS, RANK = 4096, 16, 8

_U = np.uint64
_KIND = np.zeros(256, np.uint8)  # 1 upper case, 2 lower case, 3 digit, 4 sentence marks, 5 other marks
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[0x2E, 0x2C, 0x3A, 0x3B, 0x27, 0x22, 0x28, 0x29, 0x2D]] = 4
_KIND[[b for b in range(0x21, 0x7F) if _KIND[b] == 0]] = 5
_KIND[0x80:] = 6

STATISTICS = ("log words", "word length", "upper", "digits", "sentence marks", "other marks", "words ending in other marks", "words of other marks only", "repeats of the word before", "distinct words", "upper words", "line words", "log lines", "commonest word", "words without lower case", "sentence ends")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: statistics (a row each), and the words' columns, values and first index of each row."""
    for a, b in slices(texts):
        data, offs = buffer(texts.slice(a, b - a))
        words = Words(data, offs, SPACED)
        hashes, first, n = words.hashes(), words.first, np.maximum(words.count, 1)
        kind, size = _KIND[data], np.maximum(np.diff(offs), 1)
        of = [_sums(kind == k, offs) for k in range(7)]
        running = {k: np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 5)}
        within = {k: x[words.end] - x[words.start] for k, x in running.items()} if len(words.start) else {k: np.zeros(0) for k in running}
        length = words.end - words.start
        last = kind[words.end - 1] if len(words.end) else np.zeros(0)
        final = data[words.end - 1] if len(words.end) else np.zeros(0)
        before = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1]))) if len(hashes) else np.zeros(0)
        pair = words.doc.astype(_U) << _U(12) | hashes & _U(WORD_BUCKETS - 1)
        distinct, counts = np.unique(pair, return_counts=True)
        doc, column = (distinct >> _U(12)).astype(np.int64), (distinct & _U(WORD_BUCKETS - 1)).astype(np.int64)
        at = np.searchsorted(doc, np.arange(len(offs)))
        top = np.zeros(len(n))
        np.maximum.at(top, doc, counts)
        lines = _sums(data == 10, offs) + 1
        letters = np.maximum(of[1] + of[2], 1)
        stats = np.stack([
            np.log1p(words.count), _sums(length, first) / n, of[1] / letters, of[3] / size, of[4] / size, of[5] / size, _sums(last == 5, first) / n, _sums(within[5] == length, first) / n,
            _sums(before, first) / n, np.diff(at) / n, _sums((within[1] > 1) & (within[2] == 0), first) / n, n / lines, np.log1p(lines), top / n, _sums(within[2] == 0, first) / n, _sums(final == 0x2E, first) / n,
        ], 1)
        values = np.sqrt(counts.astype(np.float64))
        norm = np.sqrt(np.maximum(np.bincount(doc, counts, len(n)), 1))
        yield stats, column, values / norm[doc], at


class FactorisationMachine:
    """Weights over WORD_BUCKETS word columns and BINS columns for each statistic."""

    def __init__(self, edges: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.edges, self.bias, self.weights, self.factors = edges, bias, weights, factors

    def columns(self, stats: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, stats[:, j]) for j, e in enumerate(self.edges)], 1)
        return WORD_BUCKETS + np.arange(bins.shape[1]) * BINS + bins

    def rows(self, stats: np.ndarray, column: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word and statistic columns together: row of each entry, column, value."""
        extra = self.columns(stats)
        n, k = extra.shape
        row = np.concatenate((np.repeat(np.arange(n), np.diff(at)), np.repeat(np.arange(n), k)))
        return row, np.concatenate((column, extra.ravel())), np.concatenate((value, np.full(n * k, k**-0.5)))

    def logits(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(row, self.weights[column] * value, n)
        mixed = np.stack([np.bincount(row, self.factors[column, f] * value, n) for f in range(RANK)], 1)
        squares = np.bincount(row, (self.factors**2).sum(1)[column] * value**2, n)
        return self.bias + linear + ((mixed**2).sum(1) - squares) / 2, mixed

    def scores(self, stats: np.ndarray, column: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(*self.rows(stats, column, value, at), len(stats))[0])

    @classmethod
    def fit(cls, stats: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, rounds: int = 30, batch: int = 256, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> FactorisationMachine:
        """Adagrad on the logistic loss, over shuffled batches."""
        rng = np.random.default_rng(seed)
        edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        width = WORD_BUCKETS + BINS * stats.shape[1]
        share = min(max(labels.mean(), 0.01), 0.99)
        own = cls(edges, float(np.log(share / (1 - share))), np.zeros(width), rng.normal(0, 0.05, (width, RANK)))
        seen_w, seen_v, seen_b = np.full(width, 1e-6), np.full((width, RANK), 1e-6), 1e-6
        for _ in range(rounds):
            order = rng.permutation(len(labels))
            for a in range(0, len(order), batch):
                chosen = order[a : a + batch]
                at = np.cumsum([0, *(len(columns[i]) for i in chosen)])
                row, column, value = own.rows(stats[chosen], np.concatenate([columns[i] for i in chosen]), np.concatenate([values[i] for i in chosen]), at)
                logit, mixed = own.logits(row, column, value, len(chosen))
                error = (_sigmoid(logit) - labels[chosen]) / len(chosen)
                push = error[row] * value
                touched = np.bincount(column, minlength=width) > 0
                grad = np.bincount(column, push, width) + decay * own.weights * touched
                seen_w += grad**2
                steps = np.stack([np.bincount(column, push * (mixed[row, f] - own.factors[column, f] * value), width) for f in range(RANK)], 1) + decay * own.factors * touched[:, None]
                seen_v += steps**2
                seen_b += error.sum() ** 2
                own.weights -= rate * grad / np.sqrt(seen_w)
                own.factors -= rate * steps / np.sqrt(seen_v)
                own.bias -= rate * error.sum() / np.sqrt(seen_b)
        return own


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for stats, column, value, at in features(filled(batch.column(1))):
            n = len(stats)
            cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(done, n), pa.array([s.tobytes() for s in stats], pa.binary()), pa.array([column[i:j].astype(np.int16).tobytes() for i, j in cut], pa.binary()), pa.array([value[i:j].astype(np.float32).tobytes() for i, j in cut], pa.binary())],
                names=["id", "stats", "cols", "vals"],
            )
            done += n


def held_out(id_col: str = "doc_id") -> Column:
    """Whether labels of the row are left out of fitting: the crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, text_col: str = "text", id_col: str = "doc_id") -> FactorisationMachine | None:
    """Fitted on at most max_rows labelled documents that aren't held out: those with the least hashes of their ids.

    Labels of one id that repeat count once, by the largest; null labels and ids count not at all. None without any.
    """
    known = labels.where(f"quality is not null and `{id_col}` is not null").where(~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = texts.join(F.broadcast(chosen.select("id")), "id", "left_semi").mapInArrow(_featured, "id long, stats binary, cols binary, vals binary").dropDuplicates(["id"]).join(F.broadcast(chosen), "id").toArrow()
    if not rows.num_rows:
        return None
    order = np.argsort(rows["id"].to_numpy())
    stats = np.frombuffer(b"".join(rows["stats"].to_pylist()), np.float64).reshape(rows.num_rows, -1)[order]
    columns = [np.frombuffer(x, np.int16).astype(np.int64) for x in rows["cols"].to_pylist()]
    values = [np.frombuffer(x, np.float32).astype(np.float64) for x in rows["vals"].to_pylist()]
    return FactorisationMachine.fit(stats, [columns[i] for i in order], [values[i] for i in order], rows["quality"].to_numpy()[order].astype(np.float64))


def quality_scores(docs: DataFrame, model: FactorisationMachine | None, threshold: float = 0.7, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Each row of docs with its columns, a score and what is predicted (1 from the threshold on). Null texts count as empty.

    Without a model all rows score 1. Rows with equal texts score alike, whatever their ids, null ones too; a text of any
    length is read whole; an empty table gives no rows. The two new names must not be columns of docs.
    """
    if clash := {score_col.lower(), predicted_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns of the documents: {sorted(clash)}")
    if model is None:
        return docs.select("*", F.lit(1.0).alias(score_col), F.lit(1).alias(predicted_col))
    text_at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType()), StructField(predicted_col, IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(*x) for x in features(filled(batch.column(text_at)))]
            found = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(score, schema)


def quality_report(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Nothing but the text is read to score it."""
    model = train(docs, labels, max_rows)
    return quality_scores(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
