"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Documents are dealt to partitions by a hash and packed there best-fit decreasing. Dual feasible functions give a
lower bound of each partition's bins. All bins with free space of partitions that stay above their bound, and bins that
are less than half full, go on to the next round: there the bins of several partitions meet, exchange their documents
and are packed anew, and the new packing is taken if it needs fewer bins. Rounds go on until none is left, all that are
left met in one partition, or a round saved less than one bin in a thousand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.store import scratch, written
from ledgerloom.llm.wordcache import DEFAULT_WORD, encoder
from ledgerloom.llm.words import filled, slices

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = 4096, vocabulary: str = DEFAULT_WORD, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents as pieces of at most capacity ids, the end id included: only longer documents are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, words=True), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, ids = filled(batch.column(1)), batch.column(0).to_pylist()
            rows: tuple[list, ...] = ([], [], [], [], [])
            for a, b in slices(texts):
                for key, got in zip(ids[a:b], encode.encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    got += end
                    for k, at in enumerate(range(0, len(got), 4 * capacity)):
                        part = got[at : at + 4 * capacity]
                        for column, value in zip(rows, (key, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing needs fewer bins: the most that the dual feasible functions below show.

    u_k(x) is x where (k + 1) x is whole, else floor((k + 1) x) / k. f_e(x) is 1 above 1 - e, 0 below e, else x.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 25):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        # in units of 1 / (k * capacity)
        units = np.where(whole, k * x, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * units).sum()) // (k * capacity)))
    total, number = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    return max(best, int((large + -(-middle // capacity)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item. Open bins are kept by free space, with a bit mask of the spaces that occur."""
    out = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        above = mask >> length
        if above:
            space = length + (above & -above).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            at, space, bins = bins, capacity, bins + 1
        out[i] = at
        space -= length
        if space:
            free[space].append(at)
            mask |= 1 << space
    return out


def _round(capacity: int, level: int):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy().astype(np.int64)
        old = table["bin"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        if (old >= 0).all():
            distinct = np.unique(old, return_inverse=True)[1]
            if int(distinct.max()) + 1 <= n:
                bins, n = distinct, int(distinct.max()) + 1
        fill = np.bincount(bins, lengths, n)
        again = fill < capacity if n > lower_bound(lengths, capacity) else fill <= capacity / 2
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.concatenate(([True], np.diff(bins[order]) != 0))
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - lengths[order] - base
        sequence = (level << 56) + (key[0].as_py() << 24) + bins
        done = table.drop_columns(["bin", "grp"])
        for name, values in (("sequence_id", sequence), ("offset", offset), ("again", again[bins])):
            done = done.append_column(name, pa.array(values))
        return done

    return pack


def pack(items: DataFrame, capacity: int = 4096, per_partition: int = 32768) -> DataFrame:
    """items (doc_id, piece, length and more) with sequence_id and offset.

    A partition of any round holds about per_partition items, dealt by hashes of rows or bins, whatever their ids; which
    of equal lengths comes first is free. What a round can't better any more stays as it is: without a certificate where
    its partition's bins are more than the bound.
    """
    extra = [c for c in items.columns if c not in ("sequence_id", "offset")]
    kinds = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in extra) + ", sequence_id long, offset long, again boolean"
    groups = max(1, -(-items.count() // per_partition))
    dealt = lambda key: F.pmod(F.xxhash64(key), F.lit(groups))
    left = items.withColumn("bin", F.lit(-1).cast("long")).withColumn("grp", dealt(F.monotonically_increasing_id()))
    out, level, entered = None, 0, None
    while True:
        packed = written(left.groupBy("grp").applyInArrow(_round(capacity, level), schema), "packed")
        bins, open_bins, open_items = packed.agg(F.count_if(F.expr("offset = 0")), F.count_if(F.expr("offset = 0 and again")), F.count_if("again")).first()
        last = groups == 1 or not open_bins or (entered is not None and (entered - bins) * 1000 < entered)
        done = (packed if last else packed.where("not again")).drop("again")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        groups, level, entered = max(1, -(-open_items // per_partition)), level + 1, open_bins
        left = packed.where("again").withColumnRenamed("sequence_id", "bin").drop("offset", "again").withColumn("grp", dealt(F.col("bin") + level))


def pack_documents(docs: DataFrame, capacity: int = 4096, vocabulary: str = DEFAULT_WORD, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty: the end id alone. Texts may be of any length; repeated rows, and rows with a null id, are
    packed each; extra columns are ignored; an empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(pack(written(pieces(docs, capacity, vocabulary, end_id, text_col, id_col), "pieces"), capacity), "packed")
