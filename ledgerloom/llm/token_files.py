"""Token-id shards with a minimal perfect hash index for keyed access.

A shard is two files. `shard-N.ids` holds the raw ids of its documents, little-endian, two bytes an id where
the vocabulary allows it, else four. `shard-N.idx` holds, one after the other:

    magic "LLTOKENS", id width, documents, documents without a key, distinct keys, bytes of the hash   (6 x 8 bytes)
    document keys, in file order, those without a key first (as 0)                                   (int64 each)
    first id of each document, counted from the shard's start, and the end                           (int64 each)
    fingerprint of the key in each slot of the hash                                                  (uint32 each)
    first document of the key in each slot                                                           (int64 each)
    the minimal perfect hash (ledgerloom.llm.mph)

Shards follow each other in ascending key order; a key with very many documents may go on in the next ones. A task
writes under a name of its own attempt and renames, so a task that is run again leaves the same files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.mph import MinimalPerfectHash, fingerprints
from ledgerloom.llm.store import fresh_path
from ledgerloom.llm.wordcache import DEFAULT_BYTE, encoder
from ledgerloom.llm.words import filled, slices

_MAGIC = b"LLTOKENS"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a local path."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, folder: str, shard: int):
        self.fs, base = filesystem(folder)
        self.ids_path = f"{base}/shard-{shard:06d}.ids"
        data = self.fs.open_input_stream(f"{base}/shard-{shard:06d}.idx").read()
        if data[:8] != _MAGIC:
            raise ValueError(f"shard {shard} of {folder} has no index")
        self.width, n, self.nulls, keys, hash_bytes = map(int, np.frombuffer(data, "<i8", 5, 8))
        at, parts = 48, []
        for kind, count in (("<i8", n), ("<i8", n + 1), ("<u4", keys), ("<i8", keys)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.keys, self.starts, self.prints, self.firsts = parts
        self.hash = MinimalPerfectHash.load(data[at : at + hash_bytes])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, or -1: one look at the hash, one at the fingerprint, one at the key."""
        as_u = keys.astype(np.int64).view(np.uint64)
        slot = self.hash.index(as_u)
        slot[(slot < 0) | (slot >= len(self.prints))] = -1
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(as_u[known])
        out = np.where(known, self.firsts[np.where(known, slot, 0)] if len(self.firsts) else -1, -1)
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out

    def documents(self, keys: np.ndarray) -> np.ndarray:
        """The documents of all of these keys that the shard has: from the one that the hash gives, those with the same key."""
        firsts = self.find(keys)
        firsts = firsts[firsts >= 0]
        ends = self.nulls + np.searchsorted(self.keys[self.nulls :], self.keys[firsts], "right")
        return np.repeat(firsts - np.concatenate(([0], np.cumsum(ends - firsts)[:-1])), ends - firsts) + np.arange(int((ends - firsts).sum())) if len(firsts) else firsts

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids of the documents first to last - 1."""
        with self.fs.open_input_file(self.ids_path) as f:
            f.seek(int(self.starts[first]) * self.width)
            data = f.read(int(self.starts[last] - self.starts[first]) * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        """Ids of one document, by its key."""
        at = int(self.find(np.array([key], np.int64))[0])
        return None if at < 0 else self.read(at, at + 1)


def _index(keys: np.ndarray, nulls: int, starts: np.ndarray, width: int) -> bytes:
    distinct, first = np.unique(keys[nulls:], return_index=True)
    as_u = distinct.view(np.uint64)
    hashed = MinimalPerfectHash.build(as_u)
    slot = hashed.index(as_u)
    prints, firsts = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8")
    prints[slot], firsts[slot] = fingerprints(as_u), first + nulls
    dump = hashed.dump()
    head = np.array([width, len(keys), nulls, len(distinct), len(dump)], "<i8").tobytes()
    return b"".join((_MAGIC, head, keys.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), prints.tobytes(), firsts.tobytes(), dump))


_WRITTEN = "shard int, docs long, ids long, nulls long, low long, high long"
_WRITTEN_NAMES = [x.split()[0] for x in _WRITTEN.split(", ")]


def _writer(folder: str, vocabulary: str, end_id: int, key_at: int, text_at: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get()
        shard = task.partitionId()
        end = np.array([end_id], "<u4").tobytes()
        width = 2 if max(encode.library.get_vocab_size(), end_id) <= 1 << 16 else 4
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        own, keys, lengths, ids, nulls = f"{base}/.attempt-{task.taskAttemptId()}", [], [], None, 0
        for batch in batches:
            texts = filled(batch.column(text_at))
            nulls += batch.column(key_at).null_count
            keys.append(batch.column(key_at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for a, b in slices(texts):
                ids = ids or store.open_output_stream(f"{own}.ids")
                got = encode.encode(texts.slice(a, b - a).to_pylist())
                lengths += [len(x) // 4 + 1 for x in got]
                ids.write(np.frombuffer(end.join([*got, b""]), "<u4").astype(f"<u{width}"))
        if ids is None:
            return
        ids.close()
        starts, every = np.concatenate(([0], np.cumsum(lengths))), np.concatenate(keys)
        with store.open_output_stream(f"{own}.idx") as f:
            f.write(_index(every, nulls, starts, width))
        for kind in ("ids", "idx"):
            to = f"{base}/shard-{shard:06d}.{kind}"
            if store.get_file_info(to).type != fs.FileType.NotFound:
                store.delete_file(to)
            store.move(f"{own}.{kind}", to)
        keyed = every[nulls:]
        ends = (None, None) if not len(keyed) else (int(keyed[0]), int(keyed[-1]))
        row = (shard, len(lengths), int(starts[-1]), nulls, *ends)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i else pa.int32()) for i, x in enumerate(row)], names=_WRITTEN_NAMES)

    return write


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = DEFAULT_BYTE, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> list[tuple]:
    """Writes docs' ids, end_id after each document, to shards under folder in ascending id order.

    Gives (shard, documents, ids, documents without a key, least key, largest key) of each shard: as many rows as
    shards, which Spark sizes by the shuffled bytes. Null texts count as empty; null ids come first; rows that share an
    id follow each other, by a hash of their texts, and may go on in the next shard, so that no key fills a task.
    """
    own = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    own = own.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    laid = own.repartitionByRange("key", "tie", "row").sortWithinPartitions("key", "tie", "row").select("key", "text")
    return sorted(tuple(r) for r in laid.mapInArrow(_writer(folder, vocabulary, end_id, 0, 1), _WRITTEN).collect())


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _asked(lows: np.ndarray, highs: np.ndarray, numbers: np.ndarray, nulls: list[int]):
    """Keys as (shard, key), once for each shard whose range has it; a null key for each shard with documents without one."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            first = np.searchsorted(highs, keys, "left")
            count = np.maximum(np.searchsorted(lows, keys, "right") - first, 0)
            at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum())) if len(keys) else first
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at].astype(np.int32)), pa.array(np.repeat(keys, count))], names=["shard", "key"])
            if batch.column(0).null_count:
                yield pa.RecordBatch.from_arrays([pa.array(nulls, pa.int32()), pa.nulls(len(nulls), pa.int64())], names=["shard", "key"])

    return ask


def _described(reader: ShardReader, base: int, documents: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents as read from the shard's payload, about 1 Mi ids at once."""
    documents = np.sort(documents)
    at = 0
    while at < len(documents):
        first = documents[at]
        end = max(at + 1, int(np.searchsorted(documents, np.searchsorted(reader.starts, reader.starts[first] + (1 << 20), "right") - 1, "left")))
        chosen = documents[at:end]
        ids = reader.read(first, chosen[-1] + 1)
        starts, ends = reader.starts[chosen], reader.starts[chosen + 1]
        crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist(), strict=True)]
        columns = [pa.array(reader.keys[chosen], pa.int64(), mask=chosen < reader.nulls), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _READ.split(", ")])
        at = end


def _reader(folder: str, base_of: dict[int, int]):
    """Rows (shard, key), each shard's together: its documents of these keys."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if now != shards[a]:
                    now, reader = int(shards[a]), ShardReader(folder, int(shards[a]))
                keys = batch.column(1).slice(a, b - a)
                if keys.null_count:
                    yield from _described(reader, base_of[now], np.arange(reader.nulls))
                yield from _described(reader, base_of[now], reader.documents(keys.drop_null().to_numpy(zero_copy_only=False)))

    return read


def read_token_files(keys: DataFrame, folder: str, shards: list[tuple]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document of the keys (one column), looked up by key in the files' index."""
    base_of, total = {}, 0
    for shard, _, ids, *_ in shards:
        base_of[shard] = total
        total += ids
    keyed = [s for s in shards if s[4] is not None]
    lows, highs, numbers = (np.array([s[i] for s in keyed], np.int64) for i in (4, 5, 0))
    distinct = keys.toDF("key").select(F.col("key").cast("long")).distinct()
    asked = distinct.mapInArrow(_asked(lows, highs, numbers, [s[0] for s in shards if s[3]]), "shard int, key long")
    laid = asked.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "key")
    return laid.mapInArrow(_reader(folder, base_of), _READ)


def token_file_report(docs: DataFrame, vocabulary: str = DEFAULT_BYTE, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes docs to token files and describes each document as looked up in them by its key.

    Null and empty texts have the end id alone; null ids come first; rows that share an id are each reported; extra
    columns are ignored; an empty table gives no rows.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    shards = write_token_files(docs, folder, vocabulary, end_id)
    return read_token_files(docs.select("doc_id"), folder, shards)
