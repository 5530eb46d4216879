"""WARC archives of pages: writing, normalising, and reading back by offset.

Archives come as one gzip stream a file, from whose middle nothing can be read. The normaliser inflates such a stream
once, in blocks, cuts it into records, and writes each as a gzip member of its own, so that a record is read by its
offset alone. What it found stands beside the archive:

    part-N.warc.gz        members, one a record
    part-N.idx.parquet    record_id, type, offset, length of each member, in the archive's order

A task writes under a name of its own attempt and renames, so a task that is run again leaves the same files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bloom import flagged
from ledgerloom.llm.store import fresh_path, scratch, written
from ledgerloom.llm.token_files import filesystem

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _GZIP = b"\r\n\r\n", 31

Headers = dict[str, str]


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; Content-Length is added."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + _END + block + _END


def inflated(stream: BinaryIO, most: int = 1 << 20) -> Iterator[bytes]:
    """What a gzip file holds, in blocks of at most `most` bytes, whether it is one member or many. ValueError where it ends within one."""
    inflater, data, begun = zlib.decompressobj(_GZIP), b"", False
    while True:
        data = data or stream.read(most)
        if not data:
            if begun and not inflater.eof:
                raise ValueError("the archive ends within a gzip member")
            return
        if inflater.eof:
            inflater = zlib.decompressobj(_GZIP)
        begun = True
        block = inflater.decompress(data, most)
        data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
        if block:
            yield block


def records(blocks: Iterator[bytes]) -> Iterator[tuple[Headers, bytes, bytes]]:
    """Headers (names in lower case), block and all bytes of each record. No more than a record and a block is held."""
    held = bytearray()

    def until(needed: int) -> bool:
        while len(held) < needed:
            more = next(blocks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while until(1):
        end = held.find(_END)
        while end < 0:
            seen = len(held)
            if not until(seen + 1):
                raise ValueError("the archive ends within a record's headers")
            end = held.find(_END, max(0, seen - len(_END)))
        first, *lines = bytes(held[:end]).split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines)}
        start = end + len(_END)
        stop = start + int(headers["content-length"])
        if not until(stop + len(_END)) or held[stop : stop + len(_END)] != _END:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        whole = bytes(held[: stop + len(_END)])
        del held[: stop + len(_END)]
        yield headers, whole[start:stop], whole


def _put(store: fs.FileSystem, own: str, to: str) -> None:
    if store.get_file_info(to).type != fs.FileType.NotFound:
        store.delete_file(to)
    store.move(own, to)


# Writing


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "-" else int(number)


def sha1_label(digest: bytes) -> str:
    """SHA-1 as archives write it."""
    return "sha1:" + base64.b32encode(digest).decode()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response with the page, or a revisit: the HTTP headers without it, its length and digest, and which response has it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", date)]
    if url:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    headers.append(("WARC-Payload-Digest", sha1_label(hashlib.sha1(payload).digest())))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", page_urn(refers_to))]
    return record([*headers, ("Content-Type", "application/http;msgtype=response")], http if revisit else http + payload)


def with_revisits(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """page_id, url, html, refers_to, revisit: of pages with equal html of least_bytes or more, those without the largest id revisit it.

    Hashes that may be repeated are found by Bloom filtering; all other pages pass straight through, and a group's pages
    meet its one row in a join that Spark can split. Null html counts as empty, and a null id is smaller than any other.
    Rows with the largest id of their group are all responses.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    hashed = own.withColumn("sha", F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256)))
    keys = hashed.where("sha is not null").select("sha")
    seen = flagged(hashed, keys, F.col("sha"), keys.count(), "again", max_filter_bytes)
    again = F.col("again") & F.col("sha").isNotNull()
    none = (F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"))
    once, maybe = seen.where(~again), seen.where(again)
    best = written(maybe.groupBy(F.col("sha").alias("of")).agg(F.max("page_id").alias("keep")), "groups")
    met = maybe.join(best, F.col("sha") == F.col("of")).withColumn("revisit", ~F.col("page_id").eqNullSafe(F.col("keep")))
    return once.select("page_id", "url", "html", *none).unionByName(met.select("page_id", "url", "html", F.when(F.col("revisit"), F.col("keep")).alias("refers_to"), "revisit"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> list[int]:
    """Writes pages (as with_revisits gives them) to folder/part-N.warc.gz, each one gzip stream, and gives the numbers: one a task.

    Every archive begins with a warcinfo record. date stands in all records, so that a task run again writes the same.
    """
    names = ["page_id", "url", "html", "refers_to", "revisit"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        number, own, out = task.partitionId(), f"{base}/.attempt-{task.taskAttemptId()}", None
        for batch in batches:
            if out is None and batch.num_rows:
                out, deflater = store.open_output_stream(own, compression=None), zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                about = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{number}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                out.write(deflater.compress(about))
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for page_id, url, html, refers_to, revisit in zip(*(part.column(i).to_pylist() for i in range(2)), part.column(2).cast(pa.binary()).to_pylist(), *(part.column(i).to_pylist() for i in (3, 4)), strict=True):
                    out.write(deflater.compress(page_record(page_id, url, html, refers_to, revisit, date)))
        if out is not None:
            out.write(deflater.flush())
            out.close()
            _put(store, own, f"{base}/part-{number:06d}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], names=["number"])

    return sorted(r[0] for r in pages.select(*names).mapInArrow(write, "number int").collect())


# Normalising


def _each(spark: SparkSession, numbers: list[int]) -> DataFrame:
    """A row and a task for each archive."""
    return spark.range(0, len(numbers), 1, max(1, len(numbers)))


def normalised(spark: SparkSession, source: str, numbers: list[int], folder: str, level: int = 6) -> DataFrame:
    """Rewrites source's archives to folder with a gzip member a record and an index beside each: number, records, bytes.

    A task inflates one archive's stream once, from its start to its end, and holds one record; an archive may be one
    member, many, or a member a record already. ValueError where a record is cut off.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        origin, root = filesystem(source)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                own, name = f"{base}/.attempt-{TaskContext.get().taskAttemptId()}-{k}", f"part-{numbers[k]:06d}"
                found, at = [], 0
                with origin.open_input_stream(f"{root}/{name}.warc.gz", compression=None) as stream, store.open_output_stream(own, compression=None) as out:
                    for headers, _, whole in records(inflated(stream)):
                        deflater = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                        member = deflater.compress(whole) + deflater.flush()
                        out.write(member)
                        found.append((headers["warc-record-id"], headers["warc-type"], at, len(member)))
                        at += len(member)
                columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
                with store.open_output_stream(f"{own}.idx") as out:
                    pq.write_table(pa.table(columns, ["record_id", "type", "offset", "length"]), out)
                _put(store, own, f"{base}/{name}.warc.gz")
                _put(store, f"{own}.idx", f"{base}/{name}.idx.parquet")
                yield pa.RecordBatch.from_arrays([pa.array([numbers[k]], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([at], pa.int64())], names=["number", "records", "bytes"])

    return _each(spark, numbers).mapInArrow(rewrite, "number int, records long, bytes long")


# Reading


class ArchiveReader:
    """Records of one normalised archive, each read by its offset."""

    def __init__(self, folder: str, number: int):
        self.fs, base = filesystem(folder)
        self.path = f"{base}/part-{number:06d}.warc.gz"
        self.index = pq.read_table(self.fs.open_input_file(f"{base}/part-{number:06d}.idx.parquet"))

    def __enter__(self) -> ArchiveReader:
        self.file = self.fs.open_input_file(self.path)
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def at(self, offset: int, length: int) -> tuple[Headers, bytes]:
        self.file.seek(offset)
        ((headers, block, _),) = records(iter([zlib.decompress(self.file.read(length), _GZIP)]))
        return headers, block

    def get(self, record_id: str) -> tuple[Headers, bytes] | None:
        """The first record with this id."""
        k = self.index.column("record_id").index(record_id).as_py()
        return None if k < 0 else self.at(self.index.column("offset")[k].as_py(), self.index.column("length")[k].as_py())


def described(headers: Headers, block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, bytes and SHA-1 of the full payload, type, and the page that a revisit refers to. ValueError where a payload isn't what its headers say."""
    head, _, payload = block.partition(_END)
    http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    kind, size = headers["warc-type"], int(http[b"content-length"])
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"record {headers['warc-record-id']} doesn't hold the payload of its digest")
    return page_of(headers["warc-record-id"]), size, digest.hex(), kind, page_of(headers["warc-refers-to"]) if kind == "revisit" else None


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PAGE_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())


def read_archives(spark: SparkSession, folder: str, numbers: list[int]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page of normalised archives, each member found by the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with ArchiveReader(folder, numbers[k]) as archive:
                    for part in archive.index.to_batches(1024):
                        kinds, offsets, lengths = (part.column(i).to_pylist() for i in (1, 2, 3))
                        rows = [described(*archive.at(o, n)) for kind, o, n in zip(kinds, offsets, lengths, strict=True) if kind in ("response", "revisit")]
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_PAGE_KINDS)], names=[x.split()[0] for x in _PAGES.split(", ")])

    return _each(spark, numbers).mapInArrow(read, _PAGES)


def warc_report(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """Writes pages to archives, normalises them into folder, and describes each page as read back from there.

    Null html is an empty payload; one of any length is a record. Rows that repeat an id share their record's id; of equal
    payloads those with the largest id are responses, and a null id is smaller than any other. An empty table gives no
    rows and no archive. Extra columns are ignored. The normalised archives stay: they are the caller's to delete.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    with scratch(spark):
        source = fresh_path(spark, "warc-streams")
        numbers = write_archives(with_revisits(pages.select("page_id", "url", "html"), least_bytes, max_filter_bytes=max_filter_bytes), source)
        normalised(spark, source, numbers, folder).collect()
    return read_archives(spark, folder, numbers)
