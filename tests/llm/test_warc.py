import gzip
import hashlib
import io

import pytest

from ledgerloom.llm.store import fresh_path
from ledgerloom.llm.token_files import filesystem
from ledgerloom.llm.warc import ArchiveReader, inflated, normalised, page_record, read_archives, record, records, warc_report, with_revisits, write_archives

BIG = "<p>é" * 400
PAGES = [
    (1, "http://a/x y", BIG), (2, None, BIG), (9, "http://a/é\r\nWARC-Type: evil", BIG), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", BIG), (9, "again", BIG),
    (7, "u", "x" * 999), (8, "u", "x" * 999), (10, "u", "x" * 1000), (11, "u", "x" * 1000), (12, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 50), (None, "u", "z" * 2000), (13, "u", "long " * 500_000),
]


def frame(spark, rows):
    from pyspark.sql import functions as F

    names = "own sha of keep again revisit refers_to type offset __own __bits0 number".split()
    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("mine").alias(n) for n in names])


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        keep = max(same, default=None) if len(data) >= 1000 else i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if keep == i else "revisit", None if keep == i else keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_pages(spark, most):
    got = [tuple(r) for r in warc_report(frame(spark, PAGES), max_filter_bytes=most).collect()]
    assert sorted(got, key=str) == brute(PAGES)
    assert warc_report(frame(spark, [])).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert sorted((tuple(r) for r in warc_report(pages).collect()), key=str) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_members_and_index(spark):
    """Streams can't be read from their middle; after normalising each index entry is a gzip member of one record, and the members are the file."""
    source, folder = fresh_path(spark, "streams"), fresh_path(spark, "members")
    numbers = write_archives(with_revisits(frame(spark, PAGES).repartition(3)), source)
    report = normalised(spark, source, numbers, folder).collect()
    assert sum(r.records for r in report) == len(PAGES) + len(numbers)
    store, base = filesystem(folder)
    for n in numbers:
        name = f"part-{n:06d}.warc.gz"
        stream = filesystem(source)[0].open_input_stream(f"{filesystem(source)[1]}/{name}", compression=None).read()
        data = store.open_input_stream(f"{base}/{name}", compression=None).read()
        assert gzip.decompress(stream) == gzip.decompress(data)
        with ArchiveReader(folder, n) as archive:
            rows = archive.index.to_pylist()
            assert rows[0]["type"] == "warcinfo" and sum(r["length"] for r in rows) == len(data)
            for r in rows:
                assert len(list(records(iter([gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])])))) == 1
            assert archive.get(rows[-1]["record_id"])[0]["warc-record-id"] == rows[-1]["record_id"] and archive.get("<urn:page:-7>") is None
    again = fresh_path(spark, "again")
    normalised(spark, folder, numbers, again).collect()  # archives with a member a record go in as well
    key = lambda f: sorted(map(str, read_archives(spark, f, numbers).collect()))
    assert key(again) == key(folder)


def test_headers_hold():
    """A URL can't add a header line, and a payload that looks like records is one payload."""
    raw = page_record(9, "http://a/é\r\nWARC-Type: evil", b"WARC/1.1\r\n\r\n", None, False, "d")
    ((headers, block, whole),) = records(iter([raw]))
    assert headers["warc-type"] == "response" and "\n" not in headers["warc-target-uri"] and block.endswith(b"\r\n\r\nWARC/1.1\r\n\r\n") and whole == raw


@pytest.mark.parametrize("cut", [1, 30, 200])
def test_cut_archives(cut):
    data = gzip.compress(record([("WARC-Type", "x"), ("WARC-Record-ID", "<a>")], bytes(range(256)) * 4))
    with pytest.raises(ValueError):
        list(records(inflated(io.BytesIO(data[:-cut]))))
    plain = gzip.decompress(data)
    with pytest.raises(ValueError):
        list(records(iter([plain[:-cut]])))
    with pytest.raises(ValueError):
        list(records(iter([b"HTTP" + plain])))


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_inflating_in_blocks(most):
    parts = [bytes([i]) * (i * 37) for i in range(40)]
    data = b"".join(map(gzip.compress, parts))
    blocks = list(inflated(io.BytesIO(data), most))
    assert b"".join(blocks) == b"".join(parts) and max(map(len, blocks)) <= most
    assert list(inflated(io.BytesIO(b""))) == []
