import hashlib
import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.models import StubRunner, polled, recognised_pages, rewritten, runner_of
from ledgerloom.sources import images, ingest, stores


def pdf(pages):
    out = b"%PDF-1.4\n"
    for text in pages:
        data = zlib.compress(b"BT /F1 12 Tf (" + text.replace("(", "\\(").replace(")", "\\)").encode("latin-1") + b") Tj 0 -14 Td [(two) -250 (parts)] TJ ET" if text else b"q 1 0 0 1 0 0 cm /Im0 Do Q")
        out += b"1 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream\nendobj\n"
    return out


def xlsx(rows):
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r) if v) + "</row>" for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="Quý"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "a.txt").write_text("Tiền mặt", encoding="utf-16")
    (tmp_path / "a_meta.json").write_text('{"company": "A"}')
    (tmp_path / "log" / "seen.txt").write_text("logged")
    (tmp_path / "b.csv").write_text("name,\nx,1\n,\n")
    (tmp_path / "c.xlsx").write_bytes(xlsx([["h", "k"], ["1", "2"], ["", "3"]]))
    (tmp_path / "d.pdf").write_bytes(pdf(["page (one)", "", "three"]))
    (tmp_path / "e.xls").write_bytes(b"old")
    (tmp_path / "f.docx").write_bytes(b"broken")
    (tmp_path / "g.bin").write_bytes(b"?")
    return str(tmp_path)


def test_whole_folder(spark, folder):
    rows = ingest.loaded(spark, folder, tag="t", skip="/log/").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert by.keys() == {"a.txt", "b.csv", "c.xlsx", "d.pdf", "e.xls", "f.docx"}
    assert by["a.txt"][0].text == "Tiền mặt\ntag:t" and by["a.txt"][0].meta == {"company": "A"}
    assert by["b.csv"][0].text.splitlines()[1:3] == ["Các cột gồm: name.", "name: x"]
    assert by["c.xlsx"][0].part == "Quý" and by["c.xlsx"][0].text.splitlines()[2:4] == ["h: 1; k: 2", "k: 3"]
    assert [r.text for r in by["d.pdf"]] == ["page (one)\ntwoparts\ntag:t", "three\ntwoparts\ntag:t"]
    assert "no reader" in by["e.xls"][0].error and "BadZipFile" in by["f.docx"][0].error
    raw = ingest.documents(ingest.discovered(spark, folder), "raw").where("path like '%c.xlsx'").first()
    assert raw.text.splitlines()[1:] == ["h | k", "1 | 2", " | 3"]
    shown = {r.path.rsplit("/", 1)[1]: r.preview for r in ingest.previews(ingest.documents(ingest.discovered(spark, folder)), pages=1).collect()}
    assert shown["d.pdf"] == "page (one)\ntwoparts" and shown["f.docx"].startswith("[unreadable")


def test_files_and_stores(spark, tmp_path):
    rows = spark.createDataFrame([("p/one", 1, "a,b", 5), ("p/one", 2, "c", None), ("two", 1, "d", 1)], "name string, pos int, x string, n int")
    out = str(tmp_path / "out")
    done = stores.write_files(stores.csv_files(rows, "name", "pos", ["x", "n"]).withColumn("name", F.concat("name", F.lit(".csv"))), out)
    assert {r.done for r in done.collect()} == {"written"}
    assert (tmp_path / "out/p/one.csv").read_bytes() == b'\xef\xbb\xbfx,n\n"a,b",5\nc,\n'
    assert {r.done for r in stores.write_files(stores.triples(rows, "name", "pos", ["x", "n"]), out, "skip").collect()} == {"written", "there"}
    assert (tmp_path / "out/p/one.json").read_text() == '[{"x":"a,b","n":5},{"x":"c","n":null}]' and (tmp_path / "out/two.txt").read_text() == "d | 1"
    assert {r.done for r in stores.write_files(stores.triples(rows, "name", "pos", ["x", "n"]), out, "skip").collect()} == {"there"}
    tables = spark.createDataFrame([("h1\nh2\na", "h1\nh2\nb"), (None, "h1\nh2\nb")], "old string, new string")
    assert [r.v for r in tables.select(stores.without_header(F.col("old"), F.col("new")).alias("v")).collect()] == ["h1\nh2\na\nb", "h1\nh2\nb"]
    path = str(tmp_path / "store")
    assert stores.open_store(spark, path, fallback=str(tmp_path / "none")) is None
    chunks = spark.createDataFrame([("1", "x", [1.0], {"type": "table"}), ("2", "y", [2.0], {})], "chunk_id string, content string, embedding array<double>, metadata map<string,string>")
    stores.append_to_store(chunks, path, "s")
    stores.append_to_store(chunks.withColumn("chunk_id", F.concat("chunk_id", F.lit("0"))).unionByName(chunks), path, "s")
    assert sorted(r.chunk_id for r in stores.open_store(spark, str(tmp_path / "none"), "s", path).collect()) == ["1", "10", "2", "20"]
    assert stores.store_summary(stores.open_store(spark, path)).first()[1:] == (4, 2)
    typed = str(tmp_path / "typed")
    for value in ("1", "2"):
        stores.appended_typed(spark.createDataFrame([(value,)], "v string").select(F.col("v").cast("int") if value == "1" else "v"), typed)
    assert sorted(r.v for r in spark.read.parquet(typed).collect()) == [1, 2]


def test_chats_and_environment(spark, tmp_path):
    for name, at in (("a", "2024-01-02"), ("b", None), ("c", "2024-05-01")):
        (tmp_path / f"{name}.json").write_text('{"chat_name": "%s", %s"messages": [["user", "hi"], ["bot", "%s"]]}' % (name, f'"updated_at": "{at}", ' if at else "", name))
    chats = ingest.saved_chats(spark, str(tmp_path))
    assert [r.chat_name for r in chats.collect()] == ["c", "a", "b"]
    assert sorted((r.chat_name, r.turn, r.text) for r in ingest.chat_messages(chats).collect())[:2] == [("a", 0, "hi"), ("a", 1, "a")]
    (tmp_path / "env").write_text("# x\nA = '1'\nB=2\n")
    assert ingest.environment({"A": ""}, {"B": "9"}, ingest.env_file(str(tmp_path / "env"))) == {"A": "1", "B": "9"} and ingest.env_file("none") == {}
    docs = spark.createDataFrame([("x/appen6.txt", "Chapter IV a\nSec. 2\nChapter IV a")], "path string, text string")
    got = ingest.enriched(docs, "text", "path", {"defaults": {"lob": "all"}, "files": [{"match": "APPEN6", "company": "six"}]}).first()
    assert got.anchors == ["CHAPTER IV a", "SECTION 2"] and (got.lob, got.company) == ("all", "six")


def ruled():
    page = np.full((200, 300), 255, np.uint8)
    page[40:161:40, 30:271] = 0
    page[40:161, [30, 110, 190, 270]] = 0
    return page


def test_images(spark):
    rng = np.random.default_rng(1)
    text = np.full((240, 320), 250, np.uint8)
    for y in range(40, 200, 16):
        text[y : y + 5, 40:280] = np.where(rng.random((5, 240)) < 0.6, 20, 250)
    assert images.skew(text) == 0 and abs(images.skew(images.rotated(text, 3.0)) - 3.0) <= 0.25 and abs(images.skew(images.rotated(text, -2.0)) + 2.0) <= 0.25
    assert (images.grey(images.png(text)) == text).all()
    assert images.cropped(text, 4).shape == (40 + 5 * 0 + 8 + 149 - 40, 248) or images.cropped(text, 4).shape[1] == 248
    assert set(np.unique(images.binarised(text))) <= {0, 255} and (images.binarised(text)[text == 20] == 0).mean() > 0.5
    x, y, w, h = images.table_box(ruled())
    assert abs(x - 30) <= 3 and abs(y - 40) <= 3 and abs(w - 241) <= 6 and abs(h - 121) <= 6 and images.table_box(text) is None
    rows = images.prepared(spark.createDataFrame([("a.png", images.png(ruled())), ("b.png", b"no")], "path string, content binary"), ("orig", "bin", "borderless", "table")).collect()
    assert {r.step for r in rows} == {"orig", "bin", "borderless", "table", None} and sum(r.error is not None for r in rows) == 1
    table = next(r for r in rows if r.step == "table")
    assert abs(table.width - 253) <= 8 and images.grey(bytes(table.content)).shape == (table.height, table.width)


def test_model_helpers(spark):
    states = iter([("queued", None), ("completed", "done")])
    assert polled(lambda: next(states), sleep=lambda s: None) == ("completed", "done")
    ticks = iter(range(100))
    assert polled(lambda: ("queued", None), 3, clock=lambda: next(ticks), sleep=lambda s: None) == ("timeout", None)
    assert isinstance(runner_of("other", {}), StubRunner)
    assert rewritten(spark.createDataFrame([("a b",), (None,)], "t string"), "t", "say", StubRunner()).collect()[0].rewritten == "a b"
    pages = spark.createDataFrame([("p", bytearray(b"one two"))], "path string, content binary")
    assert [r.line for r in recognised_pages(pages, StubRunner()).collect()] == ["one two"]


def test_jobs(spark, folder, tmp_path):
    from ledgerloom.__main__ import main

    main(["ingest", folder, str(tmp_path / "docs"), "--skip", "/log/"])
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 7
    main(["query", "unioned_tables", "/root/testdata/sf0.001", str(tmp_path / "q"), "--policy", "skip"])
    assert spark.read.parquet(str(tmp_path / "q")).count() == 30


def test_schema_helpers(spark):
    from ledgerloom.operators.parsers import ParseConfig, configured_records
    from ledgerloom.operators.ratios import period_columns
    from ledgerloom.sources.readers import content_hashes, lenient

    assert period_columns(["Mã số", "Số đầu năm", "Số  cuối năm", "Year end"]) == {"begin": "Số đầu năm", "end": "Số  cuối năm"}
    files = spark.createDataFrame([("x", bytearray(b"a\xffb"))], "path string, content binary")
    assert content_hashes(files).first().sha1 == hashlib.sha1(b"a\xffb").hexdigest()
    assert files.select(lenient(F.col("content")).alias("t")).first().t == "ab"
    config = ParseConfig.of({"globals": {"unit_multiplier": 1000, "code_aliases": {"131.1": "131"}, "number_cleanup": {"fix_patterns": [{"from": "S", "to": "5"}]}}})
    got = configured_records(spark.createDataFrame([(1, "131 1 Phải thu 1.234.567 (2.000.000)")], "i int, line string"), ["i"], "line", config).first()
    assert (got.code, got.name, int(got.end), int(got.begin), got.unit_multiplier) == ("131", "Phải thu", 1234567000, -2000000000, 1000)


def test_store_runs_that_are_repeated_or_meet(spark, tmp_path):
    """A run given twice is there once; two at the same time that bring the same ids show them once."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "runs")
    chunks = lambda ids, text: spark.createDataFrame([(str(i), text, [1.0], {"type": "table"}) for i in ids], "chunk_id string, content string, embedding array<double>, metadata map<string,string>")
    seen = lambda: sorted((int(r.chunk_id), r.content, r.store) for r in stores.open_store(spark, path, "a/b c").collect())
    for _ in range(2):
        stores.append_to_store(chunks([1, 2, 2], "first"), path, "a/b c", run="r1")
    assert seen() == [(1, "first", "a/b c"), (2, "first", "a/b c")]
    stores.append_to_store(chunks([2, 3], "second"), path, "a/b c", run="r2")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda r: stores.append_to_store(chunks([4, 5, r], f"run {r}"), path, "a/b c", run=f"x{r}"), (6, 7)))
    rows = seen()
    assert [r[0] for r in rows] == [1, 2, 3, 4, 5, 6, 7] and {r[1] for r in rows[3:5]} <= {"run 6", "run 7"}
    stores.append_to_store(chunks([9], "other"), path, "b")
    assert stores.open_store(spark, path).count() == 8 and seen() == rows
