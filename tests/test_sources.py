import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom.operators.rules import with_sidecar
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import ingest

REPO = Path(__file__).resolve().parent.parent


def test_encodings(spark, tmp_path):
    for name, data in (("a.txt", "Tiền".encode()), ("b.txt", "Tiền".encode("utf-16")), ("c.txt", b"\xe9t\xe9 \x81"), ("d.bin", b"x")):
        (tmp_path / name).write_bytes(data)
    found = readers.files(spark, str(tmp_path), pattern="*.txt")
    got = {r.path[-5:]: (r.text, r.encoding) for r in readers.texts(found).collect()}
    assert got["a.txt"] == ("Tiền", "utf-8") and got["b.txt"][1] == "utf-16" and got["c.txt"][1] in readers.ENCODINGS
    kinds = readers.files(spark, str(tmp_path)).select(readers.kind(F.col("path")).alias("k")).where("k is null").count()
    assert kinds == 1


def test_office_files(spark, tmp_path):
    w, s = readers._NS["w"].strip("{}"), readers._NS["s"].strip("{}")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>code</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    lines = readers.document_lines(readers.files(spark, str(tmp_path), pattern="*.docx")).collect()
    assert [r.line for r in sorted((r for r in lines if r.error is None), key=lambda r: r.pos)] == ["one", "x | y"]
    assert [r.path.endswith("broken.docx") for r in lines if r.error] == [True]
    row = readers.sheet_rows(readers.files(spark, str(tmp_path), pattern="*.xlsx")).first()
    assert (row.sheet, row.row_index, row.cells) == ("S1", 0, ["code", None, "5"])


def test_csv_and_sidecar(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,end\n100,5\n")
    row = readers.csv_tables(spark, str(tmp_path)).first()
    assert (row.code, row.end) == ("100", "5") and row.source.endswith("t.csv")
    files = spark.createDataFrame([("a", "own"), ("b", "own")], "stem string, company string")
    metas = spark.createDataFrame([("a", "side", 3)], "stem string, company string, page int")
    assert sorted(tuple(r) for r in with_sidecar(files, metas, "stem", ["company", "page"]).collect()) == [("a", "side", 3), ("b", "own", None)]


def test_names():
    assert readers.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    assert readers.period_roles(["Số cuối năm", "Số đầu năm", "x"]) == {"Số cuối năm": "end", "Số đầu năm": "start"}
    assert readers.period_roles(["31/12/2024", "01/01/2024"]) == {"31/12/2024": "end", "01/01/2024": "start"}
    assert sinks.chat_file("Chat #1 a") == "Chat_1_a.json" and sinks.prompt("hi {{n}}", {"n": "x"}, "g") == "hi x\n\ng"
    assert sinks.read_rules("a: [1, 2]") == sinks.read_rules('{"a": [1, 2]}') == {"a": [1, 2]}


def test_write_policies(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.range(3)
    for policy, n in (("overwrite", 3), ("append", 6), ("skip", 6), ("overwrite", 3)):
        sinks.write(rows, path, policy)
        assert spark.read.parquet(path).count() == n
    assert sinks.not_there_yet(spark.range(5), spark.read.parquet(path), ["id"]).count() == 2


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    rows = [(i % 3, f"t{i % 3}", f"2024-01-01 00:0{i}:00") for i in range(6)]
    spark.createDataFrame(rows, "path int, text string, ts string").selectExpr("path", "text", "cast(ts as timestamp) ts").write.parquet(str(src))
    stream = spark.readStream.schema("path int, text string, ts timestamp").parquet(str(src))
    for turn in range(2):
        ingest.upserted(ingest.fresh(stream, "path", "text", "ts"), out, str(tmp_path / f"c{turn}"), "sha1").awaitTermination(120)
        assert spark.read.parquet(out).count() == 3


def test_sessions_as_a_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 01:00:00", 3.0), (2, "2024-01-03 00:00:00", 1.0)], "user_id long, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = ingest.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), late="1 hour")
    q = stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    done = {(r.user_id, r.n_events, r.total) for r in spark.table("found").collect()}
    assert done == {(1, 2, 3.0), (1, 1, 3.0)}
    assert ingest.sessions(events).count() == 3


def test_entry_without_the_optional_folders(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False"], said.stderr
