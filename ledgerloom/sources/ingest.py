"""Whole folders as documents: every kind of file by its reader, one schema, and what couldn't be read beside it."""

from __future__ import annotations

import io
import os
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import rules
from ledgerloom.sources import readers

#: A document: where it is from, its place there, its text, and what is known of it.
DOCUMENT = "path string, kind string, part string, pos int, text string, error string"
#: Titles of sheets in texts.
SHEET_TITLE, COLUMNS_TITLE = "========== SHEET: {} ==========", "Các cột gồm: {}."


def discovered(spark: SparkSession, path: str, skip: str | None = None, recursive: bool = True) -> DataFrame:
    """Files under path of a known kind, each once, with kind and content; those with `skip` in their path, such as a log of recognised texts, are left out."""
    found = readers.files(spark, path, recursive).withColumn("kind", readers.kind(F.col("path"))).where("kind is not null")
    if skip:
        found = found.where(~F.col("path").contains(skip))
    return found.dropDuplicates(["path"])


def sheet_text(name: str, rows: list[list[str | None]], mode: str = "summary") -> str:
    """A sheet as text. summary: a line of the named columns, then name: value of each row that has any. raw: all cells between bars."""
    if not rows:
        return ""
    width = max(map(len, rows))
    cells = [[c or "" for c in r] + [""] * (width - len(r)) for r in rows]
    head = [h.strip() or f"Unnamed: {i}" for i, h in enumerate(cells[0])]
    title = SHEET_TITLE.format(name.upper())
    if mode == "raw":
        return "\n".join([title, *(" | ".join(r) for r in [head, *cells[1:]])])
    named = [i for i, h in enumerate(head) if not h.startswith("Unnamed")]
    lines = [title, COLUMNS_TITLE.format(", ".join(head[i] for i in named))]
    return "\n".join(lines + [line for r in cells[1:] if (line := "; ".join(f"{head[i]}: {r[i]}" for i in named if r[i].strip()))])


_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_PDF_TEXT = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\\.|[^\]\\])*)\]\s*TJ|(T\*|Td|TD|ET)", re.S)
_PDF_PART = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_PDF_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3})")


def _pdf_string(raw: bytes) -> str:
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    return _PDF_ESCAPE.sub(lambda m: plain.get(m[1], m[1] if m[1] in b"()\\" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), raw).decode("latin-1")


def pdf_pages(content: bytes) -> list[str]:
    """The text of each content stream that shows any, in file order: simple fonts only. A page that is a picture has none."""
    pages = []
    for m in _PDF_STREAM.finditer(content):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        out = []
        for text, parts, move in _PDF_TEXT.findall(data):
            if move:
                if out and not out[-1].endswith("\n"):
                    out.append("\n")
            elif parts:
                out.append("".join(_pdf_string(p) for p in _PDF_PART.findall(parts)))
            else:
                out.append(_pdf_string(text))
        pages.append("".join(out).strip())
    return pages


def _parts(path: str, kind: str, content: bytes, mode: str) -> list[tuple]:
    """part, pos and text of one file's documents."""
    ending = path.rsplit(".", 1)[-1].lower()
    if kind == "text":
        text, encoding = readers.decoded(content)
        return [(encoding, 0, text)]
    if ending == "csv":
        text = readers.decoded(content)[0]
        frame = pd.read_csv(io.StringIO(text), dtype=str, header=None).astype(object)
        rows = frame.where(frame.notna(), None).values.tolist()
        return [("CSV", 0, sheet_text("CSV", rows, mode))]
    if ending == "xlsx":
        return [(sheet, i, sheet_text(sheet, rows, mode)) for i, (sheet, rows) in enumerate(readers.xlsx_sheets(content))]
    if ending == "docx":
        return [("body", 0, "\n".join(readers.docx_lines(content)))]
    if ending == "pdf":
        return [("page", i, page) for i, page in enumerate(pdf_pages(content), 1)]
    raise ValueError(f"no reader for .{ending} files")


def documents(found: DataFrame, mode: str = "summary") -> DataFrame:
    """The documents of files (path, kind, content): a row for each text, sheet and page, and one with the error of each file that can't be read.

    Images give no row: they go to recognition (ledgerloom.models). A file is read whole by one task.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                try:
                    rows += [(path, kind, part, pos, text, None) for part, pos, text in _parts(path, kind, bytes(content), mode)]
                except Exception as e:  # one broken file never stops the others
                    rows.append((path, kind, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(rows, columns=["path", "kind", "part", "pos", "text", "error"])
            frame["pos"] = frame["pos"].astype("Int32")
            yield frame

    return found.where("kind <> 'image'").select("path", "kind", "content").mapInPandas(read, DOCUMENT)


def loaded(spark: SparkSession, path: str, mode: str = "summary", tag: str | None = None, skip: str | None = None) -> DataFrame:
    """All documents of a folder, their sidecars' metadata joined by stem, texts with a tag behind them if one is given."""
    found = discovered(spark, path, skip)
    docs = documents(found, mode).withColumn("stem", readers.stem(F.col("path")))
    if tag:
        docs = docs.withColumn("text", F.concat("text", F.lit(f"\ntag:{tag}")))
    metas = readers.files(spark, path, pattern="*_meta.json").select(readers.stem(F.col("path")).alias("stem"), F.decode("content", "UTF-8").alias("meta")).dropDuplicates(["stem"])
    return docs.join(metas, "stem", "left").withColumn("meta", F.from_json("meta", "map<string,string>"))


def pages_between(pages: DataFrame, first: int, last: int | None = None, page: str = "pos") -> DataFrame:
    """Pages first to last, both included, or to the end: a filter that reaches the scan of a stored table."""
    return pages.where(F.col(page) >= first) if last is None else pages.where(F.col(page).between(first, last))


def previews(docs: DataFrame, pages: int = 3, paragraphs: int = 30) -> DataFrame:
    """path and preview: texts whole, the first pages of a PDF, the first paragraphs of an office document; why there is none, else."""
    ending = readers.extension(F.col("path"))
    shown = docs.where((ending != "pdf") | (F.col("pos") <= pages) | F.col("error").isNotNull())
    text = F.when(ending == "docx", F.array_join(F.slice(F.split("text", "\n"), 1, paragraphs), "\n")).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), text.alias("text"))))
    found = shown.groupBy("path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("preview"), F.max("error").alias("error"))
    return found.select("path", F.when(F.col("error").isNotNull(), F.concat(F.lit("[unreadable: "), "error", F.lit("]"))).when(F.trim("preview") == "", "[no text]").otherwise(F.col("preview")).alias("preview"))


def unioned_tables(tables: list[DataFrame]) -> DataFrame:
    """Tables of different columns as one, by name, missing ones null; repeated names of one table count up."""
    out = None
    for table in tables:
        named = table.toDF(*readers.unique_names(table.columns))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def common_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*right.columns).intersect(right)


def saved_chats(spark: SparkSession, path: str) -> DataFrame:
    """chat_name, updated_at, messages of saved chats (JSON, one a file), the latest first; one without a time comes last."""
    schema = "chat_name string, updated_at string, messages array<array<string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).orderBy(F.coalesce("updated_at", F.lit("")).desc(), "chat_name")


def chat_messages(chats: DataFrame) -> DataFrame:
    """chat_name, turn, role, text: a row for each message."""
    each = chats.select("chat_name", F.posexplode("messages").alias("turn", "m"))
    return each.select("chat_name", "turn", F.get("m", F.lit(0)).alias("role"), F.get("m", F.lit(1)).alias("text"))


def environment(*sources: dict[str, str]) -> dict[str, str]:
    """Settings of several sources, the first that has a name wins: secrets, then an active file, then the default one. Values are never printed."""
    out: dict[str, str] = {}
    for source in reversed(sources):
        out |= {k: v for k, v in source.items() if v not in (None, "")}
    return out


def env_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file; none where there is no file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = (line.split("=", 1) for line in map(str.strip, f) if "=" in line and not line.startswith("#"))
        return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def enriched(docs: DataFrame, text: str, path: str, config: dict) -> DataFrame:
    """docs with headings marked in the text, the distinct anchors in order, and the fields of the matching rule."""
    from ledgerloom.functions.text import anchors, with_headings

    marked = docs.withColumn("__record", rules.rule_record(F.col(path), F.col(text), config)).withColumn(text, with_headings(F.col(text)))
    return marked.withColumn("anchors", anchors(F.col(text))).select("*", "__record.*").drop("__record")


def cleaned_tree(docs: DataFrame, clean_text, clean_cells) -> DataFrame:
    """documents() with texts and sheets cleaned by two column functions; rows with errors, and other kinds, stay as they are."""
    by_kind: Column = F.when(F.col("kind") == "text", clean_text(F.col("text"))).when(F.col("kind") == "table", clean_cells(F.col("text"))).otherwise(F.col("text"))
    return docs.withColumn("text", F.when(F.col("error").isNull(), by_kind).otherwise(F.col("text")))
