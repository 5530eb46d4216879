"""Readers of document folders: text in several encodings, tables, office files, sidecars and page images.

Files are found and read by Spark (binaryFile), so any store it can reach will do. A file that can't be read gives a row
with its error, and never stops the others.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The encodings tried in turn.
ENCODINGS = ("utf-8", "utf-8-sig", "utf-16", "utf-16le", "utf-16be", "cp1258", "latin-1")
KINDS = {"text": ("txt", "text", "md"), "table": ("csv", "xlsx", "xls"), "document": ("docx", "pdf"), "image": ("png", "jpg", "jpeg", "tif", "tiff", "bmp")}
PAGE_IMAGE = r"([^/]+)_page(\d{2,})_(bin|orig)\.png$"


def files(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def kind(path: Column) -> Column:
    """text, table, document or image by extension; null for others, which are skipped."""
    out = F.lit(None).cast("string")
    for name, endings in KINDS.items():
        out = F.when(extension(path).isin(*endings), name).otherwise(out)
    return out


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(?:_meta)?(?:\.[^./\\]*)?$", 1)


def decoded(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str | None, str | None]:
    """The text and the first encoding that reads it without an error."""
    for name in encodings:
        try:
            return content.decode(name), name
        except UnicodeError:
            continue
    return None, None


def texts(found: DataFrame) -> DataFrame:
    """path, text, encoding, error of files with their content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *decoded(bytes(c))) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame([(*r, None if r[1] else "no encoding reads it") for r in rows], columns=["path", "text", "encoding", "error"])

    return found.select("path", "content").mapInPandas(read, "path string, text string, encoding string, error string")


_NS = {"w": "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "s": "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"}


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs of a document, and its tables' rows with cells between bars."""
    w = _NS["w"]
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))[0]
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    out = []
    for node in body:
        if node.tag == f"{w}p" and text(node).strip():
            out.append(text(node))
        elif node.tag == f"{w}tbl":
            out += [" | ".join(text(cell) for cell in row.iter(f"{w}tc")) for row in node.iter(f"{w}tr")]
    return out


def xlsx_sheets(content: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """Name and rows of each sheet, cells as text."""
    s, book = _NS["s"], zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{s}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    names = [x.get("name") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{s}sheet")]
    for i, name in enumerate(names, 1):
        rows = []
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{s}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{s}c"):
                letters = re.match("[A-Z]*", cell.get("r") or "")[0]
                at = 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                cells += [None] * (at - 1 - len(cells))
                value = cell.find(f"{s}v")
                if cell.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in cell.iter(f"{s}t")))
                else:
                    cells.append(None if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text)
            rows.append(cells)
        yield name, rows


def sheet_rows(found: DataFrame) -> DataFrame:
    """path, sheet, row_index, cells, error of spreadsheets: a row for each row of each sheet."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, sheet, i, cells, None) for sheet, got in xlsx_sheets(bytes(content)) for i, cells in enumerate(got)]
                except Exception as e:  # a broken file is reported, and the others are read
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(rows, columns=["path", "sheet", "row_index", "cells", "error"])
            frame["row_index"] = frame["row_index"].astype("Int32")
            yield frame

    return found.select("path", "content").mapInPandas(read, "path string, sheet string, row_index int, cells array<string>, error string")


def document_lines(found: DataFrame) -> DataFrame:
    """path, pos, line, error of docx files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, i, line, None) for i, line in enumerate(docx_lines(bytes(content)))]
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(rows, columns=["path", "pos", "line", "error"])
            frame["pos"] = frame["pos"].astype("Int32")
            yield frame

    return found.select("path", "content").mapInPandas(read, "path string, pos int, line string, error string")


def csv_tables(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, all columns as text, and the file each row is from."""
    return spark.read.option("header", True).option("recursiveFileLookup", "true").csv(path).withColumn("source", F.col("_metadata.file_path"))


def page_images(paths: DataFrame, page: Column | None = None) -> DataFrame:
    """base, page and the paths of its bin and orig images, of any number of digits; page gives the number where names are cut to a width that doesn't hold it."""
    part = lambda i: F.regexp_extract("path", PAGE_IMAGE, i)
    number = part(2) if page is None else page
    named = paths.where(F.col("path").rlike(PAGE_IMAGE)).select(part(1).alias("base"), number.cast("int").alias("page"), part(3).alias("kind"), "path")
    return named.groupBy("base", "page").pivot("kind", ["bin", "orig"]).agg(F.min("path"))


def scanned(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Whether each file's pages all lack text, so that it needs recognition."""
    return pages.groupBy(key).agg(F.bool_and(F.trim(F.coalesce(text, F.lit(""))) == "").alias("needs_ocr"), F.count(F.lit(1)).alias("n_pages"))


def unique_names(names: list[str]) -> list[str]:
    """Repeated column names as c, c.1, c.2."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        out.append(f"{n}.{seen[n]}" if n in seen else n)
        seen[n] = seen.get(n, 0) + 1
    return out


def plain_name(name: str) -> str:
    """A column's name in lower case without accents, đ as d, spaces single."""
    folded = unicodedata.normalize("NFD", name.lower().replace("đ", "d"))
    return " ".join("".join(c for c in folded if unicodedata.category(c) != "Mn").split())


def content_hashes(found: DataFrame) -> DataFrame:
    """path and sha1 of each file's bytes."""
    return found.select("path", F.sha1("content").alias("sha1"))


def lenient(content: Column, charset: str = "UTF-8") -> Column:
    """Bytes as text, those that aren't valid left out."""
    return F.translate(F.decode(content, charset) if charset != "UTF-8" else F.make_valid_utf8(content.cast("string")), "\ufffd", "")


def period_roles(names: list[str]) -> dict[str, str]:
    """Columns renamed to end and start, by their words or, where two names hold dates, the later as end."""
    out: dict[str, str] = {}
    for n in names:
        low = n.lower()
        if re.search(r"cuối|cuoi|year end|ending|end of", low) and "end" not in out.values():
            out[n] = "end"
        elif re.search(r"đầu|dau|opening|beginning", low) and "start" not in out.values():
            out[n] = "start"
    dated = sorted((m[3], m[2].zfill(2), m[1].zfill(2), n) for n in names if (m := re.search(r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", n)))
    if not out and len(dated) >= 2:
        out = {dated[0][3]: "start", dated[-1][3]: "end"}
    return out


def paths_over(paths: DataFrame, path: str, limit: int = 240) -> DataFrame:
    """Number of paths, of those longer than the limit, and the longest."""
    n = F.length(path)
    return paths.agg(F.count(F.lit(1)).alias("n_paths"), F.count_if(n > limit).alias("n_over"), F.max(n).alias("longest"))
