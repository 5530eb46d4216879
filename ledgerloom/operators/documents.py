"""From table rows to documents: overviews, row texts, one document a period, exact deduplication and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.binding import bound
from ledgerloom.functions.text import row_text

SEPARATORS = ("\n\n", "\n", " ")


def overview(df: DataFrame, keys: list[str]) -> DataFrame:
    """One document for each key: the column names."""
    names = ", ".join(c for c in df.columns if c not in keys)
    return df.select(*keys).distinct().withColumn("content", F.lit(f"columns: {names}")).withColumn("type", F.lit("table_overview"))


def row_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in df.columns if c not in keys]
    return df.select(*keys, row_text(values).alias("content"), F.lit("table_row").alias("type")).where("content <> ''")


def period_documents(rows: DataFrame, keys: list[str], item: str, periods: tuple[str, ...] = ("end", "start"), unit: str | None = None) -> DataFrame:
    """One document for each row and period that has a value: item — period: value (unit) tags."""
    kept = [*keys, item, *([unit] if unit else []), *[c for c in ("is_total", "is_subtotal") if c in rows.columns]]
    long = rows.select(*kept, *[F.col(p).cast("string").alias(p) for p in periods]).unpivot(kept, list(periods), "period_label", "value")
    flags = F.lit("leaf")
    if "is_subtotal" in kept:
        flags = F.when(F.col("is_subtotal"), "subtotal").otherwise(flags)
    if "is_total" in kept:
        flags = F.when(F.col("is_total"), "total").otherwise(flags)
    shown = F.when(F.col(unit) != "", F.concat(F.lit(" ("), F.col(unit), F.lit(")"))).otherwise("") if unit else F.lit("")
    text = F.concat(F.col(item), F.lit(" — "), "period_label", F.lit(": "), "value", shown, F.lit(" tag:"), F.lower(item), F.lit(" tag:"), flags)
    return long.where("value is not null and trim(value) <> ''").select(*keys, "period_label", text.alias("content"), F.lit("table_row_value").alias("type"))


def deduplicated(docs: DataFrame, text: str, position: str) -> DataFrame:
    """The first document of each content, by position."""
    first = Window.partitionBy(F.sha2(text, 256)).orderBy(position)
    return docs.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most size characters, cut at the coarsest separator that fits, each beginning with up to overlap characters of the one before."""
    parts = [text]
    for separator in SEPARATORS:
        parts = [piece for p in parts for piece in ([p] if len(p) <= size else _kept(p, separator))]
    parts = [p[i : i + size] for p in parts for i in range(0, len(p), size)]
    out, now = [], ""
    for p in parts:
        if now and len(now) + len(p) > size:
            out.append(now)
            tail = now[-overlap:] if overlap else ""
            now = tail if len(tail) + len(p) <= size else ""
        now += p
    return [c for c in (x.strip() for x in [*out, now]) if c]


def _kept(text: str, separator: str) -> list[str]:
    cut = text.split(separator)
    return [x + separator for x in cut[:-1]] + ([cut[-1]] if cut[-1] else [])


#: What str.strip takes for white space.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _kept_pieces(p: Column, separator: str) -> Column:
    keep = lambda parts: F.filter(F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit(separator))).otherwise(x)), lambda x: x != "")
    return bound(F.split(p, separator), keep)


def _cut_at(separator: str, size: int) -> Callable[[Column], Column]:
    return lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_kept_pieces(p, separator))


def text_chunks(text: Column, size: int, overlap: int) -> Column:
    """split_text as an expression: pieces are cut by one separator after the other where they are too long, and folded into chunks.

    Pieces follow each other in the text, and so do a chunk and its overlap: the fold sees lengths only, and gives places.
    """
    whole = F.coalesce(text, F.lit(""))
    parts = F.array(whole)
    for separator in SEPARATORS:
        parts = F.flatten(F.transform(parts, _cut_at(separator, size)))
    hard = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda at: F.least(n - at, F.lit(size)))
    lengths = F.flatten(F.transform(F.transform(parts, F.length), lambda n: F.when(n <= size, F.array(n)).otherwise(hard(n))))

    def add(done: Column, n: Column) -> Column:
        end, now = done["end"] + n, done["end"] - done["start"]
        tail = F.least(now, F.lit(overlap))
        start = done["end"] - F.when(tail + n <= size, tail).otherwise(0)
        place = F.struct(done["start"].alias("start"), done["end"].alias("end"))
        cut = F.struct(F.array_append(done["out"], place).alias("out"), start.alias("start"), end.alias("end"))
        return F.when(end - done["start"] > size, cut).otherwise(F.struct(done["out"].alias("out"), done["start"].alias("start"), end.alias("end")))

    begin = F.struct(F.array().cast("array<struct<start: int, end: int>>").alias("out"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    places = F.aggregate(lengths, begin, add, lambda done: F.array_append(done["out"], F.struct(done["start"].alias("start"), done["end"].alias("end"))))
    found = F.transform(places, lambda p: F.btrim(F.substr(whole, p["start"] + 1, p["end"] - p["start"]), F.lit(BLANKS)))
    return F.filter(F.when(F.length(whole) <= size, F.array(F.btrim(whole, F.lit(BLANKS)))).otherwise(found), lambda c: c != "")


def chunks(docs: DataFrame, text: str, size: int = 900, overlap: int = 120, whole: Column | None = None) -> DataFrame:
    """docs with chunk_no and chunk; rows for which `whole` holds, such as tables, stay unsplit."""
    cut = text_chunks(F.col(text), size, overlap)
    if whole is not None:
        cut = F.when(whole, F.array(text)).otherwise(cut)
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, F.posexplode_outer(cut).alias("chunk_no", "chunk")).where("chunk_no is not null")  # a plain one would be told to cut each text once more, to see if there is any
