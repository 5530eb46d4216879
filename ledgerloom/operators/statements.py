"""Statement lines to rows: code, name, note and the two amounts; tokens to columns; answers from context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, text
from ledgerloom.functions.binding import settled
from ledgerloom.models import ModelRunner, generated

AMOUNT = r"\(?-?\d{1,3}(?:[.,]\d{3})+\)?|\(?-?\d{4,}\)?"
#: Header words of the five columns, accent-free.
HEADERS = {"code": ("ma so", "code"), "note": ("thuyet minh", "note"), "end": ("so cuoi nam", "cuoi nam", "closing", "year end"), "begin": ("so dau nam", "dau nam", "opening", "beginning")}


def rightmost(c: Column, k: int = 2) -> Column:
    """The last k amounts of a line, in its order."""
    return F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), k), F.regexp_extract_all(c, F.lit(AMOUNT), F.lit(0))), -k, k)


def statement_rows(lines: DataFrame, keys: list[str], line: str, multiplier: int = 1) -> DataFrame:
    """code, name, note, end and begin of lines that hold a code.

    A line of three bars or more has them in its cells. In another the code stands first, the amounts are the last two,
    and the note is a short number or numeral right before them. Each step is a column of its own, worked out once; the
    filter on codes isn't pushed below the line and the code, which it would work out again.
    """
    cell = lambda i: F.nullif(F.get("__cells", F.lit(i)), F.lit(""))
    amount = lambda i: F.get("__amounts", F.lit(i))
    free = "not __barred"
    steps = {
        "__barred": F.length("__line") - F.length(F.translate("__line", "|", "")) >= 3,
        "__cells": F.when(F.col("__barred"), F.transform(F.split(F.regexp_replace("__line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))),
        "code": F.when(F.expr(free), F.nullif(F.regexp_extract("__line", r"^\s*(\d{2,3}(?:\.\d+)?)\s", 1), F.lit(""))).otherwise(cell(0)),
        "__body": F.when(F.expr(free), F.regexp_replace("__line", r"^\s*\d{2,3}(?:\.\d+)?\s+", "")),
        "__amounts": F.when(F.expr(free), F.filter(rightmost(F.col("__body")), lambda x: x.isNotNull())).otherwise(F.array(cell(3), cell(4))),
        "__left": F.trim(F.regexp_replace("__body", AMOUNT, " ")),
        "note": F.when(F.expr(free), F.nullif(F.regexp_extract("__left", r"\s((?:\d{1,2}(?:\.\d)?)|[IVX]+)$", 1), F.lit(""))).otherwise(cell(2)),
        "name": F.when(F.col("__barred"), cell(1)).otherwise(F.when(F.col("note").isNotNull(), F.regexp_replace("__left", r"\s+\S+$", "")).otherwise(F.col("__left"))),
        "end": numbers.recognised(amount(0), multiplier),
        "begin": numbers.recognised(amount(1), multiplier),
    }
    out = settled(lines.select(*keys, F.col(line).alias("__given")), "__line", F.col("__given"))
    for name, step in steps.items():
        out = settled(out, name, step).where("code is not null") if name == "code" else out.withColumn(name, step)
    return out.select(*keys, "code", text.squeezed(F.col("name")).alias("name"), "note", "end", "begin")


def keyword_row(rows: DataFrame, keys: list[str], name: str, position: str, value: str, words: list[str], code: str | None = None) -> DataFrame:
    """For each key the value of the first row whose accent-free name holds a word; else of the row of the code."""
    plain = text.normal_words(F.col(name))
    hit = F.lit(False)
    for w in words:
        hit = hit | plain.contains(w)
    by_code = F.min_by(value, F.when(F.col("code") == code, F.col(position))) if code else F.lit(None)
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by(value, F.when(hit, F.col(position))), by_code).alias(value))


def column_anchors(tokens: DataFrame, page: list[str]) -> DataFrame:
    """The left edge of each known header on each page; null where a page lacks it."""
    plain = text.normal_words(F.col("text"))
    return tokens.groupBy(*page).agg(*[F.min(F.when(plain.isin(*words), F.col("left"))).alias(f"x_{name}") for name, words in HEADERS.items()])


def column_of_tokens(tokens: DataFrame, anchors: DataFrame, page: list[str]) -> DataFrame:
    """Tokens with the column they belong to: codes and notes by shape, amounts by the nearer amount column, all else names."""
    placed = tokens.join(anchors, page)
    amount, code = F.col("text").rlike(r"^\(?-?\d[\d.,]{3,}\)?$"), F.col("text").rlike(r"^\d{2,3}(\.\d+)?$")
    near = lambda a, b: F.abs(F.col("left") - F.col(a)) <= F.abs(F.col("left") - F.col(b))
    column = F.when(amount, F.when(near("x_end", "x_begin"), "end").otherwise("begin")).when(code & F.coalesce(near("x_code", "x_end"), F.lit(True)), "code").when(F.col("text").rlike(r"^(\d{1,2}(\.\d)?|[IVX]+)$") & F.col("x_note").isNotNull(), "note").otherwise("name")
    return placed.withColumn("column_name", column).drop(*[f"x_{n}" for n in HEADERS])


def answers(found: DataFrame, questions: DataFrame, runner: ModelRunner, separator: str = "\n\n") -> DataFrame:
    """query_id, source, answer: from the context of the found texts (internal), from the question alone (general), or none where the model fails.

    The context is joined in rank order; the model is called once for each question.
    """
    context = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), separator).alias("context"))
    asked = questions.join(context, "query_id", "left").withColumn("prompt", F.concat_ws("\n", "context", "question"))
    done = generated(asked, "prompt", runner)
    source = F.when(F.col("answer").isNull(), "none").when(F.col("context").isNotNull(), "internal").otherwise("general")
    return done.select("query_id", source.alias("source"), "answer")


def ranked_titles(lines: DataFrame, keys: list[str], position: str, line: str, first: int = 15) -> DataFrame:
    """The longest of each key's first lines, the earlier of equals."""
    top = lines.where(F.trim(line) != "").withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where(F.col("__at") <= first)
    return top.groupBy(*keys).agg(F.max_by(line, F.struct(F.length(line), -F.col("__at"))).alias("title"))
