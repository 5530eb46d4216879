"""Cleaning of tables whose columns aren't known beforehand: names, roles, kinds and cells of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, text
from ledgerloom.sources.readers import period_roles, unique_names

NUMBER_LIKE = r"^[+-]?\s*\(?\d[\d\s.,]*\)?%?$"


def number_like(c: Column) -> Column:
    return F.trim(c.cast("string")).rlike(NUMBER_LIKE)


def with_unique_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def with_period_names(df: DataFrame) -> DataFrame:
    """Columns whose names tell the period as end and start. Rename before raw copies are made, so that no copy takes the name."""
    roles = period_roles(df.columns)
    return df.toDF(*[roles.get(c, c) for c in df.columns])


def with_raw_copies(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.col(c).alias(f"{c}_raw") for c in df.columns])


def with_units(df: DataFrame, currency: str = "VND", scale: str = "1") -> DataFrame:
    for name, value in (("currency", currency), ("scale", scale)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns: the first ones renamed in order, missing ones null, further ones dropped."""
    have = df.columns[: len(names)]
    return df.select(*[F.col(c).alias(n) for c, n in zip(have, names, strict=False)], *[F.lit(None).cast("string").alias(n) for n in names[len(have) :]])


def without_blank_rows(df: DataFrame) -> DataFrame:
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    return df.where(filled)


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: share of number-like cells, and mean length. One pass over the data."""
    stats = [F.struct(F.lit(c).alias("column_name"), F.round(F.avg(number_like(F.col(c)).cast("double")), 6).alias("num_rate"), F.round(F.avg(F.length(F.col(c).cast("string"))), 6).alias("mean_length")) for c in df.columns]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def roles(df: DataFrame) -> dict[str, str]:
    """The column with the longest text as line_item; of three columns with two of over 60 % numbers these as end and start."""
    rows = profile(df).collect()  # one row for each column
    longest = max(rows, key=lambda r: r["mean_length"] or 0)["column_name"]
    figures = [r["column_name"] for r in rows if (r["num_rate"] or 0) > 0.6 and r["column_name"] != longest]
    out = {longest: "line_item"}
    if len(rows) == 3 and len(figures) == 2:
        out |= dict(zip(figures, ("end", "start"), strict=True))
    return out


def clean_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's cells as cleaned text, and as a number in <column>_num where they are one."""
    return df.select("*", *[x for c in columns for x in (text.clean_text(F.col(c)).alias(f"{c}_txt"), F.when(number_like(F.col(c)), numbers.stripped(F.col(c))).alias(f"{c}_num"))])


def split_extras(df: DataFrame, column: str = "extra_values", separator: str = ";") -> DataFrame:
    """A list in one cell as columns extra1..n, moved last; n is the longest list's length."""
    parts = F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: x != "")
    most = df.agg(F.max(F.size(parts))).first()[0] or 0
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, *[F.get(parts, F.lit(i)).alias(f"extra{i + 1}") for i in range(max(0, most))])


def better_source(primary: DataFrame, fallback: DataFrame, page: list[str], least: int = 5) -> DataFrame:
    """A page's rows of the primary extraction if it has enough, else those of the fallback."""
    good = primary.groupBy(*page).count().where(F.col("count") >= least).select(*page)
    return primary.join(good, page, "left_semi").unionByName(fallback.join(good, page, "left_anti"))


def code_order(codes: Column) -> Column:
    """Codes of an array by their dotted numbers: 9, 10, 10.2, 10.10."""
    keyed = F.transform(codes, lambda c: F.struct(F.transform(F.split(c, r"\."), lambda p: p.try_cast("int")).alias("parts"), c.alias("code")))
    return F.transform(F.array_sort(keyed), lambda k: k["code"])
