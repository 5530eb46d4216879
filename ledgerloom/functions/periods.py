"""Dates and reporting periods of statement texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import MONTHS

#: The phrases before a period's date, strongest first, and the shapes of dates and quarters.
BASES = (
    ("year_ended", r"(?i)(?:năm\s+tài\s+chính\s+)?k[ếêe]t\s*th[úu]c\s*ngày\s+([^\n,]+)"), ("year_ended", r"(?i)for\s+the\s+year\s+ended\s+([^\n]+)"),
    ("as_of", r"(?i)(?:tại|tai)\s+ngày\s+([^\n,]+)"), ("as_of", r"(?i)as\s+at\s+([^\n]+)"),
)
DAY_FIRST = (r"(?i)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", r"(?i)ngay\s+(\d{1,2})\s+thang\s+(\d{1,2})\s+nam\s+(\d{4})", r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})")
YEAR_FIRST = r"(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})"
QUARTER = r"(?i)(?:Quý\s*(III|II|IV|I|[1-4])|Q\s*([1-4]))\s*(?:năm|nam|[/-])?\s*(\d{4})"
_MONTH = "|".join(MONTHS)


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def _month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m.lower(), str(i))])
    return F.get(F.array(table[F.lower(name)]), F.lit(0))


def iso_date(c: Column) -> Column:
    """The first date found, shape by shape, as yyyy-mm-dd; whether the calendar has it isn't asked."""
    part = lambda pattern, i: F.regexp_extract(c, pattern, i)
    found = [_iso(part(p, 3), part(p, 2), part(p, 1)) for p in DAY_FIRST]
    found.append(_iso(part(YEAR_FIRST, 1), part(YEAR_FIRST, 2), part(YEAR_FIRST, 3)))
    mdy, dmy = rf"(?i)({_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})", rf"(?i)(\d{{1,2}})\s+({_MONTH}),?\s+(\d{{4}})"
    found.append(_iso(part(mdy, 3), _month_number(part(mdy, 1)), part(mdy, 2)))
    found.append(_iso(part(dmy, 3), _month_number(part(dmy, 2)), part(dmy, 1)))
    return F.coalesce(*found)


def checked_date(c: Column) -> Column:
    """The date, null where the calendar has no such day."""
    return F.try_to_date(iso_date(c), "yyyy-MM-dd")


def quarter_end(c: Column) -> Column:
    quarter = F.upper(F.concat(F.regexp_extract(c, QUARTER, 1), F.regexp_extract(c, QUARTER, 2)))
    year = F.regexp_extract(c, QUARTER, 3)
    ends = (("1", "I", "-03-31"), ("2", "II", "-06-30"), ("3", "III", "-09-30"), ("4", "IV", "-12-31"))
    return F.coalesce(*[F.when(quarter.isin(digit, roman), F.concat(year, F.lit(end))) for digit, roman, end in ends])


def period(c: Column) -> Column:
    """period, basis and text: the year's end before a date "as at", before a quarter, before any date.

    A fragment is looked at only where its phrase stands; the dates of all fragments come from one lambda, so that the
    long expression of a date stands in the plan once. text is what was matched, or the date itself where it is any date.
    """
    fragments = F.array(*[F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("part"), F.regexp_extract(c, p, 0).alias("text"))) for _, p in BASES], F.when(c.rlike(r"\d{4}"), F.struct(c.alias("part"), c.alias("text"))))
    dates = F.transform(fragments, lambda f: F.when(f.isNotNull(), iso_date(f["part"])))
    named = [(F.get(dates, F.lit(i)), basis, F.trim(F.get(fragments, F.lit(i))["text"])) for i, (basis, _) in enumerate(BASES)]
    last = F.get(dates, F.lit(len(BASES)))
    named += [(quarter_end(c), "quarter_ended", F.trim(F.regexp_extract(c, QUARTER, 0))), (last, "period_ended", last)]
    return F.coalesce(*[F.when(d.isNotNull(), F.struct(d.alias("period"), F.lit(basis).alias("basis"), text.alias("text"))) for d, basis, text in named])


def simple_period(c: Column) -> Column:
    """The first date in words, day, month and year, accented or not."""
    part = lambda pattern, i: F.regexp_extract(c, pattern, i)
    return F.coalesce(*[_iso(part(p, 3), part(p, 2), part(p, 1)) for p in DAY_FIRST[:2]])


def header_date(c: Column) -> Column:
    """A header's date, day first, with slashes or dashes and two or four digits of the year; null where it is none."""
    return F.coalesce(*[F.try_to_date(F.when(c.rlike(shape), c), form) for shape, form in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"), (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"))])
