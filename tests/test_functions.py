from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, periods, text


def values(spark, f, items):
    rows = spark.createDataFrame(list(enumerate(items)), "i int, x string").select("i", f(F.col("x")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (numbers.loose, "1.234.567", 1234.567), (numbers.loose, "1,5", 1.5), (numbers.loose, "abc", None), (numbers.stripped, "1,234,567", None), (numbers.stripped, "12,5%", 12.5),
        (numbers.comma_decimal, "1.234,56", 1234.56), (numbers.separators_dropped, "1.234,56", Decimal(123456)), (numbers.recognised, "(1.234.567)", Decimal(-1234567)), (numbers.recognised, "O1I.l23.456", Decimal(11123456)),
        (numbers.recognised, "-", None), (numbers.recognised_wide, "S£B.000", Decimal(558000)), (numbers.first_group, "x 12.345 678", Decimal(12345)), (numbers.digits_only, "1.234.567.890.123", Decimal(1234567890123)),
        (numbers.money_text, "12.345", ""), (numbers.money_text, "1234567", "1.234.567"), (numbers.percent, "12,5%", 0.125), (numbers.percent, "12", None), (numbers.note, "110 5 x", "5"),
        (numbers.two_largest, "1 222 33 4444", ["222", "4444"]), (numbers.amount_tokens, "1.234.567 12 (7.654.321)", ["1.234.567", "(7.654.321)"]),
        (periods.iso_date, "ngày 31 tháng 12 năm 2024", "2024-12-31"), (periods.iso_date, "December 31, 2024", "2024-12-31"), (periods.iso_date, "31 December 2024", "2024-12-31"), (periods.iso_date, "31/02/2024", "2024-02-31"),
        (periods.checked_date, "31/02/2024", None), (periods.quarter_end, "Quý IV/2024", "2024-12-31"), (periods.quarter_end, "Q3 2024", "2024-09-30"), (periods.quarter_end, "none", None),
        (text.strip_accents, "Số đầu năm", "so đau nam"), (text.normal_words, "Số đầu-năm!", "so dau nam"), (text.strip_single_marks, "ồ Ạ", "ồ a"), (text.truncated, "a" * 130, "a" * 117 + "..."),
        (text.without_junk, "a | b\nc  •d", "a b\nc d"), (text.clean_text, "Tiền* mặt#", "Tiền mặt"), (text.language, "Tiền và đô", "vi"), (text.language, "in March", "en"), (text.file_kind, "a/b/Risk_1.pdf", "survey"),
        (text.unit_multiplier, "Đơn vị: triệu đồng", 1_000_000), (lambda c: text.unit_multiplier(c, legacy=True), "trieu dong", 1), (text.statement_kind, "BẢNG CÂN ĐỐI KẾ TOÁN", "balance_sheet"),
        (text.with_headings, "chap. ii one\n\n\n\n• x\nSection 2\nchapter one", "# CHAPTER ii one\n\n- x\n## SECTION 2\nchapter one"), (text.forced_breaks, "a 111 Tiền 112 Vàng I. B", "a\n111 Tiền\n112 Vàng\nI. B"),
        (text.company_line, "x\nCông ty A\nTổng Công ty Bảo hiểm B", "Tổng Công ty Bảo hiểm B"), (text.company_line, "\n first \nb", "first"),
        (lambda c: text.corrected(c, {"tai san": "TÀI SẢN"}), "Tai San cu, taisan", "TÀI SẢN cu, taisan"),
    ],
)
def test_golden(spark, f, given, want):
    assert values(spark, f, [given]) == [want]


def test_period_precedence(spark):
    texts = ["Q1 2020 for the year ended 31 December 2024", "as at 1/2/2023 Quý II/2022", "Quý II/2022 5/6/2021", "5/6/2021", ""]
    got = values(spark, periods.period, texts)
    assert [(p and p.period, p and p.basis) for p in got] == [("2024-12-31", "year_ended"), ("2023-02-01", "as_of"), ("2022-06-30", "quarter_ended"), ("2021-06-05", "period_ended"), (None, None)]


def test_code_and_name(spark):
    assert [tuple(v) for v in values(spark, text.code_and_name, ["131.1 Phải thu", "no code"])] == [("131.1", "Phải thu"), (None, "no code")]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(amounts=st.lists(st.integers(-(10**30), 10**30), min_size=1, max_size=20))
def test_format_and_back(spark, amounts):
    rows = spark.createDataFrame([(i, Decimal(a)) for i, a in enumerate(amounts)], "i int, a decimal(38,0)")
    shown = numbers.grouped(F.col("a"))
    assert all(r.a == r.b for r in rows.select("a", numbers.recognised(shown).alias("b")).collect())


def test_leading_zeros_beyond_the_width(spark):
    x = F.col("x")
    row = spark.createDataFrame([("(" + "0" * 38 + "12)", "9" * 39, "-", "-0")], "x string, long string, sign string, zero string").select(
        numbers.recognised(x), numbers.recognised_wide(x), numbers.first_group(x), numbers.recognised(F.col("long")), numbers.recognised(F.col("sign")), numbers.recognised(F.col("zero"))
    ).first()
    assert [None if v is None else int(v) for v in row] == [-12, -12, -12, None, None, 0]
