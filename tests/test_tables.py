from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.models import StubRunner
from ledgerloom.operators import statements, tables


def test_names_and_roles(spark):
    df = spark.createDataFrame([("Tiền mặt tại quỹ", "1.000", "2.000"), ("Hàng tồn kho", "3.000", "x")], "a string, b string, c string")
    assert tables.roles(df.where("c <> 'x'")) == {"a": "line_item", "b": "end", "c": "start"}
    renamed = tables.with_raw_copies(tables.with_period_names(df.toDF("name", "Số cuối năm", "Số đầu năm")))
    assert renamed.columns == ["name", "end", "start", "name_raw", "end_raw", "start_raw"]
    assert tables.with_unique_names(df.toDF("a", "a", "b")).columns == ["a", "a.1", "b"]
    assert tables.with_units(df).columns[-2:] == ["currency", "scale"]
    assert tables.with_columns(df, ["x"]).columns == ["x"] and tables.with_columns(df, ["x", "y", "z", "w"]).first().w is None


def test_cells(spark):
    df = spark.createDataFrame([("Tiền* mặt", "1.234.567"), (" ", None)], "n string, v string")
    assert tables.without_blank_rows(df).count() == 1
    row = tables.clean_cells(df, ["n", "v"]).first()
    assert (row.n_txt, row.n_num, row.v_num) == ("Tiền mặt", None, 1234.567)


def test_extras_and_order(spark):
    df = spark.createDataFrame([(1, "a; b;"), (2, None), (3, "c")], "id int, extra_values string")
    assert [tuple(r) for r in tables.split_extras(df).orderBy("id").collect()] == [(1, "a", "b"), (2, None, None), (3, "c", None)]
    codes = spark.createDataFrame([(["10.10", "9", "10.2", "10"],)], "c array<string>")
    assert codes.select(tables.code_order(F.col("c")).alias("c")).first().c == ["9", "10", "10.2", "10.10"]


def test_statement_rows(spark):
    lines = ["110 Tiền và tương đương tiền 5 1.234.567 (890.123)", "| 131.1 | Phải thu | V.2 | 5.000 | |", "không có mã 1.000", "270 TỔNG CỘNG 9.999.999"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, line string")
    got = [tuple(r) for r in statements.statement_rows(df, ["pos"], "line", 1000).orderBy("pos").collect()]
    assert got == [
        (0, "110", "Tiền và tương đương tiền", "5", Decimal(1234567000), Decimal(-890123000)),
        (1, "131.1", "Phải thu", "V.2", Decimal(5000000), None),
        (3, "270", "TỔNG CỘNG", None, Decimal(9999999000), None),
    ]


def test_answers(spark):
    found = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, rank int, content string")
    asked = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id int, question string")

    class Down(StubRunner):
        def generate(self, prompts):
            if "a\n\nb" in prompts[0]:
                return ["from context"]
            raise RuntimeError("down")

    assert {tuple(r) for r in statements.answers(found, asked, Down()).collect()} == {(1, "internal", "from context"), (2, "none", None)}
