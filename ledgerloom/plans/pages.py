"""Queries of cells, line parsers, periods, rule records, ingest and sinks, over texts built from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.binding import settled
from ledgerloom.functions import cells, numbers, periods, text
from ledgerloom.operators import lines, parsers, rules
from ledgerloom.plans.registry import query, table
from ledgerloom.sources import ingest, sinks, stores

# Cells: texts of ten shapes, written the same in both dialects


_CELL = """case p_partkey % 10 when 0 then cast(100 + p_partkey % 900 as string) || '.' || cast(p_size % 10 as string) when 1 then 'IV' when 2 then cast(p_partkey % 900 + 100 as string) || '.456.789'
    when 3 then '(' || cast(p_size as string) || '.345.678)' when 4 then p_name when 5 then '131.123.456.789' when 6 then cast(p_size as string) || '.2' when 7 then cast(p_size as string) || ',5 %'
    when 8 then 'Công ty ' || p_name else cast(100 + p_partkey % 900 as string) end"""
_CELLS = f"c AS (SELECT p_partkey, {_CELL} AS x FROM part)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_CELL} x")


_THREES = "len(list_filter(string_split(x, '.'), lambda p: length(p) = 3))"


@query(f"""WITH {_CELLS} SELECT p_partkey, regexp_matches(x, '[0-9]{{1,3}}([.,][0-9]{{3}}){{2,}}(\\s|$)') AS amount, regexp_matches(x, '^\\s*[0-9]{{3}}(\\.[0-9]+)?\\s*$') OR regexp_matches(x, '(?i)^\\s*(I|II|III|IV|V)\\.?\\s*$') AS new_code,
    regexp_matches(x, '^[0-9]{{3}}(\\.[0-9]+)?$') AS code, regexp_matches(x, '^[0-9]{{2,3}}(\\.[0-9]+)*$') AS deep_code, regexp_matches(trim(x), '^[0-9]{{1,2}}(\\.[0-9])?$') AS note, regexp_matches(trim(x), '^([IVXLC]+|[0-9]{{1,2}}(\\.[0-9]+)*)$') AS numeral,
    regexp_matches(trim(x), '^\\(?[+-]?[0-9][0-9.,]*\\)?$') AS token, length(regexp_replace(x, '[^0-9]', '', 'g')) >= 6 AS money,
    len(string_split(x, '.')) > 3 OR length(replace(x, '.', '')) > 6 OR ({_THREES} >= 2 AND len(string_split(x, '.')) >= 3) AS money_code, contains(x, 'Công ty') AS header FROM c""")
def cell_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    named = {"amount": cells.is_amount(x), "new_code": cells.is_new_code(x), "code": cells.is_code(x), "deep_code": cells.is_code(x, "deep"), "note": cells.is_note(x), "numeral": cells.is_note(x, "numeral"), "token": cells.is_numeric_token(x), "money": cells.is_money(x), "money_code": cells.is_money_code(x), "header": cells.is_header(x)}
    return _cells(spark, sf_dir).select("p_partkey", *[c.alias(n) for n, c in named.items()])


_ALL_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_CORE = "regexp_replace(trim(x), '[^0-9-]', '', 'g')"
_GROUPS = "regexp_extract_all(x, '[0-9]{1,3}(?:\\.[0-9]{3})+')"


@query(f"""WITH {_CELLS} SELECT p_partkey, CASE WHEN regexp_matches(trim(x), '^\\(.*\\)$') THEN CASE WHEN length({_ALL_DIGITS}) >= 6 OR {_ALL_DIGITS} = '0' THEN '-' || {_ALL_DIGITS} END WHEN length(ltrim({_CORE}, '-')) >= 6 OR ltrim({_CORE}, '-') = '0' THEN {_CORE} END AS money,
    nullif(replace(replace(regexp_extract(x, '[0-9][0-9.,]*\\s*%'), ',', '.'), ' ', ''), '') AS share,
    try_cast(CASE WHEN {_ALL_DIGITS} <> '' THEN {_ALL_DIGITS} END AS DECIMAL(38,0)) AS joined, list_sort(list_transform({_GROUPS}, lambda g: (length(g) - length(replace(g, '.', '')), length(replace(g, '.', '')), g)))[-1][3] AS best,
    coalesce(list_sort(list_transform({_GROUPS}, lambda g: (length(g) - length(replace(g, '.', '')), length(replace(g, '.', '')), g)))[-1][3], regexp_replace(translate(x, 'OoÔôUu', '000000'), '[^0-9.]', '', 'g')) AS number FROM c""")
def cell_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _cells(spark, sf_dir).select("p_partkey", cells.money_token(x).alias("money"), cells.percent_token(x).alias("share"), cells.joined_digits(x).alias("joined"), cells.best_number(x).alias("best"), cells.number_text(x).alias("number"))


_LABEL = "case p_partkey % 4 when 0 then '  chi phi  ' || p_name when 1 then 'Phải thu | ' || p_brand when 2 then 'tien¦thue ' || p_type else p_name end"
_FIXED = "translate(strip_accents(lower(s)), 'đ', 'd')"
for _plain, _right in cells.LABEL_FIXES.items():
    _FIXED = f"replace({_FIXED}, '{_plain}', '{_right}')"
_HIT = " OR ".join(f"contains(translate(strip_accents(lower(s)), 'đ', 'd'), '{p}')" for p in cells.LABEL_FIXES)
_SQUEEZED = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT p_partkey, {_LABEL} AS x FROM part), m AS (SELECT p_partkey, x, upper(left({_SQUEEZED.format(x='x')}, 1)) || substr({_SQUEEZED.format(x='x')}, 2) AS s FROM l)
    SELECT p_partkey, CASE WHEN {_HIT} THEN {_FIXED} ELSE s END AS fixed, {_SQUEEZED.format(x="translate(x, '|¦·', '   ')")} AS token, {_SQUEEZED.format(x="regexp_replace(translate(lower(x), 'ảụ', 'au'), '[^a-z0-9 ]', ' ', 'g')")} AS letters,
    CASE WHEN upper(x) = 'IL' THEN 'II' ELSE x END AS literal, regexp_replace(x, '(chi) (phi)', '\\2 \\1', 'g') AS swapped FROM m""")
def label_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    found = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_LABEL} x")
    return found.select("p_partkey", cells.fixed_label(x).alias("fixed"), cells.clean_token(x).alias("token"), cells.letters_only(x).alias("letters"), cells.literal_fixed(x).alias("literal"), cells.replaced_patterns(x, [("(chi) (phi)", r"\2 \1"), ("", "")]).alias("swapped"))


_PRICE, _OTHER = "replace(format('{:,}', round(l_extendedprice)::BIGINT + 1000), ',', '.')", "replace(format('{:,}', l_partkey::BIGINT + 1000), ',', '.')"


@query(f"""SELECT l_orderkey, l_linenumber, {_PRICE} AS "left", {_OTHER} AS "right", {_PRICE} AS best_left, {_OTHER} AS best_right,
    CASE WHEN l_linenumber % 2 = 0 THEN {_PRICE} END AS one_left, CASE WHEN l_linenumber % 2 = 1 THEN {_PRICE} END AS one_right FROM lineitem""")
def numbers_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two amounts of each line, met in the other order, told apart by where they stand, in both ways; and one amount, by the second split."""
    price, other = numbers.grouped(F.round("l_extendedprice") + 1000), numbers.grouped(F.col("l_partkey") + 1000)
    token = lambda x, left: F.struct(x.alias("text"), left.cast("int").alias("left"), F.lit(40).alias("width"))
    shown = settled(table(spark, sf_dir, "lineitem"), "x", F.struct(price.alias("price"), other.alias("other")))
    found = shown.select("l_orderkey", "l_linenumber", F.array(token(F.col("x.other"), F.lit(700)), token(F.lit("Khoản mục"), F.lit(10)), token(F.col("x.price"), F.lit(500))).alias("tokens"), F.array(token(F.col("x.price"), F.when(F.col("l_linenumber") % 2 == 0, 500).otherwise(700))).alias("one"))
    best = settled(found, "y", F.struct(cells.two_by_x(F.col("tokens")).alias("p"), cells.best_two_by_x(F.col("tokens"), F.lit(400), F.lit(600)).alias("b"), cells.best_two_by_x(F.col("one"), F.lit(400), F.lit(600)).alias("o")))
    return best.select("l_orderkey", "l_linenumber", "y.p.left", "y.p.right", F.col("y.b.left").alias("best_left"), F.col("y.b.right").alias("best_right"), F.col("y.o.left").alias("one_left"), F.col("y.o.right").alias("one_right"))


# Line parsers: each item written as a line of one kind, and read back


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    end, begin = numbers.grouped(F.round("l_extendedprice") + 1000000), numbers.grouped(F.round("l_quantity") + 2000000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 900 + 100).cast("string").alias("code"), F.concat(F.lit("Khoản "), "l_returnflag").alias("name"), (F.col("l_linenumber") + 2).cast("string").alias("note"), end.alias("end"), begin.alias("begin"))


_ITEM = """l_orderkey, l_linenumber, (l_partkey % 900 + 100)::VARCHAR AS code, 'Khoản ' || l_returnflag AS name, (l_linenumber + 2)::VARCHAR AS note, (round(l_extendedprice) + 1000000)::DECIMAL(38,0) AS "end", (round(l_quantity) + 2000000)::DECIMAL(38,0) AS "begin" """
_SHOWN = "replace(format('{{:,}}', round({c})::BIGINT + {n}), ',', '.')"
_END_RAW, _BEGIN_RAW = _SHOWN.format(c="l_extendedprice", n=1000000), _SHOWN.format(c="l_quantity", n=2000000)


@query(f"SELECT {_ITEM} FROM lineitem")
def barred_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of odd lines the code stands in the name's cell."""
    item = _items(spark, sf_dir)
    line = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws(" | ", "code", "name", "note", "end", "begin")).otherwise(F.concat_ws("|", F.lit(""), F.concat_ws(" ", "code", "name"), "note", "end", "begin"))
    found = parsers.barred_rows(item.withColumn("line", line).select("l_orderkey", "l_linenumber", "line"), ["l_orderkey", "l_linenumber"], "line")
    return found.withColumn("name", F.regexp_replace("name", r"^\d+ ", ""))


@query(f"""SELECT l_orderkey, l_linenumber, (l_partkey % 900 + 100)::VARCHAR AS code, 'Khoản ' || l_returnflag AS name, (round(l_extendedprice) + 1000000)::BIGINT::VARCHAR AS value_1, '-' || (round(l_quantity) + 2000000)::BIGINT AS value_2 FROM lineitem""")
def valued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _items(spark, sf_dir).withColumn("line", F.concat(F.lit("Mã số: "), F.concat_ws("  ", "code", "name", "end"), F.lit("  ("), "begin", F.lit(")")))
    heads = item.where("l_linenumber = 1").select("l_orderkey", F.lit(0).alias("l_linenumber"), F.lit("Đơn vị tính: VND").alias("line"))
    return parsers.valued_lines(item.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "line").unionByName(heads), ["l_orderkey", "l_linenumber"], "line")


@query(f"""SELECT l_orderkey, sum(l_linenumber)::BIGINT AS n, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS flags, sum(round(l_extendedprice) + 1000000)::DECIMAL(38,0) AS total FROM lineitem GROUP BY l_orderkey""")
def valued_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of an order in one long line, told apart by their codes."""
    item = _items(spark, sf_dir).withColumn("part", F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.concat(F.lit("khoản-"), F.substring("name", -1, 1)), "end", "begin"))
    whole = item.groupBy("l_orderkey").agg(lines.joined_in_order("l_linenumber", "part").alias("text"))
    found = parsers.valued_segments(whole, ["l_orderkey"], "text")
    flags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("code").cast("int").alias("at"), F.substring("name", -1, 1).alias("flag")))), lambda x: x["flag"]), "")
    return found.groupBy("l_orderkey").agg(F.sum(F.col("code").cast("long")).alias("n"), flags.alias("flags"), F.sum(F.col("value_1").cast("long")).cast(numbers.WHOLE).alias("total"))


@query(f"""SELECT {_ITEM}, {_END_RAW} AS end_raw, {_BEGIN_RAW} AS begin_raw FROM lineitem""")
def long_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _items(spark, sf_dir).withColumn("line", F.concat_ws("  ", "code", "name", "note", "end", "begin"))
    blank = item.where("l_linenumber = 1").withColumn("line", F.lit("no number here"))
    return parsers.long_number_lines(item.unionByName(blank).select("l_orderkey", "l_linenumber", "line"), ["l_orderkey", "l_linenumber"], "line")


@query(f"""SELECT l_orderkey, l_linenumber, (l_partkey % 900 + 100) || '.1' AS code, 'Khoản ' || l_returnflag AS name, NULL::VARCHAR AS note, (round(l_extendedprice) + 1000000)::DECIMAL(38,0) AS "end", (round(l_quantity) + 2000000)::DECIMAL(38,0) AS "begin",
    'VND' AS unit, 1 AS unit_multiplier, {_END_RAW} AS end_raw, {_BEGIN_RAW} AS begin_raw FROM lineitem""")
def free_line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _items(spark, sf_dir).withColumn("line", F.concat(F.lit(" "), "code", F.lit(" 1 "), "name", F.lit("  "), "end", F.lit(" "), "begin"))
    found = parsers.free_lines(item.select("l_orderkey", "l_linenumber", "line"), ["l_orderkey", "l_linenumber"], "line", {"x": "y"}, {"IL": "II"})
    return parsers.records(found, ["l_orderkey", "l_linenumber"])


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 900 + 100)::VARCHAR END AS code, 'khoản ' || lower(l_returnflag) AS name, (round(l_extendedprice) + 1000000)::DECIMAL(38,0) AS "end", (round(l_quantity) + 2000000)::DECIMAL(38,0) AS "begin" FROM lineitem""")
def coded_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _items(spark, sf_dir).withColumn("line", F.concat_ws(" ", F.when(F.col("l_linenumber") % 2 == 0, F.col("code")), "name", "end", "begin"))
    return parsers.coded_values(item.select("l_orderkey", "l_linenumber", "line"), ["l_orderkey", "l_linenumber"], "line")


@query("""SELECT l_orderkey, (l_linenumber + 1) // 2 AS line_no, min(l_linenumber // 2 * 0 + (l_linenumber - 1) // 2 * 40 + (l_linenumber - 1) % 2 * 5)::INT AS top, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_linenumber) AS line FROM (SELECT DISTINCT l_orderkey, l_linenumber, any_value(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)
    GROUP BY l_orderkey, (l_linenumber + 1) // 2""".replace("(l_linenumber + 1) // 2 AS line_no", "dense_rank() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber + 1) // 2)::BIGINT AS line_no").replace("l_linenumber // 2 * 0 + ", ""))
def lines_merged_by_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recognised lines stand 5 px apart, the next pair 40 px below. Of rows that share a number, the first of the file is read."""
    met = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))
    one = met.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_returnflag", F.when(F.col("l_returnflag").isNotNull(), F.col("at"))).alias("flag"))
    placed = one.selectExpr("l_orderkey", "cast((l_linenumber - 1) div 2 * 40 + (l_linenumber - 1) % 2 * 5 as int) top", "l_linenumber left", "concat(flag, l_linenumber) line").withColumn("last_top", F.col("top"))
    return parsers.merged_by_top(placed, ["l_orderkey"]).select("l_orderkey", "line_no", "top", "line")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem), h AS (SELECT *, sum((pos % 2 = 1)::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) AS item FROM i)
    SELECT l_orderkey, min(pos)::INT AS pos, string_agg('mục ' || l_returnflag, ' ' ORDER BY pos) AS name, count(*) FILTER (pos % 2 = 0)::BIGINT AS wrapped, (max(CASE WHEN pos % 2 = 1 THEN round(l_extendedprice) + 1000 END))::DECIMAL(38,0) AS "end" FROM h GROUP BY l_orderkey, item""")
def wrapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second row of an order goes on in the next one, with a note."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    i = table(spark, sf_dir, "lineitem").withColumn("pos", pos)
    odd = F.col("pos") % 2 == 1
    rows = i.select("l_orderkey", "pos", F.when(odd, (F.col("l_partkey") % 900 + 100).cast("string")).alias("code"), F.concat(F.lit("mục | "), "l_returnflag").alias("name"), F.when(~odd, F.lit("IL")).alias("note"), F.when(odd, F.format_number(F.round("l_extendedprice") + 1000, 0)).alias("end"), F.lit("").alias("begin"))
    found = parsers.wrapped_rows(rows, ["l_orderkey"], "pos")
    return found.select("l_orderkey", "pos", "name", F.regexp_count("note", F.lit("II")).cast("long").alias("wrapped"), "end")


# Titles, units, dates


_TITLED = """case o_orderkey % 6 when 0 then 'BẢNG CÂN ĐỐI KẾ TOÁN¶Đơn vị tính: triệu đồng' when 1 then 'Income statement¶(nghìn đồng)' when 2 then 'Mã số | Thuyết minh | Số cuối năm | Số đầu năm' when 3 then 'clerk¶' || cast(o_custkey as string) || '¶' || o_orderpriority
    when 4 then 'Cash flow¶unit: VND' else 'order ' || cast(o_orderkey as string) end""".replace("¶", "' || chr(10) || '")
_LONGEST = "list_sort(list_transform(string_split(x, chr(10)), lambda l, i: (length(l), -i, l)))[-1][3]"


@query(f"""WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS which, {_TITLED} AS x FROM orders)
    SELECT o_orderkey, CASE which WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' WHEN 2 THEN 'balance_sheet' WHEN 4 THEN 'cash_flow' END AS kind,
    CASE which WHEN 0 THEN 'Bảng cân đối kế toán' WHEN 1 THEN 'Báo cáo kết quả hoạt động kinh doanh' WHEN 2 THEN 'Bảng cân đối kế toán' WHEN 4 THEN 'Báo cáo lưu chuyển tiền tệ' ELSE {_LONGEST} END AS title,
    CASE which WHEN 0 THEN 'Đơn vị tính: triệu đồng' WHEN 1 THEN '(nghìn đồng)' WHEN 4 THEN 'unit: VND' END AS raw, CASE WHEN which IN (0, 1, 4) THEN 'VND' END AS unit, CASE which WHEN 0 THEN 1000000 WHEN 1 THEN 1000 WHEN 4 THEN 1 END::BIGINT AS multiplier FROM t""")
def titles_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_TITLED} x").withColumn("t", text.statement_title(F.col("x"))).withColumn("u", text.unit_line(F.col("x")))
    return found.select("o_orderkey", "t.kind", "t.title", "u.raw", "u.unit", "u.multiplier")


_SHAPES = {0: "ngày {d} tháng {m} năm {y}", 1: "{d}/{m}/{y}", 2: "{y}-{m}-{d}", 3: "{month} {d}, {y}", 4: "{d} {month} {y}", 5: "ngay {d} thang {m} nam {y}", 6: "none"}
_PARTS = {"d": "cast(day(o_orderdate) as string)", "m": "cast(month(o_orderdate) as string)", "y": "cast(year(o_orderdate) as string)", "month": "case month(o_orderdate) " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(text.MONTHS, 1)) + " end"}


def _shaped(shape: str) -> str:
    out = "'" + shape + "'"
    for name, sql in _PARTS.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


_DATED = "case o_orderkey % 7 " + " ".join(f"when {i} then {_shaped(s)}" for i, s in _SHAPES.items()) + " end"
_ISO = "CASE WHEN o_orderkey % 7 <> 6 THEN strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"""SELECT o_orderkey, {_ISO} AS iso, CASE WHEN o_orderkey % 7 <> 6 THEN o_orderdate::DATE END AS checked, CASE WHEN o_orderkey % 7 IN (0, 5) THEN strftime(o_orderdate, '%Y-%m-%d') END AS simple,
    o_orderdate::DATE AS header, {_ISO} AS period, CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'year_ended' WHEN o_orderkey % 3 = 1 THEN 'as_of' ELSE 'period_ended' END AS basis,
    CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'For the year ended ' || {_DATED} WHEN o_orderkey % 3 = 1 THEN 'as at ' || {_DATED} ELSE {_ISO} END AS matched FROM orders""")
def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's date in one of six shapes, behind one of two phrases or none, read back."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")).selectExpr("o_orderkey", "o_orderdate", f"{_DATED} x")
    phrase = F.when(F.col("o_orderkey") % 3 == 0, "For the year ended ").when(F.col("o_orderkey") % 3 == 1, "as at ").otherwise("on ")
    header = F.date_format("o_orderdate", "d-M-yyyy")
    found = orders.withColumn("p", periods.period(F.concat(phrase, "x")))
    return found.select("o_orderkey", periods.iso_date(F.col("x")).alias("iso"), periods.checked_date(F.col("x")).alias("checked"), periods.simple_period(F.col("x")).alias("simple"), periods.header_date(header).alias("header"), F.col("p.period").alias("period"), F.col("p.basis").alias("basis"), F.col("p.text").alias("matched"))


# Rules and words


_CONFIG = {"defaults": {"company": "none", "lob": "all"}, "files": [{"match": "/a[^/]*$", "company": "first"}, {"match": "9$", "company": "nine", "lob": "nines"}, {"text_match": "license", "company": "free"}]}


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS name, html FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(name, '9$') THEN 'nine' WHEN regexp_matches(html, '(?i)license') THEN 'free' ELSE 'none' END AS company, CASE WHEN regexp_matches(name, '9$') THEN 'nines' ELSE 'all' END AS lob FROM p""")
def rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", rules.rule_record(F.col("url"), F.col("html"), _CONFIG).alias("r"))
    return found.select("page_id", "r.*")


_TYPES = "lower(p_type) || CASE WHEN p_partkey % 3 = 0 THEN ' steeel' WHEN p_partkey % 3 = 1 THEN ' qqqq 12' ELSE '' END"


@query(f"""WITH t AS (SELECT p_partkey, replace(regexp_replace(trim({_TYPES}), '\\s+', ' ', 'g'), 'brushed', 'polished') AS x FROM part), w AS (SELECT p_partkey, unnest(string_split(x, ' ')) AS word, generate_subscripts(string_split(x, ' '), 1) AS pos FROM t),
    f AS (SELECT unnest(['polished', 'anodized', 'steels', 'standard']) AS entry), m AS (SELECT DISTINCT word, entry, round(100 * (1 - levenshtein(word, entry)::DOUBLE / greatest(length(word), length(entry), 1)), 4) AS score FROM w, f WHERE regexp_matches(word, '\\p{{L}}')),
    b AS (SELECT word, entry FROM m WHERE score > 85 QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, entry) = 1)
    SELECT p_partkey, string_agg(coalesce(entry, w.word), ' ' ORDER BY pos) AS x, coalesce(string_agg(CASE WHEN entry IS NULL AND regexp_matches(w.word, '\\p{{L}}') THEN w.word END, ' ' ORDER BY pos), '') AS unknown FROM w LEFT JOIN b ON w.word = b.word GROUP BY p_partkey""")
def advanced_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_TYPES} x")
    done = rules.advanced_clean(found, ["p_partkey"], "x", {"BRUSHED": "polished", "anodised": "anodized", "steeels": "steels", "standrad": "standard"})
    return done.select("p_partkey", "x", F.array_join("unknown", " ").alias("unknown"))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(p_type), '[a-z]+')) AS word FROM part) SELECT word, count(*) AS n FROM w GROUP BY word""")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").selectExpr("p_partkey", "regexp_replace(p_type, '[^A-Za-z]+', ' ') x")
    return stores.unknown_words(rules.advanced_clean(found, ["p_partkey"], "x", {"zzzzzzzz": "zzzzzzzz"})).where("word <> ''")


# Sources and sinks


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS turn, role, text FROM conversations")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats saved as JSON, one for each conversation, and every message read back."""
    saved = sinks.chats(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("chat_name"), F.from_json("messages", "array<array<string>>").alias("messages"))
    return ingest.chat_messages(saved).withColumnRenamed("chat_name", "conv_id")


@query("SELECT p_partkey, p_brand || ',' || CASE WHEN contains(n, ',') OR contains(n, '\"') THEN '\"' || replace(n, '\"', '\"\"') || '\"' ELSE n END || ',' || p_size AS quoted, p_brand || ',' || replace(n, ',', ' ') || ',' || p_size AS plain FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN p_name || ', x' WHEN 1 THEN '\"' || p_name ELSE p_name END AS n FROM part)")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(", x"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('"'), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", name.alias("n"), "p_size")
    return rows.select("p_partkey", stores.csv_line(["p_brand", "n", "p_size"]).alias("quoted"), stores.csv_line(["p_brand", "n", "p_size"], quoted=False).alias("plain"))


@query("SELECT doc_id || CASE kind WHEN 0 THEN '.txt' ELSE '_meta.json' END AS name, sha256(CASE kind WHEN 0 THEN text ELSE '{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' END) AS sha FROM documents, (SELECT unnest([0, 1]) AS kind)")
def text_and_meta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("name", F.col("doc_id").cast("string"))
    return stores.text_and_meta(docs, "name", "text", ["lang", "n_chars"]).select("name", F.sha2("content", 256).alias("sha"))


@query("SELECT page_id, regexp_replace(replace(url, 'https://', ''), '\\.[^./]*$', '') || '_out.txt' AS mirrored FROM pages")
def mirrored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", stores.mirrored(F.col("url"), "https:/", "_out.txt").alias("mirrored"))


@query("SELECT page_id, url FROM pages WHERE page_id BETWEEN 5 AND 40")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pages_between(table(spark, sf_dir, "pages").select("page_id", "url"), 5, 40, "page_id")


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def unioned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return ingest.unioned_tables([nation, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))])


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.common_rows(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")))


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), f AS (SELECT p_brand, p_size FROM part ORDER BY p_brand, p_size LIMIT 5)
    SELECT (SELECT count(*) FROM part) AS n_rows, 100.0::DOUBLE AS pct_numeric, (SELECT count(*) FROM c) AS n_codes, (SELECT count(*) FROM c WHERE n > 1) AS n_repeated,
    '{' || (SELECT string_agg('"' || p_brand || '":' || n, ',' ORDER BY p_brand) FROM c WHERE n > 1) || '}' AS repeated_codes, '[' || (SELECT string_agg('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}', ',' ORDER BY p_brand, p_size) FROM f) || ']' AS sample, '{"unit": "VND"}' AS config""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.run_report(table(spark, sf_dir, "part").select("p_brand", "p_size"), "p_brand", ["p_size"], {"unit": "VND"})


@query("SELECT p_partkey, 'Dòng ' || p_partkey || ': p_brand = ' || p_brand || ', p_size = ' || p_size AS line FROM part")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("empty", F.lit(" "))
    return rows.select("p_partkey", cells.numbered_row(F.col("p_partkey"), ["p_brand", "empty", "p_size"]).alias("line"))
