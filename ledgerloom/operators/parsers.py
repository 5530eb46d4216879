"""Lines of recognised statements to rows, by the conventions of each kind of source.

Every parser gives code, name and note as text, the amounts' texts and their values; all are column expressions over
one line a row, so nothing shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.binding import bound, settled
from ledgerloom.functions import cells, numbers
from ledgerloom.functions.text import squeezed, truncated
from ledgerloom.operators.lines import joined_in_order
from ledgerloom.operators.rules import alias


@dataclass(frozen=True)
class ParseConfig:
    """How statement lines are read: unit and multiplier, characters to drop, patterns to replace in numbers, code aliases, numerals to put right."""

    unit: str = "VND"
    multiplier: int = 1
    drop_characters: tuple[str, ...] = (" ", ",", "£", "¥", "₫")
    patterns: tuple[tuple[str, str], ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    numerals: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, config: dict, unit: str = "VND") -> ParseConfig:
        """From a configuration's `globals`; what it leaves out keeps its default."""
        g = config.get("globals") or {}
        cleanup = g.get("number_cleanup") or {}
        patterns = tuple((p.get("from"), p.get("to")) for p in cleanup.get("fix_patterns", ()))
        return cls(g.get("currency", unit), int(g.get("unit_multiplier", 1)), tuple(cleanup.get("drop_chars", cls.drop_characters)), patterns, g.get("code_aliases") or {}, g.get("roman_normalize") or {})

    def number(self, c: Column) -> Column:
        """A raw amount's value: patterns replaced, characters dropped, then as recognised."""
        c = cells.replaced_patterns(c, self.patterns)
        for x in self.drop_characters:
            c = F.replace(c, F.lit(x), F.lit(""))
        return numbers.recognised(c, self.multiplier)


def configured_records(lines: DataFrame, keys: list[str], line: str, config: ParseConfig) -> DataFrame:
    """Records of free lines by a configuration."""
    rows = free_lines(lines, keys, line, config.aliases, config.numerals)
    found = records(rows, keys, config.unit, config.multiplier)
    return found.withColumn("end", config.number(F.col("end_raw"))).withColumn("begin", config.number(F.col("begin_raw")))


#: The words before a code in the first column.
CODE_TITLE = r"(?i)^(?:Mã\s*số|Ma\s*so|Chi\s*tieu|Chỉ\s*tiêu)\s*[:\-]?\s*"
CODE_HEAD = r"(?i)^\s*(\d{1,3}(?:\.\d{1,3}){0,2}|[IVXLCDM]+|[A-Z]\.)\s+(.+)$"
CODE_ANCHOR = r"(?i)(?:^|\s)(?!\d{1,3}(?:\.\d{3}){2}\s)(\d{1,3}(?:\.\d{1,3}){0,2}|[IVXLCDM]+|[A-Z]\.)(?=\s)"
NUMBER_TOKEN, PERCENT_TOKEN = r"\(?-?\d[\d.,]*\)?", r"\d[\d.,]*\s*%"


def _steps(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    for name, step in steps.items():
        df = df.withColumn(name, step)
    return df


def _null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def barred_rows(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Five cells between bars: code, name, note, end, begin. A code in the name stands in where the first cell has none."""
    cell = lambda i: F.coalesce(F.trim(F.get("__cells", F.lit(i))), F.lit(""))
    code = lambda c: _null(F.regexp_extract(c, r"^(\d{2,3}(?:\.\d+)*)(?![\p{L}\p{N}_])", 1))
    cut = lines.withColumn("__cells", F.split(line, r"\|"))
    return cut.select(*keys, F.coalesce(code(F.replace(cell(0), F.lit(" "), F.lit(""))), code(cell(1))).alias("code"), cell(1).alias("name"), _null(cell(2)).alias("note"), numbers.first_group(cell(3)).alias("end"), numbers.first_group(cell(4)).alias("begin"))


def value_tokens(c: Column, accept_small: bool = False, allow_percent: bool = False, wanted: int = 2) -> Column:
    """Amounts of a line in order, then, if these are too few and percentages count, those."""
    found = lambda pattern, read: F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), read), lambda x: x.isNotNull())
    money = found(NUMBER_TOKEN, lambda t: cells.money_token(t, accept_small))
    if not allow_percent:
        return money
    return F.when(F.size(money) < wanted, F.concat(money, found(PERCENT_TOKEN, cells.percent_token))).otherwise(money)


def tail_values(c: Column, k: int, accept_small: bool = False, allow_percent: bool = False) -> Column:
    """head, values: the last k values and what stands before the first of them; the whole line and none, where there are fewer."""
    # from the end: each of the last k tokens is cut off with all that follows its last place
    cut = lambda s, t: F.substr(s, F.lit(1), F.length(s) - F.instr(F.reverse(s), F.reverse(t)) - F.length(t) + 1)
    none = F.array().cast("array<string>")

    def told(values: Column, tokens: Column) -> Column:
        rest = F.aggregate(F.reverse(F.slice(tokens, -k, k)), c, cut)
        enough = F.size(values) >= k
        return F.struct(F.when(enough & (F.size(tokens) >= k), F.rtrim(rest)).otherwise(c).alias("head"), F.when(enough, F.slice(values, -k, k)).otherwise(none).alias("values"))

    if allow_percent:
        both = F.filter(F.regexp_extract_all(c, F.lit(rf"{PERCENT_TOKEN}|{NUMBER_TOKEN}"), F.lit(0)), lambda t: F.coalesce(cells.money_token(t, accept_small), cells.percent_token(t)).isNotNull())
        return bound(F.struct(value_tokens(c, accept_small, True, k).alias("values"), both.alias("tokens")), lambda x: told(x["values"], x["tokens"]))
    judged = F.transform(F.regexp_extract_all(c, F.lit(NUMBER_TOKEN), F.lit(0)), lambda t: F.struct(t.alias("token"), cells.money_token(t, accept_small).alias("value")))
    return bound(F.filter(judged, lambda x: x["value"].isNotNull()), lambda x: told(x["value"], x["token"]))


def code_and_name(c: Column) -> Column:
    """A head's code, a number, numeral or letter, and the name after it; no code where an amount stands in its place."""
    s = F.regexp_replace(F.trim(c), CODE_TITLE, "")

    def told(x: Column) -> Column:
        good = (x["code"] != "") & ~cells.is_money_code(x["code"])
        return F.struct(F.when(good, x["code"]).alias("code"), F.when(good, F.trim(F.regexp_extract(x["title"], CODE_HEAD, 2))).otherwise(x["title"]).alias("name"))

    return bound(s, lambda title: bound(F.struct(title.alias("title"), F.rtrim(F.regexp_extract(title, CODE_HEAD, 1), F.lit(".")).alias("code")), told))


def _valued(df: DataFrame, keys: list[str], text: str, k: int, accept_small: bool, allow_percent: bool) -> DataFrame:
    out = settled(df, "__tail", tail_values(F.col(text), k, accept_small, allow_percent))
    out = settled(out, "__head", code_and_name(F.col("__tail.head")))
    name = F.trim(F.regexp_replace("__head.name", r"^[\d.\s]{3,}\s*", ""))
    return out.select(*keys, F.col("__head.code").alias("code"), bound(name, lambda n: truncated(n)).alias("name"), *[F.get("__tail.values", F.lit(i)).alias(f"value_{i + 1}") for i in range(k)])


def valued_lines(lines: DataFrame, keys: list[str], line: str, k: int = 2, accept_small: bool = False, allow_percent: bool = False) -> DataFrame:
    """code, name and the last k values of each line, from left to right; header lines and empty ones are left out."""
    kept = lines.where((F.trim(line) != "") & ~cells.is_header(F.col(line))).withColumn(line, squeezed(F.col(line)))
    return _valued(kept, keys, line, k, accept_small, allow_percent)


def valued_segments(texts: DataFrame, keys: list[str], text: str, k: int = 2, accept_small: bool = False, allow_percent: bool = False) -> DataFrame:
    """The same of a text in one long line, cut before each code; segments without values are left out."""
    cut = F.split(F.regexp_replace(text, CODE_ANCHOR, "\u0001$1"), "\u0001")
    each = texts.select(*keys, F.posexplode(cut).alias("segment_no", "segment")).where(F.trim("segment") != "")
    return _valued(each, [*keys, "segment_no"], "segment", k, accept_small, allow_percent).where("value_1 is not null")


def long_number_lines(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """code at the start, note, and the two longest amounts, in their order, with their texts; lines with none of these are left out."""
    amount = r"-?\d[\d.,]{5,}"
    tokens = F.regexp_extract_all(line, F.lit(amount), F.lit(0))
    ranked = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.length(cells.digits(t))).alias("size"), i.alias("at"), t.alias("token"))))
    two = F.transform(F.array_sort(F.transform(F.slice(ranked, 1, 2), lambda s: F.struct(s["at"], s["token"]))), lambda s: s["token"])
    code = _null(F.regexp_extract(line, r"^\s*(\d{3}(?:\.\d)?)\b", 1))
    note = _null(F.translate(F.regexp_extract(line, r"(?<![\d.,])(\d{1,2}(?:[.,]\d)?)(?![\d.,])", 1), ",", "."))
    known = settled(lines.where(F.trim(line) != ""), "__x", F.struct(F.col(line).alias("line"), two.alias("two"), code.alias("code"), note.alias("note")))
    amounts = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: cells.joined_digits(F.get("__x.two", i)))
    found = settled(known, "__v", amounts)
    end, begin = F.get("__v", F.lit(0)), F.get("__v", F.lit(1))
    name = cells.line_name(F.col("__x.line"), F.col("__x.code"), F.col("__x.note"), F.col("__x.two"))
    kept = found.where(F.col("__x.code").isNotNull() | end.isNotNull() | begin.isNotNull())
    return kept.select(*keys, F.col("__x.code").alias("code"), name.alias("name"), F.col("__x.note").alias("note"), end.alias("end"), begin.alias("begin"), F.get("__x.two", F.lit(0)).alias("end_raw"), F.get("__x.two", F.lit(1)).alias("begin_raw"))


def normal_code(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """131 1 and 1311 as 131.1; aliases stand for their codes."""
    aliases = aliases or {}
    dotted = F.replace(F.trim(c), F.lit(" "), F.lit("."))
    split = F.regexp_replace(dotted, r"^(\d{3})(\d{1,2})$", "$1.$2")
    known = alias(dotted, aliases)
    return F.when(known != dotted, known).otherwise(alias(split, aliases))


def free_lines(lines: DataFrame, keys: list[str], line: str, aliases: dict[str, str] | None = None, numerals: dict[str, str] | None = None, multiplier: int = 1) -> DataFrame:
    """Records of free text: raw_code, code, label, the last two amounts of seven digits or more, their texts and values. Lines without a code are left out."""
    begins = r"^\s*(\d{3}(?:[.\s]\d{1,2})?)\b"
    steps = {
        "raw_code": F.regexp_extract(line, begins, 1),
        "__rest": F.trim(F.regexp_replace(line, begins, "")),
        "__amounts": numbers.amount_tokens(F.col("__rest")),
        "end_raw": F.when(F.size("__amounts") >= 2, F.element_at("__amounts", -2)).otherwise(F.get("__amounts", F.lit(0))),
        "begin_raw": F.when(F.size("__amounts") >= 2, F.element_at("__amounts", -1)),
        "label": F.trim(F.coalesce(F.substr("__rest", F.lit(1), F.instr(F.col("__rest"), F.col("end_raw")) - 1), F.col("__rest"))),
        "code": normal_code(F.col("raw_code"), aliases),
        "end": numbers.recognised(F.col("end_raw"), multiplier),
        "begin": numbers.recognised(F.col("begin_raw"), multiplier),
    }
    out = _steps(lines, steps).where("raw_code <> ''")
    for wrong, right in (numerals or {}).items():
        out = out.withColumn("label", F.replace("label", F.lit(wrong), F.lit(right)))
    return out.select(*keys, "raw_code", "code", "label", F.lit(None).cast("string").alias("note"), "end_raw", "begin_raw", "end", "begin")


def records(rows: DataFrame, keys: list[str], unit: str = "VND", multiplier: int = 1) -> DataFrame:
    """Statement records: the parsed values beside the raw ones, with unit and multiplier; rows without a code or an amount are left out."""
    whole = lambda c: numbers.recognised(F.col(c), multiplier)
    kept = rows.where("code is not null and (end_raw is not null or begin_raw is not null)")
    return kept.select(*keys, "code", squeezed(F.col("label")).alias("name"), "note", whole("end_raw").alias("end"), whole("begin_raw").alias("begin"), F.lit(unit).alias("unit"), F.lit(multiplier).alias("unit_multiplier"), "end_raw", "begin_raw")


def coded_values(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """code (null in lines without one), the lower-case name, and the two amounts at the end of a line; other lines are left out."""
    pattern = r"^\s*(?:(\d+[a-zA-Z0-9.]*)\s+)?(.+?)\s+([\d.,]+)\s+([\d.,]+)\s*$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    return lines.where(F.col(line).rlike(pattern)).select(*keys, _null(part(1)).alias("code"), F.lower(part(2)).alias("name"), numbers.digits_only(part(3)).alias("end"), numbers.digits_only(part(4)).alias("begin"))


def merged_by_top(lines: DataFrame, page: list[str], tolerance: int = 6) -> DataFrame:
    """Recognised lines (top, last_top, left, line) of a page as visual ones: a line goes on where its top is within the tolerance of the last token's before it."""
    by = Window.partitionBy(*page).orderBy("top", "left")
    new = F.coalesce((F.abs(F.col("top") - F.lag("last_top").over(by)) > tolerance).cast("int"), F.lit(1))
    numbered = lines.withColumn("__new", new).withColumn("line_no", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*page, "line_no").agg(F.min("top").alias("top"), joined_in_order("left", "line").alias("line"))


def wrapped_rows(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows of five columns (code, name, note, end, begin), wrapped ones joined to the row before: names and notes both.

    What is no account code belongs to the name. A row without code and amounts goes on; a name that is an amount is the end value.
    """
    token = {c: cells.clean_token(F.col(c)) for c in ("code", "name", "note", "end", "begin")}
    out = rows.select(*keys, position, *[c.alias(n) for n, c in token.items()])
    good = cells.is_code(F.col("code"))
    out = out.withColumn("name", F.when(good, F.col("name")).otherwise(F.trim(F.concat_ws(" ", "code", "name")))).withColumn("code", F.when(good, F.col("code")).otherwise("")).withColumn("note", cells.literal_fixed(F.col("note")))
    head = (F.col("code") != "") | (F.col("end") != "") | (F.col("begin") != "")
    by = Window.partitionBy(*keys).orderBy(position)
    numbered = out.withColumn("__item", F.sum((head | (F.row_number().over(by) == 1)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    texts = lambda c: F.trim(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(position, c))), lambda x: x[c]), lambda x: x != ""), " ")).alias(c)
    merged = numbered.groupBy(*keys, "__item").agg(F.min(position).alias(position), *[F.min_by(c, position).alias(c) for c in ("code", "end", "begin")], texts("name"), texts("note"))
    amount = cells.is_numeric_token(F.col("name")) & ~F.col("name").rlike(r"^\d{1,3}$") & (F.col("end") == "") & (F.col("begin") == "")
    moved = merged.withColumn("end", F.when(amount, F.col("name")).otherwise(F.col("end"))).withColumn("name", F.when(amount, "").otherwise(F.col("name")))
    whole = lambda c: F.regexp_replace(c, r"[^\d-]", "").try_cast(numbers.WHOLE)
    return moved.select(*keys, position, "code", "name", "note", whole("end").alias("end"), whole("begin").alias("begin"))
