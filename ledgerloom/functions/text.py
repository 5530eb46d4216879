"""Text normalisation, classification and layout of recognised pages, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Every precomposed Latin letter whose decomposition is one ASCII letter and marks, and that letter."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x1EFA)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_MARKED, _PLAIN = _folds()

#: The letters of the single-mark table, which leaves doubly marked letters alone.
SINGLE_MARKED = "đơôưăâáàảãạéèẻẽẹíìỉĩịóòỏõọúùủũụýỳỷỹỵ"
#: Words that tell the kind of a file by its name, of a statement by its text.
FILE_KINDS = (("BCTC", ("bctc", "balance", "fs", "financial")), ("survey", ("survey", "risk", "inspection", "giamsat")))
STATEMENTS = (
    ("balance_sheet", ("bang can doi ke toan", "balance sheet", "statement of financial position")),
    ("income_statement", ("bao cao ket qua hoat dong kinh doanh", "income statement")),
    ("cash_flow", ("bao cao luu chuyen tien te", "cash flow")),
    ("equity_changes", ("bao cao thay doi von chu so huu", "changes in equity")),
)
#: Money units and their multipliers, in accent-free form.
UNITS = {"dong": 1, "vnd": 1, "vn dong": 1, "nghin dong": 1_000, "ngan dong": 1_000, "trieu dong": 1_000_000, "ty dong": 1_000_000_000}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f\x0B ]+", " "))


def strip_accents(c: Column, fold_d: bool = False) -> Column:
    """Lower case without accents. đ stays unless fold_d, as it has no decomposition."""
    plain = F.regexp_replace(F.translate(F.lower(c), _MARKED, _PLAIN), r"\p{Mn}+", "")
    return F.translate(plain, "đ", "d") if fold_d else plain


def strip_single_marks(c: Column) -> Column:
    """Lower case, with the letters of the single-mark table folded and all others kept."""
    plain = "".join("d" if x == "đ" else unicodedata.normalize("NFD", x)[0] for x in SINGLE_MARKED)
    return squeezed(F.translate(F.lower(c), SINGLE_MARKED, plain))


def normal(c: Column) -> Column:
    return squeezed(strip_accents(c))


def normal_words(c: Column) -> Column:
    """Accent-free letters and digits, all else as spaces."""
    return squeezed(F.regexp_replace(strip_accents(c, fold_d=True), "[^a-z0-9]", " "))


def without_junk(c: Column) -> Column:
    """Bars and bullets as spaces, space runs as one, characters that aren't printable dropped; lines stay lines."""
    c = F.regexp_replace(c, "[|¦•∙·]+", " ")
    c = F.regexp_replace(c, r"[^\n\x20-\x7E -￿]", " ")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def clean_text(c: Column) -> Column:
    """Letters, digits and plain punctuation, single-spaced."""
    return squeezed(F.regexp_replace(c, r"[^\p{L}\p{N}\s.,;:()/%_-]", " "))


def truncated(c: Column, most: int = 120) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most - 3))), F.lit("..."))).otherwise(c)


def language(c: Column) -> Column:
    """vi from three marked letters on; en where an English month stands; vi otherwise."""
    marks = F.regexp_count(F.lower(c), F.lit(f"[{SINGLE_MARKED}ê]"))
    month = c.rlike(rf"(?i)\b({'|'.join(MONTHS)})\b")
    return F.when(marks >= 3, "vi").when(month, "en").otherwise("vi")


def statement_kind(c: Column) -> Column:
    words = normal_words(c)
    found = F.lit(None).cast("string")
    for kind, phrases in reversed(STATEMENTS):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | words.contains(phrase)
        found = F.when(hit, kind).otherwise(found)
    return found


def file_kind(path: Column) -> Column:
    stem = F.lower(F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1))
    found = F.lit("other")
    for kind, words in reversed(FILE_KINDS):
        found = F.when(stem.rlike("|".join(words)), kind).otherwise(found)
    return found


def unit_multiplier(c: Column, legacy: bool = False) -> Column:
    """The money unit's multiplier. The longest name counts; legacy takes the first of the table, so that a plain "trieu dong" is 1."""
    words = normal_words(c)
    names = list(UNITS) if legacy else sorted(UNITS, key=len, reverse=True)
    found = F.lit(None).cast("long")
    for name in reversed(names):
        found = F.when(words.contains(name), F.lit(UNITS[name]).cast("long")).otherwise(found)
    return found


#: What heading lines begin with, and the numbers that follow.
HEADINGS = (("#", "CHAPTER", r"CHAPTER|CHAP\.?", "[IVXLC]+"), ("##", "SECTION", r"SECTION|SEC\.?", "[A-Z0-9]+"), ("###", "PART", r"PART|PT\.?", "[A-Z0-9]+"))


def with_headings(c: Column) -> Column:
    """Numbered CHAPTER, SECTION and PART lines, also shortened ones, as headings of three levels; bullets as dashes, blank lines single."""

    def line(x: Column) -> Column:
        out = F.regexp_replace(x, r"^[-•·]\s*", "- ")
        for marks, word, names, number in HEADINGS:
            out = F.regexp_replace(out, rf"(?i)^(?:{names})\s+({number})\b(.*)$", f"{marks} {word} $1$2")
        return out

    lines = F.transform(F.split(c, "\n"), lambda x: line(F.trim(x)))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def anchors(c: Column) -> Column:
    """Distinct headings of a text with headings, in order, without their marks."""
    found = F.filter(F.split(c, "\n"), lambda x: x.rlike("^#{1,3} (?:CHAPTER|SECTION|PART) "))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^#+ ", "")))


def forced_breaks(c: Column, codes: bool = True, numerals: int = 5, money: bool = True) -> Column:
    """A line break before each account code, each numeral that begins an item, up to V or to X, and each amount of three groups."""
    if codes:
        c = F.regexp_replace(c, r"(?<=\S) +(?=\d{3}(\.\d+)? +\p{L})", "\n")
    names = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")[:numerals]
    c = F.regexp_replace(c, rf"(?<=\S) +(?=(?:{'|'.join(names)})\. )", "\n")
    return F.regexp_replace(c, r"(?<=\S) +(?=\d{1,3}(?:[.,]\d{3}){2,}(?!\d))", "\n") if money else c


#: The titles of statements, and the columns by which a balance sheet without a title is known.
TITLES = {"balance_sheet": "Bảng cân đối kế toán", "income_statement": "Báo cáo kết quả hoạt động kinh doanh", "cash_flow": "Báo cáo lưu chuyển tiền tệ", "equity_changes": "Báo cáo thay đổi vốn chủ sở hữu"}
SHEET_COLUMNS = ("ma so", "thuyet minh", "so cuoi nam", "so dau nam")


def statement_title(c: Column) -> Column:
    """kind and title: of a known statement its name; of a text with a balance sheet's columns that one's; else no kind and the longest of the first 15 lines."""
    words, kind = normal_words(c), statement_kind(c)
    columns = F.lit(True)
    for name in SHEET_COLUMNS:
        columns = columns & words.contains(name)
    kind = F.coalesce(kind, F.when(columns, "balance_sheet"))
    head = F.slice(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 15)
    longest = F.array_max(F.transform(head, lambda x, i: F.struct(F.length(x).alias("size"), (-i).alias("at"), x.alias("line"))))["line"]
    names = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return F.struct(kind.alias("kind"), F.coalesce(F.when(kind.isNotNull(), names[kind]), longest).alias("title"))


def unit_line(c: Column, lines: int = 30) -> Column:
    """raw, unit and multiplier: of the first lines the one that names the unit, else the first with a currency's name."""
    head = F.slice(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, lines)
    named = F.filter(head, lambda x: strip_single_marks(x).rlike(r"d[o0]n\s*v[ij]t?\s*t?inh?"))
    money = F.filter(head, lambda x: x.rlike(r"(?i)(?<![\p{L}\p{N}])(?:VN[ĐD]|đồng|dong|triệu|trieu|tỷ|ty)(?![\p{L}\p{N}])"))
    raw = F.coalesce(F.get(named, F.lit(0)), F.get(money, F.lit(0)))
    multiplier = unit_multiplier(raw)
    return F.struct(raw.alias("raw"), F.when(multiplier.isNotNull(), "VND").alias("unit"), multiplier.alias("multiplier"))


def corrected(c: Column, fixes: dict[str, str]) -> Column:
    """Whole words replaced, whatever their case, in the table's order."""
    for wrong, right in fixes.items():
        c = F.regexp_replace(c, rf"(?i)(?<![\p{{L}}\p{{N}}])\Q{wrong}\E(?![\p{{L}}\p{{N}}])", right.replace("$", r"\$"))
    return c


def row_text(columns: list[str], separator: str = " | ") -> Column:
    """name=value of each column that has a value."""
    parts = F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns])
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), separator)


def code_and_name(c: Column) -> Column:
    """A line's leading account code, and the rest."""
    code = F.regexp_extract(c, r"^\s*(\d{2,3}(?:\.\d+)?)\s", 1)
    return F.struct(F.nullif(code, F.lit("")).alias("code"), F.trim(F.regexp_replace(c, r"^\s*\d{2,3}(?:\.\d+)?\s+", "")).alias("name"))


def company_line(c: Column, lines: int = 20) -> Column:
    """Of the first lines the one that most looks like a company's name, the longer of equals; the first line if none does."""
    head = F.filter(F.transform(F.slice(F.split(c, "\n"), 1, lines), squeezed), lambda x: x != "")
    has = lambda x, words: F.greatest(*[x.contains(w).cast("int") for w in words])

    def score(x: Column) -> Column:
        low = F.lower(x)
        return 2 * has(low, ("công ty", "cong ty")) + 2 * has(low, ("bảo hiểm", "bao hiem")) + has(low, ("tổng", "tong"))

    scored = F.transform(head, lambda x, i: F.struct(score(x).alias("score"), F.length(x).alias("size"), (-i).alias("at"), x.alias("line")))
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))
    return F.coalesce(best["line"], F.get(head, F.lit(0)))


def is_ascii_table(c: Column) -> Column:
    lines = F.split(c, "\n")
    return F.size(F.filter(lines, lambda x: x.contains("|"))) >= F.greatest(F.lit(6), F.floor(F.size(lines) / 4))
