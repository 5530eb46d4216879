"""Cells and tokens of recognised tables: what they look like, and how they are cleaned."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.binding import bound
from ledgerloom.functions.numbers import WHOLE
from ledgerloom.functions.text import squeezed, strip_accents, strip_single_marks

GROUPED = r"\d{1,3}(?:\.\d{3})+"
#: What headers and noise lines of statements hold.
HEADER_WORDS = r"(?i)Công\s*ty|BẢNG\s*CÂN|BANG\s*CAN|ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}|Đơn\s*vị\s*tính|Don\s*vi\s*tinh|Thuyết|fninh"
NOISE_LINE = r"(?i)^[^\p{L}\p{N}]{1,4}$|^(?:he|y|m|per|\$f|~)$"
#: Labels whose accents recognition loses.
LABEL_FIXES = {
    "tai bao hiem": "tái bảo hiểm", "hoa hong": "hoa hồng", "phai thu": "phải thu", "bao hiem": "bảo hiểm", "chi phi": "chi phí", "tien": "tiền", "thue": "thuế", "du phong": "dự phòng",
    "hang ton kho": "hàng tồn kho", "ngan han": "ngắn hạn", "dau tu": "đầu tư", "nam giu": "nắm giữ", "dao han": "đáo hạn", "iv.": "IV.", "vi.": "VI.", "v.": "V.", "iii.": "III.", "ii.": "II.", "i.": "I.",
}


def is_amount(c: Column) -> Column:
    """Whether a text holds an amount of at least three groups of digits."""
    return c.rlike(r"\d{1,3}(?:[.,]\d{3}){2,}(?:\s|$)")


def is_new_code(c: Column) -> Column:
    """Whether a line is an account code or a numeral up to five and nothing else."""
    return c.rlike(r"^\s*\d{3}(?:\.\d+)?\s*$") | c.rlike(r"(?i)^\s*(?:I|II|III|IV|V)\.?\s*$")


def is_code(c: Column, kind: str = "account") -> Column:
    """account: three digits, one dotted part. deep: two or three digits, any dotted parts. plain: three digits alone."""
    return c.rlike({"account": r"^\d{3}(?:\.\d+)?$", "deep": r"^\d{2,3}(?:\.\d+)*$", "plain": r"^\d{3}$"}[kind])


def is_note(c: Column, kind: str = "short") -> Column:
    """short: one or two digits and a digit behind a dot. numeral: also roman numerals and more dotted parts."""
    return F.trim(c).rlike({"short": r"^\d{1,2}(?:\.\d)?$", "numeral": r"^(?:[IVXLC]+|\d{1,2}(?:\.\d+)*)$"}[kind])


def is_numeric_token(c: Column) -> Column:
    return F.trim(c).rlike(r"^\(?[+-]?\d[\d.,]*\)?$")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def is_money(c: Column, least: int = 6) -> Column:
    """Whether a cell has as many digits as an amount of money."""
    return F.coalesce(F.length(digits(c)) >= least, F.lit(False))


def is_money_code(c: Column) -> Column:
    """Whether what stands where a code should is an amount: over two dots, over six digits, or two groups of three among three."""
    parts = F.split(c, r"\.")
    threes = F.size(F.filter(parts, lambda p: F.length(p) == 3))
    return (F.size(parts) > 3) | (F.length(F.translate(c, ".", "")) > 6) | ((threes >= 2) & (F.size(parts) >= 3))


def is_header(c: Column) -> Column:
    return F.coalesce(c.rlike(HEADER_WORDS), F.lit(False))


def header_text(c: Column) -> Column:
    """Lines of a page's head that are text: neither noise of a few characters, nor table rows, nor amounts."""
    kept = F.filter(F.split(c, "\n"), lambda x: (F.length(F.trim(x)) > 2) & ~F.trim(x).rlike(NOISE_LINE) & ~x.contains("|") & ~x.rlike(GROUPED))
    return F.trim(F.array_join(kept, "\n"))


def letters_only(c: Column) -> Column:
    """Single-mark letters folded, all but letters and digits as spaces."""
    return squeezed(F.regexp_replace(strip_single_marks(c), r"[^a-z0-9\s]", " "))


def clean_token(c: Column) -> Column:
    """A token without the rules of the table that fell into it."""
    return squeezed(F.translate(F.coalesce(c, F.lit("")), "|¦·", "   "))


def literal_fixed(c: Column, fixes: dict[str, str] | None = None) -> Column:
    """Whole cells replaced, whatever their case: the numeral that is read as IL, unless other fixes are given."""
    for wrong, right in (fixes or {"IL": "II"}).items():
        c = F.when(F.upper(c) == wrong.upper(), right).otherwise(c)
    return c


def replaced_patterns(c: Column, patterns: Iterable[tuple[str, str]]) -> Column:
    """Patterns of a configuration replaced in order; its \\1 are groups. Empty patterns are passed over."""
    for pattern, by in patterns:
        if pattern:
            c = F.regexp_replace(c, pattern, F.lit(_groups(by)))
    return c


def _groups(by: str) -> str:
    out, at = "", 0
    while at < len(by):
        if by[at] == "\\" and by[at + 1 : at + 2].isdigit():
            out, at = f"{out}${by[at + 1]}", at + 2
        else:
            out, at = out + ("\\$" if by[at] == "$" else by[at]), at + 1
    return out


def line_name(line: Column, code: Column, note: Column, amounts: Column) -> Column:
    """What a statement line says besides its leading code, its amounts and its note."""
    quoted = lambda c: F.regexp_replace(c, r"([.()+])", r"\\$1")
    out = F.when(code.isNotNull(), F.regexp_replace(line, F.concat(F.lit(r"^\s*"), quoted(code), F.lit(r"\b\s*")), F.lit(""))).otherwise(line)
    out = F.aggregate(F.coalesce(amounts, F.array().cast("array<string>")), out, lambda s, a: F.when(a.isNull(), s).otherwise(F.replace(s, a, F.lit(" "))))
    out = F.when(note.isNotNull(), F.regexp_replace(out, F.concat(F.lit(r"(?<!\d)"), quoted(note), F.lit(r"(?!\d)")), F.lit(" "))).otherwise(out)
    return F.regexp_replace(squeezed(out), r"^[ \-:;|]+|[ \-:;|]+$", "")


def fixed_label(c: Column) -> Column:
    """A label with a capital first; where it holds words of LABEL_FIXES, all folded and these words with their accents back."""
    s = squeezed(F.coalesce(c, F.lit("")))
    s = F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))
    low = strip_accents(s, fold_d=True)
    hit, fixed = F.lit(False), low
    for plain, right in LABEL_FIXES.items():
        hit, fixed = hit | low.contains(plain), F.replace(fixed, F.lit(plain), F.lit(right))
    return F.when(hit, fixed).otherwise(s)


def joined_digits(c: Column) -> Column:
    """An amount whose separators are dropped and whose runs of digits are joined; null where a sign then stands inside."""
    runs = F.regexp_extract_all(F.translate(F.trim(c), ",.", ""), F.lit(r"-?\d+"), F.lit(0))
    text = F.array_join(runs, "")
    return F.when(text.rlike(r"^-?\d{1,38}$"), text).try_cast(WHOLE)


def money_token(c: Column, accept_small: bool = False) -> Column:
    """A token's digits with its sign, brackets as a minus; null below six digits, but for zero, unless accept_small."""
    t, least = F.trim(c), 1 if accept_small else 6
    enough = lambda x: (x == "0") | (F.length(x) >= least)

    def told(core: Column) -> Column:
        inner = F.translate(core, "-", "")
        bracketed = F.when((inner != "") & enough(inner), F.concat(F.lit("-"), inner))
        plain = F.when(core.rlike(r"^-*\d+$") & enough(F.ltrim(core, F.lit("-"))), core)
        return F.when(t.rlike(r"^\(.*\)$"), bracketed).otherwise(plain)

    return bound(F.regexp_replace(t, r"[^\d-]", ""), told)


def percent_token(c: Column) -> Column:
    """The first percentage as text: a decimal point, no dots between thousands."""
    s = F.translate(F.regexp_extract(c, r"\d[\d.,]*\s*%", 0), ", ", ".")
    number = F.regexp_replace(F.rtrim(s, F.lit("%")), r"(?<=\d)\.(?=\d{3}\b)", "")
    return F.when(number.rlike(r"^\d+(\.\d*)?$"), F.concat(number, F.lit("%")))


def _score(c: Column) -> list[Column]:
    return [(F.length(c) - F.length(F.translate(c, ".", ""))).alias("dots"), F.length(digits(c)).alias("digits")]


def best_number(c: Column) -> Column:
    """The group of digits with most dots, then most digits, then the first; null without any."""
    found = F.regexp_extract_all(c, F.lit(GROUPED), F.lit(0))
    return F.array_max(F.transform(found, lambda x, i: F.struct(*_score(x), (-i).alias("at"), x.alias("text"))))["text"]


def number_text(c: Column) -> Column:
    """The best group of a text, else its digits and dots; zero-like letters count as zeros."""
    return F.coalesce(best_number(c), F.regexp_replace(F.translate(c, "OoÔôUu", "000000"), r"[^0-9.]", ""))


def two_by_x(tokens: Column) -> Column:
    """left, right: the numbers of the two leftmost of tokens (text, left, width) that hold one; null with fewer than two."""
    held = F.filter(tokens, lambda t: t["text"].rlike(r"\d[\d.,]*"))
    placed = F.array_sort(F.transform(held, lambda t, i: F.struct((t["left"] + t["width"] / 2).alias("x"), i.alias("at"), t["text"].alias("text"))))
    number = lambda p, i: number_text(F.get(p, F.lit(i))["text"])
    return bound(placed, lambda p: F.when(F.size(p) >= 2, F.struct(number(p, 0).alias("left"), number(p, 1).alias("right"))))


def best_two_by_x(tokens: Column, first_split: Column, second_split: Column) -> Column:
    """left, right: of the three best groups right of the first split, the leftmost and the rightmost.

    One alone is the right one beyond the second split, else the left one. Of three whose outer two are equal, the
    pair that is farthest apart and differs, with the first of the left ones.
    """
    middle = lambda t: t["left"] + t["width"] / 2
    right_of = F.filter(tokens, lambda t: middle(t) > first_split - 6)
    groups = F.flatten(F.transform(right_of, lambda t: F.transform(F.regexp_extract_all(t["text"], F.lit(GROUPED), F.lit(0)), lambda g: F.struct(middle(t).alias("x"), g.alias("text")))))
    ranked = F.transform(groups, lambda g, i: F.struct(*[(-s).alias(n) for s, n in zip(_score(g["text"]), ("dots", "digits"), strict=True)], F.abs(g["x"] - first_split).alias("far"), i.alias("at"), g["x"].alias("x"), g["text"].alias("text")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(ranked), 1, 3), lambda g: F.struct(g["x"], g["text"])))
    pair = lambda a, b: F.struct(a.alias("left"), b.alias("right"))
    none = F.lit(None).cast("string")

    def chosen(top: Column) -> Column:
        at = lambda i: F.element_at(top, i)["text"]
        one = F.when(F.element_at(top, 1)["x"] > second_split, pair(none, at(1))).otherwise(pair(at(1), none))
        retried = F.when((F.size(top) >= 3) & (at(1) == at(-1)) & (at(1) != at(2)), pair(at(1), at(2))).otherwise(pair(at(1), at(-1)))
        return F.when(F.size(top) == 1, one).when(F.size(top) >= 2, retried)

    return bound(best, chosen)


def titled_columns(names: list[str]) -> str:
    return f"Tiêu đề cột: {', '.join(names)}"


def numbered_row(number: Column, names: list[str]) -> Column:
    """Dòng n: name = value, ... of the columns that have one."""
    cells = F.array(*[F.when(F.trim(F.col(n).cast("string")) != "", F.concat(F.lit(f"{n} = "), F.col(n).cast("string"))) for n in names])
    return F.concat(F.lit("Dòng "), number.cast("string"), F.lit(": "), F.array_join(F.filter(cells, lambda x: x.isNotNull()), ", "))
