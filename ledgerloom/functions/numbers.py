"""Number parsing. The readers disagree on purpose: each follows the conventions of one kind of source.

All give null where a text is no number, and keep whole money amounts exact as decimal(38,0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"


def _last_dot(c: Column) -> Column:
    """Of several dots the last is the decimal point."""
    dots = F.length(c) - F.length(F.translate(c, ".", ""))
    at = F.length(c) - F.instr(F.reverse(c), ".") + 1
    whole = F.translate(F.substr(c, F.lit(1), at - 1), ".", "")
    return F.when(dots > 1, F.concat(whole, F.lit("."), F.substr(c, at + 1))).otherwise(c)


def _decimal_text(c: Column) -> Column:
    """Commas alone are decimal points, and several are no number; of dots alone the last is; both together are no number."""
    c = F.regexp_replace(c, r"\s", "")
    return F.when(~c.contains(","), _last_dot(c)).when(~c.contains("."), F.translate(c, ",", ".")).otherwise(c)


def loose(c: Column) -> Column:
    """Spaces dropped; commas alone are decimal; of several dots the last is."""
    return _double(_decimal_text(c))


def stripped(c: Column) -> Column:
    """As loose, after all but digits, signs and separators is dropped."""
    return _double(_decimal_text(F.regexp_replace(c, r"[^0-9.,+-]", "")))


def comma_decimal(c: Column) -> Column:
    """Commas are dots, and the last dot is decimal."""
    return _double(_last_dot(F.translate(F.regexp_replace(c, r"[^0-9.,+-]", ""), ",", ".")))


def separators_dropped(c: Column) -> Column:
    """Dots and commas never count."""
    return _whole(F.regexp_replace(c, r"[.,\s]", ""))


def _double(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), c).try_cast("double")


def _whole(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?\d{1,38}$"), c).try_cast(WHOLE)


def _bracketed(c: Column) -> Column:
    return F.trim(c).rlike(r"^\(.*\)$|^-")


def _signed(digits: Column, negative: Column) -> Column:
    """A text of digits only as a number: the sign goes into the text, so that both are worked out once."""
    return F.concat(F.when(negative, "-").otherwise(""), digits).try_cast(WHOLE)


def recognised(c: Column, multiplier: int = 1) -> Column:
    """Letters that look like digits are; brackets are a minus; all separators are dropped; times the unit."""
    digits = F.regexp_replace(F.translate(c, "OoIl", "0011"), r"[^0-9]", "")
    return (_signed(digits, _bracketed(c)) * F.lit(multiplier).cast(WHOLE)).cast(WHOLE)


def recognised_wide(c: Column) -> Column:
    """More look-alikes; quotes dropped; all separators dropped."""
    digits = F.regexp_replace(F.translate(c, "Il|¡OoS£B'\"", "111100558"), r"[^0-9]", "")
    return _signed(digits, _bracketed(c))


def first_group(c: Column) -> Column:
    """The first run of digits and separators, its separators dropped."""
    fixed = F.translate(c, "OoIl", "0011")
    return _signed(F.regexp_replace(F.regexp_extract(fixed, r"\d[\d.,]*", 0), r"[.,]", ""), _bracketed(c))


def grouped(c: Column) -> Column:
    """A whole number with dots between thousands, null as an empty text."""
    return F.coalesce(F.translate(F.format_number(c.cast(WHOLE), 0), ",", "."), F.lit(""))


def money_text(c: Column, least: int = 6) -> Column:
    """Digits of an amount of at least `least` digits, grouped; else an empty text."""
    digits = F.regexp_replace(F.translate(c, "OolIB", "00118"), r"[^0-9]", "")
    return F.when(F.length(digits) < least, "").otherwise(grouped(digits.try_cast(WHOLE)))


def digits_only(c: Column) -> Column:
    """All digits as one number, zero without any; the sign is lost (N9, of which long amounts no longer fail)."""
    return F.coalesce(F.regexp_replace(c, r"[^0-9]", "").try_cast(WHOLE), F.lit(0).cast(WHOLE))


def look_alikes(c: Column, drop_dots: bool = False) -> Column:
    """O, Ô and U as zero, other characters dropped; dots stay unless drop_dots."""
    return F.regexp_replace(F.translate(F.upper(c), "OÔU", "000"), r"[^0-9]" if drop_dots else r"[^0-9.]", "")


def amount_tokens(c: Column, least: int = 7) -> Column:
    """Tokens of digits and separators with at least `least` digits."""
    tokens = F.regexp_extract_all(c, F.lit(r"\(?-?\d[\d.,]*\)?"), F.lit(0))
    return F.filter(tokens, lambda t: F.length(F.regexp_replace(t, r"[^0-9]", "")) >= least)


def percent(c: Column) -> Column:
    """12,5% as 0.125; null without a percent sign."""
    text = F.translate(F.regexp_extract(c, r"(-?\d+(?:[.,]\d+)?)\s*%", 1), ",", ".")
    return F.nullif(text, F.lit("")).try_cast("double") / 100


def note(c: Column) -> Column:
    """The first token of one or two digits."""
    return F.nullif(F.regexp_extract(c, r"(?:^|\s)(\d{1,2})(?:\s|$)", 1), F.lit(""))


def two_largest(c: Column) -> Column:
    """The two tokens with most digits, the earlier of equals, in the order of the text (T4)."""
    tokens = F.regexp_extract_all(c, F.lit(r"\d[\d.,]*"), F.lit(0))
    ranked = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.length(F.regexp_replace(t, r"[^0-9]", ""))).alias("digits"), i.alias("at"), t.alias("token"))))
    return F.transform(F.array_sort(F.transform(F.slice(ranked, 1, 2), lambda s: F.struct(s["at"], s["token"]))), lambda s: s["token"])
