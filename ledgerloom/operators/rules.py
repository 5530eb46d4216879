"""Matching against small configuration tables: file rules, aliases, sidecars, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule (pattern, value) whose pattern is found."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def alias(code: Column, table: dict[str, str]) -> Column:
    """The code that an alias stands for, or the code itself."""
    if not table:
        return code
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(known[code], code)


def with_sidecar(files: DataFrame, metas: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Files with their sidecar's fields, which win over the file's own of the same name."""
    side = metas.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = files.join(side, key, "left")
    own = {f: F.coalesce(f"__{f}", f) if f in files.columns else F.col(f"__{f}") for f in fields}
    return joined.select(*[F.col(c) for c in files.columns if c not in fields], *[c.alias(f) for f, c in own.items()])


def similarity(a: Column, b: Column) -> Column:
    """100 for equal texts, less by the edit distance's share of the longer one."""
    return F.round(100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))), 4)


def _edits(size: Column, least: float) -> Column:
    """The most edits between a text of this length and any that is similar enough."""
    return (F.ceil(size * ((100 - least) / least)) - 1).cast("int")


def _pieces(size: Column, least: float) -> tuple[Column, Column, Column]:
    """How many pieces an entry of this length is cut into, one more than the edits; their length, and how many at the end are longer by one."""
    n = F.greatest(_edits(size, least) + 1, F.lit(1))
    return n, (size / n).cast("int"), size % n


def _piece(i: Column, size: Column, least: float) -> tuple[Column, Column]:
    """Start and length of the i-th piece."""
    n, short, longer = _pieces(size, least)
    return i * short + F.greatest(i - (n - longer), F.lit(0)), short + (i >= n - longer).cast("int")


def fuzzy_match(words: DataFrame, dictionary: DataFrame, least: float = 85.0) -> DataFrame:
    """Each word with the dictionary's most similar entry, if over `least`; else itself. Ties go to the first in order.

    An entry that so few edits lead to from a word has one of its pieces in the word as it is, hardly moved: entries are
    indexed by length and pieces, and words look up their substrings of these lengths there. So both sides meet in an
    equi-join, whatever the size of the dictionary, and only pairs that share a piece are compared.
    """
    n = lambda c: F.length(c)
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    def own(i: Column) -> Column:
        start, size = _piece(i, n("entry"), least)
        return F.struct(n("entry").alias("size"), i.alias("piece"), F.substr("entry", start + 1, size).alias("part"))

    def sought(size: Column) -> Column:
        def of_piece(i: Column) -> Column:
            start, length = _piece(i, size, least)
            shift = F.greatest(_edits(size, least), F.lit(0))
            places = upto(F.greatest(start - shift, F.lit(0)), F.least(n("word") - length, start + shift))
            return F.transform(places, lambda at: F.struct(size.alias("size"), i.alias("piece"), F.substr("word", at + 1, length).alias("part")))

        return F.flatten(F.transform(F.sequence(F.lit(0), _pieces(size, least)[0] - 1), of_piece))

    entries = dictionary.select("entry").where("entry <> ''").distinct()
    index = entries.select("entry", F.explode(F.transform(F.sequence(F.lit(0), _pieces(n("entry"), least)[0] - 1), own)).alias("__key"))
    distinct = words.select("word").where("word <> ''").distinct()
    sizes = F.sequence(F.ceil(n("word") * (least / 100)).cast("int"), F.floor(n("word") * (100 / least)).cast("int"))
    asked = distinct.select("word", F.explode(F.array_distinct(F.flatten(F.transform(sizes, sought)))).alias("__key"))
    met = asked.join(index, "__key").select("word", "entry").distinct().withColumn("score", similarity(F.col("word"), F.col("entry"))).where(F.col("score") > least)
    best = met.withColumn("__at", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "entry"))).where("__at = 1").select("word", F.col("entry").alias("matched"), "score")
    return words.join(best, "word", "left").withColumn("matched", F.coalesce("matched", "word"))


def advanced_clean(docs: DataFrame, keys: list[str], text: str, corrections: dict[str, str], least: float = 85.0) -> DataFrame:
    """keys, text in lower case with the corrections made and each word set to the most similar right form, and the unknown words.

    A word with letters that no right form is similar to stays, and is listed in `unknown`.
    """
    low = F.lower(F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    for wrong, right in corrections.items():
        low = F.replace(low, F.lit(wrong.lower()), F.lit(right)) if wrong else low
    each = docs.select(*keys, F.posexplode(F.split(low, " ")).alias("__at", "word"))
    forms = docs.sparkSession.createDataFrame([(x,) for x in sorted(set(corrections.values()))], "entry string")
    known = fuzzy_match(each.where(F.col("word").rlike(r"\p{L}")).select("word").distinct(), forms, least).select("word", "matched", "score")
    done = each.join(known, "word", "left").withColumn("__out", F.coalesce("matched", "word"))
    unknown = F.col("word").rlike(r"\p{L}") & F.col("score").isNull()
    ordered = F.array_sort(F.collect_list(F.struct("__at", "__out", F.when(unknown, F.col("word")).alias("__unknown"))))
    out = done.groupBy(*keys).agg(ordered.alias("__words"))
    return out.select(*keys, F.array_join(F.transform("__words", lambda w: w["__out"]), " ").alias(text), F.array_compact(F.transform("__words", lambda w: w["__unknown"])).alias("unknown"))


def rule_record(path: Column, text: Column, rules: dict) -> Column:
    """A struct of the fields of a rule file: the first rule whose `match` the file's name has, else the first whose `text_match` the text has, over the defaults."""
    defaults, files = rules.get("defaults") or {}, rules.get("files") or []
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    own = lambda rule: {k: v for k, v in rule.items() if k not in ("match", "text_match")}
    fields = list(dict.fromkeys([*defaults, *(k for rule in files for k in own(rule))]))
    chain = [(name.rlike(f"(?i){r['match']}"), own(r)) for r in files if r.get("match")]
    chain += [(F.coalesce(text.rlike(f"(?i){r['text_match']}"), F.lit(False)), own(r)) for r in files if r.get("text_match")]
    columns = []
    for field in fields:
        out = F.lit(defaults.get(field)).cast("string")
        for condition, found in reversed(chain):
            out = F.when(condition, F.lit(found.get(field, defaults.get(field))).cast("string")).otherwise(out)
        columns.append(out.alias(field))
    return F.struct(*columns)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("__at", F.row_number().over(by)).where("__at = 1").drop("__at")


def unchanged_skipped(new: DataFrame, old: DataFrame, key: str, text: str) -> DataFrame:
    """New rows whose key and content hash aren't known yet."""
    hashed = new.withColumn("sha1", F.sha1(text))
    return hashed.join(old.select(key, "sha1"), [key, "sha1"], "left_anti")
