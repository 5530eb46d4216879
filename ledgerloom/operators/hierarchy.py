"""Account hierarchies and balance checks: parents against the signed sums of their children, and their repair.

Rules are a small table (rule_id, parent, child, sign); values are rows (entity keys, code, one column a period).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.binding import bound

#: The balance sheet's and income statement's equations, parent = signed children.
BALANCE_RULES = {
    "110": "111 112", "130": "131 132 133 134 135 136 137 138 -139", "140": "141", "150": "151 152", "151": "151.1 151.2", "190": "191 192",
    "100": "110 120 130 140 150 190", "210": "211 212 213 214 215 216", "220": "221 222 223 224 225", "240": "241 242 243", "250": "251 252",
    "260": "261 262 263", "200": "210 220 240 250 260", "270": "100 200", "329": "329.1 329.2 329.3", "300": "310 320 329 330", "400": "410 420", "440": "300 400",
}
INCOME_RULES = {"25": "23 -24", "30": "19 25 -26", "40": "31 -32", "50": "30 40", "60": "50 -51 -52"}


def rule_edges(spark: SparkSession, rules: dict[str, str]) -> DataFrame:
    """One row for each child of a rule: rule_id, parent, child, sign."""
    rows = [(f"{p}={c}", p, x.lstrip("+-"), -1 if x[0] == "-" else 1) for p, c in rules.items() for x in c.split()]
    return spark.createDataFrame(rows, "rule_id string, parent string, child string, sign int")


def formula_rules(formulas: list[str]) -> dict[str, str]:
    """Rules of formulas such as "A = B + C - D"."""
    out = {}
    for formula in formulas:
        left, right = formula.split("=")
        out[left.strip()] = " ".join(right.replace("+", " ").replace("- ", "-").split())
    return out


def dotted_parent(code: Column) -> Column:
    """131.1 belongs to 131; a code without a dot to none."""
    return F.nullif(F.regexp_extract(code, r"^(.*)\.[^.]*$", 1), F.lit(""))


def dynamic_edges(codes: DataFrame) -> DataFrame:
    """parent, child of direct children: X00 of X10..X90, XY0 of XY1..XY9, a.b of a. Equi-joins only: each code names its parent."""
    code = F.col("code")
    three, last = code.rlike(r"^\d{3}$"), F.right(code, F.lit(1))
    parent = F.coalesce(
        dotted_parent(code),
        F.when(three & (last != "0"), F.concat(F.left(code, F.lit(2)), F.lit("0"))),
        F.when(three & (last == "0") & (F.substring(code, 2, 1) != "0"), F.concat(F.left(code, F.lit(1)), F.lit("00"))),
    )
    children = codes.select(code.alias("child"), parent.alias("parent")).where("parent is not null").distinct()
    return children.join(codes.select(code.alias("parent")).distinct(), "parent").select("parent", "child")


def code_prefixes(code: Column) -> Column:
    """131.1.2 as [131, 131.1, 131.1.2], so that prefix joins are equi-joins."""
    parts = F.split(code, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return F.when(F.contains(code, F.lit(".")), every).otherwise(F.array(code))


def family(parents: DataFrame) -> DataFrame:
    """code with parent_code and the array of its children's codes: each code is grouped with the codes that name it, in one shuffle."""
    code = F.col("code")
    told = F.explode(F.array(F.struct(code.alias("code"), dotted_parent(code).alias("parent_code"), F.lit(None).cast("string").alias("child")), F.struct(dotted_parent(code).alias("code"), F.lit(None).cast("string").alias("parent_code"), code.alias("child"))))
    each = parents.select(told.alias("x")).select("x.*").where("code is not null")
    found = each.groupBy("code").agg(F.count_if(F.col("child").isNull()).alias("__n"), F.max("parent_code").alias("parent_code"), F.array_sort(F.collect_set("child")).alias("children_codes"))
    return found.where("__n > 0").drop("__n")


def bounded(config: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of configuration, to be broadcast if it is counted to have no more than `most` rows; else Spark shuffles it."""
    return F.broadcast(config) if config.limit(most + 1).count() <= most else config


def tree_key(code: Column) -> Column:
    """Texts that sort codes in tree order: a code stands before all that belongs to it, and that before any other code."""
    return F.translate(code, ".", "\u0001")


def gathered(values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each entity: keys, and its rows in tree order as `lines` of code, n, names and v0, v1 ... for the columns.

    names are the codes that a row stands for: its own, and those to which it belongs as long as they aren't there
    themselves. In tree order what belongs to a code is one interval behind it, so a fold over the sorted rows knows the
    nearest code above from those still open: nothing is joined. Rows that agree in code and values are counted (n)
    before an entity's are brought together, so a task holds an entity's distinct rows: those of one statement. Rows
    without a code are left out.
    """
    kinds = dict(values.dtypes)
    named = [F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]
    fields = ["code", *[f"v{i}" for i in range(len(columns))]]
    counted = values.where("code is not null").select(*keys, "code", *named).groupBy(*keys, *fields).agg(F.count(F.lit(1)).alias("n"))
    together = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(tree_key(F.col("code")).alias("key"), *fields, "n"))).alias("lines"))
    out = ", ".join(["code: string", "n: bigint", "names: array<string>", *[f"v{i}: {kinds[c]}" for i, c in enumerate(columns)]])

    def line(x: Column, names: Column) -> Column:
        return F.struct(x["code"].alias("code"), x["n"].alias("n"), names.alias("names"), *[x[f"v{i}"].alias(f"v{i}") for i in range(len(columns))])

    def step(done: Column, x: Column) -> Column:
        open_ = F.filter(done["path"], lambda p: F.startswith(x["key"], F.concat(p, F.lit("\u0001"))))
        above = F.coalesce(F.length(F.try_element_at(open_, F.lit(-1))), F.lit(0))
        names = F.filter(code_prefixes(x["code"]), lambda p: F.length(p) > above)
        return F.struct(F.array_append(open_, x["key"]).alias("path"), F.array_append(done["out"], line(x, names)).alias("out"))

    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast(f"array<struct<{out}>>").alias("out"))
    tree = F.exists("lines", lambda x: F.contains(x["code"], F.lit(".")))
    return together.withColumn("lines", F.when(tree, F.aggregate("lines", start, step, lambda done: done["out"])).otherwise(F.transform("lines", lambda x: line(x, F.array(x["code"])))))


def parts_of(values: DataFrame, edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, child, parent, sign, amount: each rule's child with what is it or belongs to it: 131.1 belongs to 131 where no code in between is there.

    So an absent child is given by its topmost parts, and a present one by itself alone. amount is null where the row's is.
    """
    line = gathered(values, keys, [value]).select(*keys, F.explode_outer("lines").alias("__x"))
    each = line.select(*keys, F.explode("__x.names").alias("child"), (F.col("__x.v0") * F.col("__x.n")).alias("amount"))
    return each.join(bounded(edges), "child")


def signed_rollup(values: DataFrame, edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of sign * value of each parent's children, nulls as 0: keys, parent, children_sum, n_children. Absent children are given by their parts."""
    met = parts_of(values, edges, keys, value)
    return met.groupBy(*keys, "parent").agg(F.sum(F.col("sign") * F.coalesce(F.col("amount"), F.lit(0))).alias("children_sum"), F.count_distinct("child").alias("n_children"))


def within(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Whether two amounts agree; null where one is missing counts as no."""
    near = (F.abs(a - b) <= absolute) | ((a != 0) & (F.abs((a - b) / a) <= relative))
    return F.coalesce(near, F.lit(False))


def checked_totals(values: DataFrame, edges: DataFrame, keys: list[str], value: str, absolute: float = 1.0, relative: float = 0.005) -> DataFrame:
    """Each parent that has children with their sum, the difference, and whether they agree; a parent that is there more than once is checked each time."""
    line = gathered(values, keys, [value]).select(*keys, F.explode_outer("lines").alias("__x"))
    part = lambda p: F.struct(p.alias("child"), (F.col("__x.v0") * F.col("__x.n")).alias("amount"), F.lit(0).cast("long").alias("own"))
    itself = F.struct(F.col("__x.code").alias("child"), F.col("__x.v0").alias("amount"), F.col("__x.n").alias("own"))
    each = line.select(*keys, F.explode(F.array_append(F.transform("__x.names", part), itself)).alias("__p")).select(*keys, "__p.*")
    rules = bounded(edges.select(F.col("child").alias("__child"), F.col("parent").alias("__parent"), "sign"))
    met = each.join(rules, (F.col("child") == F.col("__child")) & (F.col("own") == 0), "left").where("own > 0 or __child is not null").withColumn("parent", F.coalesce("__parent", "child"))
    found = met.groupBy(*keys, "parent").agg(
        F.sum(F.col("sign") * F.coalesce(F.col("amount"), F.lit(0))).alias("children_sum"), F.count_distinct("__child").alias("n_children"),
        F.collect_list(F.when(F.col("own") > 0, F.struct(F.col("amount").alias("observed"), "own"))).alias("__own"),
    )
    rows = found.where("n_children > 0").select(*keys, "parent", "children_sum", "n_children", F.explode("__own").alias("__o")).select("*", "__o.observed", F.explode(F.sequence(F.lit(1).cast("long"), "__o.own"))).drop("__o", "__own", "col")
    return rows.withColumn("diff", F.col("observed") - F.col("children_sum")).withColumn("ok", within(F.col("observed"), F.col("children_sum"), absolute, relative))


def complete_rules(values: DataFrame, edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rules of which all children are present themselves (a relational division), with their sums."""
    sizes = edges.groupBy("rule_id", "parent").agg(F.count(F.lit(1)).alias("size"))
    met = values.join(bounded(edges), values["code"] == edges["child"]).groupBy(*keys, "rule_id", "parent").agg(F.sum(F.col("sign") * F.col(value)).alias("children_sum"), F.count_distinct("child").alias("met"))
    return met.join(bounded(sizes), ["rule_id", "parent"]).where("met = size").drop("met", "size")


def formula_checks(values: DataFrame, edges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each entity's formulas: the left side, the right side with absent codes as 0, and a finding: ok, differs, or missing where the left side is absent.

    Each row tells the rules that it is part of, so an entity's rules are summed and brought together without joins of rows.
    """
    rules = edges.select("rule_id", "parent").distinct()
    roles = edges.select("rule_id", F.col("child").alias("code"), "sign").unionByName(rules.select("rule_id", F.col("parent").alias("code"), F.lit(None).cast("int").alias("sign")))
    met = values.select(*keys, "code", value).join(bounded(roles.groupBy("code").agg(F.collect_list(F.struct("rule_id", "sign")).alias("__roles"))), "code", "left")
    each = met.select(*keys, F.col(value).alias("__value"), F.explode_outer("__roles").alias("__r")).select(*keys, "__value", "__r.*")
    part, whole = F.when(F.col("sign").isNotNull(), F.col("sign") * F.coalesce("__value", F.lit(0))), F.when(F.col("rule_id").isNotNull() & F.col("sign").isNull(), F.struct(F.col("__value").alias("left_side")))
    sums = each.groupBy(*keys, "rule_id").agg(F.coalesce(F.sum(part), F.lit(0)).alias("right_side"), F.collect_list(whole).alias("left"))
    told = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("rule_id").isNotNull(), F.struct("rule_id", F.struct("right_side", "left"))))).alias("__told"))
    found = told.join(bounded(rules)).withColumn("__x", F.try_element_at("__told", "rule_id")).select(*keys, "rule_id", "parent", F.coalesce("__x.right_side", F.lit(0)).alias("right_side"), F.explode_outer("__x.left").alias("__l"))
    finding = F.when(F.col("__l").isNull(), "missing").when(F.col("__l.left_side").eqNullSafe(F.col("right_side")), "ok").otherwise("differs")
    return found.select(*keys, "rule_id", "parent", F.col("__l.left_side").alias("left_side"), "right_side", finding.alias("finding"))


def named_rule_checks(values: DataFrame, rules: dict[str, list[str]], keys: list[str], name: str, value: str) -> DataFrame:
    """The same for rules between names, in lower case, of statements without codes: parents of which all parts are present, and their sums."""
    spark = values.sparkSession
    edges = spark.createDataFrame([(p.lower(), p.lower(), c.lower(), 1) for p, parts in rules.items() for c in parts], "rule_id string, parent string, child string, sign int")
    named = values.select(*keys, F.lower(name).alias("code"), value)
    sums = complete_rules(named, edges, keys, value).drop("rule_id")
    found = sums.join(named.select(*keys, F.col("code").alias("parent"), F.col(value).alias("observed")), [*keys, "parent"])
    return found.withColumn("ok", F.col("observed").eqNullSafe(F.col("children_sum")))


def missing_children(values: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, parent, code: children that a present parent's rule names and of which the entity has neither the code nor a part.

    What is there and what is asked for meet in one aggregation: each row tells its codes, and what its rule asks for.
    """
    none = F.lit(None).cast("string")
    rules = bounded(edges.groupBy(F.col("parent").alias("code")).agg(F.collect_list("child").alias("__children")))
    told = values.where("code is not null").select(*keys, "code").join(rules, "code", "left")
    there = F.transform(code_prefixes(F.col("code")), lambda c: F.struct(c.alias("code"), none.alias("parent")))
    asked = F.transform(F.coalesce("__children", F.array().cast("array<string>")), lambda c: F.struct(c.alias("code"), F.col("code").alias("parent")))
    met = told.select(*keys, F.explode(F.concat(there, asked)).alias("__x")).select(*keys, "__x.*")
    found = met.groupBy(*keys, "code").agg(F.count_if(F.col("parent").isNull()).alias("__n"), F.collect_list("parent").alias("__parents"))
    return found.where("__n = 0").select(*keys, F.explode("__parents").alias("parent"), "code")


def variant_children(codes: DataFrame, legacy: bool = False) -> DataFrame:
    """parent, child: X00 of X10..X90 and XY0 of XY1..XY9, whichever are there, and a of all a.b; legacy also gives X00 every code of its hundred."""
    code = F.col("child")
    rows = codes.select(code.alias("child") if "child" in codes.columns else F.col("code").alias("child")).distinct()
    three = code.rlike(r"^\d{3}$")
    tens, hundreds = F.concat(F.left(code, F.lit(2)), F.lit("0")), F.concat(F.left(code, F.lit(1)), F.lit("00"))
    options = [F.when(three & (F.right(code, F.lit(1)) != "0"), tens), F.when(three & (F.substring(code, 2, 1) != "0") & (F.lit(legacy) | (F.right(code, F.lit(1)) == "0")), hundreds)]
    prefixes = code_prefixes(code)
    every = F.concat(F.array_compact(F.array(*options)), F.slice(prefixes, F.lit(1), F.size(prefixes) - 1))
    return rows.select(F.explode(every).alias("parent"), "child").join(rows.select(F.col("child").alias("parent")), "parent", "left_semi").select("parent", "child").distinct()


def merged_rules(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """parent, child, sign, origin of all rules that hold: static where the configuration has them, dynamic where only the codes show them.

    A parent of the configuration keeps its signed children, and those found beside them are new; any other parent has
    the children found, all added.
    """
    fixed = edges.select("parent", "child", "sign", F.lit("static").alias("origin"))
    found = dynamic_edges(codes).join(fixed.select("parent", "child"), ["parent", "child"], "left_anti")
    configured = edges.select("parent").distinct().withColumn("__static", F.lit(True))
    named = found.join(bounded(configured), "parent", "left").select("parent", "child", F.lit(1).alias("sign"), F.when(F.col("__static"), "new").otherwise("dynamic").alias("origin"))
    return fixed.unionByName(named)


def new_children(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct children found in the data that no rule of their parent names."""
    return dynamic_edges(codes).join(edges.select("parent", "child").distinct(), ["parent", "child"], "left_anti")


def by_depth(rules: dict[str, str]) -> list[list[str]]:
    """Parents by depth, those without parents among their children first."""
    children = {p: [x.lstrip("+-") for x in c.split()] for p, c in rules.items()}
    depth: dict[str, int] = {}

    def of(code: str) -> int:
        if code not in depth:
            depth[code] = 1 + max((of(x) for x in children[code] if x in children), default=0)
        return depth[code]

    for p in children:
        of(p)
    return [[p for p in children if depth[p] == d] for d in sorted(set(depth.values()))]


def _rule_array(rules: dict[str, str]) -> Column:
    """The rules as one array, from the lowest level up: parent, its added and its subtracted children."""
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    signed = {p: [x if x[0] in "+-" else f"+{x}" for x in c.split()] for p, c in rules.items()}
    of = lambda p, sign: texts([x[1:] for x in signed[p] if x[0] == sign])
    return F.array(*[F.struct(F.lit(p).alias("parent"), of(p, "+").alias("plus"), of(p, "-").alias("minus")) for level in by_depth(rules) for p in level])


def _sum_kind(kind: str) -> str:
    """The type in which amounts of a type are summed."""
    return f"decimal(38,{kind[:-1].split(',')[1]})" if kind.startswith("decimal") else "double" if kind in ("double", "float") else "bigint"


def _repaired_lines(lines: Column, rules: dict[str, str], kinds: list[str], absolute: float, relative: float) -> Column:
    """lines, as gathered has them, with totals that disagree set to their children's sums, one rule after the other."""

    def repair(now: Column, rule: Column) -> Column:
        weight = lambda x: F.size(F.array_intersect(x["names"], rule["plus"])) - F.size(F.array_intersect(x["names"], rule["minus"]))

        def summed(parts: Column, i: int, kind: str) -> Column:
            amount = lambda x: (F.coalesce(x[f"v{i}"], F.lit(0)).cast(_sum_kind(kind)) * x["n"] * weight(x)).cast(_sum_kind(kind))
            return F.aggregate(parts, F.lit(0).cast(_sum_kind(kind)), lambda t, x: (t + amount(x)).cast(_sum_kind(kind)))

        def as_told(sums: Column) -> Column:
            def line(x: Column) -> Column:
                of = lambda i: F.when(~within(x[f"v{i}"], sums[f"s{i}"], absolute, relative), sums[f"s{i}"].cast(kinds[i])).otherwise(x[f"v{i}"])
                told = F.struct(x["code"].alias("code"), x["n"].alias("n"), x["names"].alias("names"), *[of(i).alias(f"v{i}") for i in range(len(kinds))])
                return F.when(x["code"] == rule["parent"], told).otherwise(x)

            return F.transform(now, line)

        def with_parts(parts: Column) -> Column:
            sums = F.struct(*[summed(parts, i, k).alias(f"s{i}") for i, k in enumerate(kinds)])
            return F.when(F.size(parts) > 0, bound(sums, as_told)).otherwise(now)

        parts = F.filter(now, lambda x: F.arrays_overlap(x["names"], rule["plus"]) | F.arrays_overlap(x["names"], rule["minus"]))
        return F.when(F.exists(now, lambda x: x["code"] == rule["parent"]), bound(parts, with_parts)).otherwise(now)

    return F.aggregate(_rule_array(rules), lines, repair)


def repaired_columns(values: DataFrame, rules: dict[str, str], keys: list[str], columns: list[str], absolute: float = 1.0, relative: float = 0.005) -> DataFrame:
    """keys, code, and for each column an array of two: its value after the repair, and what was there.

    The rules are folded over an entity's rows from the lowest level up, so there are two shuffles whatever their depth,
    and whatever the number of columns.
    """
    kinds = [dict(values.dtypes)[c] for c in columns]
    both = gathered(values, keys, columns).withColumn("now", _repaired_lines(F.col("lines"), rules, kinds, absolute, relative))
    rows = both.select(*keys, F.explode_outer(F.arrays_zip("now", "lines")).alias("__x")).select(*keys, "__x.*", F.explode(F.sequence(F.lit(1).cast("long"), "__x.lines.n")))
    told = rows.select(*keys, "lines.code", *[F.array(F.col(f"now.v{i}"), F.col(f"lines.v{i}")).alias(c) for i, c in enumerate(columns)])
    uncoded = values.where("code is null").select(*keys, "code", *[F.array(F.col(c), F.col(c)).alias(c) for c in columns])
    return told.unionByName(uncoded) if "code" in values.columns and values.schema["code"].nullable else told


def repaired(values: DataFrame, rules: dict[str, str], keys: list[str], value: str, absolute: float = 1.0, relative: float = 0.005, dry_run: bool = False) -> DataFrame:
    """values with totals that disagree set to the sum of their children, from the lowest level up, and what was there before.

    A missing total is a disagreement. Each level sees the repairs of those below, and absent children are given by
    their parts. Rows without a code stay as they are, and rows that are there twice stay two. dry_run leaves the
    values, and gives the sums as `suggested` only.
    """
    now = repaired_columns(values, rules, keys, [value], absolute, relative)
    new, old = F.get(value, F.lit(0)), F.get(value, F.lit(1))
    changed = ~new.eqNullSafe(old)
    if dry_run:
        return now.select(*keys, "code", old.alias(value), F.when(changed, new).alias("suggested"))
    return now.select(*keys, "code", new.alias(value), old.alias("observed"), changed.alias("changed"))


def repair_audit(values: DataFrame, rules: dict[str, str], keys: list[str], columns: list[str], absolute: float = 1.0, relative: float = 0.005) -> DataFrame:
    """One row for each total that a repair changes: code, column, observed, suggested, children_used (signed, in the rule's order), status.

    All columns are repaired in one pass; they are given in one common type.
    """
    used = F.create_map(*[F.lit(x) for p, c in rules.items() for x in (p, ",".join(x if x[0] in "+-" else f"+{x}" for x in c.split()))])
    told = repaired_columns(values, rules, keys, columns, absolute, relative)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.get(c, F.lit(1)).alias("observed"), F.get(c, F.lit(0)).alias("suggested")) for c in columns]))
    rows = told.select(*keys, "code", each.alias("__x")).select(*keys, "code", "__x.*").where(~F.col("suggested").eqNullSafe(F.col("observed")))
    return rows.withColumn("children_used", F.element_at(used, F.col("code"))).withColumn("status", F.lit("mismatch"))


def current_and_noncurrent(values: DataFrame, keys: list[str], value: str, current: str = "100", noncurrent: str = "200", total: str = "270", absolute: float = 1.0, relative: float = 0.01) -> DataFrame:
    """For each entity with a total: the sum of current and noncurrent, and the total to keep: the sum where the total is missing or near it."""
    of = lambda code, name: F.max(F.when(F.col("code") == code, F.col(value))).alias(name)
    found = values.groupBy(*keys).agg(of(current, "current"), of(noncurrent, "noncurrent"), of(total, "observed"), F.count_if(F.col("code") == total).alias("__n"))
    both = F.coalesce("current", F.lit(0)) + F.coalesce("noncurrent", F.lit(0))
    kept = F.when((both != 0) & (F.col("observed").isNull() | within(F.col("observed"), both, absolute, relative)), both).otherwise(F.col("observed"))
    known = found.where("__n > 0 and (current is not null or noncurrent is not null)").drop("__n")
    return known.withColumn("total", kept).withColumn("changed", ~F.col("total").eqNullSafe(F.col("observed")))


def row_levels(rows: DataFrame) -> DataFrame:
    """is_total, is_subtotal and level of coded rows: a code with dotted descendants is a subtotal."""
    above = rows.select(F.explode(F.slice(code_prefixes(F.col("code")), F.lit(1), F.size(F.split("code", r"\.")) - 1)).alias("code")).distinct().withColumn("__above", F.lit(True))
    total = F.col("code").rlike(r"^\d00$") | F.lower("name").rlike("(?:^|[^a-z])(?:total|tong cong)")
    out = rows.join(above, "code", "left").withColumn("is_total", total).withColumn("is_subtotal", ~total & (F.col("__above").isNotNull() | F.col("code").rlike(r"^\d\d0$")))
    return out.drop("__above").withColumn("level", F.when(F.col("is_total"), "total").when(F.col("is_subtotal"), "subtotal").otherwise("leaf"))


def cross_check(left: DataFrame, right: DataFrame, keys: list[str], left_code: str, right_code: str, value: str, absolute: float = 1.0) -> DataFrame:
    """Whether a total of one statement equals a total of another, such as assets and sources of funds."""
    one = left.where(F.col("code") == left_code).select(*keys, F.col(value).alias("left_value"))
    two = right.where(F.col("code") == right_code).select(*keys, F.col(value).alias("right_value"))
    return one.join(two, keys, "full").withColumn("ok", within(F.col("left_value"), F.col("right_value"), absolute, 0.0))


def sign_checks(values: DataFrame, value: str, non_negative: list[str]) -> DataFrame:
    return values.where(F.col("code").isin(non_negative) & (F.col(value) < 0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
