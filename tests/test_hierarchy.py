"""Roll-ups, checks and repairs of code trees against plain loops over random trees."""

import random
import re

import pytest

from ledgerloom.operators import hierarchy

RULES = {"130": "131 -132 131.1", "100": "110 130 151", "151": "151.1 151.2", "270": "100 -200", "440": "270 300"}


def trees(seed):
    rng = random.Random(seed)
    codes = "100 110 130 131 131.1 131.1.2 131.1.2.3 131.2 1311 132 132.5 151 151.1 151.2 151.2.7 200 200.1 270 300 440 999".split()
    rows = []
    for e in [*range(12), None]:
        for c in rng.sample(codes, rng.randint(0, len(codes))):
            rows += [(e, c, rng.choice([None, 1, 5, 70, 1000, 100000]))] * rng.choice([1, 1, 1, 2])
            if rng.random() < 0.1:
                rows.append((e, c, 33))
    return [*rows, (3, None, 8)]


def below(code, child):
    return code == child or code.startswith(child + ".")


def taken(rows, child):
    """Rows of an entity that give a child: none whose code belongs to another that is the child or a part of it too."""
    codes = {c for c, _ in rows if c}
    return [i for i, (c, _) in enumerate(rows) if c and below(c, child) and not any(below(x, child) and x != c and below(c, x) for x in codes)]


def brute_sums(rows, rules):
    out = {}
    for parent, children in rules.items():
        total, met = 0, 0
        for x in children.split():
            got = taken(rows, x.lstrip("-"))
            total, met = total + (-1 if x[0] == "-" else 1) * sum(rows[i][1] or 0 for i in got), met + bool(got)
        if met:
            out[parent] = (total, met)
    return out


def near(a, b):
    return a is not None and (abs(a - b) <= 1 or (a != 0 and abs((a - b) / a) <= 0.005))


def entities(rows):
    return {e: [(c, v) for x, c, v in rows if x == e] for e in {r[0] for r in rows}}


def frame(spark, rows):
    return spark.createDataFrame(rows, "e int, code string, v long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_trees(spark, seed):
    rows = trees(seed)
    edges = hierarchy.rule_edges(spark, RULES)
    got = sorted(map(str, hierarchy.signed_rollup(frame(spark, rows), edges, ["e"], "v").select("e", "parent", "children_sum", "n_children").collect()))
    sums = {e: brute_sums(r, RULES) for e, r in entities(rows).items()}
    from pyspark.sql import Row

    assert got == sorted(str(Row(e=e, parent=p, children_sum=s, n_children=n)) for e, found in sums.items() for p, (s, n) in found.items())
    checked = hierarchy.checked_totals(frame(spark, rows), edges, ["e"], "v").select("e", "parent", "observed", "children_sum", "ok").collect()
    want = [(e, c, v, sums[e][c][0], near(v, sums[e][c][0])) for e, r in entities(rows).items() for c, v in r if c in sums[e]]
    assert sorted(map(tuple, checked), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", [4, 5])
def test_random_repairs(spark, seed):
    rows, want = trees(seed), []
    for e, r in entities(rows).items():
        now = list(r)
        for parent in ("130", "151", "100", "270", "440"):
            found = brute_sums(now, {parent: RULES[parent]})
            for s, _ in found.values():
                now = [(c, s if c == parent and not near(v, s) else v) for c, v in now]
        want += [(e, c, n, v, n != v) for (c, n), (_, v) in zip(now, r, strict=True)]
    got = hierarchy.repaired(frame(spark, rows), RULES, ["e"], "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    audit = hierarchy.repair_audit(frame(spark, rows), RULES, ["e"], ["v"]).collect()
    assert sorted((str(r.e), r.code, str(r.observed), str(r.suggested)) for r in audit) == sorted((str(e), c, str(v), str(n)) for e, c, n, v, changed in want if changed)
    assert all(r.children_used == hierarchy_used(r.code) for r in audit)


def hierarchy_used(code):
    return ",".join(x if x[0] == "-" else f"+{x}" for x in RULES[code].split())


def test_kinds_of_amounts(spark):
    rows = [("x", "100", 5.0, 1), ("x", "110", 2.5, 2), ("x", "130.1", 1.25, 3)]
    df = spark.createDataFrame(rows, "e string, code string, a double, b int").selectExpr("e", "code", "a", "cast(b as decimal(20,2)) b")
    got = {r.code: (r.a, [str(x) for x in r.b]) for r in hierarchy.repaired_columns(df, {"100": "110 130"}, ["e"], ["a", "b"]).collect()}
    assert got["100"] == ([3.75, 5.0], ["5.00", "1.00"]) and got["110"] == ([2.5, 2.5], ["2.00", "2.00"])
    assert hierarchy.repaired(df.where("false"), {"100": "110 130"}, ["e"], "a").count() == 0


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_two_shuffles_whatever_the_depth(spark, tmp_path):
    frame(spark, trees(1)).write.parquet(str(tmp_path / "v"))
    values = spark.read.parquet(str(tmp_path / "v"))
    for rules in ({"100": "110"}, RULES, hierarchy.BALANCE_RULES):
        assert exchanges(hierarchy.repaired(values, rules, ["e"], "v")) == 2
    assert exchanges(hierarchy.signed_rollup(values, hierarchy.rule_edges(spark, RULES), ["e"], "v")) == 2
    assert exchanges(hierarchy.checked_totals(values, hierarchy.rule_edges(spark, RULES), ["e"], "v")) == 2


def test_family(spark):
    rows = [("131",), ("131.1",), ("131.2",), ("131.2.1",), ("9.9",), (None,), ("131.1",)]
    got = sorted((r.code, r.parent_code, r.children_codes) for r in hierarchy.family(spark.createDataFrame(rows, "code string")).collect())
    assert got == [("131", None, ["131.1", "131.2"]), ("131.1", "131", []), ("131.2", "131", ["131.2.1"]), ("131.2.1", "131.2", []), ("9.9", "9", [])]
