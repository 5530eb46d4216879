import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from tests.llm.cases import frame, texts


def sets_of(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent=80):
    sets, root = {i: sets_of(t, size) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def chains():
    """Groups in which only neighbours are similar enough, copies, and texts that share a passage but are no duplicates."""
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared = [word() for _ in range(60)]
    for _ in range(6):
        now = [word() for _ in range(120)]
        for _ in range(12):
            rows.append(" ".join(now))
            if rng.random() < 0.3:
                rows.append(" ".join(now).upper())
            now = now[:]
            for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
                now[at] = word()
    for _ in range(40):
        rows.append(" ".join(shared + [word() for _ in range(rng.randint(5, 60))]))
    return list(enumerate(rows, 100))


def test_links_of_brute_force(spark):
    rows = [(i, t) for i, t in texts() if i not in (None, 9)] + chains()
    for size in (4, 5):
        got = near_duplicates(frame(spark, rows), size=size).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, size)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    got = near_duplicates(frame(spark)).collect()
    assert len(got) == len(texts())
    assert sorted(r.component_id for r in got if r.doc_id in (3, 4, 5, 9)) == [3, 4, 5, 9, 9]
    assert near_duplicates(frame(spark, [])).count() == 0
    left = drop_near_duplicates(frame(spark))
    assert left.columns == frame(spark).columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4, 5, 6, 7, 9, 9, 10, 11, 12]


def test_components(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - F.when(F.col("id") % 50 == 0, 0).otherwise(1)).alias("b"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got.get(i, i) == i - i % 50 for i in range(300))
