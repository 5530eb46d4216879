import hashlib
import zlib

import pytest

from ledgerloom.llm.merkle import block_height, manifest, tamper_report
from tests.llm.cases import SCHEMA, frame, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def folded_up(digests):
    """The root, and for each digest the runs that its node is in, with its place in them: whole levels at once."""
    paths, level, where = [[] for _ in digests], digests, list(range(len(digests)))
    while len(level) > 1:
        for i, at in enumerate(where):
            lo = at // 8 * 8
            run = level[lo : lo + 8]
            paths[i].append((run[: at - lo], run[at - lo + 1 :]))
        level = [H(*level[k : k + 8]) for k in range(0, len(level), 8)]
        where = [at // 8 for at in where]
    return level[0], paths


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    own = {t: folded_up([leaf(r) for r in trees[t]]) for t in order}
    root, above = folded_up([own[t][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for r, path in zip(trees[t], own[t][1], strict=True):
            path = path + above[k]
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf((*r[:4], r[4].translate(LOWER)) if touched and r[4] is not None else r)
            for left, right in path:
                now = H(*left, now, *right)
            out.append((r[0], leaf(r), own[t][0], root, H(*(x for left, right in path for x in left + right)), now, now == root))
    return sorted(out, key=str)


def run(docs):
    return sorted((tuple(r) for r in tamper_report(docs).collect()), key=str)


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_odd_rows(spark):
    docs = frame(spark)
    assert run(docs) == brute(plain(docs))
    assert tamper_report(frame(spark, [])).count() == 0
    one = frame(spark, [(3, "Alone")])
    (row,) = tamper_report(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H()


def test_trees_of_many_sizes(spark):
    """Trees of 1 to 600 leaves, one of null, and more than 64 of them: last runs of one, and several levels of trees."""
    rows = []
    for t, n in enumerate([1, 2, 7, 8, 9, 63, 64, 65, 73, 600, *[1] * 60]):
        for i in range(n):
            rows.append((len(rows) * 7, f"Text {i % 5}", None if t == 4 else f"l{t}", "S", i, None, None, None))
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA)
    assert run(docs) == brute(plain(docs))


def test_blocks_of_blocks(spark):
    """With blocks of one level, the roots of blocks go through four tables."""
    docs = frame(spark, [(i, f"Text {i % 50}") for i in range(700)])
    own = manifest(docs, ["doc_id", "text"], "lang", "doc_id", height=1)
    root, paths = folded_up([leaf((i, f"Text {i % 50}")) for i in range(700)])
    rows = {r.id: r for r in own.collect()}
    assert {bytes(r.root).hex() for r in rows.values()} == {root}
    hexes = lambda side: [side[k : k + 64] for k in range(0, len(side), 64)]
    for i in range(700):
        assert [(hexes(bytes(p.left).hex()), hexes(bytes(p.right).hex())) for p in rows[i].path] == paths[i]


@pytest.mark.parametrize("total, height", [(0, 0), (1, 0), (2, 1), (8, 1), (9, 2), (4096, 4), (4097, 4), (10**9, 4)])
def test_heights(total, height):
    assert block_height(total, 8, 4) == height


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert run(docs) == brute(plain(docs))
