import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm.resampling import bucket_gains, bucket_totals, resampled
from ledgerloom.llm.word_trie import continued, tries
from ledgerloom.llm.words import ALNUM, Words
from tests.llm.cases import frame, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5, least_words=20):
    """The same by counting spelled runs one by one."""
    totals = []
    for rows in (docs, target):
        n = [0] * 10_000
        for t in rows:
            for f in runs(t[1])[1]:
                n[zlib.crc32(f.encode()) % 10_000] += 1
        totals.append(n)
    s, t = totals
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        words, features = runs(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(features), weight, score, None, len(words) >= least_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def benchmark(spark, rows=(("the lazy dog jumps", ), (None,), ("Quick BROWN fox",))):
    return spark.createDataFrame(list(rows), "text string")


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling(spark, percent):
    docs = [*texts(), *((100 + i, f"the quick w{i % 7} brown fox " * 6) for i in range(40)), (105, "the quick w5 brown fox " * 6)]
    got = sorted((tuple(r) for r in resampled(frame(spark, docs), benchmark(spark), percent=percent).collect()), key=str)
    assert got == brute(docs, [(0, r.text) for r in benchmark(spark).collect()], percent)


def test_whole_tables_against_brute_force(spark):
    at = "/root/testdata/sf0.01"
    docs, target = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(0, r.text) for r in target.collect()])
    assert sorted((tuple(r) for r in resampled(docs, target).collect()), key=str) == want


def test_resampling_without_rows(spark):
    assert resampled(frame(spark, []), benchmark(spark)).count() == 0
    rows = resampled(frame(spark, [(1, None), (2, "")]), benchmark(spark, [])).collect()
    assert [(r.n_features, r.weight, r["rank"]) for r in rows] == [(0, 0, None)] * 2
    assert bucket_totals(benchmark(spark, [])).count() == 0 and not bucket_gains(benchmark(spark, []), benchmark(spark, [])).any()


def test_trie_in_small_blocks():
    """Counts and CRCs of a trie cut into blocks of two words are those of the spelled runs; no run crosses texts."""
    data = ["a b a b a b c", "", "c c c c " + "x" * 70_000, "b ab"]
    raw = [t.encode() for t in data]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), ALNUM)
    want, got = {}, {}
    for t in data:
        for f in runs(t)[1]:
            want[zlib.crc32(f.encode())] = want.get(zlib.crc32(f.encode()), 0) + 1
    for level in tries(words, 3, block=2):
        for crc, n in zip(level.crc.tolist(), level.count().tolist(), strict=True):
            got[crc] = got.get(crc, 0) + n
    assert got == want


def test_continued_crcs():
    rng = np.random.default_rng(1)
    pairs = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 300, (50, 2))]
    of = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    assert continued(of(0), of(1), np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]
