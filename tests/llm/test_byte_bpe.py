import hashlib
import random
import time

import public_tokenizers
import tiktoken

from ledgerloom.llm.byte_bpe import DEFAULT_RANKS, encode_and_decode, read_ranks
from tests.llm.cases import frame, texts


def _digest(x):
    return hashlib.sha256(x).hexdigest()


def test_ids_of_the_library(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(DEFAULT_RANKS), special_tokens={})
    odd = ["a  b\n\n c ", "Don't 'S 12ab  ", " x  y\u0085z\x1c\x1d", "Ⅷ ½ ǅ x̂́ 中文字 🙂🙂 ẞ", "<|endoftext|>", "x" * 40, "\\ \" ' \x00 \x7f", "zzzzqqqqxxxxjjjj" * 3]
    rows = [*texts(), *enumerate(odd, 200)]
    rng = random.Random(2)
    rows += [(300 + i, "".join(rng.choices(letters, k=n))) for i, (letters, n) in enumerate([("ab", 700), ("theanio", 900), ("abcdefghijklmnopqrstuvwxyz", 2000), ("中文字日本語", 400), ("a", 1025), ("=-", 800)])]
    for dictionary in (0, 3000):
        got = encode_and_decode(frame(spark, rows), dictionary=dictionary).collect()
        want = sorted((i or 0, len(ids := library.encode_ordinary(t or "")), _digest(" ".join(map(str, ids)).encode()), _digest((t or "").encode())) for i, t in rows)
        assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert encode_and_decode(frame(spark, [])).count() == 0


def test_time_of_long_words(spark):
    rng = random.Random(3)
    took = []
    for n in (200, 3000, 24000):  # the first one warms up
        docs = frame(spark, [(1, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)))])
        start = time.perf_counter()
        encode_and_decode(docs, dictionary=0).collect()
        took.append(time.perf_counter() - start)
    assert took[2] <= 8 * took[1]


def test_time_of_long_texts(spark):
    took = []
    for n in (2000, 40000, 320000):  # the first one warms up
        docs = frame(spark, [(1, "the cat " * (n // 2))])
        start = time.perf_counter()
        got = encode_and_decode(docs).collect()
        took.append(time.perf_counter() - start)
        assert got[0].n_tokens == n + 1 and got[0].decoded_sha256 == _digest(b"the cat " * (n // 2))
    assert took[2] <= 3 * took[1], took
