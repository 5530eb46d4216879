import hashlib
import zlib

import numpy as np
from tokenizers import Tokenizer

from ledgerloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from ledgerloom.llm.license_scan import Automaton, license_scan, text_words
from ledgerloom.llm.packing import best_fit_decreasing, lower_bound, pack_documents
from ledgerloom.llm.store import fresh_path
from ledgerloom.llm.token_files import ShardReader, token_file_report, write_token_files
from ledgerloom.llm.wordcache import DEFAULT_BYTE, DEFAULT_WORD
from tests.llm.cases import frame, texts


def _library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_exact_duplicates(spark):
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(frame(spark)).collect())
    want = []
    for i, t in texts():
        same = [j for j, u in texts() if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i or 0, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert exact_duplicates(frame(spark, [])).count() == 0


def test_exact_duplicates_without_a_broadcast(spark):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(exact_duplicates(frame(spark), max_filter_bytes=0)) == rows(exact_duplicates(frame(spark)))


def test_drop_exact_duplicates(spark):
    docs = frame(spark)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 4, 5, 6, 7, 9, 10, 11, 12, 13]


def test_token_files(spark):
    encode = _library(DEFAULT_BYTE)
    got = token_file_report(frame(spark)).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(texts(), key=lambda x: (x[0] is not None, x[0])), strict=True):
        ids = [*encode(t), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), _crc(ids))
        at += len(ids)
    assert token_file_report(frame(spark, [])).count() == 0


def test_keyed_access(spark):
    folder = fresh_path(spark, "keyed")
    shards = write_token_files(frame(spark), folder)
    readers = [ShardReader(folder.removeprefix("file://"), s[0]) for s in shards]
    found = [x for r in readers if (x := r.get(7)) is not None]
    assert len(found) == 1 and found[0].tolist() == [*_library(DEFAULT_BYTE)(dict(texts())[7]), 0]
    assert all(r.get(k) is None for r in readers for k in (8, 999, -5))


def test_packing(spark):
    encode = _library(DEFAULT_WORD)
    rows = pack_documents(frame(spark)).collect()
    whole = sorted(([i or 0, *x] for i, t in texts() for x in _cut([*encode(t), 1])))
    assert sorted([r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32] for r in rows) == whole
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r.length for r in rows) // 4096)
    assert pack_documents(frame(spark, [])).count() == 0


def _cut(ids):
    return [[k, at, len(ids[at : at + 4096]), _crc(ids[at : at + 4096])] for k, at in enumerate(range(0, len(ids), 4096))]


def test_bounds_never_pass_a_packing():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        bins = best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, lengths).max() <= 100
        assert lower_bound(lengths, 100) <= bins.max() + 1
    assert lower_bound(np.full(10, 51), 100) == 10 and lower_bound(np.full(9, 34), 100) == 5


def test_bins_with_a_gap_meet_again(spark):
    """Partitions whose bins stay above their bound, packed anew with others: no item is lost, and no more bins than before."""
    from ledgerloom.llm.packing import pack

    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, 0, int(x)) for i, x in enumerate(rng.choice([34, 35, 30, 21, 17, 12], 3000))], "doc_id long, piece int, length long")
    alone = pack(items, capacity=100, per_partition=1 << 30).select("sequence_id").distinct().count()
    rows = pack(items, capacity=100, per_partition=200).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist() and sum(n for _, n in places) <= 100
    assert len(by) <= 1.02 * alone


def _brute_places(text):
    words, out = text_words(text), []
    for phrase in ("under the mit license", "apache license version 2", "cc by nc"):
        p = phrase.encode().split()
        out += [i for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(out), min(out, default=None), max(out, default=None)


def test_license_scan(spark):
    rows = license_scan(frame(spark)).collect()
    want = sorted((i or 0, *map(str, _brute_places(t or ""))) for i, t in texts())
    assert sorted((r.doc_id or 0, str(r.n_words), str(r.n_base), str(r.first_word), str(r.last_word)) for r in rows) == want
    by = {r.doc_id: r for r in rows}
    assert by[9].labels == by[9].base_labels == "mit" and by[9].score == 1
    assert by[10].labels == "apache-2,cc-by-nc" and by[1].labels == "" and by[1].score == 0


def test_whole_licenses(spark):
    """Every template's own wording, its regions left out or filled, is accepted; with one mandatory word changed it isn't."""
    import re

    from ledgerloom.llm.license_scan import TEMPLATES

    for label, template in TEMPLATES:
        short = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", template, flags=re.S)
        filled = lambda t, n: re.sub(r"<<var;name=\w+;words=(\d+)-(\d+)>>", lambda m: " ".join(["q"] * int(m[n])), t)
        texts_ = [filled(short, 1), filled(re.sub(r"<<(begin|end)Optional>>", " ", template), 2)]
        x = Automaton(label, template)
        assert all(x.found(text_words("zz " + t + " zz")) for t in texts_), template
        spoilt = [w for w in text_words(texts_[0]) if w != x.mandatory[-1]]
        assert 0 <= x.share(spoilt) < 1


def test_license_scan_of_no_rows(spark):
    assert license_scan(frame(spark, [])).count() == 0
    assert [(r.doc_id, r.n_words) for r in license_scan(frame(spark, [(None, "a b")])).collect()] == [(None, 2)]


def test_automaton_regions():
    x = Automaton("x", "a <<beginOptional>>b <<var;name=v;words=1-2>><<endOptional>> license <<var;name=w;words=0-1>> end")
    yes = ["a license end", "a b q license end", "a b q r license z end", "zz a license q end"]
    no = ["a b license end", "a b q r s license end", "a license q q end", "a c license end", "license end"]
    assert all(x.found(text_words(t)) for t in yes) and not any(x.found(text_words(t)) for t in no)
