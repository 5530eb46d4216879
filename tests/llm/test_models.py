import hashlib

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.ann import nearest_neighbours
from ledgerloom.llm.chat import CONTROLS, chat_report, escaped, unescaped
from ledgerloom.llm.quality import RANK, FactorisationMachine, held_out, quality_report, quality_scores, train
from tests.llm.cases import frame, texts

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in got]
    assert len(got) > 50 and sum(right) / len(right) >= 0.95
    good, bad = [[r.score for r in got if r.quality == q] for q in (1, 0)]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (11, 0, 0), (None, 1, 0), (6, None, 0), (2, 1, 0), (12, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_report(frame(spark), labels).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality_report(frame(spark, []), labels).count() == 0
    docs = frame(spark)
    assert quality_scores(docs, train(docs, labels.limit(0))).columns == [*docs.columns, "score", "predicted"]
    crc = {r.doc_id: r.held for r in spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", held_out().alias("held")).collect()}
    assert all(v == (__import__("zlib").crc32(str(k).encode()) % 4 == 2) for k, v in crc.items())


def test_interactions_of_explicit_pairs():
    """The linear-time score against the sum over all pairs of features."""
    rng = np.random.default_rng(3)
    width, n = 40, 12
    own = FactorisationMachine(np.zeros((0, 0)), 0.3, rng.normal(size=width), rng.normal(size=(width, RANK)))
    columns = [rng.choice(width, rng.integers(0, 9), replace=False) for _ in range(n)]
    values = [rng.normal(size=len(c)) for c in columns]
    row = np.repeat(np.arange(n), [len(c) for c in columns])
    got = own.logits(row, np.concatenate(columns), np.concatenate(values), n)[0]
    for i, (c, v) in enumerate(zip(columns, values, strict=True)):
        want = 0.3 + sum(own.weights[j] * x for j, x in zip(c, v, strict=True))
        want += sum(own.factors[c[a]] @ own.factors[c[b]] * v[a] * v[b] for a in range(len(c)) for b in range(a))
        assert abs(got[i] - want) < 1e-9


def test_ties_score_alike(spark):
    docs = spark.createDataFrame([(i, "one two three. " * (1 + i % 3)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    scores = {}
    for r in quality_report(docs, labels).collect():
        scores.setdefault(r.doc_id % 3, set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())


def brute(rows, ids, k):
    out = {}
    for q in ids:
        scored = []
        for i, v in rows.items():
            if i != q:
                s = 0.0
                for a, b in zip(rows[q], v, strict=True):
                    s += float(a) * float(b)
                scored.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_recall_and_exact_scores(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in vectors.collect()}
    want = brute(rows, [i for i in rows if i % 20 == 0], 20)
    for share, rows, least in ((None, 4096, 0.9), (None, 16, 0.9), (0.1, 4096, 0.25)):
        found = {}
        for r in nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, probe_share=share, least_rows=rows, most_rows=rows).orderBy("query_id", "rank").collect():
            found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert found.keys() == want.keys() and all(len(x) == 20 for x in found.values())
        assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= least
        assert all(s == dict(want[q]).get(i, s) for q, x in found.items() for i, s in x)


def test_recall_of_queries_unlike_the_rows(spark):
    """Queries opposed to the rows' clusters, and residuals that codes tell apart badly: lists and rerank follow the queries."""
    rng = np.random.default_rng(1)
    n, size = 3000, 32
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    opposed = unit(unit(rng.normal(size=(50, size)))[rng.integers(0, 50, n)] + 0.04 * rng.normal(size=(n, size)))
    opposed[::20] *= -1
    noisy = rng.normal(size=(n, size))
    for x in (opposed, noisy):
        x = x.astype(np.float32).astype(float)
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        scores = x[::20] @ x.T
        scores[np.arange(n // 20), np.arange(0, n, 20)] = -np.inf
        want = np.argsort(-scores, 1, "stable")[:, :20]
        found = {}
        for r in nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, rerank=20).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(found[20 * i] & set(w.tolist())) / 20 for i, w in enumerate(want)]) >= 0.93


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (8, [0.5, 0.25], 1), (20, [0.0, 1.0], 1), (None, [1.0, 1.0], 1), (40, None, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 8, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 8, 0.25), (20, 3, 0, 0.0)]
    assert nearest_neighbours(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    twice = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in (20, 1, 1, 2, 3, 3)], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in nearest_neighbours(twice, F.col("vec_id") % 20 == 0, k=4).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (3, 1, "assistant", "b \\ <s> \\\\</s> é🙂"), (3, 0, None, None), (3, 2, "assistant", None), (3, 2, "[INST]", "<"), (3, None, "assistant", "x" * 9000), (None, 1, "assistant", "n")]
    got = {r.conv_id: r for r in chat_report(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, mask string")).collect()}
    for key in {r[0] for r in rows}:
        turns = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in rows if c == key), key=lambda t: (t[0], t[1] or 0, t[2]))
        learnt = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = CONTROLS[0] + "".join(f"[INST]{escaped(r)}[/INST]{escaped(x)}</s>" for _, _, r, x in turns)
        row = got[key]
        assert row.n_turns == len(turns) and row.loss_chars == len(learnt) and row.formatted_chars == len(whole)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_escapes():
    for text in ("", "\\", "</s>", "<\\/s>", "[/INST][INST]<s>", "<<s>", "\\</s>\\\\"):
        assert unescaped(escaped(text)) == text and not any(c in escaped(text) for c in CONTROLS)
