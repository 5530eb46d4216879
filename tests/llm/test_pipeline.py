import corpus_pipeline
from ledgerloom.llm.store import written
from tests.llm.test_near_dedup import brute
from tests.llm.test_passages import brute_covered

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == first
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(kept[name])
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    wrong = [i for i, q in labels.items() if (i in kept["quality"]) != bool(q)]
    assert len(wrong) <= 0.06 * len(labels) and all(kept["quality"][i] == whole[i] for i in kept["quality"])
    best = {t: max(i for i, u in kept["quality"].items() if u == t) for t in kept["quality"].values()}
    assert kept["exact_dedup"] == {i: t for t, i in best.items()}
    roots = {i: root for i, _, root in brute(sorted(kept["exact_dedup"].items()), 5)}
    assert kept["near_dedup"] == {i: t for i, t in kept["exact_dedup"].items() if roots[i] == i} and len(kept["near_dedup"]) < len(kept["exact_dedup"])
    covered = brute_covered(sorted(kept["near_dedup"].items()))
    for i, text in kept["near_dedup"].items():
        words, left = text.split(), (kept["substring_dedup"].get(i) or "").split()
        assert len(left) <= len(words) - len(covered.get(i, ()))  # every 50 words in a row that an earlier document has are cut
        assert len(left) < len(words) or left == words
    whole_left = sum(len(t.split()) for t in kept["substring_dedup"].values())
    uncovered = sum(len(t.split()) - len(covered.get(i, ())) for i, t in kept["near_dedup"].items())
    assert 0.9 * uncovered <= whole_left <= uncovered
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept["substring_dedup"].keys()
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
