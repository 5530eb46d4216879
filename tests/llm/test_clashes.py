"""Every operator and pipeline stage on rows with null, empty, repeated and tied texts and ids, an empty table, and extra columns of working names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.byte_bpe import encode_and_decode
from ledgerloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from ledgerloom.llm.license_scan import license_scan
from ledgerloom.llm.merkle import tamper_report
from ledgerloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.passages import drop_repeated_passages, substring_duplicates
from ledgerloom.llm.quality import quality_report
from ledgerloom.llm.resampling import resampled
from ledgerloom.llm.token_files import token_file_report
from tests.llm.cases import texts

#: Names that working columns have had, and such as results have.
NAMES = "__cell0 __bucket0 __bits0 __hot0 __seen __own __sha __of __keep __size __spans __id __gone __cut __key __text __again __text_sha score predicted keep_id length bin grp again sequence_id id key text_sha set root component_id kept seen sha of keep __at __part __base place rank weight score_ tree at total digest carried path subroot root leaf first".split()
SF = "/root/testdata/sf0.001"


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (11, 0, 0), (6, 1, 0), (12, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")


def clashing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("doc_id", "text", *[F.lit("mine").alias(n) for n in NAMES])


OPERATORS = {
    "exact_duplicates": lambda d: exact_duplicates(d), "near_duplicates": lambda d: near_duplicates(d), "substring_duplicates": lambda d: substring_duplicates(d), "pack_documents": lambda d: pack_documents(d),
    "license_scan": lambda d: license_scan(d), "quality_report": lambda d: quality_report(d, labels(d.sparkSession)), "token_file_report": lambda d: token_file_report(d), "encode_and_decode": lambda d: encode_and_decode(d, dictionary=100),
    "tamper_report": lambda d: tamper_report(d if "lang" in d.columns else d.select("*", *[F.lit("mine").alias(c) for c in ("lang", "source", "n_chars")])), "resampled": lambda d: resampled(d, d.select("text"), percent=50, least_words=5),
}
CUTS = {"drop_exact_duplicates": drop_exact_duplicates, "drop_near_duplicates": drop_near_duplicates, "drop_repeated_passages": drop_repeated_passages} | {n: None for n, _ in corpus_pipeline.STAGES[:-1]}


@pytest.mark.parametrize("name", OPERATORS)
def test_results_do_not_depend_on_extra_columns(spark, name):
    rows = [(i, t[:4000] if t and name == "encode_and_decode" else t) for i, t in texts()]
    plain, extra = (OPERATORS[name](d).drop("sequence_id", "offset") for d in (clashing(spark, rows).select("doc_id", "text"), clashing(spark, rows)))
    assert plain.columns == extra.columns and sorted(map(str, plain.collect())) == sorted(map(str, extra.collect()))
    assert OPERATORS[name](clashing(spark, [])).count() == 0


@pytest.mark.parametrize("name", CUTS)
def test_columns_of_the_caller_stay(spark, name):
    stage = dict(corpus_pipeline.STAGES).get(name)
    run = (lambda d: stage(spark, d, SF)) if stage else CUTS[name]
    docs = clashing(spark, texts())
    left = run(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert rows and all(r[n] == "mine" for r in rows for n in NAMES)
    given = {(i, t) for i, t in texts()}
    assert name in ("drop_repeated_passages", "substring_dedup") or all((r.doc_id, r.text) in given for r in rows)
    assert run(clashing(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    """Two texts of one id: each is linked by its own set, and a passage is cut from the one that was read."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, a), (2, b), (7, a), (7, b), (7, b), (8, "x " + a)]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(clashing(spark, rows)).collect())
    assert got == [(1, 1), (2, 2), (7, 1), (7, 2), (7, 2), (8, 1)]
    left = sorted((r.doc_id, r.text) for r in drop_repeated_passages(clashing(spark, rows)).collect())
    assert {(1, a), (2, b), (8, "x ")} <= set(left) and len([r for r in left if r[0] == 7]) in (1, 2)
