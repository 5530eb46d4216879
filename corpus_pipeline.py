"""From raw documents to packed ones, in five stages; each works on all that the one before it kept.

1. quality: documents that the classifier predicts to be of low quality go.
2. exact_dedup: of equal texts the document with the largest doc_id stays.
3. near_dedup: of documents linked by a similarity of 0.8 of five-word shingles, one stays.
4. substring_dedup: passages of 50 words or more that an earlier document holds are cut out of later ones.
5. packing: what is left is tokenised and packed into sequences of 4096 tokens.

A null text counts as empty. Empty texts are scored like others, and go where the classifier rejects them; of those that
it keeps exact_dedup leaves one. A text of any length is read whole. Rows with a null id count as one smaller than all
others for exact_dedup, and pass near_dedup and substring_dedup untouched. Of rows that repeat an id, exact_dedup leaves
one of each text, near_dedup all or none, and substring_dedup cuts the one with the least SHA-256. Ties go to the largest
id in exact_dedup and to the smallest after it. Columns beside doc_id and text may have any names and come out as they
went in, but for n_chars, which follows the text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.exact_dedup import drop_exact_duplicates
from ledgerloom.llm.near_dedup import drop_near_duplicates
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.passages import drop_repeated_passages
from ledgerloom.llm.quality import quality_scores, train
from ledgerloom.llm.store import deleted, fresh_path, scratch, working_name, written_at


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labels of documents that are still there; keeps what scores 0.7 or more."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = (working_name(docs, x) for x in ("score", "predicted"))
    return quality_scores(docs, model, score_col=score, predicted_col=predicted).where(F.col(predicted) == 1).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL can't express the classifier, the signatures or the packing; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read again; what is read no more is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scratch(spark):
            docs = written_at(stage(spark, docs, sf_dir), path)
        deleted(spark, before)
        before = [path]
    packed = STAGES[-1][1](spark, docs, sf_dir)
    deleted(spark, before)
    return packed
