"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import oracle
from ledgerloom.llm.ann import nearest_neighbours
from ledgerloom.llm.byte_bpe import encode_and_decode
from ledgerloom.llm.chat import chat_report
from ledgerloom.llm.exact_dedup import exact_duplicates
from ledgerloom.llm.license_scan import license_scan
from ledgerloom.llm.merkle import tamper_report
from ledgerloom.llm.near_dedup import near_duplicates
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.passages import substring_duplicates
from ledgerloom.llm.quality import quality_report
from ledgerloom.llm.resampling import resampled
from ledgerloom.llm.token_files import token_file_report
from ledgerloom.llm.warc import warc_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_report(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_report(table(spark, sf_dir, "conversations").select(*probe.columns).unionByName(probe))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_report(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_report(table(spark, sf_dir, "pages"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


EVERY = (op1_exact_dedup, op2_byte_bpe, op3_substring_dedup, op4_best_fit_packing, op5_license_scan, op6_quality_classifier, op7_token_output, op8_minhash_dedup, op9_ann_search, op10_chat_format, op11_merkle_manifest, op12_warc, op13_importance_resampling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in EVERY}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": oracle.OP1, "op11_merkle_manifest": oracle.OP11, "op12_warc": oracle.OP12, "op13_importance_resampling": oracle.OP13}
