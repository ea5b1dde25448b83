"""One registered query per operator of this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    audit,
    bpe,
    decontaminate,
    htmltext,
    langid,
    linededup,
    merkle,
    mixing,
    quality,
    secrets,
    sharding,
    simhash,
    warc,
)
from tessera.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read_table(spark, sf_dir, "documents"))


@query("op2_line_dedup", linededup.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(read_table(spark, sf_dir, "documents"))


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(read_table(spark, sf_dir, "documents"))


@query("op4_warc", warc.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding(read_table(spark, sf_dir, "documents"))


@query("op7_decontamination", decontaminate.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.html_text(read_table(spark, sf_dir, "pages"))


@query("op9_secret_scan", secrets.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read_table(spark, sf_dir, "documents"))


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(read_table(spark, sf_dir, "documents"))


@query("op12_filter_audit", audit.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
