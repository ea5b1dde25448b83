"""The training corpus, stage by stage: ``run(spark, sf_dir)`` applies STAGES to documents.

Each stage reads what the one before it wrote. Every stage but the last returns the columns
of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, quality, sharding, simhash
from tessera.llm.common import read_table
from tessera.session import new_stage_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.drop_rejected(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-copies."""
    return simhash.drop_near_copies(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def interleave(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the Pfair schedule mixes their sources."""
    return mixing.in_order(docs)


def _unused(docs: DataFrame, name: str) -> str:
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot; slots keep the order of the mix in each shard."""
    file, row = _unused(docs, "__file"), _unused(docs, "__row")
    try:
        at = docs.metadataColumn("_metadata")
        # files in the order of their numbers, which outgrow the zeros they are padded with
        number = F.regexp_extract(at["file_name"], r"^part-(\d+)", 1).try_cast("long")
        ordered = docs.withColumns({file: F.struct(number.alias("n"), at["file_name"].alias("name")), row: at["row_index"]})
    except AnalysisException:  # not read straight from files, so there is no order to keep
        return sharding.with_shard(docs)
    return sharding.with_shard(ordered, along=(file, row))


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", interleave),
    ("sharding", to_shards),
]

# The stages' hashes and iterations have no equivalent in DuckDB SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_stage_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
