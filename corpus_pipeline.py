"""Corpus pipeline: rejects poor documents, keeps one of each near-duplicate group, drops documents that hold benchmark
items, mixes sources, and writes token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. The mixture is the order of the rows in the files; the
last stage takes it from the files' names and the rows' places in them, and writes ids in that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import decontam, mixing, quality, simhash, tokens
from surveyloom.llm.common import shared_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def place_in_files(docs: DataFrame) -> Column | None:
    """Place of a row in the files that docs was read from, as a long; none if it wasn't read from files."""
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        docs.select(name, row)
    except AnalysisException:
        return None
    number = [F.coalesce(F.regexp_extract(name, p, 1).try_cast("long"), F.lit(0)) for p in (r"part-(\d+)", r"-c(\d+)\.")]
    return number[0] * (1 << 42) + number[1] * (1 << 34) + row


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_digest(docs, place_in_files(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixture", mix_sources),
    ("tokens", write_token_ids),
]

#: The classifier, the fingerprints' links and the ids have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = shared_path(spark, f"stage-{name}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
