"""Readers and writers of the tables that runs exchange."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.instrument import SURVEY, Instrument
from surveyloom.functions.scalars import fingerprint
from surveyloom.operators.scoring import validate

ATTEMPT = "request_id string, prompt_sha256 string, attempt int, seed long, raw_completion string, valid boolean, errors array<string>, scores map<string,int>, achieved_total int, achieved_tier string, tier_match boolean, retryable boolean, completed_at timestamp, elapsed_s double"


def read_cohort(spark: SparkSession, path: str, instrument: Instrument = SURVEY) -> DataFrame:
    """A cohort's CSV in the declared columns and order; other columns, missing ones or bad cells are errors."""
    names = spark.read.option("header", True).csv(path).columns
    if sorted(names) != sorted(instrument.columns):
        raise ValueError("the file has other columns than the instrument")
    kinds = {f.name: T.DoubleType() if f.name == instrument.age else T.DoubleType() for f in instrument.schema()}
    read = spark.read.schema(T.StructType([T.StructField(n, kinds[n]) for n in names])).option("header", True).option("mode", "FAILFAST").csv(path)
    return validate(read, instrument).select(instrument.age, *(F.col(c).cast("int").alias(c) for c in instrument.columns[1:]))


def read_responses(spark: SparkSession, path: str, instrument: Instrument = SURVEY) -> DataFrame:
    """A synthetic table's CSV: id and declared columns, missing cells allowed."""
    return spark.read.schema(instrument.schema(with_id=True)).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_sav(spark: SparkSession, path: str, instrument: Instrument = SURVEY) -> DataFrame:
    """An SPSS file, only the declared columns; needs the optional pyreadstat."""
    try:
        import pyreadstat
    except ImportError as e:
        raise RuntimeError("reading SPSS files needs pyreadstat") from e
    frame, _ = pyreadstat.read_sav(path, usecols=instrument.columns)
    return spark.createDataFrame(frame[instrument.columns])


def read_documents(path: str) -> dict:
    """A summary, configuration or document in YAML or JSON, on the driver."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def read_requests(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of requests; a line that doesn't fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A long metric table."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("value", F.col("value").cast("double"))


def read_run(spark: SparkSession, table: DataFrame, manifest: dict, instrument: Instrument = SURVEY) -> DataFrame:
    """A finished run's table: its manifest has to say complete, and as many rows as there are."""
    if manifest.get("status") != "complete":
        raise ValueError("the run is not complete")
    ids = table.agg(F.count("*").alias("n"), F.count_distinct(instrument.id).alias("d")).first()
    if ids["n"] != manifest["n_patients"] or ids["d"] != ids["n"]:
        raise ValueError("the table has other rows than the manifest says, or ids are repeated")
    return table.drop(instrument.id)


def write_new(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Never overwrites."""
    writer = rows.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_block(rows: DataFrame, path: str, by: str = "domain") -> None:
    """Replaces the blocks, one a value of `by`, that rows has and leaves the others: a block that was cut off
    is written again as a whole."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def committed_blocks(spark: SparkSession, path: str, by: str = "domain") -> list[str]:
    """Values of `by` under path, none if nothing is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(r[by] for r in spark.read.parquet(path).select(by).distinct().collect()) if fs.exists(hadoop) else []


def manifest_of(spark: SparkSession, parts: Iterable[tuple[str, object]]) -> DataFrame:
    """One row (key, json, sha256) for each part of a manifest."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True), fingerprint(v)) for k, v in parts], "key string, json string, sha256 string")
