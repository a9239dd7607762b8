"""The driver's orders as a questionnaire cohort, by whole-number arithmetic that SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveyloom.functions.instrument import SURVEY


def cohort_sql(div: str, missing: bool = False) -> str:
    """SELECT over orders; div is the engine's whole division. missing: leaves out an item of some rows."""
    columns, j = ["o_orderkey as ID", "cast(case when o_orderkey % 281 = 0 then null else 18 + (o_orderkey * 13 + o_custkey) % 34 end as double) as W1_age_r", "cast(1 + (o_custkey % 2) as int) as W1_sex_r"], 0
    for di, d in enumerate(SURVEY.domains):
        for c in d.items:
            j += 1
            k = f"(((o_orderkey * 7919 + o_custkey * 104729) % 101) * 3 + ((o_orderkey * {31 + 2 * j} + o_custkey * {17 + 6 * j}) % 101) + ((o_orderkey * {1009 + 2 * di}) % 101) * 2)"
            value = f"cast(least({d.top}, ({k} * {k} * {d.top + 2}) {div} 360000) as int)"
            columns.append(f"case when o_orderkey % 97 = 0 then null else {value} end as {c}" if missing and j == 1 else f"{value} as {c}")
    return f"select {', '.join(columns)} from orders"


def cohort(spark: SparkSession, sf_dir: str, missing: bool = False) -> DataFrame:
    select, _, _ = cohort_sql("div", missing).rpartition(" from orders")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_expressions(select.removeprefix("select ")))


def _expressions(text: str) -> list[str]:
    """Splits a select list at its outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Even ids stand for the real table, odd ones for the synthetic one."""
    return rows.where("ID % 2 = 0"), rows.where("ID % 2 = 1")
