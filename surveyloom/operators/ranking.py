"""Ranks that no single task has to make."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a group that one task ranks.
RANGE_ROWS = 100_000


def group_rank(rows: DataFrame, group: list[str], key: str, tie: list[str], digits: int | None = None, name: str = "rank") -> DataFrame:
    """Adds the rank, from 1, of each row in its group by a hexadecimal key (md5, say), then by tie.

    The key's leading digits cut a group into ranges of about equal size; a row's rank is its place in the range and
    the number of rows in the ranges before. digits: as many as keep a range of a group that has all rows near
    RANGE_ROWS, from the number of rows, which is counted; so ranges stay bounded whatever the table's size.
    """
    if digits is None:
        digits = max(2, math.ceil(math.log(max(1, rows.count() / RANGE_ROWS), 16)))
    cut = rows.withColumn("_range", F.substring(key, 1, digits))
    counts = cut.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    within = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(key, *tie)))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_range") == F.col("_r")]
    return within.join(before, on).withColumn(name, F.col("_before") + F.col("_at")).select(*rows.columns, name)


def average_ranks(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, rank): average rank of each distinct value in its group, from counts of the values.

    Meant for values with few distinct ones, as scores: only their counts are ordered, never the rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("rank", F.sum("n").over(w) - (F.col("n") - 1) / 2)


def cumulative(rows: DataFrame, group: list[str], order: str, value: str, name: str = "upto") -> DataFrame:
    """Running sum of value by order in each group."""
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order: a window limited to one row, which tasks apply before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def largest_remainder(rows: DataFrame, group: list[str], label: str, weight: str, n: Column) -> DataFrame:
    """Adds `units`: n units over each group's labels by weight, leftovers to the largest remainders, ties by label."""
    w = Window.partitionBy(*group)
    exact = n * F.col(weight) / F.sum(weight).over(w)
    out = rows.withColumn("_n", n).withColumn("_e", exact).withColumn("_a", F.floor("_e")).withColumn("_left", F.col("_n") - F.sum("_a").over(w))
    out = out.withColumn("_k", F.row_number().over(w.orderBy(F.desc(F.col("_e") - F.col("_a")), label)))
    return out.withColumn("units", (F.col("_a") + (F.col("_k") <= F.col("_left")).cast("int")).cast("long")).drop("_n", "_e", "_a", "_left", "_k")
