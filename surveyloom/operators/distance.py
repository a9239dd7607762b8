"""Normalised Hamming distances between rows of two tables: energy distance and nearest neighbours.

Equal rows are one row with a multiplicity. Pairs are made in blocks: both sides are cut into blocks of a bounded
number of distinct rows, and a task takes one block of each side, counts mismatches by a product of indicator
matrices, and hands on a histogram of mismatches or the two least per row. No task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
#: Distinct rows a side beyond which the caller has to ask for it: the work grows with their product.
LARGE = 200_000


def distinct_rows(codes: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, id, codes, weight): distinct code rows with their number. Pairs read them several times: stage them first
    if codes are long to make."""
    return codes.groupBy(*(by or []), F.array(*(F.col(c).cast("int") for c in columns)).alias("codes")).agg(F.count("*").alias("weight")).withColumn("id", F.md5(F.array_join("codes", ",")))


def blocked(rows: DataFrame, side: str, blocks: int, others: int) -> DataFrame:
    """Each row with its block, once for each block of the other side."""
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    return rows.select(own.alias(f"{side}_block"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(f"{side}_other"), F.col("id").alias(f"{side}_id"), F.col("codes").alias(f"{side}_codes"), F.col("weight").alias(f"{side}_weight"))


def _mismatches(a: pd.Series, b: pd.Series) -> np.ndarray:
    x, y = np.stack(a.to_numpy()).astype(np.int64), np.stack(b.to_numpy()).astype(np.int64)
    both = np.concatenate([x, y])
    same = np.zeros((len(x), len(y)), dtype=np.float32)
    parts_x, parts_y = [], []
    for j in range(x.shape[1]):
        values = np.unique(both[:, j])
        parts_x.append((x[:, j][:, None] == values).astype(np.float32))
        parts_y.append((y[:, j][:, None] == values).astype(np.float32))
    same = np.concatenate(parts_x, axis=1) @ np.concatenate(parts_y, axis=1).T
    return x.shape[1] - np.rint(same).astype(np.int64)


def _pairs(left: DataFrame, right: DataFrame, large: bool):
    n, m = left.count(), right.count()
    if max(n, m) > LARGE and not large:
        raise ValueError(f"{n} x {m} distinct rows: pass large=True for so many pairs")
    p, q = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    return blocked(left, "l", p, q).groupBy("l_block", "l_other").cogroup(blocked(right, "r", q, p).groupBy("r_other", "r_block"))


def pair_histogram(left: DataFrame, right: DataFrame, large: bool = False) -> DataFrame:
    """(k, n): number of pairs of a left and a right row with k mismatches, multiplicities counted.
    left, right: from distinct_rows."""

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"k": pd.Series(dtype="int32"), "n": pd.Series(dtype="int64")})
        k = _mismatches(a["l_codes"], b["r_codes"])
        w = np.outer(a["l_weight"].to_numpy(dtype=np.float64), b["r_weight"].to_numpy(dtype=np.float64))
        n = np.bincount(k.ravel(), weights=w.ravel())
        at = np.flatnonzero(n)
        return pd.DataFrame({"k": at.astype("int32"), "n": n[at].astype("int64")})

    return _pairs(left, right, large).applyInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))


def mean_root(hist: DataFrame, width: int, rows: int | None = None) -> float:
    """Mean of the root of k / width over the pairs; rows: over pairs i < j of one table's rows, each counted
    twice in hist beside the rows with themselves."""
    found = {r["k"]: r["n"] for r in hist.collect()}  # at most width + 1
    total = sum(n * (k / width) ** 0.5 for k, n in sorted(found.items()))
    return total / (sum(found.values()) if rows is None else rows * (rows - 1))


def energy_distance(real: DataFrame, synthetic: DataFrame, columns: list[str], large: bool = False) -> float:
    """Root of twice the mean distance between less those within, not below 0; each table needs two rows."""
    return energy(distinct_rows(real, columns), distinct_rows(synthetic, columns), len(columns), large)


def energy(x: DataFrame, y: DataFrame, width: int, large: bool = False) -> float:
    """The energy distance of tables from distinct_rows."""
    n, m = (t.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first()["n"] for t in (x, y))
    if min(n, m) < 2:
        raise ValueError("each table needs two rows")
    return max(0.0, 2 * mean_root(pair_histogram(x, y, large), width) - mean_root(pair_histogram(x, x, large), width, n) - mean_root(pair_histogram(y, y, large), width, m)) ** 0.5


def two_nearest(rows: DataFrame, targets: DataFrame, leave_out: bool = False, large: bool = False) -> DataFrame:
    """(id, weight, d1, d2): mismatches of each distinct row with its two nearest rows among the targets, copies
    counted singly. leave_out: rows and targets are the same table and a row is no target of itself, its copies are."""

    def two(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series(dtype=str), "weight": pd.Series(dtype="int64"), "d": pd.Series(dtype="int32"), "n": pd.Series(dtype="int64")})
        k = _mismatches(a["l_codes"], b["r_codes"])
        w = b["r_weight"].to_numpy(dtype=np.int64)
        out = []
        near = np.argsort(k, axis=1, kind="stable")[:, :3]
        for i, (own, weight) in enumerate(zip(a["l_id"], a["l_weight"], strict=True)):
            for j in near[i]:
                n = w[j] - (leave_out and b["r_id"].iloc[j] == own)
                if n > 0:
                    out.append((own, weight, k[i, j], n))
        return pd.DataFrame(out, columns=["id", "weight", "d", "n"]).astype({"weight": "int64", "d": "int32", "n": "int64"})

    found = _pairs(rows, targets, large).applyInPandas(two, "id string, weight long, d int, n long")
    # of each block three rows at most; the least, and the least again if it stands for two rows
    least = found.groupBy("id", "weight").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.array_repeat("d", F.least(F.col("n"), F.lit(2)).cast("int"))))), 1, 2).alias("two"))
    return least.select("id", "weight", F.get("two", F.lit(0)).alias("d1"), F.get("two", F.lit(1)).alias("d2"))


def proximity(nearest: DataFrame, width: int) -> DataFrame:
    """(dcr_mean, dcr_p05, exact_percent, nndr_p05) over rows, copies counted; the ratio is 1 where d2 is 0.

    d1 and d2 are whole numbers up to width, so their joint counts, a few thousand, hold all that's asked."""
    rows = nearest.groupBy("d1", "d2").agg(F.sum("weight").alias("n"))
    d, ratio = F.col("d1") / float(width), F.when(F.col("d2") > 0, F.col("d1") / F.col("d2")).otherwise(1.0)
    return rows.agg(
        (F.sum(d * F.col("n")) / F.sum("n")).alias("dcr_mean"), F.percentile(d, F.lit(0.05), F.col("n")).alias("dcr_p05"),
        (100.0 * F.sum(F.when(F.col("d1") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("exact_percent"), F.percentile(ratio, F.lit(0.05), F.col("n")).alias("nndr_p05"),
    )
