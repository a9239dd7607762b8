"""Confusion counts, tier metrics, and their pooling over folds, domains and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.instrument import TIERS


def confusion(rows: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """(by, truth, predicted, n) over the whole grid of tiers: counts are made in one pass, empty cells are 0."""
    flat = rows.groupBy(*by).agg(*(F.count_if((F.col(truth) == a) & (F.col(predicted) == b)).alias(f"{a}|{b}") for a in TIERS for b in TIERS))
    cells = F.array(*(F.struct(F.lit(a).alias("truth"), F.lit(b).alias("predicted"), F.col(f"`{a}|{b}`").alias("n")) for a in TIERS for b in TIERS))
    return flat.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def tier_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, tier, tp, fp, fn, support) from confusion cells."""
    return cells.select(*by, "truth", "predicted", "n", F.explode(F.array(*map(F.lit, TIERS))).alias("tier")).groupBy(*by, "tier").agg(
        F.sum(F.when((F.col("truth") == F.col("tier")) & (F.col("predicted") == F.col("tier")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("truth") != F.col("tier")) & (F.col("predicted") == F.col("tier")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("truth") == F.col("tier")) & (F.col("predicted") != F.col("tier")), F.col("n")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("truth") == F.col("tier"), F.col("n")).otherwise(0)).alias("support"),
    )


def ratios(counts: DataFrame) -> DataFrame:
    """Adds precision, recall (null where undefined) and f1 (0 where undefined)."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))})


def macro(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, f1_macro, precision_macro, recall_macro_observed, accuracy, n_test): undefined precision and F1 count as 0
    in the mean over tiers, undefined recalls are left out."""
    return ratios(counts).groupBy(*by).agg(
        F.avg("f1").alias("f1_macro"), F.avg(F.coalesce("precision", F.lit(0.0))).alias("precision_macro"), F.avg("recall").alias("recall_macro_observed"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"), F.sum("support").alias("n_test"),
    )


def pooled(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of folds summed by (by, tier): ratios are taken afterwards, not averaged."""
    return counts.groupBy(*by, "tier").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")))


def scope_means(metrics: DataFrame, by: list[str], values: list[str], scopes: dict[str, list[str]], domain: str = "domain") -> DataFrame:
    """(by, scope, values): unweighted means over the domains of each scope, for groups that have all of them. The
    metrics are made once: each row goes to the scopes that its domain is in."""
    own = F.array(*(F.when(F.col(domain).isin(domains), F.struct(F.lit(name).alias("scope"), F.lit(len(set(domains))).alias("_all"))) for name, domains in scopes.items()))
    rows = metrics.select(*by, domain, *values, F.explode(F.array_compact(own)).alias("_s")).select(*by, domain, *values, "_s.*")
    return rows.groupBy(*by, "scope", "_all").agg(F.count_distinct(domain).alias("_n"), *(F.avg(v).alias(v) for v in values)).where("_n = _all").select(*by, "scope", *values)


def tiers_pooled(counts: DataFrame, by: list[str], domains: list[str], domain: str = "domain") -> DataFrame:
    """Ratios of each tier's counts summed over the domains."""
    return ratios(pooled(counts.where(F.col(domain).isin(domains)), by))


def upper_tiers(cells: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """(by, recall, precision, false positives, support) of the tiers from `least` on, taken as one."""
    high = [t for t in TIERS if int(t[-1]) >= least]

    def total(a: Column | None, b: Column | None) -> Column:
        cond = F.lit(True)
        for x in (a, b):
            cond = cond & x if x is not None else cond
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    t, p = F.col("truth").isin(high), F.col("predicted").isin(high)
    s = cells.groupBy(*by).agg(total(t, p).alias("tp"), total(~t, p).alias("upper_false_positives"), total(t, None).alias("upper_support"))
    return s.select(*by, F.try_divide(F.col("tp").cast("double"), "upper_support").alias("upper_recall"), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("upper_false_positives")).alias("upper_precision"), "upper_false_positives", "upper_support")


def curve_summary(cells: DataFrame, by: list[str], fold: str = "fold") -> DataFrame:
    """Confusion cells of folds summed by (by), with macro metrics and upper tiers."""
    summed = cells.groupBy(*by, "truth", "predicted").agg(F.sum("n").alias("n"))
    return macro(tier_counts(summed, by), by).join(upper_tiers(summed, by), by)
