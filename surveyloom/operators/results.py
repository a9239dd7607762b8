"""Summaries of long metric tables over repeats and seeds, and paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.ranking import first_of


def melted(wide: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Wide metrics to (ids, metric, value), as doubles."""
    return wide.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(ids, values, "metric", "value")


def condition(regime: Column, context: Column, dependence: Column) -> Column:
    """'regime:context', with ':independent' where that is the dependence; a null context is 'baseline'."""
    return F.concat_ws(":", regime, F.coalesce(context, F.lit("baseline")), F.when(dependence == "independent", F.lit("independent")))


def fills(rows: DataFrame) -> DataFrame:
    """Evaluation rows with what they leave open: a run 'real' is real in model, regime and context, with ratio 0; a null
    context is 'baseline', a null domain 'all_variables', and the targeted domains are the eligible ones. Utility rows
    of other runs have ratio 1 where none is given. Adds `condition`."""
    real = F.col("run") == "real"
    own = {c: F.when(real, F.lit("real")).otherwise(F.col(c)) for c in ("model", "regime", "context")}
    ratio = F.when(real, F.lit(0.0)).otherwise(F.coalesce(F.col("ratio").cast("double"), F.when(F.col("family") == "utility_repeat", F.lit(1.0))))
    domain = F.coalesce("domain", F.lit("all_variables"))
    out = rows.withColumns(own | {"ratio": ratio, "domain": F.when(domain == "targeted_domains", F.lit("eligible_domains")).otherwise(domain)})
    return out.withColumn("context", F.coalesce("context", F.lit("baseline"))).withColumn("condition", condition(F.col("regime"), F.col("context"), F.col("dependence")))


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Adds the columns of a small table of runs by their key; rows of a run that isn't there have nulls."""
    return null_safe_join(rows, table, [key], "left")


def refit_rounds(best: str) -> Column:
    """The median of the best rounds, rounded up, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.percentile(best, F.lit(0.5))).cast("long"))


def first_best(candidate: str, score: str, order: str) -> Column:
    """The candidate with the highest score; of equals the one that comes first by order."""
    return F.max_by(F.col(candidate), F.struct(F.col(score), -F.col(order)))


def declared_among(rows: DataFrame, by: str, value: str, declared: list[str]) -> DataFrame:
    """(by, n_missing, is_subset): of the declared values, a handful, how many a group lacks. Only they are gathered."""
    has = rows.groupBy(by).agg(*(F.bool_or(F.col(value) == x).alias(f"_{i}") for i, x in enumerate(declared)))
    missing = sum((1 - F.coalesce(F.col(f"_{i}"), F.lit(False)).cast("int") for i in range(len(declared))), F.lit(0))
    return has.select(by, missing.alias("n_missing")).withColumn("is_subset", F.col("n_missing") == 0)


def agreed_references(rows: DataFrame, identity: list[str], value: str = "value", within: float = 1e-12) -> DataFrame:
    """(identity, n, spread, agrees): repeated reference rows have to have one value."""
    return rows.groupBy(*identity).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread")).withColumn("agrees", F.coalesce(F.col("spread") <= within, F.lit(True)))


def deduplicated(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    return first_of(rows, identity, [F.col(c) for c in order])


def repeated(rows: DataFrame, identity: list[str]) -> DataFrame:
    return rows.groupBy(*identity).agg(F.count("*").alias("n")).where("n > 1")


def single_cohort(rows: DataFrame, column: str) -> DataFrame:
    """(n_distinct, mixed)"""
    return rows.agg(F.count_distinct(column).alias("n_distinct")).withColumn("mixed", F.col("n_distinct") > 1)


def seed_sets(rows: DataFrame, by: list[str], repeat: str, seed: str) -> DataFrame:
    """(by, consistent): whether every repeat has the same seeds. Seeds are few; their sets are compared as text."""
    sets = rows.groupBy(*by, repeat).agg(F.array_join(F.array_sort(F.collect_set(F.col(seed).cast("string"))), ",").alias("_s"))
    return sets.groupBy(*by).agg((F.count_distinct("_s") <= 1).alias("consistent"))


def repeat_summary(rows: DataFrame, by: list[str], repeat: str = "repeat", seed: str = "seed", value: str = "value") -> DataFrame:
    """(by, mean, sd, seed_sd, n_repeats, n_seeds): seeds are averaged within a repeat, then mean and sample deviation
    are over repeats; seed_sd is over the seeds' own means."""
    within = rows.groupBy(*by, repeat).agg(F.avg(value).alias("_m"))
    over = within.groupBy(*by).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("sd"), F.count("*").alias("n_repeats"))
    seeds = rows.groupBy(*by, seed).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.stddev_samp("_m").alias("seed_sd"), F.count("*").alias("n_seeds"))
    return null_safe_join(over, seeds, by)


def seed_summary(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n_seeds"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet null keys; the keys once, from the left."""
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True) if not keys else None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = e if on is None else on & e
    return left.join(r, on, how).drop(*(f"_r_{k}" for k in keys))


def paired_difference(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], repeat: str = "repeat", value: str = "value") -> DataFrame:
    """(by, mean, sd, n): left less right for pairs with equal keys, averaged within a repeat, then over repeats.
    A key that occurs twice on a side is an error that the job reports."""

    def once(rows: DataFrame, name: str) -> DataFrame:
        g = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(value).alias(name))
        return g.withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.raise_error(F.lit("a key is repeated")).cast("double"))).drop("_n")

    both = null_safe_join(once(left, "_l"), once(right, "_r"), keys).withColumn("_d", F.col("_l") - F.col("_r"))
    within = both.groupBy(*by, repeat).agg(F.avg("_d").alias("_m"))
    return within.groupBy(*by).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("sd"), F.count("*").alias("n"))
