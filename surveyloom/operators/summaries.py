"""Marginal summaries of a cohort and their validation."""

from __future__ import annotations

import math
import re
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.functions.instrument import SURVEY, TIERS, Instrument
from surveyloom.functions.scalars import age_bin, half_even, probit
from surveyloom.operators.ranking import average_ranks
from surveyloom.operators.scoring import long_scores, score_table, with_totals

#: Edges of the age histogram; a bin ends a year before the next one begins, so the last year is 51.
AGE_EDGES = (18, 19, 20, 21, 23, 52)


def tier_prevalence(table: DataFrame, instrument: Instrument = SURVEY) -> DataFrame:
    """(domain, tier, n, share, percent) for all five tiers: share among scored rows, percent among all rows.

    Conditional sums in one pass; the one row that they make is turned."""
    flags = {(d, t): F.count_if(F.coalesce(d.tier_number(F.col(f"_{d.name}")) == int(t[-1]), F.lit(False))) for d in instrument.domains for t in TIERS}
    wide = with_totals(table, instrument).agg(F.count("*").alias("all"), *(x.alias(f"{d.name}|{t}") for (d, t), x in flags.items()))
    each = F.array(*(F.struct(F.lit(d.name).alias("domain"), F.lit(t).alias("tier"), F.col(f"`{d.name}|{t}`").alias("n"), _sum([F.col(f"`{d.name}|{u}`") for u in TIERS]).alias("scored")) for d, t in flags))
    rows = wide.select("all", F.explode(each).alias("r"))
    return rows.select("r.domain", "r.tier", "r.n", F.try_divide(F.col("r.n").cast("double"), "r.scored").alias("share"), F.try_divide(F.col("r.n") * 100.0, "all").alias("percent"))


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def sex_ratio(table: DataFrame, instrument: Instrument = SURVEY) -> DataFrame:
    """(sex, n, share) with names, 0 for one that doesn't occur."""
    c = F.col(instrument.sex)
    wide = table.agg(F.count_if(c == 1).alias("male"), F.count_if(c == 2).alias("female"))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(s).alias("sex"), F.col(s).alias("n"), F.try_divide(F.col(s).cast("double"), F.col("male") + F.col("female")).alias("share")) for s in ("male", "female")))).alias("r")).select("r.*")


def age_histogram(table: DataFrame, edges: tuple[int, ...] = AGE_EDGES, instrument: Instrument = SURVEY) -> DataFrame:
    """(bin, n, share) over observed ages, bins named by their first and last year; ages outside all bins are counted as
    'outside'."""
    age = F.col(instrument.age)
    bins = [(f"{a}-{b - 1}", (age >= a) & (age < b)) for a, b in zip(edges, edges[1:], strict=False)]
    wide = table.agg(F.count(age).alias("observed"), *(F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in [*bins, ("outside", (age < edges[0]) | (age >= edges[-1]))]))
    names = [*(n for n, _ in bins), "outside"]
    return wide.select("observed", F.explode(F.array(*(F.struct(F.lit(n).alias("bin"), F.col(f"`{n}`").alias("n")) for n in names))).alias("r")).select("r.*", F.try_divide(F.col("r.n").cast("double"), "observed").alias("share"))


def age_missing(table: DataFrame, instrument: Instrument = SURVEY) -> DataFrame:
    age = F.col(instrument.age)
    return table.agg(F.count("*").alias("n"), F.count(age).alias("n_observed_age"), F.count_if(age.isNull()).alias("n_missing_age"), F.try_divide(F.count_if(age.isNull()).cast("double"), F.count("*")).alias("missing_rate"), F.min(age).alias("min_age"), F.max(age).alias("max_age"))


def distinct_scores(table: DataFrame, instrument: Instrument = SURVEY) -> DataFrame:
    """(domain, n_distinct): a correlation needs two."""
    return long_scores(table, instrument).groupBy("domain").agg(F.count_distinct("total").alias("n_distinct"))


def quantile_edges(table: DataFrame, column: str, bins: int = 5) -> list[float]:
    """Distinct exact quantiles; linear between values."""
    got = table.agg(F.percentile(column, F.array(*(F.lit(k / bins) for k in range(bins + 1)))).alias("q")).first()["q"]
    return sorted(set(got or []))


def binned(value: Column, edges: list[float]) -> Column:
    """Number of interior edges below value, so that bins are closed on the right; null stays null."""
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (value > e).cast("int")
    return F.when(value.isNotNull(), out)


def score_ranks(table: DataFrame, instrument: Instrument = SURVEY) -> DataFrame:
    """(domain, total, n, rank): average rank of each score."""
    return average_ranks(long_scores(table, instrument), ["domain"], "total")


def rank_correlation(table: DataFrame, instrument: Instrument = SURVEY, transform: bool = True) -> DataFrame:
    """(a, b, r) of each pair of domains: Pearson of the normal scores of average ranks, or of the ranks themselves.

    Ranks come from counts of scores, at most 41 a domain, and go back as a map: rows aren't shuffled."""
    complete = with_totals(table, instrument).dropna()
    long = complete.select(F.explode(F.array(*(F.struct(F.lit(d.name).alias("domain"), F.col(f"_{d.name}").alias("total")) for d in instrument.domains))).alias("d")).select("d.*")
    ranks = average_ranks(long, ["domain"], "total")
    if transform:
        n = F.sum("n").over(Window.partitionBy("domain"))
        ranks = ranks.withColumn("z", probit(F.col("rank") / (n + 1)))
    else:
        ranks = ranks.withColumn("z", F.col("rank").cast("double"))
    found = {(r["domain"], r["total"]): r["z"] for r in ranks.collect()}  # at most the attainable totals
    if not found:
        return table.sparkSession.createDataFrame([], "a string, b string, r double")
    columns = []
    for d in instrument.domains:
        pairs = [F.lit(x) for (name, t), z in sorted(found.items()) if name == d.name for x in (t, z)]
        columns.append(F.create_map(*pairs)[F.col(f"_{d.name}")].alias(d.name))
    z = complete.select(*columns)
    names = instrument.names
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = z.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("r")).select("r.*")


def cohort_summary(table: DataFrame, instrument: Instrument = SURVEY) -> dict:
    """The aggregates that profiles are sampled from; every part is a small aggregate. The table is read once: totals,
    age and sex are kept while the parts are made."""
    narrow = with_totals(table, instrument, (instrument.age, instrument.sex)).persist()
    try:
        return _summary(narrow, instrument)
    finally:
        narrow.unpersist()


def _summary(table: DataFrame, instrument: Instrument) -> dict:
    names = instrument.names
    corr = {(r["a"], r["b"]): r["r"] for r in rank_correlation(table, instrument).withColumn("r", half_even(F.col("r"), 2)).collect()}
    if any(v is None for v in corr.values()) or not corr:
        raise ValueError("a score does not vary")
    matrix = [[1.0 if a == b else corr.get((a, b), corr.get((b, a))) for b in names] for a in names]
    missing = age_missing(table, instrument).first()
    bins = {r["bin"]: r["share"] for r in age_histogram(table, instrument=instrument).withColumn("share", half_even(F.col("share"), 3)).collect()}
    if bins.pop("outside", 0):
        raise ValueError("an age is outside the histogram")
    tiers: dict = {}
    for r in tier_prevalence(table, instrument).withColumn("share", half_even(F.col("share"), 3)).collect():
        tiers.setdefault(r["domain"], {})[r["tier"]] = r["share"]
    return {
        "n": missing["n"], "n_complete_scores": score_table(table, instrument).dropna().count(), "n_observed_age": missing["n_observed_age"], "n_missing_age": missing["n_missing_age"], "disorders": names,
        "correlation_probit_2dp": matrix, "tier_prevalences": tiers, "sex_ratio": {r["sex"]: r["share"] for r in sex_ratio(table, instrument).withColumn("share", half_even(F.col("share"), 3)).collect()},
        "age_histogram": bins, "age_missing_rate": missing["missing_rate"],
    }


def probabilities(values: dict, labels: tuple[str, ...] | list[str]) -> dict[str, float]:
    """Normalised: exactly the labels, finite, in [0, 1], of positive sum."""
    if set(values) != set(labels) or any(isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v) or not 0 <= v <= 1 for v in values.values()):
        raise ValueError("not probabilities of the labels")
    total = math.fsum(values.values())
    if total <= 0:
        raise ValueError("probabilities sum to nothing")
    return {k: values[k] / total for k in labels}


def normalised(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds `probability`: value over its group's sum; null where the sum is nothing."""
    return rows.withColumn("probability", F.try_divide(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(*group))))


def bin_overlap(labels: DataFrame, label: str = "bin") -> DataFrame:
    """(bin, low, high, overlaps): whether a bin begins no later than the year in which the one below it ends."""
    parsed = labels.select(F.col(label).alias("bin"), age_bin(F.col(label)).alias("b")).select("bin", "b.low", "b.high")
    w = Window.orderBy("low", "high")  # bins of one histogram, a handful
    return parsed.withColumn("overlaps", F.coalesce(F.lag("high").over(w) >= F.col("low"), F.lit(False)))


def checked_summary(summary: dict, instrument: Instrument = SURVEY) -> dict:
    """A normalised copy of a summary, or an error; the input isn't changed."""
    from surveyloom.operators.copula import repaired

    names = instrument.names
    if list(summary["disorders"]) != names:
        raise ValueError("other domains than the instrument's")
    matrix, _ = repaired(summary["correlation_probit_2dp"])
    rate = summary.get("age_missing_rate", 0.0)
    if isinstance(rate, bool) or not isinstance(rate, int | float) or not 0 <= rate <= 1:
        raise ValueError("the rate of missing ages is not a probability")
    histogram = summary.get("age_histogram")
    if not isinstance(histogram, dict) or (not histogram and rate < 1):
        raise ValueError("an age may be drawn, but there is no histogram")
    bins = {}
    for label, p in probabilities(histogram, list(histogram)).items() if histogram else ():
        ends = re.fullmatch("([0-9]+)-([0-9]+)", label)
        if not ends or int(ends[1]) > int(ends[2]):
            raise ValueError(f"not an age bin: {label}")
        bins[int(ends[1]), int(ends[2])] = p
    bins = dict(sorted(bins.items()))
    if any(a[1] >= b[0] for a, b in pairwise(bins)):
        raise ValueError("age bins overlap")
    n = summary.get("n", 1)
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("the number of people is not a positive whole number")
    return {"correlation": matrix, "tiers": {d: probabilities(summary["tier_prevalences"][d], TIERS) for d in names}, "sex": probabilities(summary["sex_ratio"], ("male", "female")), "age": bins, "age_missing_rate": float(rate)}


def frame_of(spark: SparkSession, summary: dict) -> DataFrame:
    """A summary's numbers as rows (part, key, value)."""
    rows = [("tier", f"{d}/{t}", float(p)) for d, x in summary["tier_prevalences"].items() for t, p in x.items()]
    rows += [("sex", k, float(v)) for k, v in summary["sex_ratio"].items()] + [("age", k, float(v)) for k, v in summary["age_histogram"].items()]
    rows += [("correlation", f"{a}/{b}", float(summary["correlation_probit_2dp"][i][j])) for i, a in enumerate(summary["disorders"]) for j, b in enumerate(summary["disorders"]) if i < j]
    return spark.createDataFrame([*rows, ("n", "n", float(summary["n"])), ("age", "missing", float(summary["age_missing_rate"]))], "part string, key string, value double")
