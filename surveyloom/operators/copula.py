"""Joint severity profiles sampled from summaries by a Gaussian copula."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.instrument import SURVEY, TIERS, Domain, Instrument
from surveyloom.functions.scalars import half_even, norm_cdf, normal, uniform

# What rounding to two decimals may do to an eigenvalue, and the least eigenvalue kept.
SLACK, LEAST = 6 * 0.005 + 1e-10, 1e-8


def repaired(matrix: list[list[float]]) -> tuple[np.ndarray, dict]:
    """A correlation matrix made positive definite: eigenvalues are raised to LEAST and the diagonal is scaled to 1.
    Rejects what isn't a correlation matrix and what rounding can't explain. A few domains: driver work."""
    m = np.array(matrix, dtype=np.float64)
    if m.ndim != 2 or m.shape[0] != m.shape[1] or not np.isfinite(m).all() or not np.allclose(m, m.T, atol=1e-12, rtol=0) or not np.allclose(np.diag(m), 1, atol=1e-12, rtol=0) or np.abs(m).max() > 1 + 1e-12:
        raise ValueError("not a correlation matrix")
    values, vectors = np.linalg.eigh(m)
    about = {"min_eigenvalue": float(values.min()), "repaired": False, "largest_change": 0.0}
    if values.min() < -SLACK:
        raise ValueError("the correlation matrix is far from positive definite")
    if values.min() < LEAST:
        m = vectors * np.maximum(values, LEAST) @ vectors.T
        scale = np.sqrt(np.diag(m))
        m = m / np.outer(scale, scale)
        np.fill_diagonal(m, 1.0)
        about = about | {"repaired": True, "largest_change": float(np.abs(m - np.array(matrix)).max())}
    return m, about


def inverse_tier_cdf(u: Column, domain: Domain, prevalence: dict[str, float]) -> Column:
    """Struct (tier, total) at u: the tier by cumulated prevalence of those that occur, then evenly over the tier's
    attainable totals by what is left of u."""
    active = [(k, prevalence[t]) for k, t in enumerate(TIERS) if prevalence[t] > 0]
    u = F.least(u, F.lit(1 - 2.0**-53))
    out, upto = None, 0.0
    steps = []
    for i, (k, p) in enumerate(active):
        below, upto = upto, 1.0 if i == len(active) - 1 else upto + p
        steps.append((k, p, below, upto))
    for k, p, below, upto in reversed(steps):
        totals = domain.attainable(k)
        at = F.least(F.floor((u - below) / p * len(totals)).cast("int"), F.lit(len(totals) - 1))
        made = F.struct(F.lit(TIERS[k]).alias("tier"), F.get(F.array(*map(F.lit, totals)), at).alias("total"))
        out = made if out is None else F.when(u < upto, made).otherwise(out)
    return out


def category_at(u: Column, probabilities: dict) -> Column:
    """The key at u by cumulated probability; keys without any are skipped and u = 1 is the last."""
    some = [(k, p) for k, p in probabilities.items() if p > 0]
    out, upto = F.lit(some[-1][0]), []
    total = 0.0
    for k, p in some[:-1]:
        total += p
        upto.append((k, total))
    for k, c in reversed(upto):
        out = F.when(u < c, F.lit(k)).otherwise(out)
    return out


def age_at(u_bin: Column, u_value: Column, bins: dict[tuple[int, int], float]) -> Column:
    """An age: the bin at the first number, a whole year in it, both ends included, at the second. Null without bins."""
    if not bins:
        return F.lit(None).cast("int")
    low = category_at(u_bin, {a: p for (a, _), p in bins.items()})
    years = F.create_map(*(F.lit(x) for a, b in bins for x in (a, b - a + 1)))[low]
    return (low + F.least(F.floor(u_value * years), years - 1)).cast("int")


def profiles(spark: SparkSession, summary: dict, n: int, seed: int, prevalences: dict[str, dict[str, float]] | None = None, dependence: str = "copula", instrument: Instrument = SURVEY) -> DataFrame:
    """n profiles: patient_id, AGE, SEX, and word, tier and target of each domain.

    Random numbers depend on seed, stream, person and domain alone: the first k profiles are the same for every
    n >= k and any partitioning, and changing the tiers of some domains leaves all else as it is. dependence
    'independent' skips the correlation with the same normal numbers.
    """
    from surveyloom.operators.summaries import checked_summary, probabilities

    if isinstance(n, bool) or not isinstance(n, int) or n < 1 or isinstance(seed, bool) or not isinstance(seed, int) or dependence not in ("copula", "independent"):
        raise ValueError("n is a positive and seed a whole number; dependence is copula or independent")
    s = checked_summary(summary, instrument)
    if set(prevalences or {}) - set(instrument.names):
        raise ValueError("prevalences of unknown domains")
    tiers = s["tiers"] | {d: probabilities(p, TIERS) for d, p in (prevalences or {}).items()}
    factor = np.linalg.cholesky(s["correlation"]) if dependence == "copula" else np.eye(len(instrument.domains))
    person = F.col("person")
    rows = spark.range(n).withColumnRenamed("id", "person")
    rows = rows.withColumns({f"_z{j}": normal(seed, f"score/{d.name}", person) for j, d in enumerate(instrument.domains)})
    rows = rows.withColumns({f"_u{i}": norm_cdf(_dot([(float(factor[i, j]), F.col(f"_z{j}")) for j in range(i + 1)])) for i in range(len(instrument.domains))})
    missing = uniform(seed, "missing", person) < s["age_missing_rate"]
    out = [
        F.format_string("syn_aggregate_%05d", person + 1).alias("patient_id"),
        F.when(~missing, age_at(uniform(seed, "bin", person), uniform(seed, "age", person), s["age"])).alias("AGE"),
        category_at(uniform(seed, "sex", person), {1.0: s["sex"]["male"], 2.0: s["sex"]["female"]}).alias("SEX"),
    ]
    for i, d in enumerate(instrument.domains):
        got = inverse_tier_cdf(F.col(f"_u{i}"), d, tiers[d.name])
        number = F.substring(got["tier"], -1, 1).cast("int")
        out += [F.get(F.array(*map(F.lit, d.words)), number).alias(d.key), got["tier"].alias(f"{d.key}_TIER_CODE"), half_even(d.score_of(got["total"]), 1).alias(f"{d.key}_SCORE_TARGET")]
    return rows.select(*out)


def _dot(terms: list[tuple[float, Column]]) -> Column:
    out = F.lit(0.0)
    for w, z in terms:
        out = out + w * z
    return out
