"""Evaluation of several runs against a cohort as one long metric table, and the study's matrix of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.instrument import SURVEY, Instrument
from surveyloom.operators import association, distance, summaries


def fidelity(real: DataFrame, synthetic: DataFrame, instrument: Instrument = SURVEY) -> dict[str, float]:
    c = association.encoded(real, synthetic, instrument)
    hist = association.divergence(association.histogram(c, instrument.columns)).agg(F.avg("jsd").alias("jsd")).first()
    v = association.cramers_v(association.contingency(c, instrument.columns), ["src", "a", "b"])
    e = association.association_error(v, instrument).first()
    energy = distance.energy_distance(c.where("src = 'real'"), c.where("src = 'synthetic'"), instrument.columns)
    return {"jsd": hist["jsd"], "mae_v": e["mae_v"], "energy": energy, "between_disorder_mae_v": e["between_disorder_mae_v"], "within_questionnaire_mae_v": e["within_questionnaire_mae_v"]}


def proximity(real: DataFrame, synthetic: DataFrame | None, instrument: Instrument = SURVEY) -> dict[str, float]:
    """Of the synthetic table to the real one; without one, of the real table to itself, each row left out."""
    c = association.encoded(real, real if synthetic is None else synthetic, instrument)
    x = distance.distinct_rows(c.where("src = 'real'"), instrument.columns)
    y = x if synthetic is None else distance.distinct_rows(c.where("src = 'synthetic'"), instrument.columns)
    return distance.proximity(distance.two_nearest(y, x, leave_out=synthetic is None), len(instrument.columns)).first().asDict()


def evaluation(real: DataFrame, runs: dict[str, DataFrame], instrument: Instrument = SURVEY, targeted: tuple[str, ...] = ()) -> DataFrame:
    """(run, family, domain, metric, value). Runs whose tiers were targeted have no fidelity: their margins differ by
    intent."""
    rows = [("real", "proximity", None, k, float(v)) for k, v in proximity(real, None, instrument).items()]
    for name, table in runs.items():
        if name not in targeted:
            rows += [(name, "fidelity", None, k, float(v)) for k, v in fidelity(real, table, instrument).items()]
            rows += [(name, "proximity", None, k, float(v)) for k, v in proximity(real, table, instrument).items()]
        rows += [(name, "characterisation", r["domain"], f"{r['tier']}_prevalence_percent", float(r["percent"])) for r in summaries.tier_prevalence(table, instrument).collect()]
    return real.sparkSession.createDataFrame(rows, "run string, family string, domain string, metric string, value double")


def jobs(models: list[str], seeds: list[int], conditions: dict[str, dict]) -> list[tuple[str, int, str]]:
    """Models, seeds and conditions of a study; a condition that expands another comes after what it expands."""
    depth = {c: 0 for c in conditions}
    for c, about in conditions.items():
        at = about.get("expands")
        while at:
            depth[c] += 1
            at = conditions[at].get("expands")
    made = [(m, s, c) for c, about in conditions.items() for m in models if m in about.get("models", models) for s in seeds]
    return sorted(made, key=lambda j: (depth[j[2]], j[0], j[1], j[2]))
