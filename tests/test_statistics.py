"""Distances, divergence and association against numpy over all pairs, and known values of the derived cohort."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.functions.instrument import SURVEY
from surveyloom.operators import association, distance, summaries
from surveyloom.plans.cohort import cohort, halves

C = SURVEY.columns


@pytest.fixture(scope="module")
def codes(spark):
    rows = cohort(spark, "/root/testdata/sf0.01").where("ID < 1128")
    return association.encoded(*halves(rows)).cache()


@pytest.fixture(scope="module")
def arrays(codes):
    got = codes.collect()
    return tuple(np.array([[r[c] for c in C] for r in got if r["src"] == s]) for s in ("real", "synthetic"))


def sides(codes):
    return tuple(distance.distinct_rows(codes.where(F.col("src") == s), C) for s in ("real", "synthetic"))


def plain_two(x, y, own):
    d = (x[:, None] != y[None]).sum(2)
    if own:
        d[np.arange(len(x)), np.arange(len(x))] = 1000
    d = np.sort(d, axis=1)[:, :2]
    ratio = np.where(d[:, 1] > 0, d[:, 0] / np.maximum(d[:, 1], 1), 1)
    return d[:, 0].mean() / 71, np.percentile(d[:, 0] / 71, 5), 100 * (d[:, 0] == 0).mean(), np.percentile(ratio, 5)


@pytest.mark.parametrize("block", [2048, 100])
def test_distances(codes, arrays, monkeypatch, block):
    monkeypatch.setattr(distance, "BLOCK", block)
    real, synthetic = arrays
    k = (real[:, None] != synthetic[None]).sum(2)
    assert {r["k"]: r["n"] for r in distance.pair_histogram(*sides(codes)).collect()} == {i: n for i, n in enumerate(np.bincount(k.ravel())) if n}
    x, y = sides(codes)
    assert np.allclose(tuple(distance.proximity(distance.two_nearest(y, x), 71).first()), plain_two(synthetic, real, False))
    assert np.allclose(tuple(distance.proximity(distance.two_nearest(x, x, leave_out=True), 71).first()), plain_two(real, real, True))


def test_known_values(codes):
    energy = distance.energy_distance(codes.where("src = 'real'"), codes.where("src = 'synthetic'"), C)
    assert math.isclose(energy, 0.010514030037545016, rel_tol=1e-9)
    x, y = sides(codes)
    assert np.allclose(tuple(distance.proximity(distance.two_nearest(y, x), 71).first()), (0.2719508540605334, 0.014084507042253521, 1.950354609929078, 0.0922727272727273))
    assert np.allclose(tuple(distance.proximity(distance.two_nearest(x, x, True), 71).first()), (0.26753071621216656, 0.028169014084507043, 2.4822695035460995, 0.600909090909091))
    jsd = association.divergence(association.histogram(codes, C)).agg(F.avg("jsd")).first()[0]
    assert math.isclose(jsd, 0.002682461939777382, rel_tol=1e-9)
    v = association.cramers_v(association.contingency(codes, C), ["src", "a", "b"]).cache()
    one = v.where("src = 'real' and a = 'W1_depression_it1' and b = 'W1_specific_phobia_it2'").first()["v"]
    assert math.isclose(one, 0.2963473796679898, rel_tol=1e-9)
    e = association.association_error(v).first()
    assert (e["n_pairs"], e["n_between"], e["n_within"]) == (2485, 2040, 306)
    assert np.allclose([e["mae_v"], e["between_disorder_mae_v"], e["within_questionnaire_mae_v"]], [0.024140683453308793, 0.023185064881775196, 0.027869698552952838])


def test_known_correlation(spark):
    real, _ = halves(cohort(spark, "/root/testdata/sf0.01").where("ID < 1128"))
    summary = summaries.cohort_summary(real)
    assert summary["correlation_probit_2dp"][0] == [1.0, 0.4, 0.58, 0.66, 0.66, 0.67, 0.68]
    assert [round(summary["tier_prevalences"]["panic"][f"tier_{k}"] * 564) for k in range(5)] == [185, 183, 115, 62, 19]


def test_identical_tables(spark):
    rows = cohort(spark, "/root/testdata/sf0.001").limit(60).cache()
    c = association.encoded(rows, rows)
    assert association.divergence(association.histogram(c, C)).agg(F.max("jsd")).first()[0] == 0
    assert association.association_error(association.cramers_v(association.contingency(c, C), ["src", "a", "b"])).first()["mae_v"] < 1e-12
    assert distance.energy_distance(c.where("src = 'real'"), c.where("src = 'synthetic'"), C) < 0.2


def test_flipped_dependence(spark):
    rows = [(s, i % 2, i % 2 if s == "real" else 1 - i % 2) for s in ("real", "synthetic") for i in range(400)]
    c = spark.createDataFrame(rows, "src string, a int, b int")
    assert association.divergence(association.histogram(c, ["a", "b"])).agg(F.max("jsd")).first()[0] == 0
    assert distance.energy_distance(c.where("src = 'real'"), c.where("src = 'synthetic'"), ["a", "b"]) > 0.01


def test_too_few_rows(codes):
    with pytest.raises(ValueError, match="two rows"):
        distance.energy_distance(codes.where("src = 'real'").limit(1), codes.where("src = 'synthetic'"), C)
