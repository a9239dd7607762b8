"""Stopping rules, inner resampling, protocols and size curves of the utility evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import models, utility
from surveyloom.plans.cohort import cohort


@pytest.fixture(scope="module")
def people(spark):
    return cohort(spark, "/root/testdata/sf0.001").cache()


def noise(n, seed=0, classes=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 4)), rng.integers(0, classes, n)


def test_a_fold_that_says_nothing_about_rounds():
    x, y = noise(60)
    y[:] = 1
    y[::20] = 4  # three rows of another class: one in each fold

    def one_class(train, _):
        return x[train], np.full(len(train), 1), [4]

    choice = models.select(x, y, models.BOOST, 0, one_class)
    assert (choice.rounds, choice.uninformative, choice.folds, choice.unavailable) == (1, 3, 3, [4])


def test_validation_classes_unseen_in_training_scale_the_tolerance(monkeypatch):
    x, y = noise(400, 1)
    xv, yv = noise(100, 2)
    plain = models.Boost(3, False).fit(x, y, 5, (xv, yv))
    far = np.where(np.arange(100) % 2 == 0, yv, 4)
    seen = models.Boost(3, False).fit(x, y, 5, (xv, far))
    half = models.Boost(3, False).fit(x, y, 5, (xv[::2], yv[::2]))
    assert seen.best == half.best  # the loss is over the seen ones alone
    assert plain.best >= 1
    monkeypatch.setattr(models, "TOLERANCE", 1e9)
    assert len(models.Boost(3, False).fit(x, y, 5, (xv, yv)).trees) <= models.PATIENCE


def test_a_stalled_search_is_an_error(monkeypatch):
    x, y = noise(100)
    monkeypatch.setattr(models, "GRADIENT", 0.0)
    with pytest.raises(models.NotConverged):
        models.Linear(1.0, False).fit(x, y, 5)


def test_linear_against_the_gradient():
    """At the end no part of the mean loss's gradient exceeds the limit."""
    x, y = noise(300, 3)
    m = models.Linear(1.0, True).fit(x, y, 5)
    z, w = m._prepare(x), models._balanced(y, 5, True)
    p = models._softmax(z @ m.w)
    g = z.T @ ((p - np.eye(5)[y]) * w[:, None])
    g[:-1] += m.w[:-1]
    assert np.abs(g).max() / w.sum() <= models.GRADIENT


def test_units_by_largest_remainder():
    asked = np.array([0] * 5 + [1] * 3 + [4] * 2)
    assert utility.counts_for(asked, 7)[0].tolist() == [4, 2, 0, 0, 1]
    assert utility.counts_for(asked, 7, np.array([1, 1, 4]))[1:] == ([0], "renormalised")
    assert utility.counts_for(asked, 7, np.array([2, 3]))[0].tolist() == [0, 0, 4, 3, 0]
    assert utility.counts_for(asked, 7, np.array([2, 3]))[2] == "uniform"


def test_copies_stay_out_of_validation():
    """Of a subset with copies, inner folds hold each source once, and a training part only its own."""
    x, y = np.arange(40.0)[:, None], np.arange(40) % 2
    positions = np.random.default_rng(0).integers(0, 20, 40)
    seen = []
    grid = ({"kind": "linear", "C": 1.0, "balanced": False},)
    real_select = models.select

    def spy(ux, uy, grid, seed, build=None):
        assert len(ux) == len(set(positions.tolist()))
        folds = models.inner_folds(uy, seed)
        for f in range(folds.max() + 1):
            a, b = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            bx, by, _ = build(a, b)
            seen.append(len(bx))
            assert set(bx[:, 0]) <= set(ux[a][:, 0])
            assert not set(bx[:, 0]) & set(ux[b][:, 0])
        return real_select(ux, uy, grid, seed, build)

    utility.select, kept = spy, utility.select
    try:
        utility.tuned_on_synthetic(positions[:, None].astype(float), positions % 2, positions, grid, 0)
    finally:
        utility.select = kept
    assert all(20 < n < 40 for n in seen)
    assert len(x) == len(y)


def test_protocols_of_targeted_runs(people):
    real, a = people.where("ID % 2 = 0 and ID < 240"), people.where("ID % 2 = 1 and ID < 240")
    empty = a.withColumn("W1_depression_it1", F.lit(None).cast("double"))
    got = utility.utility(real, {"a": a, "b": empty}, ("logistic",), ["depression", "agoraphobia"], folds=2, targeted={"a": ("depression",)}).cache()
    n = {(r["domain"], r["run"], r["protocol"], r["status"]): r["n"] for r in got.groupBy("domain", "run", "protocol", "status").agg(F.sum("n").alias("n")).collect()}
    assert n == {
        ("depression", "real", "TRTR", "complete"): 120, ("agoraphobia", "real", "TRTR", "complete"): 120,
        ("depression", "a", "TSTR", "complete"): 120, ("depression", "a", "TAUG", "complete"): 120, ("depression", "a", "TRTR_RESAMPLED", "complete"): 120,
        ("agoraphobia", "a", "TSTR", "complete"): 120, ("agoraphobia", "a", "TAUG", "complete"): 120,
        ("depression", "b", "TSTR", "no_scorable_synthetic_target"): None, ("depression", "b", "TAUG", "no_scorable_synthetic_target"): None,
        ("agoraphobia", "b", "TSTR", "complete"): 120, ("agoraphobia", "b", "TAUG", "complete"): 120,
    }
    lost = got.where("run = 'b' and domain = 'depression'").first()
    assert (lost["n_missing_target"], lost["candidate"], lost["truth"]) == (120, None, None)
    assert utility.effort(got.where("status = 'complete'")).where("seconds <= 0").isEmpty()
    again = utility.utility(real.repartition(5), {"a": a, "b": empty}, ("logistic",), ["depression", "agoraphobia"], folds=2, targeted={"a": ("depression",)})
    assert sorted(map(repr, again.drop("seconds").collect())) == sorted(map(repr, got.drop("seconds").collect()))


def test_arguments_are_checked(people):
    real = people.where("ID < 40")
    for more in ({"folds": 1}, {"domains": ["x"]}, {"classifiers": ("x",)}, {"runs": {"real": real}}, {"targeted": {"x": ("panic",)}}, {"seed": -1}):
        with pytest.raises(ValueError):
            utility.utility(real, **more)
    with pytest.raises(ValueError, match="rows"):
        utility.utility(real.limit(0))


def test_nested_positions():
    got = utility.nested_positions(100, 30, 20, [0.5, 1.0, 2.0, 5.0], [1])
    assert {r: len(p) for r, p in got.items()} == {0.5: 10, 1.0: 20, 2.0: 40, 5.0: 100}
    assert all(set(got[a]) <= set(got[b]) for a, b in ((0.5, 1.0), (1.0, 2.0), (2.0, 5.0)))
    assert set(got[1.0]) <= set(range(30))
    assert np.array_equal(got[2.0], utility.nested_positions(60, 30, 20, [0.5, 1.0, 2.0], [1])[2.0])
    with pytest.raises(ValueError, match="too few"):
        utility.nested_positions(99, 30, 20, [1.0, 5.0], [1])


def test_curve(people):
    real, pool = people.where("ID % 3 = 0 and ID < 240"), people.where("ID % 3 > 0 and ID < 240")
    got = utility.learning_curves(real, {"p": pool}, [0.5, 1, 2], 80, ("logistic",), ["panic"], folds=2).cache()
    sizes = {(r["protocol"], r["ratio"], r["fold"]): (r["n_fit"], r["n_added"], r["n"]) for r in utility.job_sizes(got).collect()}
    assert len(sizes) == 2 * (1 + 3 * 5)
    for (protocol, ratio, _), (fit, added, n) in sizes.items():
        train = 80 - n
        assert added == (0 if protocol == "TRTR" else -(-int(ratio * train * 2) // 2))
        assert fit == (train if protocol == "TRTR" else added + train * (not protocol.startswith("TSTR")))
    cells = {}
    for r in got.collect():
        cells.setdefault((r["protocol"], r["ratio"], r["fold"]), []).append((r["truth"], r["predicted"], r["n"]))
    for f in (0, 1):
        for ratio in (0.5, 1.0):  # the very same rows
            assert sorted(cells["TSTR", ratio, f]) == sorted(cells["TSTR_SYNTH_RESAMPLED", ratio, f])
            assert sorted(cells["TAUG", ratio, f]) == sorted(cells["TAUG_SYNTH_RESAMPLED", ratio, f])
    twice = got.where("protocol = 'TSTR_SYNTH_RESAMPLED' and ratio = 2").first()
    assert twice["n_unique_sources"] <= twice["n_real_train"] < twice["n_added"]
    assert got.where("policy = 'same rows' and ratio > 1").isEmpty()


def test_settings_and_prompt_sizes(spark):
    from surveyloom.operators import requests

    least = {"model": "m", "model_revision": "A" * 40, "backend": "b"}
    got = requests.resolved_settings(least)
    assert (got["model_revision"], got["max_retries"], got["top_k"]) == ("a" * 40, 2, -1)
    for bad in ({}, least | {"x": 1}, least | {"model_revision": "main"}, least | {"temperature": True}, least | {"top_p": 0}, least | {"top_k": 0}, least | {"seed": -1}, least | {"timeout": float("nan")}, least | {"max_tokens": 8192}, least | {"workers": 1.0}):
        with pytest.raises(ValueError):
            requests.resolved_settings(bad)
    rows = spark.createDataFrame([("a", [("user", "x y z")]), ("b", [("system", "q"), ("user", "r")])], "request_id string, messages array<struct<role:string,content:string>>")

    def count(messages):
        return sum(len(m["content"].split()) for m in messages)

    assert requests.checked_prompts(rows, count, 5, 8) == {"n_requests": 2, "max_input_tokens": 3, "max_tokens": 5, "context_window": 8}
    assert {r["request_id"]: r["fits"] for r in requests.prompt_sizes(rows, count, 5, 7).collect()} == {"a": False, "b": True}
    with pytest.raises(ValueError, match="1 prompts"):
        requests.checked_prompts(rows, count, 5, 7)


def test_documents_are_checked():
    from surveyloom.functions.instrument import SURVEY
    from surveyloom.operators import requests

    good = {d.name: {"about": ["x"], "items": [{"key": c, "label": c} for c in d.items]} for d in SURVEY.domains}
    assert requests.checked_documents(good) is good
    panic = good["panic"]
    for bad in ({k: v for k, v in good.items() if k != "panic"}, good | {"panic": panic | {"about": []}}, good | {"panic": panic | {"items": panic["items"][::-1]}}, good | {"panic": panic | {"items": panic["items"][:-1]}}, good | {"panic": panic | {"items": [i | {"label": " "} for i in panic["items"]]}}):
        with pytest.raises(ValueError):
            requests.checked_documents(bad)


def test_extra_attempts(spark, tmp_path):
    from surveyloom.streaming import journal

    rows = spark.createDataFrame([("p:panic", "panic", 4.0, "tier_0")], "request_id string, disorder string, score_target double, tier_code string")
    path = str(tmp_path / "j")

    def bad(request, seed):
        return "no"

    assert journal.run(spark, rows, path, bad, 1, retries=1).isEmpty()
    assert journal.run(spark, rows, path, bad, 1, retries=1).isEmpty()
    assert journal.effort(spark.read.schema(journal.ENTRY).parquet(path)).first()[:2] == (2, 1)
    assert journal.run(spark, rows, path, bad, 1, retries=1, extra=2).isEmpty()
    done = journal.effort(spark.read.schema(journal.ENTRY).parquet(path)).first()
    assert done["n_attempts"] == 4
    assert done["seconds"] >= 0
    with pytest.raises(ValueError, match="extra"):
        journal.run(spark, rows, path, bad, 1, extra=-1)
