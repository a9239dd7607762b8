"""Scoring, validation, sampling, folds, results, responses, journal, sources and models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.functions.instrument import SURVEY
from surveyloom.functions.responses import parse
from surveyloom.functions.scalars import fingerprint, norm_cdf, probit
from surveyloom.operators import confusion, copula, models, ranking, requests, resampling, results, scoring, summaries, utility
from surveyloom.plans.cohort import cohort
from surveyloom.sources import tables
from surveyloom.streaming import journal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    return cohort(spark, SF).cache()


@pytest.fixture(scope="module")
def summary(people):
    return summaries.cohort_summary(people)


def test_instrument():
    assert len(SURVEY.columns) == 71
    assert [SURVEY["depression"].tier_of_total(t) for t in (4, 5, 9, 10, 14, 15, 19, 20, 27)] == [0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [SURVEY["panic"].tier_of_total(t) for t in (4, 5, 14, 15, 24, 25, 34, 35, 40)] == [0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert len(SURVEY.predictors("depression")), len(SURVEY.predictors("panic")) == (62, 61)


def test_missing_item_nulls_its_domain_alone(people):
    row = scoring.score_table(people.withColumn("W1_panic_it3", F.lit(None).cast("int")).limit(1)).first()
    assert row["panic_score"] is None
    assert row["panic_tier_code"] is None
    assert row["depression_tier_code"] is not None


@pytest.mark.parametrize(("column", "value"), [("W1_panic_it1", "5"), ("W1_panic_it1", "-1"), ("W1_panic_it1", "cast(null as int)"), ("W1_sex_r", "3"), ("W1_age_r", "-1D"), ("W1_age_r", "20.5D")])
def test_validation_rejects(people, column, value):
    table = people.drop("ID").withColumn(column, F.expr(value))
    with pytest.raises(ValueError, match=column):
        scoring.validate(table)


def test_validation(people):
    assert scoring.validate(people.drop("ID")).count() == people.count()
    with pytest.raises(ValueError, match="columns"):
        scoring.validate(people)
    with pytest.raises(ValueError, match="no rows"):
        scoring.validate(people.drop("ID").limit(0))


def test_profiles_depend_on_person_alone(spark, summary):
    a = copula.profiles(spark, summary, 50, 7).orderBy("patient_id").collect()
    b = copula.profiles(spark, summary, 300, 7).repartition(7).orderBy("patient_id").collect()
    assert a == b[:50]
    assert copula.profiles(spark, summary, 50, 8).orderBy("patient_id").collect() != a
    uniform = {"panic": {f"tier_{k}": 0.2 for k in range(5)}}
    c = copula.profiles(spark, summary, 50, 7, uniform).orderBy("patient_id").collect()
    keep = [k for k in a[0].asDict() if not k.startswith("PANIC")]
    assert [[r[k] for k in keep] for r in a] == [[r[k] for k in keep] for r in c]


def test_profiles_follow_the_summary(spark, summary):
    rows = copula.profiles(spark, summary, 5000, 1)
    for t, p in summary["tier_prevalences"]["panic"].items():
        assert abs(rows.where(F.col("PANIC_TIER_CODE") == t).count() / 5000 - p) < 0.025
    assert abs(rows.where("AGE is null").count() / 5000 - summary["age_missing_rate"]) < 0.01
    assert rows.where("AGE < 18 or AGE >= 52").count() == 0
    both = "PANIC_SCORE_TARGET", "AGORAPHOBIA_SCORE_TARGET"
    assert rows.agg(F.corr(*both)).first()[0] > 0.4
    assert abs(copula.profiles(spark, summary, 5000, 1, dependence="independent").agg(F.corr(*both)).first()[0]) < 0.06
    assert requests.targets(rows).where("not valid").count() == 0


def test_repair():
    m, about = copula.repaired([[1.0, 0.999, 0.0], [0.999, 1.0, 0.046], [0.0, 0.046, 1.0]])
    assert about["repaired"]
    assert 0 < about["largest_change"] < 0.05
    assert np.linalg.eigvalsh(m).min() > 0
    for bad in ([[1, 2], [2, 1]], [[1, 0.5], [0.4, 1]], [[1.0, -0.9, -0.9], [-0.9, 1, -0.9], [-0.9, -0.9, 1]]):
        with pytest.raises(ValueError, match="correlation"):
            copula.repaired(bad)


def test_normal_functions(spark):
    rows = spark.createDataFrame([(p,) for p in (0.001, 0.5, 0.975, 0.0, 1.0)], "p double").select(probit("p").alias("z"), norm_cdf(probit("p")).alias("p")).collect()
    assert abs(rows[2]["z"] - 1.959963984540054) < 1e-12
    assert rows[3]["z"] is None
    assert abs(rows[0]["p"] - 0.001) < 1e-12


def test_summary_rejections(summary):
    for change in ({"age_missing_rate": 2}, {"sex_ratio": {"male": 1.0}}, {"age_histogram": {"18-20": 0.5, "19-30": 0.5}}, {"age_histogram": {"x": 1.0}}, {"disorders": ["panic"]}):
        with pytest.raises(ValueError):
            summaries.checked_summary(summary | change)


CLOSED = {"18-18": 0.123, "19-19": 0.221, "20-20": 0.169, "21-22": 0.246, "23-51": 0.242}


def test_bins_hold_both_ends(spark, summary):
    assert list(summary["age_histogram"]) == list(CLOSED)
    checked = summaries.checked_summary(summary | {"age_histogram": CLOSED})
    assert list(checked["age"]) == [(18, 18), (19, 19), (20, 20), (21, 22), (23, 51)]
    for bad in ({"18-19": 0.5, "19-20": 0.5}, {"20-19": 1.0}, {" 18-19": 1.0}, {"18-19\n": 1.0}, {}):
        with pytest.raises(ValueError):
            summaries.checked_summary(summary | {"age_histogram": bad})
    rows = copula.profiles(spark, summary | {"age_histogram": CLOSED, "age_missing_rate": 0.0}, 4000, 5)
    ages = {r["AGE"]: r["count"] / 4000 for r in rows.groupBy("AGE").count().collect()}
    assert set(ages) == set(range(18, 52))
    for (low, high), p in checked["age"].items():
        assert abs(sum(ages[a] for a in range(low, high + 1)) - p) < 0.03
    assert abs(ages[21] - ages[22]) < 0.03
    assert rows.agg(F.min("patient_id"), F.max("patient_id")).first()[:] == ("syn_aggregate_00001", "syn_aggregate_04000")
    nobody = copula.profiles(spark, summary | {"age_histogram": {}, "age_missing_rate": 1.0}, 50, 5)
    assert nobody.where("AGE is not null").isEmpty()


def test_bin_labels(spark):
    labels = ["18-18", "18-23", "23-18", "18 - 23", "x", "18-", None]
    rows = spark.createDataFrame([(x,) for x in labels], "bin string")
    got = {r["bin"]: (r["low"], r["high"], r["overlaps"]) for r in summaries.bin_overlap(rows.where("bin in ('18-18', '18-23')")).collect()}
    assert got == {"18-18": (18, 18, False), "18-23": (18, 23, True)}
    from surveyloom.functions.scalars import age_bin

    assert [r["b"] and tuple(r["b"]) for r in rows.select(age_bin(F.col("bin")).alias("b")).collect()] == [(18, 18), (18, 23), None, None, None, None, None]


def test_ranges_grow_with_the_table(spark, monkeypatch):
    """A range holds a bounded number of rows, and ranks are the same."""
    rows = spark.range(4000).selectExpr("id", "'one' as g", "md5(cast(id as string)) as k")
    plain = {r["id"]: r["rank"] for r in ranking.group_rank(rows, ["g"], "k", ["id"]).collect()}
    monkeypatch.setattr(ranking, "RANGE_ROWS", 1)
    assert {r["id"]: r["rank"] for r in ranking.group_rank(rows, ["g"], "k", ["id"]).collect()} == plain
    assert sorted(plain.values()) == list(range(1, 4001))


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(3000).selectExpr("id", "if(id < 2500, 'hot', 'cold') as g", "md5(cast(id as string)) as k")
    got = ranking.group_rank(rows, ["g"], "k", ["id"]).collect()
    for g in ("hot", "cold"):
        own = sorted((r["k"], r["rank"]) for r in got if r["g"] == g)
        assert [r for _, r in own] == list(range(1, len(own) + 1))


def test_folds(spark):
    rows = spark.range(200).selectExpr("id", "case when id < 3 then 'rare' when id % 2 = 0 then 'a' else 'b' end as tier")
    got = resampling.stratified_folds(rows, "id", "tier", 5, 2).collect()
    assert {r["folds"] for r in got} == {3}
    assert all(abs(sum(r["fold"] == f and r["tier"] == "a" and r["repeat"] == 0 for r in got) - 99 / 3) < 1.1 for f in range(3))
    single = resampling.stratified_folds(rows.where("id <> 1 and id <> 2"), "id", "tier", 5).collect()
    assert {r["folds"] for r in single} == {5}


def test_subsets(spark):
    rows = spark.range(40).toDF("id")
    assert resampling.subset(rows, "id", 10, 1, "x").select("id").distinct().count() == 10
    assert resampling.subset(rows, "id", 100, 1, "x").count() == 100
    pool = spark.range(60).selectExpr("id", "id as position")
    got = resampling.nested_subsets(pool, "id", "position", 20, 10, [0.5, 1, 2, 5], 3).collect()
    sets = {r: {x["id"] for x in got if x["ratio"] == r} for r in (0.5, 1.0, 2.0, 5.0)}
    assert [len(s) for s in sets.values()] == [5, 10, 20, 50]
    assert sets[0.5] < sets[1.0] < sets[2.0] < sets[5.0]
    assert sets[2.0] == set(range(20))
    with pytest.raises(ValueError, match="few"):
        resampling.nested_subsets(pool, "id", "position", 20, 10, [1, 10], 3)
    with pytest.raises(ValueError, match="ratios"):
        resampling.checked_ratios([2, 1])


def test_matched_counts_policies(spark):
    def frame(**n):
        return spark.createDataFrame(list(n.items()), "tier string, n long")

    got = {r["tier"]: (r["units"], r["policy"]) for r in resampling.matched_counts(frame(a=5, b=5), frame(a=1, c=2)).collect()}
    assert got == {"a": (3, "renormalised"), "b": (0, "renormalised")}
    got = {r["tier"]: (r["units"], r["policy"]) for r in resampling.matched_counts(frame(a=5, b=5), frame(c=3)).collect()}
    assert got == {"a": (2, "uniform"), "b": (1, "uniform")}


def test_pooled_recall_is_of_sums(spark):
    rows = [("f1", "tier_4", "tier_4", 1), ("f2", "tier_4", "tier_0", 3)]
    cells = spark.createDataFrame(rows, "fold string, truth string, predicted string, n long").withColumn("run", F.lit("x"))
    counts = confusion.tier_counts(cells, ["run", "fold"])
    r = confusion.ratios(confusion.pooled(counts, ["run"])).where("tier = 'tier_4'").first()
    assert r["recall"] == 0.25


def test_macro_f1_with_an_absent_tier(spark):
    rows = [(f"tier_{k}", f"tier_{k}") for k in range(4)]
    cells = confusion.confusion(spark.createDataFrame(rows, "t string, p string").withColumn("run", F.lit("x")), ["run"], "t", "p")
    m = confusion.macro(confusion.tier_counts(cells, ["run"]), ["run"]).first()
    assert (m["f1_macro"], m["recall_macro_observed"], m["accuracy"]) == (0.8, 1.0, 1.0)


def test_repeat_summary(spark):
    rows = [("a", s, r, v) for r, v in ((0, 0.1), (1, 0.2), (2, 0.3)) for s in (42, 43)] + [(None, 42, 0, 1.0)]
    got = {r["run"]: r for r in results.repeat_summary(spark.createDataFrame(rows, "run string, seed int, repeat int, value double"), ["run"]).collect()}
    assert abs(got["a"]["mean"] - 0.2) < 1e-12
    assert abs(got["a"]["sd"] - 0.1) < 1e-12
    assert got[None]["n_repeats"] == 1


def test_paired_difference_rejects_repeated_keys(spark):
    rows = spark.createDataFrame([(None, 0, 1.0), (None, 0, 2.0)], "k string, repeat int, value double")
    with pytest.raises(Exception, match="repeated"):
        results.paired_difference(rows, rows, ["k", "repeat"], ["k"]).collect()


GOOD = json.dumps({"scores": {c: 1 for c in SURVEY["depression"].items}})


@pytest.mark.parametrize(
    ("raw", "ok"),
    [(GOOD, True), (GOOD.replace("1,", "1.0,"), True), (GOOD.replace("1,", "1.5,"), False), (GOOD.replace("1,", "true,"), False), (GOOD.replace("1,", "4,"), False), (GOOD.replace("1,", "NaN,"), False), (GOOD.replace("1,", "1e400,"), False),
     (GOOD[:-1] + ', "more": 1}', False), (GOOD.replace('"W1_depression_it2"', '"W1_depression_it1"'), False), ("x" + GOOD, False), (None, False), ("[]", False), ("[" * 100_000, False)],
)
def test_strict_responses(raw, ok):
    assert (parse(raw, SURVEY["depression"])[0] is not None) == ok


def test_journal(spark, summary, tmp_path):
    rows = requests.targets(copula.profiles(spark, summary, 6, 3)).select(F.concat_ws(":", "patient_id", "disorder").alias("request_id"), "patient_id", "disorder", "score_target", "tier_code")
    calls = tmp_path / "calls"
    calls.mkdir()

    def flaky(request, seed):
        if request["attempt"] == 1 and request["disorder"] == "panic":
            return "not json"
        if request["disorder"] == "agoraphobia":
            raise journal.ProviderError("no", 404)
        return journal.even_answers(request, seed)

    got = journal.run(spark, rows, str(tmp_path / "journal"), flaky, 42)
    assert got.count() == 36
    assert got.where("not tier_match").count() == 0
    entries = spark.read.parquet(str(tmp_path / "journal"))
    assert {r["disorder"]: r["n"] for r in entries.selectExpr("substring_index(request_id, ':', -1) as disorder").groupBy("disorder").agg(F.count("*").alias("n")).collect()} == {d: 12 if d == "panic" else 6 for d in SURVEY.names}
    assert journal.run(spark, rows, str(tmp_path / "journal"), journal.even_answers, 42).count() == 36
    assert spark.read.parquet(str(tmp_path / "journal")).count() == entries.count()
    assert journal.checked_journal(entries, rows, 42).count() == entries.count()
    wide = requests.response_table(got.select(F.substring_index("request_id", ":", 1).alias("patient_id"), F.substring_index("request_id", ":", -1).alias("disorder"), "scores"))
    assert wide.count() == 6
    assert wide.where("W1_agoraphobia_it1 is not null").count() == 0
    assert requests.completion(rows, got).first()["status"] == "incomplete"
    stream = journal.progress_stream(spark, str(tmp_path / "journal")).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.sql("select sum(n) from progress").first()[0] == entries.count()


def test_torn_journal(spark, tmp_path):
    line = json.dumps({"request_id": "a:panic", "attempt": 1, "seed": 5, "valid": False})
    (tmp_path / "j.jsonl").write_text(f"{line}\n{line}\n{line[:20]}")
    assert journal.read_journal(spark, str(tmp_path / "j.jsonl")).count() == 2
    (tmp_path / "k.jsonl").write_text(f"{line}\n{line[:20]}\n{line[:9]}\n{line}")
    with pytest.raises(ValueError, match="can't be read"):
        journal.read_journal(spark, str(tmp_path / "k.jsonl"))


def test_rendering(spark, summary):
    documents = {d.name: {"about": [f"About {d.name}."], "items": [{"key": c, "label": c} for c in d.items]} for d in SURVEY.domains}
    p = copula.profiles(spark, summary, 3, 3)
    for context in ("own", "full"):
        rows = requests.rendered(p, documents, context).collect()
        assert len({r["request_id"] for r in rows}) == 21
        assert all(len(r["prompt_sha256"]) == 64 and SURVEY[r["disorder"]].items[-1] in r["messages"][1]["content"] for r in rows)
        assert all(("DEPRESSION: target" in r["messages"][1]["content"]) == (context == "full" or r["disorder"] == "depression") for r in rows)
    frame = requests.rendered(p, documents, "own")
    assert requests.extension_conflicts(frame, requests.rendered(copula.profiles(spark, summary, 5, 3), documents, "own")).isEmpty()
    assert requests.bundle_complete(frame, 7).where("complete").count() == 3


def test_sources(spark, people, tmp_path):
    path = str(tmp_path / "cohort")
    tables.write_new(people.drop("ID").limit(30), path, "csv")
    assert tables.read_cohort(spark, path).columns == SURVEY.columns
    with pytest.raises(Exception, match="already exists|PATH_ALREADY"):
        tables.write_new(people, path, "csv")
    block = str(tmp_path / "block")
    for v in (1, 2):
        tables.write_block(spark.createDataFrame([("a", v)], "domain string, v int"), block)
    tables.write_block(spark.createDataFrame([("b", 3)], "domain string, v int"), block)
    assert sorted((r["domain"], r["v"]) for r in spark.read.parquet(block).collect()) == [("a", 2), ("b", 3)]
    assert tables.committed_blocks(spark, block) == ["a", "b"]
    assert tables.committed_blocks(spark, str(tmp_path / "none")) == []
    assert fingerprint({"b": 1, "a": [1.5]}) == fingerprint({"a": [1.5], "b": 1})


def test_models_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) * 2
    x[rng.random(x.shape) < 0.02] = np.nan
    for grid in (models.LINEAR[2:4], models.BOOST[2:3]):
        choice = models.select(x[:200], y[:200], grid)
        assert (models.fit_predict(choice, x[:200], y[:200], x[200:]) == y[200:]).mean() > 0.85
        assert choice.score > 0.3
    alone = models.select(x[:10], np.full(10, 3), models.LINEAR)
    assert (alone.candidate, alone.score) == (models.LINEAR[0], None)
    assert set(models.fit_predict(alone, x[:10], np.full(10, 3), x)) == {3}


def test_utility(people):
    real, synthetic = people.where("ID % 2 = 0 and ID < 240"), people.where("ID % 2 = 1 and ID < 240")
    cells = utility.utility(real, {"a": synthetic}, ("logistic",), ["depression"], folds=2).cache()
    n = {r["protocol"]: r["n"] for r in cells.groupBy("protocol").agg(F.sum("n").alias("n")).collect()}
    assert n == {"TRTR": 120, "TSTR": 120, "TAUG": 120}
    m = confusion.macro(confusion.tier_counts(cells, ["protocol"]), ["protocol"]).collect()
    assert all(0 <= r["f1_macro"] <= 1 for r in m)
