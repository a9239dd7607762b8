"""Work of single tasks and passes over the tables doesn't grow faster than the tables."""

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import confusion, resampling, scoring, summaries
from surveyloom.plans import catalogue
from surveyloom.plans.cohort import cohort
from surveyloom.streaming import journal

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_requests_are_asked_once(spark, tmp_path):
    rows = spark.range(0, 200, 1, 1).selectExpr("concat('p', id, ':panic') as request_id", "'panic' as disorder", "double(id % 2) as score_target", "if(id % 3 = 0, null, 'tier_1') as tier_code", "0 as attempts")
    log = str(tmp_path / "log")

    def provider(request, seed):
        with open(log, "a") as f:
            f.write("x")
        return journal.even_answers(request, seed)

    plain = journal.attempted(rows, provider, 1).drop("elapsed_s")
    expected = sorted(map(repr, plain.collect()))
    assert len(open(log).read()) == 200
    provider.depends = ("disorder", "score_target")
    assert sorted(map(repr, journal.attempted(rows, provider, 1).drop("elapsed_s").collect())) == expected
    assert len(open(log).read()) == 204  # with or without a tier


def test_sides_are_made_once(spark):
    for side in catalogue.sides(spark, SMALL):
        assert not any("orders" in f for f in side.inputFiles())


def test_summary_reads_the_table_once(spark):
    people = cohort(spark, SMALL, True)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    summaries.cohort_summary(people.mapInArrow(count, people.schema))
    assert seen.value == people.count()


def test_one_domain_reads_its_items_alone(spark):
    rows = cohort(spark, SMALL, True)
    assert "depression" not in plan(scoring.long_scores(rows, keep=("ID",), domains=("panic",)))
    a, b = scoring.long_scores(rows, keep=("ID",), domains=("panic",)), scoring.long_scores(rows, keep=("ID",)).where("domain = 'panic'")
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("most", [3, 50_000])
def test_draws_in_parts(spark, monkeypatch, most):
    monkeypatch.setattr(resampling, "DRAWS", most, raising=False)
    rows = spark.range(40).selectExpr("id", "concat('t', id % 2) as tier")
    counts = spark.createDataFrame([("t0", 17), ("t1", 0)], "tier string, units long")
    got = resampling.matched_resample(rows, "id", "tier", counts, 1)
    assert sorted(r["copy"] for r in got.collect()) == list(range(1, 18))
    assert (got.where("tier <> 't0'").count(), "_part" in plan(got)) == (0, True)


def test_later_positions_are_in_many_ranges(spark, monkeypatch):
    seen, ranked = [], resampling.group_rank

    def spy(rows, group, key, tie, **more):
        seen.append(rows.where("_stage = 1").select(F.substring(key, 1, 2)).distinct().count())
        return ranked(rows, group, key, tie, **more)

    monkeypatch.setattr(resampling, "group_rank", spy)
    pool = spark.range(5000).selectExpr("id", "id as position")
    got = resampling.nested_subsets(pool, "id", "position", 1000, 1000, [1, 5], 3).where("ratio = 5 and place > 1000").orderBy("place")
    assert [r["id"] for r in got.collect()] == list(range(1000, 5000))
    assert seen[0] > 200


def test_scopes_share_the_metrics(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (1, "a", 5.0)], "repeat int, domain string, v double")
    got = confusion.scope_means(rows, ["repeat"], ["v"], {"one": ["a"], "both": ["a", "b"], "none": ["c"]})
    assert sorted(map(tuple, got.collect())) == [(0, "both", 2.0), (0, "one", 1.0), (1, "one", 5.0)]
    assert plan(got).count("LogicalRDD") + plan(got).count("LocalRelation") == 1
