"""The operators' queries over the driver's tables, and the same as DuckDB SQL.

Each entry is a function of (spark, sf_dir) with its SQL beside it, or without where SQL can't express it or is too
slow on whole tables. Doubles are rounded to nine decimals on both sides, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.instrument import SURVEY, TIERS
from surveyloom.functions.scalars import age_bin, attempt_seed, fingerprint, half_even, last_part
from surveyloom.operators import association, confusion, copula, distance, ranking, requests, resampling, results, scoring, summaries, utility
from surveyloom.operators.staging import kept
from surveyloom.plans.cohort import cohort, cohort_sql, halves
from surveyloom.streaming import journal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COHORT, MISSING = cohort_sql("//"), cohort_sql("//", True)
D = SURVEY.domains


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(r9(c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


# --- the same in SQL: totals, tiers, long form ---


def total_sql(d) -> str:
    return "(" + " + ".join(d.items) + ")"


def tier_sql(d, total: str) -> str:
    number = " + ".join(f"({total} {'>=' if d.mean else '>'} {c})::int" for c in d.cuts)
    return f"case when {total} is not null then 'tier_' || ({number}) end"


TOTALS = f"totals as (select ID, W1_age_r, W1_sex_r, {', '.join(f'{total_sql(d)} as t_{d.name}' for d in D)} from cohort)"
LONG = "long as (" + " union all ".join(f"select ID, W1_age_r, W1_sex_r, '{d.name}' as domain, t_{d.name}::int as total, {tier_sql(d, f't_{d.name}')} as tier from totals" for d in D) + ")"


def with_long(body: str, source: str = MISSING) -> str:
    return f"with cohort as ({source}), {TOTALS}, {LONG} {body}"


TIER_VALUES = "(values " + ", ".join(f"('{t}')" for t in TIERS) + ") g(tier)"
DOMAIN_VALUES = "(values " + ", ".join(f"('{d.name}')" for d in D) + ") h(domain)"


# --- scoring and quality ---


@query(
    f"with cohort as ({MISSING}), {TOTALS} select ID, "
    + ", ".join(f"{f't_{d.name} / {d.n_items}.0' if d.mean else f't_{d.name}::double'} as {d.score_column}, {tier_sql(d, f't_{d.name}')} as {d.tier_column}" for d in D)
    + " from totals"
)
def score_tiers(spark, sf_dir):
    return scoring.score_table(cohort(spark, sf_dir, True), keep=("ID",))


SQL["score_tiers"] = SQL["score_tiers"].replace("/ 10.0", "::double / 10.0::double")


@query(
    f"with cohort as ({MISSING}) "
    + " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null) as n_null, count(*) filter ({bad}) as n_bad from cohort" for c, bad in [("W1_sex_r", "W1_sex_r is null or W1_sex_r not in (1, 2)"), ("W1_age_r", "W1_age_r < 0 or W1_age_r <> floor(W1_age_r)"), *((c, f"{c} is null or {c} < 0 or {c} > {d.top}") for d in D for c in d.items)])
)
def quality_report(spark, sf_dir):
    return scoring.quality_report(cohort(spark, sf_dir, True))


@query("select o_custkey as id, count(*) as n from orders group by 1 having count(*) > 1 or o_custkey is null")
def duplicate_ids(spark, sf_dir):
    return scoring.duplicate_ids(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey")


@query("select * from (values " + ", ".join(f"('{d.name}', 'tier_{t}', {x}::int, {x / d.n_items if d.mean else float(x)}::double)" for d in D for t in range(5) for x in d.attainable(t)) + ") v(domain, tier, total, score)")
def attainable_scores(spark, sf_dir):
    return scoring.attainable_scores(spark)


@query(with_long("select ID, count(*) filter (tier is not null and total = 0) as n_zero, count(*) as n from long group by ID", COHORT))
def valid_targets(spark, sf_dir):
    rows = scoring.long_scores(cohort(spark, sf_dir), keep=("ID",))
    ok = F.lit(False)
    for d in D:
        ok = ok | ((F.col("domain") == d.name) & scoring.valid_target(d, d.score_of(F.col("total")), F.col("tier")))
    return rows.groupBy("ID").agg(F.count_if(ok & (F.col("total") == 0)).alias("n_zero"), F.count_if(ok).alias("n"))


# --- summaries ---


@query(with_long(f"select h.domain, g.tier, count(l.ID) as n, round(count(l.ID)::double / sum(count(l.ID)) over (partition by h.domain), 9) as share, round(count(l.ID) * 100.0::double / (select count(*) from cohort), 9) as percent from {DOMAIN_VALUES} cross join {TIER_VALUES} left join long l on l.domain = h.domain and l.tier = g.tier group by 1, 2"))
def tier_prevalence(spark, sf_dir):
    return rounded(summaries.tier_prevalence(cohort(spark, sf_dir, True)))


@query(f"with cohort as ({COHORT}) select s.sex, count(ID) as n, round(count(ID)::double / sum(count(ID)) over (), 9) as share from (values ('male', 1), ('female', 2)) s(sex, code) left join cohort on W1_sex_r = code group by 1")
def sex_ratio(spark, sf_dir):
    return rounded(summaries.sex_ratio(cohort(spark, sf_dir)))


_BINS = list(zip(summaries.AGE_EDGES, summaries.AGE_EDGES[1:], strict=False))


@query(
    f"with cohort as ({COHORT}), b as (select * from (values " + ", ".join(f"('{a}-{b - 1}', {a}, {b})" for a, b in _BINS) + ") v(bin, lo, hi)), counts as (select bin, count(ID) as n from b left join cohort on W1_age_r >= lo and W1_age_r < hi group by 1 union all select 'outside', count(*) from cohort where W1_age_r < 18 or W1_age_r >= 52) "
    "select bin, n, round(n::double / (select count(W1_age_r) from cohort), 9) as share from counts"
)
def age_histogram(spark, sf_dir):
    return rounded(summaries.age_histogram(cohort(spark, sf_dir)))


@query(f"with cohort as ({COHORT}) select count(*) as n, count(W1_age_r) as n_observed_age, count(*) - count(W1_age_r) as n_missing_age, round((count(*) - count(W1_age_r))::double / count(*), 9) as missing_rate, min(W1_age_r) as min_age, max(W1_age_r) as max_age from cohort")
def age_missing(spark, sf_dir):
    return rounded(summaries.age_missing(cohort(spark, sf_dir)))


@query(with_long("select domain, count(distinct total) as n_distinct from long group by 1"))
def score_distinct(spark, sf_dir):
    return summaries.distinct_scores(cohort(spark, sf_dir, True))


@query("select o_orderpriority, o_orderstatus, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by o_orderpriority), 9) as probability from orders group by 1, 2")
def probability_normalise(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return rounded(summaries.normalised(counts, ["o_orderpriority"], "n"))


@query("with b as (select distinct (p_size // 5 * 4)::varchar || '-' || (p_size // 5 * 4 + 3 + p_size // 25 * 2)::varchar as bin from part), c as (select bin, split_part(bin, '-', 1)::int as low, split_part(bin, '-', 2)::int as high from b) select bin, low, high, coalesce(lag(high) over (order by low, high) >= low, false) as overlaps from c")
def bin_overlap(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat(p_size div 5 * 4, '-', p_size div 5 * 4 + 3 + p_size div 25 * 2) as bin").distinct()
    return summaries.bin_overlap(labels)


@query("with x as (select p_partkey, p_size::varchar || '-' || (p_size + p_partkey % 3 - 1)::varchar as label, p_size as lo, (p_size + p_partkey % 3 - 1)::int as hi from part) select p_partkey, label, case when hi >= lo then lo::int end as low, case when hi >= lo then hi end as high from x")
def age_bin_parse(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "concat(p_size, '-', p_size + p_partkey % 3 - 1) as label")
    return rows.withColumn("b", age_bin(F.col("label"))).select("p_partkey", "label", "b.low", "b.high")


_EDGES = "edges as (select list_sort(list_distinct(quantile_cont(W1_age_r, [0, 0.2, 0.4, 0.6, 0.8, 1]))) as e from cohort where ID % 2 = 0)"
_AGE_CODE = "case when W1_age_r is null then -1 else len(list_filter(e[2:len(e) - 1], lambda x: W1_age_r > x)) end::int"


@query(f"with cohort as ({COHORT}), {_EDGES} select ID, W1_age_r, nullif({_AGE_CODE}, -1) as bin from cohort, edges")
def age_quantile_bins(spark, sf_dir):
    rows = cohort(spark, sf_dir)
    edges = summaries.quantile_edges(halves(rows)[0], "W1_age_r")
    return rows.select("ID", "W1_age_r", summaries.binned(F.col("W1_age_r"), edges).alias("bin"))


# --- histograms, divergence, association ---

_CODES = f"codes as (select case when ID % 2 = 0 then 'real' else 'synthetic' end as src, {_AGE_CODE} as W1_age_r, " + ", ".join(f"coalesce({c}, -1)::int as {c}" for c in SURVEY.columns[1:]) + " from cohort, edges)"
_CELLS = "cells as (" + " union all ".join(f"select '{c}' as \"column\", {c} as code, src from codes" for c in SURVEY.columns) + ")"
_HIST = f"with cohort as ({COHORT}), {_EDGES}, {_CODES}, {_CELLS}, hist as (select \"column\", code, count(*) filter (src = 'real') as n_real, count(*) filter (src = 'synthetic') as n_synthetic from cells group by 1, 2)"
_JSD = f"{_HIST}, p as (select \"column\", n_real::double / sum(n_real) over (partition by \"column\") as p, n_synthetic::double / sum(n_synthetic) over (partition by \"column\") as q from hist), jsd as (select \"column\", sum(case when p > 0 then 0.5 * p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then 0.5 * q * log2(2 * q / (p + q)) else 0 end) as jsd from p group by 1)"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.encoded(*halves(cohort(spark, sf_dir)))


@query(f"{_HIST} select * from hist")
def category_histogram(spark, sf_dir):
    return association.histogram(codes(spark, sf_dir), SURVEY.columns)


@query(f'{_JSD} select "column", round(greatest(jsd, 0), 9) as jsd from jsd')
def jsd_per_column(spark, sf_dir):
    return rounded(association.divergence(association.histogram(codes(spark, sf_dir), SURVEY.columns)))


@query(f"{_JSD} select round(avg(greatest(jsd, 0)), 9) as jsd from jsd")
def jsd_mean(spark, sf_dir):
    return rounded(association.divergence(association.histogram(codes(spark, sf_dir), SURVEY.columns)).agg(F.avg("jsd").alias("jsd")))


_NUMBER = {c: i for i, c in enumerate(SURVEY.columns)}
_PAIRS = f"with cohort as ({COHORT}), {_EDGES}, {_CODES}, wide as (select src, [{', '.join(SURVEY.columns)}] as x from codes), names as (select [{', '.join(repr(c) for c in SURVEY.columns)}] as n), pairs as (select i.i as i, j.j as j from range(1, 72) i(i), range(1, 72) j(j) where i.i < j.j), cont as (select src, i, j, x[i] as code_a, x[j] as code_b, count(*) as n from wide, pairs group by all)"
_V = f"{_PAIRS}, m as (select *, sum(n) over (partition by src, i, j, code_a) as ra, sum(n) over (partition by src, i, j, code_b) as cb from cont), s as (select src, i, j, sum(n::double * n / (ra::double * cb)) - 1 as phi, sum(n)::double as n, count(distinct code_a) - 1.0::double as r, count(distinct code_b) - 1.0::double as c from m group by all), v as (select src, i, j, case when r > 0 and c > 0 and n >= 2 and least(r - r * r / (n - 1), c - c * c / (n - 1)) > 0 then sqrt(greatest(0, phi - r * c / (n - 1)) / least(r - r * r / (n - 1), c - c * c / (n - 1))) else 0 end as v from s)"


def association_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.cramers_v(association.contingency(codes(spark, sf_dir), SURVEY.columns), ["src", "a", "b"])


@query(f"{_PAIRS} select src, (select n from names)[i] as a, (select n from names)[j] as b, code_a, code_b, cont.n from cont")
def contingency(spark, sf_dir):
    return association.contingency(codes(spark, sf_dir), SURVEY.columns)


@query(f"{_V} select src, (select n from names)[i] as a, (select n from names)[j] as b, round(v, 9) as v from v")
def cramers_v(spark, sf_dir):
    return rounded(association_rows(spark, sf_dir))


_DOMAIN_NO = "[" + ", ".join(str(-1 if SURVEY.domain_of(c) is None else SURVEY.names.index(SURVEY.domain_of(c))) for c in SURVEY.columns) + "]"


@query(
    f"{_V}, e as (select i, j, abs(sum(case when src = 'real' then v else -v end)) as e, {_DOMAIN_NO}[i] as da, {_DOMAIN_NO}[j] as db from v group by i, j) select round(avg(e), 9) as mae_v, round(avg(e) filter (da >= 0 and db >= 0 and da <> db), 9) as between_disorder_mae_v, round(avg(e) filter (da >= 0 and da = db), 9) as within_questionnaire_mae_v, "
    "count(*) as n_pairs, count(*) filter (da >= 0 and db >= 0 and da <> db) as n_between, count(*) filter (da >= 0 and da = db) as n_within from e"
)
def association_mae(spark, sf_dir):
    return rounded(association.association_error(association_rows(spark, sf_dir)))


@query(
    "with c as (select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2), m as (select *, sum(n) over (partition by l_returnflag) as ra, sum(n) over (partition by l_linestatus) as cb from c), s as (select sum(n::double * n / (ra::double * cb)) - 1 as phi, sum(n)::double as n, count(distinct l_returnflag) - 1.0::double as r, count(distinct l_linestatus) - 1.0::double as k from m) "
    "select 'lineitem' as \"table\", round(sqrt(greatest(0, phi - r * k / (n - 1)) / least(r - r * r / (n - 1), k - k * k / (n - 1))), 9) as v from s"
)
def flag_association(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.lit("lineitem").alias("table"), F.col("l_returnflag").alias("code_a"), F.col("l_linestatus").alias("code_b")).agg(F.count("*").alias("n"))
    return rounded(association.cramers_v(cells, ["table"]))


# --- distances: SQL over all pairs is too slow; tests compare with brute force ---


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = kept(distance.distinct_rows(codes(spark, sf_dir), SURVEY.columns, ["src"]), "distinct")
    return tuple(c.where(F.col("src") == s).drop("src") for s in ("real", "synthetic"))


# Pairs of distinct rows with their numbers; K: mismatches of a pair.
_COLUMNS = ", ".join(SURVEY.columns)
_K = " + ".join(f"(a.{c} <> b.{c})::int" for c in SURVEY.columns)
_SIDES = f"with cohort as ({COHORT}), {_EDGES}, {_CODES}, x as (select row_number() over () as id, * from (select {_COLUMNS}, count(*) as w from codes where src = 'real' group by all)), y as (select row_number() over () as id, * from (select {_COLUMNS}, count(*) as w from codes where src = 'synthetic' group by all))"
_W = float(len(SURVEY.columns))


def _histogram_sql(left: str, right: str) -> str:
    return f"select ({_K})::int as k, sum(a.w * b.w)::bigint as n from {left} a, {right} b group by 1"


def _mean_sql(left: str, right: str) -> str:
    pairs = "sum(n)" if left != right else f"(select sum(w) * (sum(w) - 1) from {left})"
    return f"(select sum(n * sqrt(k / {_W}::double)) / {pairs} from ({_histogram_sql(left, right)}))"


def _proximity_sql(left: str, right: str) -> str:
    own = " - (a.id = b.id)::int" if left == right else ""
    return f"""{_SIDES}, near as (select a.id, any_value(a.w) as w, {_K} as k, sum(b.w{own}) as n from {left} a, {right} b group by a.id, 3 having sum(b.w{own}) > 0),
two as (select id, any_value(w) as w, min(k) as d1, case when arg_min(n, k) >= 2 then min(k) else list_sort(list(k))[2] end as d2 from near group by id),
each as (select d1, d2, unnest(range(w)) from two)
select round(avg(d1 / {_W}::double), 9) as dcr_mean, round(quantile_cont(d1 / {_W}::double, 0.05), 9) as dcr_p05, round(100.0::double * count(*) filter (d1 = 0) / count(*), 9) as exact_percent, round(quantile_cont(case when d2 > 0 then d1 / d2::double else 1.0::double end, 0.05), 9) as nndr_p05 from each"""


@query(f"{_SIDES} {_histogram_sql('x', 'y')}")
def hamming_pairs(spark, sf_dir):
    return distance.pair_histogram(*sides(spark, sf_dir), large=True)


@query(f"{_SIDES} select round(sqrt(greatest(0, 2 * {_mean_sql('x', 'y')} - {_mean_sql('x', 'x')} - {_mean_sql('y', 'y')})), 9) as energy")
def energy_distance(spark, sf_dir):
    value = distance.energy(*sides(spark, sf_dir), len(SURVEY.columns), large=True)
    return spark.createDataFrame([(value,)], "energy double").select(r9("energy").alias("energy"))


@query(_proximity_sql("y", "x"))
def dcr_nndr(spark, sf_dir):
    real, synthetic = sides(spark, sf_dir)
    return rounded(distance.proximity(distance.two_nearest(synthetic, real, large=True), len(SURVEY.columns)))


@query(_proximity_sql("x", "x"))
def loo_proximity(spark, sf_dir):
    real, _ = sides(spark, sf_dir)
    return rounded(distance.proximity(distance.two_nearest(real, real, leave_out=True, large=True), len(SURVEY.columns)))


# --- ranks and correlation ---


@query(with_long("select domain, total, count(*) as n, max(r) as rank from (select domain, total, rank() over (partition by domain order by total) + (count(*) over (partition by domain, total) - 1) / 2.0::double as r from long where total is not null) group by 1, 2"))
def average_rank(spark, sf_dir):
    return summaries.score_ranks(cohort(spark, sf_dir, True)).withColumn("rank", F.col("rank").cast("double"))


_RANKED = ", ".join(f"rank() over (order by t_{d.name}) + (count(*) over (partition by t_{d.name}) - 1) / 2.0::double as r{i}" for i, d in enumerate(D))


@query(f"with cohort as ({MISSING}), {TOTALS}, r as (select {_RANKED} from totals where t_depression is not null), w as (select " + ", ".join(f"corr(r{i}, r{j}) as c{i}_{j}" for i in range(7) for j in range(i + 1, 7)) + " from r) " + " union all ".join(f"select '{D[i].name}' as a, '{D[j].name}' as b, round(c{i}_{j}, 9) as r from w" for i in range(7) for j in range(i + 1, 7)))
def rank_pearson(spark, sf_dir):
    return rounded(summaries.rank_correlation(cohort(spark, sf_dir, True), transform=False))


@query()
def rank_probit_correlation(spark, sf_dir):
    return summaries.rank_correlation(cohort(spark, sf_dir, True))


@query()
def cohort_aggregates(spark, sf_dir):
    return summaries.frame_of(spark, summaries.cohort_summary(cohort(spark, sf_dir, True)))


# --- sampling given uniforms ---

_SHARES = {"tier_0": 0.4, "tier_1": 0.0, "tier_2": 0.3, "tier_3": 0.2, "tier_4": 0.1}


def _cdf_sql(d, u: str) -> str:
    out, upto, steps = "", 0.0, []
    active = [(k, p) for k, p in enumerate(_SHARES.values()) if p > 0]
    for n, (k, p) in enumerate(active):
        below, upto = upto, 1.0 if n == len(active) - 1 else upto + p
        steps.append((k, p, below, upto))
    for k, p, below, upto in steps[:-1]:
        t = d.attainable(k)
        out += f"when {u} < {upto!r}::double then {{'tier': 'tier_{k}', 'total': {t}[least(floor(({u} - {below!r}::double) / {p!r}::double * {len(t)})::int, {len(t) - 1}) + 1]}} "
    k, p, below, _ = steps[-1]
    t = d.attainable(k)
    return f"case {out} else {{'tier': 'tier_{k}', 'total': {t}[least(floor(({u} - {below!r}::double) / {p!r}::double * {len(t)})::int, {len(t) - 1}) + 1]}} end"


_U = "((o_orderkey * 7919) % 10007) / 10007.0::double"


@query(f"with x as (select o_orderkey, {_U} as u from orders), y as (select o_orderkey, {_cdf_sql(D[0], 'u')} as d, {_cdf_sql(D[1], 'u')} as a from x) select o_orderkey, d.tier as dep_tier, d.total::int as dep_total, a.tier as anx_tier, a.total::int as anx_total from y")
def inverse_tier_cdf(spark, sf_dir):
    u = F.expr("((o_orderkey * 7919) % 10007) / 10007.0D")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", copula.inverse_tier_cdf(u, D[0], _SHARES).alias("d"), copula.inverse_tier_cdf(u, D[1], _SHARES).alias("a"))
    return rows.select("o_orderkey", F.col("d.tier").alias("dep_tier"), F.col("d.total").alias("dep_total"), F.col("a.tier").alias("anx_tier"), F.col("a.total").alias("anx_total"))


@query(f"select o_orderkey, case when {_U} < 0.25 then 'a' when {_U} < 0.75 then 'c' else 'd' end as category from orders")
def category_draw(spark, sf_dir):
    u = F.expr("((o_orderkey * 7919) % 10007) / 10007.0D")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", copula.category_at(u, {"a": 0.25, "b": 0.0, "c": 0.5, "d": 0.25}).alias("category"))


@query(f"with x as (select o_orderkey, {_U} as u, ((o_orderkey * 104729) % 10009) / 10009.0::double as v from orders) select o_orderkey, case when u < 0.25 then 18 when u < 0.5 then 19 + floor(v * 2)::int when u < 0.75 then 21 + floor(v * 2)::int else 23 + floor(v * 29)::int end as age from x")
def age_draw(spark, sf_dir):
    u, v = F.expr("((o_orderkey * 7919) % 10007) / 10007.0D"), F.expr("((o_orderkey * 104729) % 10009) / 10009.0D")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", copula.age_at(u, v, {(18, 18): 0.25, (19, 20): 0.25, (21, 22): 0.25, (23, 51): 0.25}).alias("age"))


@query()
def copula_profiles(spark, sf_dir):
    summary = summaries.cohort_summary(cohort(spark, sf_dir))
    return copula.profiles(spark, summary, summary["n"], 42)


# --- apportionment, subsets, folds ---

_REMAINDER = "a as (select *, floor(e)::bigint as f, sum(floor(e)) over (partition by domain) as s, row_number() over (partition by domain order by e - floor(e) desc, tier) as k from q)"


@query(with_long(f", c as (select domain, tier, count(*) as n from long where tier is not null group by 1, 2), q as (select domain, tier, n, 100 * n::double / sum(n) over (partition by domain) as e from c), {_REMAINDER} select domain, tier, n, (f + (k <= 100 - s)::int)::bigint as units from a"))
def largest_remainder(spark, sf_dir):
    counts = scoring.long_scores(cohort(spark, sf_dir, True)).where("tier is not null").groupBy("domain", "tier").agg(F.count("*").alias("n"))
    return ranking.largest_remainder(counts, ["domain"], "tier", "n", F.lit(100))


@query(with_long(", h as (select tier, count(*) as have from long where domain = 'panic' and tier in ('tier_0', 'tier_2', 'tier_3') group by 1), q0 as (select tier, count(*) as requested from long where domain = 'depression' and tier is not null group by 1), t as (select sum(requested) as total from q0), q as (select 'x' as domain, h.tier, coalesce(requested, 0) as requested, total::double * coalesce(requested, 0) / sum(coalesce(requested, 0)) over () as e, total from h left join q0 using (tier), t), " + _REMAINDER + " select tier, requested, (f + (k <= total - s)::int)::bigint as units, 'renormalised' as policy from a"))
def matched_counts(spark, sf_dir):
    long = scoring.long_scores(cohort(spark, sf_dir, True)).where("tier is not null")
    available = long.where("domain = 'panic' and tier in ('tier_0', 'tier_2', 'tier_3')").groupBy("tier").agg(F.count("*").alias("n"))
    return resampling.matched_counts(available, long.where("domain = 'depression'").groupBy("tier").agg(F.count("*").alias("n")))


def _n_orders(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").count()


_NEST = "with s as (select count(*) // 4 as ref, count(*) // 8 as n from orders), p as (select o_orderkey, o_orderkey as position, case when o_orderkey < ref then md5('42/x/' || o_orderkey) end as k, ref, n from orders, s), o as (select *, row_number() over (order by (k is null), k, position) as place from p) select r.r as ratio, place, o_orderkey from o, (values (0.5::double), (1.0), (2.0), (5.0)) r(r) where place <= ceil(r.r * n)"


@query(_NEST)
def nested_subsets(spark, sf_dir):
    n = _n_orders(spark, sf_dir)
    pool = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").alias("position"))
    return resampling.nested_subsets(pool, "o_orderkey", "position", n // 4, n // 8, [0.5, 1, 2, 5], 42, "x").drop("position")


@query(with_long(", f as (select ID, tier, row_number() over (partition by tier order by md5('42/0/' || ID), ID) as k, (select min(n) from (select count(*) as n from long where domain = 'panic' group by tier)) as least from long where domain = 'panic') select ID, tier, 0 as repeat, ((k - 1) % least(5, least))::int as fold, least(5, least)::int as folds from f", COHORT))
def stratified_folds(spark, sf_dir):
    rows = scoring.long_scores(cohort(spark, sf_dir), keep=("ID",), domains=("panic",)).select("ID", "tier")
    return resampling.stratified_folds(rows, "ID", "tier").withColumn("folds", F.col("folds").cast("int"))


@query("with s as (select l_orderkey, l_suppkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as k from lineitem) select l_suppkey, 1::bigint as n, (hash_fold)::int as fold from (select l_suppkey, row_number() over (order by md5('42/0/' || l_suppkey), l_suppkey) % 3 as hash_fold from s where k = 1)")
def leakage_zero(spark, sf_dir):
    """Copies of a source are dropped before folds are dealt: each source is in one fold."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("position"))
    one = resampling.unique_sources(rows, "l_suppkey", "position").withColumn("_key", resampling.order_key(42, F.lit(0), F.col("l_suppkey"))).withColumn("_one", F.lit(0))
    ranked = ranking.group_rank(one, ["_one"], "_key", ["l_suppkey"])
    return ranked.groupBy("l_suppkey", (F.col("rank") % 3).cast("int").alias("fold")).agg(F.count("*").alias("n"))


@query(with_long(", h as (select tier, count(*) as have from long where domain = 'panic' group by 1) select tier, have // 2 as units, least(have, have // 2) > 0 as drawn from h", COHORT))
def matched_resample(spark, sf_dir):
    rows = scoring.long_scores(cohort(spark, sf_dir), keep=("ID",), domains=("panic",)).select("ID", "tier")
    counts = rows.groupBy("tier").agg(F.expr("count(*) div 2").alias("units"))
    drawn = resampling.matched_resample(rows, "ID", "tier", counts, 42, "resample")
    return drawn.groupBy("tier").agg(F.count("*").alias("units"), (F.count("*") > 0).alias("drawn"))


# --- confusion: the tier of the next domain is the prediction ---

_PRED = ", pred as (select a.ID, a.domain, a.tier as truth, b.tier as predicted, (a.ID % 5)::int as fold, (a.ID % 3)::int as repeat from long a join (values " + ", ".join(f"('{D[i].name}', '{D[(i + 1) % 7].name}')" for i in range(7)) + ") n(domain, next) on a.domain = n.domain join long b on b.ID = a.ID and b.domain = n.next where a.tier is not null and b.tier is not null)"
_GRID = f"grid as (select * from {TIER_VALUES.replace('g(tier)', 'g(truth)')} cross join {TIER_VALUES.replace('g(tier)', 'k(predicted)')})"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scoring.score_table(cohort(spark, sf_dir, True), keep=("ID",))
    each = F.array(*(F.struct(F.lit(D[i].name).alias("domain"), F.col(D[i].tier_column).alias("truth"), F.col(D[(i + 1) % 7].tier_column).alias("predicted")) for i in range(7)))
    rows = t.select("ID", F.explode(each).alias("p")).select("ID", "p.*", (F.col("ID") % 5).cast("int").alias("fold"), (F.col("ID") % 3).cast("int").alias("repeat"))
    return rows.where("truth is not null and predicted is not null")


def _cells_sql(by: str) -> str:
    return f"keys as (select distinct {by} from pred), cells as (select {', '.join('keys.' + b.strip() for b in by.split(','))}, grid.truth, grid.predicted, count(pred.ID) as n from keys cross join grid left join pred on {' and '.join(f'pred.{b.strip()} = keys.{b.strip()}' for b in by.split(','))} and pred.truth = grid.truth and pred.predicted = grid.predicted group by all)"


def _counts_sql(by: str) -> str:
    return f"counts as (select {by}, tier, sum(n) filter (truth = tier and predicted = tier)::bigint as tp, sum(n) filter (truth <> tier and predicted = tier)::bigint as fp, sum(n) filter (truth = tier and predicted <> tier)::bigint as fn, sum(n) filter (truth = tier)::bigint as support from cells cross join {TIER_VALUES} group by all)"


_RATIOS = "round(case when tp + fp > 0 then tp::double / (tp + fp) end, 9) as precision, round(case when tp + fn > 0 then tp::double / (tp + fn) end, 9) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp::double / (2 * tp + fp + fn) else 0 end, 9) as f1"
_MACRO = "avg(case when 2 * tp + fp + fn > 0 then 2 * tp::double / (2 * tp + fp + fn) else 0 end) as f1_macro, avg(case when tp + fp > 0 then tp::double / (tp + fp) else 0 end) as precision_macro, avg(case when tp + fn > 0 then tp::double / (tp + fn) end) as recall_macro_observed, sum(tp)::double / sum(support) as accuracy, sum(support)::bigint as n_test"


def _conf(by: str, body: str) -> str:
    return with_long(f"{_PRED}, {_GRID}, {_cells_sql(by)}, {_counts_sql(by)} {body}")


_ROUND = "round(f1_macro, 9) as f1_macro, round(precision_macro, 9) as precision_macro, round(recall_macro_observed, 9) as recall_macro_observed, round(accuracy, 9) as accuracy, n_test"


@query(_conf("domain, repeat, fold", "select domain, repeat, fold, truth, predicted, n from cells"))
def confusion_counts(spark, sf_dir):
    return confusion.confusion(predicted(spark, sf_dir), ["domain", "repeat", "fold"], "truth", "predicted")


def fold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["domain", "repeat", "fold"]
    return confusion.tier_counts(confusion.confusion(predicted(spark, sf_dir), by, "truth", "predicted"), by)


@query(_conf("domain, repeat, fold", f"select domain, repeat, fold, tier, tp, fp, fn, support, {_RATIOS} from counts"))
def tier_metrics(spark, sf_dir):
    return rounded(confusion.ratios(fold_counts(spark, sf_dir)))


def pooled_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion.macro(confusion.pooled(fold_counts(spark, sf_dir), ["domain", "repeat"]), ["domain", "repeat"])


_POOLED = f", m as (select domain, repeat, {_MACRO} from (select domain, repeat, tier, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(support) as support from counts group by all) group by all)"


@query(_conf("domain, repeat, fold", f"{_POOLED} select domain, repeat, {_ROUND} from m"))
def pooled_repeats(spark, sf_dir):
    return rounded(pooled_macro(spark, sf_dir))


_SCOPES = {"all": SURVEY.names, "targeted": ["panic", "depression"], "incomplete": ["panic", "nowhere"]}


@query(_conf("domain, repeat, fold", f"{_POOLED} select repeat, 'all' as scope, round(avg(f1_macro), 9) as f1_macro, round(avg(accuracy), 9) as accuracy from m group by repeat having count(distinct domain) = 7 union all select repeat, 'targeted', round(avg(f1_macro), 9), round(avg(accuracy), 9) from m where domain in ('panic', 'depression') group by repeat having count(distinct domain) = 2"))
def scope_means(spark, sf_dir):
    return rounded(confusion.scope_means(pooled_macro(spark, sf_dir), ["repeat"], ["f1_macro", "accuracy"], _SCOPES))


@query(_conf("domain, repeat, fold", f"select repeat, tier, tp, fp, fn, support, {_RATIOS} from (select repeat, tier, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(support)::bigint as support from counts where domain in ('panic', 'depression') group by all)"))
def targeted_pooled(spark, sf_dir):
    return rounded(confusion.tiers_pooled(fold_counts(spark, sf_dir), ["repeat"], ["panic", "depression"]))


_UP = "u as (select domain, repeat, sum(n) filter (truth >= 'tier_3' and predicted >= 'tier_3') as tp, sum(n) filter (truth < 'tier_3' and predicted >= 'tier_3')::bigint as upper_false_positives, sum(n) filter (truth >= 'tier_3')::bigint as upper_support from cells group by all), v as (select domain, repeat, round(case when upper_support > 0 then tp::double / upper_support end, 9) as upper_recall, round(case when tp + upper_false_positives > 0 then tp::double / (tp + upper_false_positives) end, 9) as upper_precision, upper_false_positives, upper_support from u)"


@query(_conf("domain, repeat", f", {_UP} select * from v"))
def upper_tier(spark, sf_dir):
    by = ["domain", "repeat"]
    return rounded(confusion.upper_tiers(confusion.confusion(predicted(spark, sf_dir), by, "truth", "predicted"), by))


@query(_conf("domain, repeat", f", {_UP}, m as (select domain, repeat, {_MACRO} from counts group by all) select domain, repeat, {_ROUND}, upper_recall, upper_precision, upper_false_positives, upper_support from m join v using (domain, repeat)"))
def curve_summary(spark, sf_dir):
    by = ["domain", "repeat"]
    return rounded(confusion.curve_summary(confusion.confusion(predicted(spark, sf_dir), [*by, "fold"], "truth", "predicted"), by))


@query("select quality, toxic, count(*) as n from labels group by 1, 2")
def label_confusion(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


# --- results over seeds and repeats: customers stand for runs, priorities for seeds ---

_METRICS = "metrics as (select o_orderstatus as run, o_orderpriority as seed, (o_custkey % 3)::int as repeat, case when o_custkey % 10 = 0 then null else 'c' || (o_custkey % 4) end as context, o_totalprice / 1000 as value, o_orderkey from orders)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderstatus as run", "o_orderpriority as seed", "cast(o_custkey % 3 as int) as repeat", "case when o_custkey % 10 = 0 then null else concat('c', o_custkey % 4) end as context", "o_totalprice / 1000 as value", "o_orderkey")


@query(
    f"with {_METRICS}, w as (select run, context, repeat, avg(value) as m from metrics group by all), o as (select run, context, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, count(*) as n_repeats from w group by all), s0 as (select run, context, seed, avg(value) as m from metrics group by all), s as (select run, context, round(stddev_samp(m), 6) as seed_sd, count(*) as n_seeds from s0 group by all) "
    "select o.*, s.seed_sd, s.n_seeds from o join s on o.run is not distinct from s.run and o.context is not distinct from s.context"
)
def seed_repeat_summary(spark, sf_dir):
    got = results.repeat_summary(metrics(spark, sf_dir), ["run", "context"])
    return got.select("run", "context", *(F.round(c, 6).alias(c) for c in ("mean", "sd")), "n_repeats", F.round("seed_sd", 6).alias("seed_sd"), "n_seeds")


_SIDE = "select context, repeat, seed, max(value) as value from metrics where run = '{}' group by all"


@query(f"with {_METRICS}, l as ({_SIDE.format('O')}), r as ({_SIDE.format('F')}), d as (select l.context, l.repeat, avg(l.value - r.value) as m from l join r on l.context is not distinct from r.context and l.repeat = r.repeat and l.seed = r.seed group by all) select context, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, count(*) as n from d group by all")
def paired_difference(spark, sf_dir):
    m = metrics(spark, sf_dir)
    left, right = (m.where(F.col("run") == s).groupBy("context", "repeat", "seed").agg(F.max("value").alias("value")) for s in "OF")
    got = results.paired_difference(left, right, ["context", "repeat", "seed"], ["context"])
    return got.select("context", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query(f"with {_METRICS} select run, context, count(*) as n, round(max(value) - min(value), 6) as spread, max(value) - min(value) <= 1e-12 as agrees from metrics group by all")
def reference_agreement(spark, sf_dir):
    got = results.agreed_references(metrics(spark, sf_dir), ["run", "context"])
    return got.withColumn("spread", F.round("spread", 6))


@query(f"with {_METRICS} select run, context, seed, o_orderkey from (select *, row_number() over (partition by run, context, seed order by o_orderkey) as k from metrics) where k = 1")
def reference_dedup(spark, sf_dir):
    return results.deduplicated(metrics(spark, sf_dir), ["run", "context", "seed"], ["o_orderkey"]).select("run", "context", "seed", "o_orderkey")


@query(f"with {_METRICS}, s as (select run, repeat, string_agg(distinct seed, ',' order by seed) as s from metrics group by all) select run, count(distinct s) <= 1 as consistent from s group by all")
def seed_sets(spark, sf_dir):
    return results.seed_sets(metrics(spark, sf_dir), ["run"], "repeat", "seed")


@query("select o_orderpriority, count(distinct o_orderstatus) as n_distinct, count(distinct o_orderstatus) > 1 as mixed from orders group by 1")
def mixed_cohorts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.groupBy("o_orderpriority").agg(F.count_distinct("o_orderstatus").alias("n_distinct")).withColumn("mixed", F.col("n_distinct") > 1)


@query("select o_orderkey, 'r' || o_orderstatus || ':' || coalesce(case when o_custkey % 10 = 0 then null else 'c' || (o_custkey % 4) end, 'baseline') || case when o_custkey % 2 = 1 then ':independent' else '' end as condition from orders")
def condition_flags(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    context = F.when(F.col("o_custkey") % 10 != 0, F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string")))
    return rows.select("o_orderkey", results.condition(F.concat(F.lit("r"), "o_orderstatus"), context, F.when(F.col("o_custkey") % 2 == 1, "independent").otherwise("copula")).alias("condition"))


@query("select l_orderkey, l_linenumber, metric, value from (unpivot (select l_orderkey, l_linenumber, l_quantity::double as l_quantity, l_extendedprice::double as l_extendedprice, l_discount::double as l_discount from lineitem) on l_quantity, l_extendedprice, l_discount into name metric value value)")
def melt_metrics(spark, sf_dir):
    return results.melted(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"])


# --- requests and attempts: orders and events ---

_TRIES = "tries as (select user_id as request_id, event_id as attempt, event_type = 'purchase' as valid, event_type <> 'error' as retryable, value from events)"


def tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as request_id", "event_id as attempt", "event_type = 'purchase' as valid", "event_type <> 'error' as retryable", "value")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as request_id")


@query(f"with {_TRIES}, t as (select request_id, count(*) as attempts, bool_or(valid) as ok, bool_or(not valid and not retryable) as final from tries group by 1) select o_orderkey as request_id, coalesce(attempts, 0) as attempts from orders left join t on o_orderkey = request_id where not coalesce(ok, false) and not coalesce(final, false) and coalesce(attempts, 0) < 12")
def remaining_requests(spark, sf_dir):
    return requests.remaining(asked(spark, sf_dir), tries(spark, sf_dir), 12)


@query(f"with {_TRIES} select o_orderkey as request_id, attempt, value from orders left join (select * from (select *, row_number() over (partition by request_id order by attempt desc) as k from tries where valid) where k = 1) t on o_orderkey = request_id")
def latest_success(spark, sf_dir):
    return requests.with_success(asked(spark, sf_dir), requests.latest_success(tries(spark, sf_dir), "request_id", "attempt", "valid", ["value"]))


@query(f"with {_TRIES}, s as (select distinct request_id from tries where valid) select count(*) as n_requests, count(s.request_id) as n_success, case when count(*) = count(s.request_id) then 'complete' else 'incomplete' end as status from orders left join s on o_orderkey = s.request_id")
def completion_status(spark, sf_dir):
    return requests.completion(asked(spark, sf_dir), tries(spark, sf_dir).where("valid"))


@query(with_long(f"{_PRED} select coalesce(domain, 'all') as domain, count(*) as n, round(100.0::double * count(*) filter (truth = predicted) / count(*), 9) as percent from pred group by rollup (domain)"))
def tier_agreement(spark, sf_dir):
    return rounded(requests.tier_agreement(predicted(spark, sf_dir), "domain", "predicted", "truth"))


@query("select l_orderkey as patient_id, count(*) as n, count(distinct l_linenumber) as n_domains, count(distinct l_returnflag) as n_profiles, count(*) = 4 and count(distinct l_linenumber) = 4 and count(distinct l_returnflag) = 1 as complete from lineitem group by 1")
def bundle_complete(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey as patient_id", "l_linenumber as disorder", "l_returnflag as profile")
    return requests.bundle_complete(rows, 4)


@query(f"with cohort as ({MISSING}) select ID, " + ", ".join(SURVEY.items) + " from cohort")
def pivot_responses(spark, sf_dir):
    """Answers as one map for each domain, turned into the wide table again."""
    maps = [F.struct(F.lit(d.name).alias("disorder"), F.create_map(*(x for c in d.items for x in (F.lit(c), F.col(c)))).alias("scores")) for d in D]
    rows = cohort(spark, sf_dir, True).select(F.col("ID").alias("patient_id"), F.explode(F.array(*maps)).alias("m")).select("patient_id", "m.*")
    return requests.response_table(rows)


@query("select o_orderkey, (('0x' || substr(sha256('42:' || o_orderkey || ':' || (o_custkey % 3)), 1, 8))::bigint) as seed from orders")
def attempt_seeds(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", attempt_seed(F.lit(42), F.col("o_orderkey"), F.col("o_custkey") % 3).alias("seed"))


@query("select c.condition, m.m as model, s.s as seed from (values ('natural', ['4b', '9b', '27b']), ('balanced', ['27b'])) c(condition, models), (values ('4b'), ('9b'), ('27b')) m(m), (values (42), (43), (44)) s(s) where list_contains(c.models, m.m)")
def job_matrix(spark, sf_dir):
    names = spark.createDataFrame([("4b",), ("9b",), ("27b",)], "model string")
    return requests.job_matrix(names, spark.createDataFrame([(42,), (43,), (44,)], "seed int"), spark.createDataFrame([("natural", ["4b", "9b", "27b"]), ("balanced", ["27b"])], "condition string, models array<string>"))


@query("select distinct c_name, split_part(c_name || ':' || c_mktsegment, ':', -1) as disorder from customer")
def split_request_id(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_name", last_part(F.concat_ws(":", "c_name", "c_mktsegment")).alias("disorder")).distinct()


@query("select l_orderkey, l_linenumber, round_even(l_discount * 2.5, 1) as rounded, format('{:.1f}', l_quantity::double) as shown from lineitem")
def half_even_round(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", half_even(F.col("l_discount") * 2.5, 1).alias("rounded"), F.format_string("%.1f", F.col("l_quantity").cast("double")).alias("shown"))


@query(f"select '{fingerprint({'names': SURVEY.names, 'columns': SURVEY.columns})}' as sha256, count(*) as n from region")
def instrument_fingerprint(spark, sf_dir):
    value = fingerprint({"columns": SURVEY.columns, "names": SURVEY.names})
    return spark.read.parquet(f"{sf_dir}/region.parquet").agg(F.count("*").alias("n")).select(F.lit(value).alias("sha256"), "n")


@query("select o_orderpriority, count(*) as n, sha256(count(*) || ':' || sum(('0x' || substr(md5(o_orderkey::varchar), 1, 15))::bigint)::varchar) as fingerprint from orders group by 1")
def split_fingerprints(spark, sf_dir):
    return resampling.split_fingerprint(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderpriority"], "o_orderkey")


@query("select o_orderkey, 0::bigint as copy from orders order by md5('42/t/' || o_orderkey), o_orderkey limit 1000")
def matched_subset(spark, sf_dir):
    return resampling.subset(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey", 1000, 42, "t")


@query("with s as (select o_orderkey from orders order by md5('42/t/' || o_orderkey), o_orderkey limit 1000) select o_orderkey from orders where o_orderkey not in (select o_orderkey from s)")
def unselected(spark, sf_dir):
    """Positions that a subset leaves."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return resampling.unselected(rows, resampling.subset(rows, "o_orderkey", 1000, 42, "t"), "o_orderkey")


@query(f"with cohort as ({MISSING}), x as (select ID, case when ID % 7 = 0 then -1.0 when ID % 11 = 0 then null else W1_age_r end as age, case when ID % 5 = 0 then 3 when ID % 13 = 0 then null else W1_sex_r end as sex from cohort) select ID, (age is null or age >= 0) and coalesce(sex in (1, 2), false) as valid from x")
def demographics(spark, sf_dir):
    age = F.when(F.col("ID") % 7 == 0, F.lit(-1.0)).when(F.col("ID") % 11 != 0, F.col("W1_age_r"))
    sex = F.when(F.col("ID") % 5 == 0, F.lit(3.0)).when(F.col("ID") % 13 != 0, F.col("W1_sex_r"))
    return cohort(spark, sf_dir, True).select("ID", requests.demographics_valid(age, sex).alias("valid"))


_RUNS = [("O", "27b", 42), ("F", "4b", 43)]


@query("with k as (select * from (values ('O', '27b', 42), ('F', '4b', 43)) k(o_orderstatus, model, seed)) select o_orderkey, o_orderstatus, model, seed from orders left join k using (o_orderstatus)")
def run_lookup(spark, sf_dir):
    table = spark.createDataFrame(_RUNS, "o_orderstatus string, model string, seed int")
    return results.looked_up(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), table, "o_orderstatus")


_EVALUATION = "select o_orderkey, case when o_custkey % 9 = 0 then 'real' else 'r' || o_orderstatus end as run, case when o_custkey % 2 = 0 then '4b' end as model, 'natural' as regime, case when o_custkey % 3 = 0 then 'full' end as context, case o_custkey % 5 when 0 then null when 1 then 'targeted_domains' else 'panic' end as domain, case when o_custkey % 4 = 0 then 'fidelity' else 'utility_repeat' end as family, case when o_custkey % 7 = 0 then 2.0 end as ratio, case when o_custkey % 6 = 0 then 'independent' end as dependence from orders"


@query(
    f"with x as ({_EVALUATION}), y as (select o_orderkey, run, case when run = 'real' then 'real' else model end as model, case when run = 'real' then 'real' else regime end as regime, coalesce(case when run = 'real' then 'real' else context end, 'baseline') as context, "
    "case coalesce(domain, 'all_variables') when 'targeted_domains' then 'eligible_domains' else coalesce(domain, 'all_variables') end as domain, family, (case when run = 'real' then 0 else coalesce(ratio, case when family = 'utility_repeat' then 1 end) end)::double as ratio, dependence from x) "
    "select *, regime || ':' || context || case when dependence = 'independent' then ':independent' else '' end as condition from y"
)
def evaluation_fills(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("_orders")
    return results.fills(spark.sql(_EVALUATION.replace("from orders", "from _orders")))


@query("select o_orderpriority, greatest(1, ceil(median(o_custkey % 50)))::bigint as rounds, bool_or(o_totalprice > 400000) as support_restricted from orders group by 1")
def best_rounds(spark, sf_dir):
    """Rounds to refit with, and whether any fold lacked a tier."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("best", F.col("o_custkey") % 50)
    return rows.groupBy("o_orderpriority").agg(results.refit_rounds("best").alias("rounds"), F.bool_or(F.col("o_totalprice") > 400000).alias("support_restricted"))


@query("select o_orderstatus, arg_max(o_orderkey, (o_custkey % 100, -o_orderkey)) as chosen from orders group by 1")
def first_best(spark, sf_dir):
    """The first of the candidates with the best score."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("score", F.col("o_custkey") % 100)
    return rows.groupBy("o_orderstatus").agg(results.first_best("o_orderkey", "score", "o_orderkey").alias("chosen"))


@query("with a as (select o_custkey as c, list(distinct o_orderpriority) as p from orders group by 1) select c as o_custkey, len(list_filter(['1-URGENT', '2-HIGH'], lambda x: not list_contains(p, x)))::int as n_missing, len(list_filter(['1-URGENT', '2-HIGH'], lambda x: not list_contains(p, x))) = 0 as is_subset from a")
def set_relations(spark, sf_dir):
    """Whether what a run declares is among what it has."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return results.declared_among(rows, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])


# --- models, prompts and the journal: rows only ---


@query()
def logreg_utility(spark, sf_dir):
    """All seven domains and four protocols."""
    real, synthetic = halves(cohort(spark, sf_dir))
    return utility.utility(real, {"odd": synthetic}, ("logistic",), folds=3, targeted={"odd": utility.ELIGIBLE}).drop("seconds")


_JOBS = """, f as (select (row_number() over (partition by tier order by md5('42/0/' || ID), ID) - 1) % (select least(3, min(n)) from (select count(*) as n from long where domain = 'panic' and ID % 2 = 0 group by tier)) as fold from long where domain = 'panic' and ID % 2 = 0),
t as (select fold, count(*) as test, (select count(*) from f) - count(*) as train from f group by 1)
select 'panic' as domain, 0 as repeat, fold::int as fold, 'logistic' as classifier, run, protocol, ratio::double as ratio, train::int as n_real_train, test::int as n_real_test, (train * times)::int as n_fit, (case when run = 'real' then 0 else train end)::int as n_added, test as n
from t, (values ('real', 'TRTR', 0, 1), ('odd', 'TSTR', 1, 1), ('odd', 'TAUG', 1, 2), ('odd', 'TRTR_RESAMPLED', 1, 2)) p(run, protocol, ratio, times)"""


@query(with_long(_JOBS, COHORT))
def utility_jobs(spark, sf_dir):
    """Sizes of the jobs of one domain, as its confusion cells and training parts have them."""
    real, synthetic = halves(cohort(spark, sf_dir))
    return utility.job_sizes(utility.utility(real, {"odd": synthetic}, ("logistic",), ["panic"], folds=3, targeted={"odd": utility.ELIGIBLE}))


@query()
def boost_utility(spark, sf_dir):
    real, _ = halves(cohort(spark, sf_dir))
    return utility.utility(real, None, ("boosting",), ["panic"], folds=3).drop("seconds")


@query()
def utility_curve(spark, sf_dir):
    """Half, as many and twice as many synthetic rows as real ones, one domain, a real cohort of a quarter of the rows."""
    rows = cohort(spark, sf_dir)
    return utility.learning_curves(rows.where("ID % 4 = 0"), {"odd": rows.where("ID % 2 = 1")}, [0.5, 1, 2], rows.where("ID % 4 = 0").count(), ("logistic",), ["panic"], folds=3).drop("seconds")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = {d.name: {"about": [f"About {d.key.lower()}."], "items": [{"key": c, "label": c} for c in d.items]} for d in D}
    return requests.rendered(copula_profiles(spark, sf_dir), documents, "own")


@query()
def rendered_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", "patient_id", "disorder", F.col("target.score_target").alias("score_target"), F.col("target.tier_code").alias("tier_code"), "prompt_sha256")


@query()
def journal_replay(spark, sf_dir):
    """Attempts of all requests by the offline provider, read strictly."""
    rows = requests.targets(copula_profiles(spark, sf_dir)).select(F.concat_ws(":", "patient_id", "disorder").alias("request_id"), "disorder", "score_target", "tier_code", F.lit(0).alias("attempts"))
    made = journal.attempted(rows, journal.even_answers, 42)
    return made.groupBy("valid", "tier_match").agg(F.count("*").alias("n"))


FLAGSHIP = "jsd_per_column"
