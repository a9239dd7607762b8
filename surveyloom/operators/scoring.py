"""Scores, tiers and data-quality reports of a response table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.instrument import SURVEY, TIERS, Domain, Instrument


def with_totals(table: DataFrame, instrument: Instrument = SURVEY, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and each domain's total as `_domain`. Scores and tiers refer to these columns, not to ten items
    at each mention, which keeps the generated code small. A table that has the totals keeps them."""
    if all(f"_{d.name}" in table.columns for d in instrument.domains):
        return table.select(*keep, *(f"_{d.name}" for d in instrument.domains))
    return table.select(*keep, *(d.total().cast("int").alias(f"_{d.name}") for d in instrument.domains))


def score_table(table: DataFrame, instrument: Instrument = SURVEY, keep: tuple[str, ...] = ()) -> DataFrame:
    """Seven scores and tiers beside the kept columns. A missing item makes its own domain null."""
    made: list[Column] = []
    for d in instrument.domains:
        total = F.col(f"_{d.name}")
        made += [d.score_of(total).alias(d.score_column), d.tier_of(total).alias(d.tier_column)]
    return with_totals(table, instrument, keep).select(*keep, *made)


def long_scores(table: DataFrame, instrument: Instrument = SURVEY, keep: tuple[str, ...] = (), domains: tuple[str, ...] | None = None) -> DataFrame:
    """(kept, domain, total, tier): one row for each row and domain, of some domains alone if they are given: the others'
    items are then not even read."""
    some = instrument if domains is None else Instrument(tuple(instrument[d] for d in domains), instrument.age, instrument.sex, instrument.id)
    each = F.array(*(F.struct(F.lit(d.name).alias("domain"), F.col(f"_{d.name}").alias("total"), d.tier_of(F.col(f"_{d.name}")).alias("tier")) for d in some.domains))
    return with_totals(table, some, keep).select(*keep, F.explode(each).alias("d")).select(*keep, "d.*")


def bad_item(column: str, top: int, allow_missing: bool) -> Column:
    c = F.col(column)
    wrong = (c < 0) | (c > top) | (c != F.floor(c)) | F.isnan(c.cast("double"))
    return F.coalesce(wrong, F.lit(not allow_missing))


def quality_report(table: DataFrame, instrument: Instrument = SURVEY, allow_missing: bool = False) -> DataFrame:
    """(column, n_null, n_bad) of every declared column: one aggregation, then its one row is turned."""
    rules: dict[str, Column] = {instrument.sex: F.coalesce(~F.col(instrument.sex).isin(1, 2), F.lit(not allow_missing))}
    age = F.col(instrument.age).cast("double")
    rules[instrument.age] = F.coalesce((age < 0) | (age != F.floor(age)) | F.isnan(age) | (F.abs(age) == float("inf")), F.lit(False))
    rules |= {c: bad_item(c, d.top, allow_missing) for d in instrument.domains for c in d.items}
    wide = table.agg(*(F.struct(F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(bad).alias("n_bad")).alias(c) for c, bad in rules.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}.n_null").alias("n_null"), F.col(f"{c}.n_bad").alias("n_bad")) for c in rules))).alias("r")).select("r.*")


def check_columns(table: DataFrame, instrument: Instrument = SURVEY, exact: bool = True) -> None:
    """Raises on repeated, missing or, if exact, other columns."""
    if len(set(table.columns)) != len(table.columns):
        raise ValueError("column names are repeated")
    missing, other = set(instrument.columns) - set(table.columns), set(table.columns) - set(instrument.columns)
    if missing or (exact and other):
        raise ValueError(f"missing columns: {sorted(missing)}; undeclared: {sorted(other) if exact else []}")


def validate(table: DataFrame, instrument: Instrument = SURVEY, exact: bool = True, allow_missing: bool = False) -> DataFrame:
    """The table, if it's not empty and no declared column has a bad cell; else raises."""
    check_columns(table, instrument, exact)
    if table.isEmpty():
        raise ValueError("the table has no rows")
    bad = [r["column"] for r in quality_report(table, instrument, allow_missing).where("n_bad > 0").collect()]
    if bad:
        raise ValueError(f"invalid cells in {', '.join(bad[:5])}")
    return table


def duplicate_ids(table: DataFrame, column: str = "ID") -> DataFrame:
    """(id, n) of ids that are null or occur more than once."""
    return table.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null")


def attainable_scores(spark, instrument: Instrument = SURVEY) -> DataFrame:
    """(domain, tier, total, score): every total that a domain can have."""
    return spark.createDataFrame([(d.name, TIERS[t], x, x / d.n_items if d.mean else float(x)) for d in instrument.domains for t in range(5) for x in d.attainable(t)], "domain string, tier string, total int, score double")


def valid_target(domain: Domain, score: Column, tier: Column) -> Column:
    """Whether a score is on the domain's grid and in the tier."""
    total = score * (domain.n_items if domain.mean else 1)
    whole = F.abs(total - F.round(total)) < 1e-8
    return F.coalesce(whole & total.between(0, domain.n_items * domain.top) & (domain.tier_of(F.round(total).cast("int")) == tier), F.lit(False))
