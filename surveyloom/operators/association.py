"""Category histograms, divergence, contingency and association of two tables' columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.functions.instrument import SURVEY, Instrument
from surveyloom.operators.summaries import binned, quantile_edges

#: Code of a missing value: a category of its own.
MISSING = -1


def encoded(real: DataFrame, synthetic: DataFrame, instrument: Instrument = SURVEY, bins: int = 5) -> DataFrame:
    """Both tables' declared columns as integer codes, with column src: age in bins by the real table's quantiles,
    other values as they are, missing ones MISSING. Codes of values need not be dense: no result depends on it."""
    edges = quantile_edges(real, instrument.age, bins)
    codes = [F.coalesce(binned(F.col(instrument.age), edges).cast("int"), F.lit(MISSING)).alias(instrument.age)]
    codes += [F.coalesce(F.col(c).cast("int"), F.lit(MISSING)).alias(c) for c in instrument.columns[1:]]
    return real.select(F.lit("real").alias("src"), *codes).unionByName(synthetic.select(F.lit("synthetic").alias("src"), *codes))


def histogram(codes: DataFrame, columns: list[str]) -> DataFrame:
    """(column, code, n_real, n_synthetic). Rows become column-code pairs that tasks count before the shuffle, which
    moves a few hundred rows a task."""
    long = codes.select("src", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("code")) for c in columns))).alias("x")).select("src", "x.*")
    return long.groupBy("column", "code").agg(F.count_if(F.col("src") == "real").alias("n_real"), F.count_if(F.col("src") == "synthetic").alias("n_synthetic"))


def divergence(hist: DataFrame) -> DataFrame:
    """(column, jsd): squared Jensen-Shannon distance, base 2, from histogram()."""
    w = Window.partitionBy("column")
    p, q = F.try_divide(F.col("n_real").cast("double"), F.sum("n_real").over(w)), F.try_divide(F.col("n_synthetic").cast("double"), F.sum("n_synthetic").over(w))
    rows = hist.select("column", p.alias("p"), q.alias("q"))

    def part(a: str) -> Column:
        return F.when(F.col(a) > 0, F.col(a) * F.log2(2 * F.col(a) / (F.col("p") + F.col("q")))).otherwise(0.0)

    return rows.groupBy("column").agg(F.greatest(F.lit(0.0), 0.5 * F.sum(part("p")) + 0.5 * F.sum(part("q"))).alias("jsd"))


def contingency(codes: DataFrame, columns: list[str]) -> DataFrame:
    """(src, a, b, code_a, code_b, n) of all pairs of columns, a before b.

    A task counts all pairs at once: with rows as indicators of column-code pairs, the product of that matrix with
    itself holds every table. It hands on its sums, whose number depends on the codes alone, so nothing of the size of
    rows times pairs is ever made. Counts are exact in double precision; a task sums up 4,096 rows at a time.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[int, int], int] = {}
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            src = np.array(batch.column(0).to_pylist(), dtype=object)
            x = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1) if batch.num_rows else np.zeros((0, len(columns)), dtype=np.int64)
            at = np.empty(x.shape, dtype=np.int64)
            for j in range(x.shape[1]):
                values, back = np.unique(x[:, j], return_inverse=True)
                at[:, j] = np.array([number.setdefault((j, int(v)), len(number)) for v in values], dtype=np.int64)[back] if len(values) else 0
            for s in set(src.tolist()):
                own = at[src == s]
                for i in range(0, len(own), 4096):
                    part = own[i : i + 4096]
                    one = np.zeros((len(part), len(number)), dtype=np.float32)
                    one[np.arange(len(part))[:, None], part] = 1
                    made = (one.T @ one).astype(np.float64)
                    before = sums.get(s)
                    if before is not None and before.shape != made.shape:
                        before = np.pad(before, (0, len(made) - len(before)))
                    sums[s] = made if before is None else before + made
        keys = list(number)
        for s, m in sums.items():
            i, j = np.nonzero(m)
            ok = np.array([keys[a][0] < keys[b][0] for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=bool) if len(i) else np.zeros(0, dtype=bool)
            i, j = i[ok].tolist(), j[ok].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(i), pa.string()), pa.array([columns[keys[a][0]] for a in i], pa.string()), pa.array([columns[keys[b][0]] for b in j], pa.string()),
                 pa.array([keys[a][1] for a in i], pa.int32()), pa.array([keys[b][1] for b in j], pa.int32()), pa.array([int(m[a, b]) for a, b in zip(i, j, strict=True)], pa.int64())],
                names=["src", "a", "b", "code_a", "code_b", "n"],
            )

    rows = codes.select("src", *(F.col(c).cast("long").alias(c) for c in columns))
    return rows.mapInArrow(count, "src string, a string, b string, code_a int, code_b int, n long").groupBy("src", "a", "b", "code_a", "code_b").agg(F.sum("n").alias("n"))


def cramers_v(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, v): bias-corrected, from contingency rows (by, code_a, code_b, n); 0 where a column is constant or n < 2."""
    row, col = F.sum("n").over(Window.partitionBy(*by, "code_a")), F.sum("n").over(Window.partitionBy(*by, "code_b"))
    cells = table.withColumn("_p", F.col("n") * F.col("n") / (row.cast("double") * col))
    s = cells.groupBy(*by).agg(F.sum("_p").alias("p"), F.sum("n").cast("double").alias("n"), F.count_distinct("code_a").alias("r"), F.count_distinct("code_b").alias("c"))
    r, c, n = F.col("r") - 1.0, F.col("c") - 1.0, F.col("n")
    phi = F.greatest(F.lit(0.0), F.col("p") - 1 - F.try_divide(r * c, n - 1))
    den = F.least(r - F.try_divide(r * r, n - 1), c - F.try_divide(c * c, n - 1))
    return s.select(*by, F.when((n >= 2) & (r > 0) & (c > 0) & (den > 0), F.sqrt(F.try_divide(phi, den))).otherwise(0.0).alias("v"))


def association_error(v: DataFrame, instrument: Instrument = SURVEY) -> DataFrame:
    """(mae_v, between_disorder_mae_v, within_questionnaire_mae_v, n_pairs, ...) from v of both tables by (src, a, b)."""
    domains = F.create_map(*(F.lit(x) for c in instrument.items for x in (c, instrument.domain_of(c))))
    pairs = v.groupBy("a", "b").agg(F.abs(F.sum(F.when(F.col("src") == "real", F.col("v")).otherwise(-F.col("v")))).alias("e"), domains[F.col("a")].alias("da"), domains[F.col("b")].alias("db"))
    both = F.col("da").isNotNull() & F.col("db").isNotNull()
    within, between = both & (F.col("da") == F.col("db")), both & (F.col("da") != F.col("db"))
    return pairs.agg(
        F.avg("e").alias("mae_v"), F.avg(F.when(between, F.col("e"))).alias("between_disorder_mae_v"), F.avg(F.when(within, F.col("e"))).alias("within_questionnaire_mae_v"),
        F.count("*").alias("n_pairs"), F.count_if(F.coalesce(between, F.lit(False))).alias("n_between"), F.count_if(F.coalesce(within, F.lit(False))).alias("n_within"),
    )
