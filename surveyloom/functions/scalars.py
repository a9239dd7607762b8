"""Scalar functions that Spark lacks or that need a fixed definition."""

from __future__ import annotations

import hashlib
import json
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()


@F.pandas_udf(T.DoubleType())
def probit(p: pd.Series) -> pd.Series:
    """Inverse of the normal distribution function; null outside (0, 1)."""
    return p.map(lambda x: _NORMAL.inv_cdf(x) if x is not None and 0 < x < 1 else None).astype("float64")


#: Chebyshev coefficients of exp(x^2) erfc(x) over t = (2 - x) / (2 + x), fitted once to the library's own erfc.
_POINTS = 40


def _scaled_erfc() -> np.ndarray:
    t = np.cos(np.pi * (np.arange(_POINTS) + 0.5) / _POINTS)
    x = 2 * (1 - t) / (1 + t)
    # beyond 26 erfc underflows; its asymptotic series is exact to the last digit there
    y = np.array([math.exp(v * v) * math.erfc(v) if v < 20 else sum((-1) ** k * math.prod(range(1, 2 * k, 2)) / (2 * v * v) ** k for k in range(8)) / (v * math.sqrt(math.pi)) for v in x])
    return np.polynomial.chebyshev.chebfit(t, y * (1 + x), _POINTS - 1)


_COEFFICIENTS = _scaled_erfc()


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Normal distribution function, whole arrays at a time; NaN stays NaN."""
    x = np.abs(z) / math.sqrt(2)
    finite = np.where(np.isfinite(x), x, 40.0)
    tail = 0.5 * np.exp(-finite * finite) * np.polynomial.chebyshev.chebval((2 - finite) / (2 + finite), _COEFFICIENTS) / (1 + finite)
    return np.where(np.isnan(z), np.nan, np.where(z > 0, 1 - tail, tail))


@F.pandas_udf(T.DoubleType())
def norm_cdf(z: pd.Series) -> pd.Series:
    made = normal_cdf(z.to_numpy(dtype="float64"))
    return pd.Series(made).where(z.notna().to_numpy())


def attempt_seed(seed: Column, request: Column, attempt: Column) -> Column:
    """First 32 bits, as a number, of the SHA-256 of 'seed:request:attempt'."""
    text = F.concat_ws(":", seed.cast("string"), request.cast("string"), attempt.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def last_part(value: Column, mark: str = ":") -> Column:
    return F.substring_index(value, mark, -1)


def first_part(value: Column, mark: str = ":") -> Column:
    """What stands before the last mark."""
    return F.regexp_extract(value, f"^(.*){mark}[^{mark}]*$", 1)


def age_bin(label: Column) -> Column:
    """Struct (low, high) of 'lo-hi', both ends included; null where it isn't of that form or the ends are reversed."""
    low, high = (F.regexp_extract(label, r"^(\d+)-(\d+)\z", k) for k in (1, 2))
    return F.when((low != "") & (low.try_cast("int") <= high.try_cast("int")), F.struct(low.try_cast("int").alias("low"), high.try_cast("int").alias("high")))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def row_fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, keys sorted, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed, stream and keys alone, not on rows, partitions or their order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), *keys), 11) / F.lit(float(1 << 53))


def normal(seed: int, stream: str, *keys: Column) -> Column:
    """A standard normal number by the same rule (Box and Muller)."""
    u, v = uniform(seed, f"{stream}/u", *keys), uniform(seed, f"{stream}/v", *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def register(spark: SparkSession) -> None:
    """probit, norm_cdf and strict_scores for SQL."""
    from surveyloom.functions.responses import strict_scores

    spark.udf.register("probit", probit)
    spark.udf.register("norm_cdf", norm_cdf)
    spark.udf.register("strict_scores", strict_scores)
