"""Strict reading of completions: {"scores": {item: number}} and nothing else."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.instrument import SURVEY, Domain


class Rejected(ValueError):
    pass


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Rejected("a key is repeated")
    return out


def _number(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise Rejected("a number is not finite")
    return x


def _constant(text: str) -> None:
    raise Rejected(f"{text} is not a JSON number")


def parse(raw: str | None, domain: Domain) -> tuple[dict[str, int] | None, str | None]:
    """(scores, None) or (None, reason). 2.0 counts as 2; true, "2" and 2.5 are rejected."""
    try:
        value = json.loads(raw or "", object_pairs_hook=_pairs, parse_float=_number, parse_constant=_constant)
        if not isinstance(value, dict) or set(value) != {"scores"} or not isinstance(value["scores"], dict):
            raise Rejected("not an object with scores alone")
        scores = value["scores"]
        if set(scores) != set(domain.items):
            raise Rejected("other items than asked for")
        for k, v in scores.items():
            if isinstance(v, bool) or not isinstance(v, int | float) or v != int(v) or not 0 <= v <= domain.top:
                raise Rejected(f"{k} is not a whole number in range")
        return {c: int(scores[c]) for c in domain.items}, None
    except (ValueError, RecursionError, OverflowError) as e:
        return None, str(e) or type(e).__name__


@F.pandas_udf(T.StructType([T.StructField("scores", T.MapType(T.StringType(), T.IntegerType())), T.StructField("error", T.StringType()), T.StructField("total", T.IntegerType())]))
def strict_scores(raw: pd.Series, name: pd.Series) -> pd.DataFrame:
    """Reads each completion for the domain named beside it."""
    known = set(SURVEY.names)
    got = [parse(r, SURVEY[n]) if n in known else (None, "no such domain") for r, n in zip(raw, name, strict=True)]
    return pd.DataFrame({"scores": [s for s, _ in got], "error": [e for _, e in got], "total": pd.array([None if s is None else sum(s.values()) for s, _ in got], dtype="Int32")})
