"""Declared instruments: domains of ordinal items, their score rules and tiers, as Spark types and expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIERS = tuple(f"tier_{k}" for k in range(5))


@dataclass(frozen=True)
class Domain:
    """A questionnaire: items 0..top, scored by their sum or mean. Cuts are on the integer total, so that no mean
    is compared as a float: a sum is beyond a cut if greater, a mean if at least as great."""

    name: str
    n_items: int
    top: int
    mean: bool
    cuts: tuple[int, ...]
    words: tuple[str, ...]
    prefix: str = "W1"

    @property
    def items(self) -> list[str]:
        return [f"{self.prefix}_{self.name}_it{k}" for k in range(1, self.n_items + 1)]

    @property
    def score_column(self) -> str:
        return f"{self.name}_score"

    @property
    def tier_column(self) -> str:
        return f"{self.name}_tier_code"

    @property
    def key(self) -> str:
        return self.name.upper().replace("_", " ")

    def total(self) -> Column:
        """Sum of the items: null if any is."""
        out = F.col(self.items[0])
        for c in self.items[1:]:
            out = out + F.col(c)
        return out

    def score_of(self, total: Column) -> Column:
        return total / F.lit(float(self.n_items)) if self.mean else total.cast("double")

    def tier_number(self, total: Column) -> Column:
        out = F.lit(0)
        for cut in self.cuts:
            out = out + (total >= cut if self.mean else total > cut).cast("int")
        return out

    def tier_of(self, total: Column) -> Column:
        return F.when(total.isNotNull(), F.concat(F.lit("tier_"), self.tier_number(total).cast("string")))

    def tier_of_total(self, total: int) -> int:
        return sum(total >= c if self.mean else total > c for c in self.cuts)

    def attainable(self, tier: int) -> list[int]:
        """Totals of a tier, ascending."""
        return [t for t in range(self.n_items * self.top + 1) if self.tier_of_total(t) == tier]


@dataclass(frozen=True)
class Instrument:
    domains: tuple[Domain, ...]
    age: str = "W1_age_r"
    sex: str = "W1_sex_r"
    id: str = "ID"

    def __getitem__(self, name: str) -> Domain:
        return next(d for d in self.domains if d.name == name)

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.domains]

    @property
    def items(self) -> list[str]:
        return [c for d in self.domains for c in d.items]

    @property
    def columns(self) -> list[str]:
        return [self.age, self.sex, *self.items]

    def domain_of(self, column: str) -> str | None:
        return next((d.name for d in self.domains if column in d.items), None)

    def predictors(self, name: str) -> list[str]:
        """All columns but the domain's own items."""
        return [c for c in self.columns if c not in self[name].items]

    def schema(self, with_id: bool = False) -> T.StructType:
        own = [T.StructField(self.id, T.StringType(), False)] if with_id else []
        return T.StructType([*own, T.StructField(self.age, T.DoubleType()), T.StructField(self.sex, T.IntegerType()), *(T.StructField(c, T.IntegerType()) for c in self.items)])


# The seven questionnaires of the built-in instrument, with cut-offs on totals and words of severity.
_MILD = ("none", "mild", "moderate", "severe", "extreme")
SURVEY = Instrument(
    (
        Domain("depression", 9, 3, False, (4, 9, 14, 19), ("none", "mild", "moderate", "moderately severe", "severe")),
        *(Domain(n, 10, 4, True, (5, 15, 25, 35), _MILD) for n in ("separation_anxiety", "specific_phobia", "social_anxiety", "panic", "agoraphobia", "generalized_anxiety")),
    )
)
