"""Vector expressions over `array<float>` columns; sums run in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are compared after rounding to this many places, so that the order of
# summation (block multiply or per-row fold) can never decide a rank.
SCORE_PLACES = 9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def score(a: Column, b: Column) -> Column:
    return F.round(dot(a, b), SCORE_PLACES)


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def is_valid(v: Column, dimension: int) -> Column:
    """Right width, every component finite, norm above zero."""
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce((F.size(v) == dimension) & finite & (norm(v) > 0), F.lit(False))


def l2_normalize(v: Column) -> Column:
    """v / |v| as floats; a zero vector becomes null."""

    def divide(s: Column) -> Column:
        unit = F.transform(s["v"], lambda x: (x.cast("double") / s["n"]).cast("float"))
        return F.when(s["n"] > 0, unit)

    return let(F.struct(v.alias("v"), norm(v).alias("n")), divide)


def mrl_prefix(v: Column, dimension: int) -> Column:
    return l2_normalize(F.slice(v, 1, dimension))


def score_to_unit(score_column: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score_column + 1) / 2))


def is_usable_score(score_column: Column, bound: float) -> Column:
    """Finite and within +-bound.  NaN must be tested first: Spark sorts it above all."""
    return F.coalesce(
        ~F.isnan(score_column) & (F.abs(score_column) <= bound), F.lit(False)
    )
