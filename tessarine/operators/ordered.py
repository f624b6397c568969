"""Ordered work that must survive a key holding a third of all rows.

A plain `partitionBy(key).orderBy(x)` window sends one key to one task.  The
functions here first cut every key's rows into order-preserving buckets (edges
from a mergeable quantile sketch), work inside each bucket, and carry one small
summary row per bucket to the next.  Results are exact: the sketch only decides
where the cuts are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
SMALL_GROUP = 100_000  # groups below this many rows stay in one bucket
_ONE = "_one"


def _same_keys(left: str, right: str, keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe key equality, keeping the left keys."""
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), _same_keys("l", "r", keys), how).select(
        "l.*", *extra
    )


def with_buckets(
    df: DataFrame, keys: list[str], order: str, buckets: int = BUCKETS, small: int | None = None
) -> DataFrame:
    """Add `_bucket`, non-decreasing in the numeric column `order` within `keys`.

    Only groups of at least `small` rows are cut.
    """
    small = SMALL_GROUP if small is None else small
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = df.groupBy(*keys).agg(
        F.percentile_approx(order, cuts, F.lit(buckets * 20)).alias("_edges"),
        F.count(F.lit(1)).alias("_rows"),
    ).withColumn("_edges", F.when(F.col("_rows") >= small, F.col("_edges")).otherwise(F.slice("_edges", 1, 0))).drop("_rows")
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])

    def halve(low: Column, step: Column) -> Column:
        """Binary search: move up by `step` if the edge there is still below the value."""
        below = F.coalesce(F.get("_edges", low + step - 1) < F.col(order), F.lit(False))
        return low + F.when(below, step).otherwise(0)

    bucket = F.aggregate(halves, F.lit(0), halve)
    return attach(df, edges, keys).withColumn("_bucket", bucket).drop("_edges")


def _carried(bucketed: DataFrame, keys: list[str], amount: Column, name: str) -> DataFrame:
    """Per bucket, the total of `amount` over all earlier buckets of the key."""
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = bucketed.groupBy(*keys, "_bucket").agg(amount.alias("_total"))
    return totals.select(
        *keys, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias(name)
    )


def numbered(
    df: DataFrame, keys: list[str], order: str, name: str, ties: list[str] | None = None
) -> DataFrame:
    """0-based position of each row in (`order`, `ties`) within `keys`."""
    work = df if keys else df.withColumn(_ONE, F.lit(1))
    by = keys or [_ONE]
    cut = with_buckets(work, by, order)
    offset = _carried(cut, by, F.count(F.lit(1)), "_before")
    inside = Window.partitionBy(*by, "_bucket").orderBy(order, *(ties or []))
    return (
        attach(cut, offset, by + ["_bucket"])
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_before"))
        .drop("_bucket", "_before", _ONE)
    )


def running_total(
    df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, name: str
) -> DataFrame:
    """Sum of `value` up to and including each row."""
    cut = with_buckets(df, keys, order)
    offset = _carried(cut, keys, F.sum(value), "_before")
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        attach(cut, offset, keys + ["_bucket"])
        .withColumn(name, F.sum(value).over(inside) + F.col("_before"))
        .drop("_bucket", "_before")
    )


def previous_value(
    df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, name: str
) -> DataFrame:
    """The row before this one within `keys`, as struct(v) so null values stay visible."""
    cut = with_buckets(df, keys, order)
    item = F.struct(F.col(value).alias("v"))
    last = cut.groupBy(*keys, "_bucket").agg(
        F.max_by(item, F.struct(order, *ties)).alias("_last")
    )
    buckets = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.select(*keys, "_bucket", F.lag("_last").over(buckets).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)
    return (
        attach(cut, carried, keys + ["_bucket"])
        .withColumn(name, F.coalesce(F.lag(item).over(inside), F.col("_carry")))
        .drop("_bucket", "_carry")
    )


def values_at(df: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """The value at each wanted 0-based sorted position.

    `wanted` has `keys` and `rank` (distinct pairs).  Copies are merged into counts
    first, so a value that fills a third of the table is one row from there on.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cut = with_buckets(counts, keys, value)
    offset = _carried(cut, keys, F.sum("_n"), "_before")
    upto = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = attach(cut, offset, keys + ["_bucket"]).withColumn(
        "_end", F.sum("_n").over(upto) + F.col("_before")
    )
    # Ranks travel as one short array per key, so no row is paired with another.
    ranks = wanted.groupBy(*keys).agg(F.collect_set("rank").alias("_ranks"))
    start = F.col("_end") - F.col("_n")
    hits = attach(placed, ranks, keys).withColumn(
        "_hit", F.filter("_ranks", lambda r: (r >= start) & (r < F.col("_end")))
    )
    return hits.filter(F.size("_hit") > 0).select(
        *keys, F.explode("_hit").alias("rank"), F.col(value).alias("value")
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, percents: tuple[float, ...]
) -> DataFrame:
    """Exact linearly interpolated percentiles `p<percent>` per key, plus `count` and `mean`.

    Null and non-finite values are dropped.  Use this for continuous measures;
    for whole-number measures of bounded range the built-in `percentile` keeps one
    counter per distinct value and is cheaper.
    """
    check_percents(percents)
    column = F.col(value)
    finite = df.filter(column.isNotNull() & ~F.isnan(column) & (F.abs(column) < math.inf))
    by = keys or [_ONE]
    finite = finite.withColumn(_ONE, F.lit(1)).select(*by, column.cast("double").alias("_x"))
    stats = finite.groupBy(*by).agg(
        F.count("_x").alias("count"), F.avg("_x").alias("mean")
    )

    def place(p: float) -> Column:
        return (F.col("count") - 1) * F.lit(p) / 100

    wanted = stats.select(
        *by,
        F.explode(
            F.array_distinct(
                F.array(
                    *[f(place(p)).cast("long") for p in percents for f in (F.floor, F.ceil)]
                )
            )
        ).alias("rank"),
    )
    found = values_at(finite, by, "_x", wanted).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")
    )
    joined = attach(stats, found, by)
    out = []
    for p in percents:
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        weight = place(p) - low
        out.append(
            (F.col("_at")[low] * (1 - weight) + F.col("_at")[high] * weight).alias(f"p{p:g}")
        )
    return joined.select(*keys, "count", "mean", *out)


def check_percents(percents: tuple[float, ...]) -> None:
    for p in percents:
        if not 0 <= p <= 100:
            raise ValueError("percent must be between 0 and 100")
