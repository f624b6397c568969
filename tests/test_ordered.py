import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarine.operators import ordered as O


@pytest.fixture
def cut_everything(monkeypatch):
    monkeypatch.setattr(O, "SMALL_GROUP", 0)


def skewed(spark, n=1200):
    """One key holds most rows, with many equal values."""
    rng = random.Random(3)
    rows = [("hot" if i % 4 else f"k{i % 3}", i, float(rng.choice([5, 5, 5, rng.random() * 90])), rng.choice("aab")) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, id long, x double, t string").repartition(5)


def test_quantiles_equal_numpy(spark, cut_everything):
    rows, df = skewed(spark)
    got = {r["k"]: r for r in O.exact_quantiles(df, ["k"], "x", (0, 50, 70, 99, 100)).collect()}
    for key in {r[0] for r in rows}:
        values = [r[2] for r in rows if r[0] == key]
        assert got[key]["count"] == len(values)
        for p in (0, 50, 70, 99, 100):
            assert got[key][f"p{p}"] == pytest.approx(float(np.percentile(values, p)))


def test_literal_percentiles(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (40.0,), (float("nan"),), (None,)], "x double")
    row = O.exact_quantiles(df, [], "x", (50, 70, 100)).first()
    assert (row["count"], row["p50"], row["p70"], row["p100"]) == (3, 20.0, pytest.approx(28.0), 40.0)
    assert O.exact_quantiles(df.filter("x > 99"), [], "x", (50,)).count() in (0, 1)
    with pytest.raises(ValueError):
        O.exact_quantiles(df, [], "x", (101,))


def test_numbering_running_total_and_previous(spark, cut_everything):
    rows, df = skewed(spark)
    numbers = {(r.k, r.id): r.n for r in O.numbered(df, ["k"], "id", "n").collect()}
    totals = {(r.k, r.id): r.s for r in O.running_total(df, ["k"], "id", [], F.col("id"), "s").collect()}
    before = {(r.k, r.id): r.p for r in O.previous_value(df, ["k"], "id", [], "t", "p").collect()}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        total = 0
        for i, r in enumerate(group):
            total += r[1]
            assert numbers[(key, r[1])] == i
            assert totals[(key, r[1])] == total
            previous = before[(key, r[1])]
            assert (previous.v if previous else None) == (group[i - 1][3] if i else None)
