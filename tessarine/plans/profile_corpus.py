"""The full corpus profile as report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessarine.operators import profile as P
from tessarine.session import materialize
from tessarine.sources import store


def profile_corpus(records: DataFrame) -> DataFrame:
    """Length and ratio summaries per language and overall (language null).

    Percentiles read the ratios several times over: they are cut from the texts once and stored, two numbers a pair.
    """
    lengths = P.profile_lengths(P.length_metrics(records))
    ratios = materialize(P.translation_ratios(records), "ratios")
    by_language = P.numeric_summary(ratios, ["language", "metric"], "value")
    overall = P.numeric_summary(ratios, ["metric"], "value").withColumn("language", F.lit(None).cast("string"))
    return lengths.unionByName(by_language).unionByName(overall)


def report_tables(records: DataFrame) -> dict[str, DataFrame]:
    return {
        "metrics": profile_corpus(records),
        "categories": P.categorical_counts(records),
        "coverage": P.field_coverage(records),
        "quality": P.passage_quality(records),
        "duplicates": P.duplicate_ids(records),
    }


def write_report(records: DataFrame, path: str) -> None:
    """One CSV per table: a row per language, and a row per language and metric."""
    for name, table in report_tables(records).items():
        store.csv_sink(table, f"{path}/{name}")
