"""User-supplied encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def encoder_udf(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """UDF text -> array<float>; `load` runs once per task stream and returns the encode function.

    Without an encoder, vectors enter as a table joined by id.
    """

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, ArrayType(FloatType()))
