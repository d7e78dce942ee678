"""Bit operations on binary values; those on integers are plain Spark operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _zip(a: pd.Series, b: pd.Series, f) -> pd.Series:
    return pd.Series([None if x is None or y is None else f(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], index=a.index, dtype=object)


def _wide(x: bytes, y: bytes) -> tuple[bytes, bytes]:
    n = max(len(x), len(y))
    return x.ljust(n, b"\0"), y.ljust(n, b"\0")


def register(spark: SparkSession) -> None:
    """AND keeps the shorter length; OR and XOR extend the shorter value with zeros."""

    def band(a: pd.Series, b: pd.Series) -> pd.Series:
        return _zip(a, b, lambda x, y: bytes(p & q for p, q in zip(x, y, strict=False)))

    def bor(a: pd.Series, b: pd.Series) -> pd.Series:
        return _zip(a, b, lambda x, y: bytes(p | q for p, q in zip(*_wide(x, y), strict=True)))

    def bxor(a: pd.Series, b: pd.Series) -> pd.Series:
        return _zip(a, b, lambda x, y: bytes(p ^ q for p, q in zip(*_wide(x, y), strict=True)))

    def bnot(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else bytes(255 - p for p in bytes(x)))

    for name, f in (("ls_band", band), ("ls_bor", bor), ("ls_bxor", bxor), ("ls_bnot", bnot)):
        spark.udf.register(name, F.pandas_udf(f, "binary"))
