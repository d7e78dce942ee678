"""Windows over class membership: the last n rows, or the rows within an interval of the newest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, n: int, *order: str, by: list[str] | None = None) -> DataFrame:
    """The n rows that arrived last, of each group if ``by`` is given; ``order`` is the order of arrival.

    Without groups this is a top-n: each task keeps n rows. With groups, Spark limits each group before the shuffle.
    """
    if not by:
        return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def last_interval(df: DataFrame, seconds: float, ts: str, by: list[str] | None = None) -> DataFrame:
    """The rows within ``seconds`` of the newest row (of their group), bounds included."""
    by = by or []
    newest = df.groupBy(*by).agg(F.max(ts).alias("__newest"))
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)).cast("decimal(18,6)"))
    joined = df.join(newest, by) if by else df.crossJoin(newest)  # one row without groups
    return joined.where(F.col(ts) >= F.col("__newest") - span).select(*df.columns)


def since(df: DataFrame, seconds: float, ts: str) -> DataFrame:
    """The rows of the last ``seconds`` by the clock."""
    return df.where(F.col(ts).cast("timestamp") >= F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)).cast("decimal(18,6)")))


def running_count(df: DataFrame, seconds: int, ts: str, by: list[str], out: str = "n_window") -> DataFrame:
    """For each row, how many rows of its group lie within ``seconds`` up to it."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-int(seconds * 1_000_000), 0)
    return df.withColumn(out, F.count("*").over(w))


def timer_buckets(df: DataFrame, seconds: int, ts: str) -> DataFrame:
    """(tick, n): how many rows each tick of a timer finds since the one before."""
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    return df.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.end").cast("timestamp_ntz").alias("tick"), "n")
