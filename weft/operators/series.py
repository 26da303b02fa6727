"""Metric series: one row for each lane, index and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inflation(df: DataFrame, lane: str, index: str, value: str) -> DataFrame:
    """value / first value - 1; null if the first is 0."""
    base = F.first(value).over(Window.partitionBy(lane).orderBy(index))
    return df.select(lane, index, F.round(F.when(base != 0, F.col(value) / base - 1), 6).alias("inflation"))


def alarm(df: DataFrame, lane: str, index: str, value: str, bar: float, n: int) -> DataFrame:
    """Are the last n values, n of them, all below the bar? With the largest, the last and the count."""
    back = F.row_number().over(Window.partitionBy(lane).orderBy(F.col(index).desc()))
    late = df.withColumn("__r", back)
    own = F.when(F.col("__r") <= n, F.col(value))
    return late.groupBy(lane).agg(
        ((F.count(own) == n) & (F.max(own) < bar)).alias("alarm"), F.round(F.max(value), 6).alias("largest"), F.round(F.max(F.when(F.col("__r") == 1, F.col(value))), 6).alias("last"), F.count("*").alias("n")
    )


def adjacent_drop(df: DataFrame, lane: str, index: str, value: str, cliff: float = 0.6, gradual: float = 0.3) -> DataFrame:
    """The largest fall between neighbours, where, its share of the range, its shape, and whether values never rise."""
    fall = F.col(value) - F.lead(value).over(Window.partitionBy(lane).orderBy(index))
    share = F.try_divide(F.max("__d"), F.max(value) - F.min(value))
    return df.withColumn("__d", fall).groupBy(lane).agg(
        F.round(F.max("__d"), 6).alias("largest_drop"), F.max_by(index, "__d").cast("long").alias("at_step"), F.round(share, 6).alias("share"),
        F.when(share >= cliff, "cliff").when(share >= gradual, "gradual").otherwise("flat").alias("shape"), (F.min(F.coalesce(F.col("__d") >= 0, F.lit(True)).cast("int")) == 1).alias("monotone"),
    )


def counter_checks(df: DataFrame, lane: str, index: str, value: str) -> DataFrame:
    """Steps where the counter does not rise, values that are not finite, and how many repeat their neighbour."""
    order = Window.partitionBy(lane).orderBy(index)
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    seen = df.withColumn("__i", F.lag(index).over(order)).withColumn("__v", F.lag(value).over(order))
    return seen.groupBy(lane).agg(
        F.count_if(F.col(index) <= F.col("__i")).alias("not_rising"), F.count_if(bad).alias("not_finite"), F.round(F.try_divide(F.count_if(F.round(value) == F.round("__v")), F.count("*") - 1), 6).alias("repetition")
    )


def endpoint_metrics(df: DataFrame, lane: str, index: str, value: str) -> DataFrame:
    """The last value of each lane."""
    return df.groupBy(lane).agg(F.max_by(value, index).alias("last"), F.max(index).alias("at"))
