"""Order and randomness that depend on keys alone, never on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.storage import checkpoint

#: Hexadecimal digits of the seeded order that make a bucket: of a whole table, and of a group.
_DIGITS, _GROUP_DIGITS = 4, 3


def order_key(seed: int, *keys: str | Column) -> Column:
    """md5 of seed and keys: the same seed gives the same order, another one another order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)).cast("binary"))


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))


def below(rate: float, *parts: Column) -> Column:
    """uniform(...) < rate, told from the digits without making the number."""
    bound = math.ceil(rate * 4294967296.0)
    return F.lit(rate > 0) if not 0 < bound < 1 << 32 else _digest(*parts) < f"{bound:08x}"


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5."""
    digest = _digest(*parts)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _numbered(df: DataFrame, bucket: str, keys: list[str], name: str, by: list[str]) -> DataFrame:
    """Ordinals from the rows before each bucket and the place in it; the bucket is a column of
    the row, so both counts see the same buckets whatever the plan."""
    sizes = df.groupBy(*by, bucket).agg(F.count("*").alias("__rows_in"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    starts = sizes.select(*by, bucket, F.coalesce(F.sum("__rows_in").over(before), F.lit(0)).alias("__start"))
    starts = starts.toDF(*(f"__s{k}" for k in range(len(by) + 1)), "__start")
    same = F.lit(True)
    for k, c in enumerate([*by, bucket]):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{k}"))
    row = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*keys)) - 1
    ranked = df.withColumn("__row", row).join(starts if by else F.broadcast(starts), same, "left")
    return ranked.withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop("__start", "__row", bucket, *(f"__s{k}" for k in range(len(by) + 1)))


def with_ordinal(df: DataFrame, *keys: str, name: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """Numbers rows from 0 in the order of the keys, within groups if `by` is given.

    Rows are dealt over ranges of (by, keys), stored with the number of their range, and
    counted and numbered from that copy: no task sorts the whole table or a whole group, and
    counts and rows cannot come from different samples. Rows with equal keys are numbered in
    any order; null keys come first."""
    groups = list(by or [])
    ranged = df.repartitionByRange(*(F.col(k) for k in [*groups, *keys])).withColumn("__part", F.spark_partition_id())
    return _numbered(checkpoint(ranged), "__part", list(keys), name, groups).select(*df.columns, name)


def shuffled(df: DataFrame, seed: int, *keys: str, name: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """with_ordinal over the seeded order; the keys break ties.

    The order is a hash, so its first digits are buckets of even size that need no sample
    and no stored copy."""
    ordered = df.withColumn("__order", order_key(seed, *keys))
    bucket = ordered.withColumn("__bucket", F.substring("__order", 1, _GROUP_DIGITS if by else _DIGITS))
    return _numbered(bucket, "__bucket", ["__order", *keys], name, list(by or [])).select(*df.columns, name)
