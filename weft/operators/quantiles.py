"""Exact order statistics by histograms: rows are counted in narrower and narrower bins, and
never sorted or gathered.

The first bins are sixteenths of a power of two; each further pass cuts the bins that hold an
asked rank into CUTS parts, between their least and greatest value. A bin of one value is an
answer, and so is one of FEW rows, which are sorted where they are. What moves between
executors are counts by group and bin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.storage import checkpoint, small

CUTS = 4096
#: Rows of one bin that are sorted at once.
FEW = 4096
_STEPS = 16


def _coarse(v: Column) -> Column:
    """Grows with v: sign, then sixteenths of a power of two."""
    size = F.floor(F.log2(F.abs(v)) * _STEPS)
    return F.when(v > 0, 100_000 + size).when(v < 0, -100_000 - size).otherwise(0).cast("int")


def _fine(v: Column) -> Column:
    """The part of [__low, __high] that v is in; grows with v, and tells both ends apart."""
    return F.floor((v - F.col("__low")) / (F.col("__high") - F.col("__low")) * CUTS).cast("int")


def _same(by: list[str], keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__t{k}")) for k, c in enumerate([*by, *keys])), F.lit(True))


def order_statistics(df: DataFrame, value: Column, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """by, n, and for each name the value of that rank (from 0, an expression of n) in its group.

    Nulls, NaN and infinities are dropped; null keys are a group; a rank outside 0 to n - 1 gives
    null; groups without values do not appear."""
    v = value.cast("double")
    rows = df.select(*by, (v + 0.0).alias("__v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).withColumn("__k0", _coarse(F.col("__v")))
    spread = (F.count("*").alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    bins = rows.groupBy(*by, "__k0").agg(*spread)
    in_order = Window.partitionBy(*by).orderBy("__k0")  # a row for each bin
    bins = bins.withColumn("__end", F.sum("__c").over(in_order)).withColumn("n", F.sum("__c").over(Window.partitionBy(*by)))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    bins = bins.select("*", asked.alias("__ask")).select(*by, "n", "__k0", "__c", "__min", "__max", "__end", "__ask.*")
    held = (F.col("rank") < F.col("__end")) & (F.col("rank") >= F.col("__end") - F.col("__c"))
    targets = checkpoint(bins.where(held).withColumn("rank", F.col("rank") - F.col("__end") + F.col("__c")).drop("__end"))
    sizes = checkpoint(bins.select(*by, "n").distinct())
    found, keys = [], ["__k0"]
    while True:
        found.append(targets.where(F.col("__min") == F.col("__max")).select(*by, "name", F.col("__min").alias("value")))
        open_ = targets.where(F.col("__min") < F.col("__max"))
        if open_.isEmpty():
            break
        few = open_.where(F.col("__c") <= FEW)
        many = open_.where(F.col("__c") > FEW)
        place = [f"__t{k}" for k in range(len(by) + len(keys))]
        cells = small(few.select(*by, *keys).distinct().toDF(*place))
        gathered = rows.join(cells, _same(by, keys)).groupBy(*place).agg(F.sort_array(F.collect_list("__v")).alias("__all"))  # of FEW rows at most
        found.append(few.join(gathered, _same(by, keys)).select(*by, "name", F.get("__all", F.col("rank").cast("int")).alias("value")))
        if many.isEmpty():
            break
        name = f"__k{len(keys)}"
        cells = small(many.select(*by, *keys, F.col("__min").alias("__low"), F.col("__max").alias("__high")).distinct().toDF(*place, "__low", "__high"))
        rows = rows.join(cells, _same(by, keys)).withColumn(name, _fine(F.col("__v"))).drop(*place, "__low", "__high")
        inner = Window.partitionBy(*by, *keys).orderBy(name)
        parts = rows.groupBy(*by, *keys, name).agg(*spread).withColumn("__end", F.sum("__c").over(inner))
        parts = parts.toDF(*place, *parts.columns[len(place) :])
        met = many.select(*by, *keys, "n", "name", "rank").join(parts, _same(by, keys)).drop(*place)
        keys.append(name)
        targets = checkpoint(met.where(held).withColumn("rank", F.col("rank") - F.col("__end") + F.col("__c")).drop("__end"))
    values = reduce(DataFrame.union, found)
    wide = values.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks))
    names = [f"__t{k}" for k in range(len(by))]
    return sizes.join(wide.toDF(*names, *ranks), _same(by, []), "left").select(*by, "n", *ranks)


def quantiles(df: DataFrame, value: Column, by: list[str], parts: dict[str, float]) -> DataFrame:
    """by, n, and for each name the quantile of that part, linear between the two nearest ranks."""
    n = F.col("n")
    ranks = {}
    for k, q in enumerate(parts.values()):
        ranks |= {f"__lo{k}": F.floor(F.lit(q) * (n - 1)), f"__hi{k}": F.ceil(F.lit(q) * (n - 1))}
    found = order_statistics(df, value, by, ranks)
    at = lambda q: F.lit(q) * (n - 1) - F.floor(F.lit(q) * (n - 1))
    return found.select(*by, "n", *((F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * at(q)).alias(name) for k, (name, q) in enumerate(parts.items())))


def summarised(df: DataFrame, value: Column, by: list[str], parts: dict[str, float]) -> DataFrame:
    """by, n, mean, sd (n - 1), low, high, and quantiles: the profile of one number of a lane."""
    v = value.cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    moments = df.groupBy(*by).agg(F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("sd"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    names = [f"__t{k}" for k in range(len(by))]
    joined = quantiles(df, value, by, parts).join(moments.toDF(*names, "mean", "sd", "low", "high"), _same(by, []))
    return joined.select(*by, "n", "mean", "sd", "low", "high", *parts)
