"""Evaluation over scores that a provider computes: ablations by donor and blank, lanes, pairs of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.operators.pairing import group_donor
from weft.operators.stats import Z95, rounded

#: A model outside: rows (key, variant, ...) -> rows (key, variant, score); null where it failed.
ScoreProvider = Callable[[DataFrame], DataFrame]


def variants(rows: DataFrame, key: str, images: str) -> DataFrame:
    """Each row aligned, with the pictures of a donor that has as many, and blank."""
    counted = group_donor(rows.withColumn("__n", F.size(images)), "__n", key).drop("__n")
    donors = rows.select(F.col(key).alias("donor"), F.col(images).alias("donor_images"))
    joined = counted.join(donors, "donor", "left")
    kinds = F.explode(F.array(F.struct(F.lit("aligned").alias("variant"), F.col(images).alias("shown")), F.struct(F.lit("permuted").alias("variant"), F.col("donor_images").alias("shown")), F.struct(F.lit("blank").alias("variant"), F.transform(images, lambda _: F.lit(None)).cast(rows.schema[images].dataType).alias("shown"))))
    return joined.select("*", kinds.alias("__k")).select(*rows.columns, "__k.variant", "__k.shown").where((F.col("variant") != "permuted") | F.col("shown").isNotNull())


def ablation(scores: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Differences to aligned on rows that have both; a row without its aligned score counts nowhere."""
    return ablation_of_wide(scores.groupBy(*by, key).pivot("variant", ["aligned", "permuted", "blank"]).agg(F.first("score")), by)


def ablation_of_wide(wide: DataFrame, by: list[str]) -> DataFrame:
    """`ablation` of rows that have their aligned, permuted and blank scores side by side: no row per variant, no second grouping."""
    out = wide.where(F.col("aligned").isNotNull()).groupBy(*by)
    columns = [F.count("*").alias("n"), rounded(F.avg("aligned")).alias("aligned")]
    for v in ("permuted", "blank"):
        both, d = F.col(v).isNotNull(), F.col(v) - F.col("aligned")
        columns += [
            F.count(v).alias(f"n_{v}"), rounded(F.avg(d)).alias(f"delta_{v}"), rounded(F.try_divide(F.avg(d), F.avg(F.when(both, F.col("aligned"))))).alias(f"rel_{v}"),
            rounded(Z95 * F.stddev_samp(d) / F.sqrt(F.count(v))).alias(f"half_{v}"),
        ]
    return out.agg(*columns)


def training_effect(base: DataFrame, trained: DataFrame, by: list[str], metric: str) -> DataFrame:
    """The trained value minus the base value of each source that both have."""
    a, b = base.select(*by, F.col(metric).alias("base")), trained.select(*by, F.col(metric).alias("trained"))
    return a.join(b, by).withColumn("effect", rounded(F.col("trained") - F.col("base")))


def lane_table(scores: DataFrame, higher_is_better: dict[str, bool]) -> DataFrame:
    """source, metric, image and native means, and how much the image lane retains; the
    direction is that of the metric. scores: source, metric, lane (image or native), value."""
    wide = scores.groupBy("source", "metric").pivot("lane", ["image", "native"]).agg(F.avg("value"))
    up = F.coalesce(*(F.when(F.col("metric") == m, F.lit(v)) for m, v in higher_is_better.items()), F.lit(True))
    kept = F.when(up, X.retention(F.col("image"), F.col("native"))).otherwise(X.retention(F.col("image"), F.col("native"), False))
    return wide.select("source", "metric", rounded(F.col("image")).alias("image"), rounded(F.col("native")).alias("native"), rounded(kept).alias("retention"))
