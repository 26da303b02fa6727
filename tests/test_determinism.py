"""Ordinals of tables too wide and too long for one range sample, whatever the partitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weft.functions.determinism import shuffled, with_ordinal
from weft.operators import mixture as M


def wide(spark, n, parts):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("text"))


@pytest.mark.parametrize("parts", [4, 8, 32])
def test_every_row_once(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        n = 60_000
        df = wide(spark, n, parts)
        for numbered in (shuffled(df, 5, "k"), with_ordinal(df, "text", "k")):
            row = numbered.agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")).first()
            assert tuple(row) == (n, n, 0, n - 1)
        ordered = with_ordinal(df.select("k", "text"), "k").where(F.col("ordinal") != F.col("k"))
        assert ordered.count() == 0
        for numbered in (shuffled(df, 5, "k", by=["g"]), with_ordinal(df, "k", by=["g"])):
            groups = numbered.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.max("ordinal").alias("high")).collect()
            assert len(groups) == 7 and all(r.n == r.d == r.high + 1 for r in groups)
        halves = M.split(df, 0.9, 3, "k").groupBy("split").count().collect()
        assert dict(map(tuple, halves)) == {"train": n * 9 // 10, "validation": n // 10}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_null_groups_and_ties(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", None), ("a", 2), ("a", 2)], "g string, k int")
    got = sorted((r.g or "", r.ordinal) for r in with_ordinal(df, "k", by=["g"]).collect())
    assert got == [("", 0), ("", 1), ("a", 0), ("a", 1), ("a", 2)]
    assert with_ordinal(df.limit(0), "k").count() == 0 and shuffled(df.limit(0), 1, "k", by=["g"]).count() == 0


def test_below_is_uniform_below(spark):
    from weft.functions.determinism import below, uniform

    df = spark.range(3000)
    for rate in (0.0, 1e-12, 0.1, 0.3, 0.5, 1 - 1e-12, 1.0):
        assert df.where(below(rate, F.lit(3), F.col("id")) != (uniform(F.lit(3), F.col("id")) < rate)).count() == 0
    exact = df.select(uniform(F.lit(3), F.col("id")).alias("u")).first().u
    assert df.where("id = 0").where(below(exact, F.lit(3), F.col("id"))).count() == 0
