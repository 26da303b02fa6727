"""Whole evaluation reports: estimates with their intervals, and the decisions these allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.storage import stored
from weft.operators import stats as S

AT_LEAST, AT_MOST = ">=", "<="


def decay_report(scores: DataFrame, by: list[str], bins=S.TOKEN_BINS, least: int = 30, limit: int | None = None) -> DataFrame:
    """Of each group and bin of positions: tokens, rows, gain of aligned over blank and over permuted
    inputs in points, each with its standard error over rows; the deepest bin that keeps half of
    bin 0's gain, and with `limit` the group's rows that have positions from there on.

    A row's tokens of a bin count by their mean in the standard errors, so one long row is one row."""
    gain, permuted = (F.col("a_c").cast("double") - F.col(c).cast("double") for c in ("b_c", "p_c"))
    placed = scores.withColumn("bin_no", S.bin_number(F.col("pos"), bins)).where(F.col("bin_no").isNotNull())
    rows = placed.groupBy(*by, "bin_no", "row").agg(
        F.count("*").alias("k"), F.sum(gain).alias("g"), F.avg(gain).alias("gm"), F.count(permuted).alias("kp"), F.sum(permuted).alias("p"), F.avg(permuted).alias("pm"),
        F.max(F.col("pos") >= limit if limit is not None else F.lit(False)).alias("deep"),
    )
    se = lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)) * 100
    found = rows.groupBy(*by, "bin_no").agg(
        F.sum("k").alias("n_tokens"), F.count("*").alias("n_rows"), S.rounded(F.sum("g") / F.sum("k") * 100).alias("gain_pts"), S.rounded(se("gm")).alias("se_pts"),
        S.rounded(F.try_divide(F.sum("p"), F.sum("kp")) * 100).alias("permuted_pts"), S.rounded(se("pm")).alias("permuted_se_pts"),
    )
    found = found.join(F.broadcast(S.bin_table(scores.sparkSession, bins).select("bin_no", "lo")), "bin_no")
    deep = S.deepest_bin(found, by).select(*by, "d50_lo", "status")
    ends = rows.groupBy(*by, "row").agg(F.max("deep").alias("deep")).groupBy(*by).agg(F.count("*").alias("rows_all"), F.count_if("deep").alias("rows_cut"))
    out = found.join(deep, by).join(ends, by).withColumn("underpowered", F.col("n_tokens") < least)
    return out.select(*by, "lo", "n_tokens", "n_rows", "gain_pts", "se_pts", "permuted_pts", "permuted_se_pts", "underpowered", "d50_lo", "status", "rows_all", "rows_cut")


def ladder_report(scores: DataFrame, rung: str, density: DataFrame, width: int, n_buckets: int, baseline: int, least: int, n_boot: int = 1000) -> DataFrame:
    """Of each rung: its density, where its gain collapses, the interval of that point over resampled rows
    and in how many replicates it was found, and the rows whose mean gain is above, below or at 0
    with the sign test. no_later: it collapses no later than the rung of the next lower density."""
    from weft.plans.composites import density_ladder

    bucket = F.least(F.floor(F.col("char_off") / width), F.lit(n_buckets - 1)).cast("int")
    each = scores.groupBy(rung, "row", bucket.alias("bucket")).agg(F.sum(F.col("a_c").cast("long") - F.col("b_c").cast("long")).alias("sum_d"), F.count("*").alias("cnt"))
    whole = each.groupBy(rung, "bucket").agg(F.sum("sum_d").alias("sum_d"), F.sum("cnt").alias("cnt"))
    points = density_ladder(whole, rung, density, width, baseline, least)
    spread = S.bootstrap_collapse(each, [rung], width, baseline, least, n_boot).select(rung, "n_resolved", F.col("ci_low").alias("k_low"), F.col("ci_high").alias("k_high"))
    return points.join(spread, rung, "left").join(S.row_signs(scores, [rung]), rung, "left")


def rated_checks(observations: DataFrame, by: list[str], bars: dict[str, tuple[str, float]], row: str = "row", n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """observations: by, check, row, hit (0 or 1; null counts as none). Of each group and check of
    `bars`: observations, rows, pooled rate and mean of rows with its standard error, interval over
    resampled rows, and PASS or FAIL only if the whole interval is on one side of the bar.

    A check without an observation in a group is UNDECIDABLE there and has no rate. Observations
    are read once: what they add up to by row is stored, rows of one name beside one another."""
    spark = observations.sparkSession
    asked = F.broadcast(spark.createDataFrame([(c, d, float(b)) for c, (d, b) in bars.items()], "check string, direction string, bar double"))
    added = observations.groupBy(*by, "check", row).agg(F.sum(F.col("hit").cast("double")).alias("hits"), F.count("hit").alias("tokens"))
    added = stored(added.sortWithinPartitions(row))
    rows = added.where(F.col("tokens") > 0)
    rates = S.bootstrap_rate(rows, "hits", "tokens", [*by, "check"], n_boot, seed, row=row)
    sizes = rows.groupBy(*by, "check").agg(F.sum("tokens").alias("n"))
    wanted = added.select(*by).distinct().join(asked)
    joined = wanted.join(rates.join(sizes, [*by, "check"]), [*by, "check"], "left")
    above = S.ci_decision(F.col("ci_low"), F.col("ci_high"), F.col("bar"))
    undecided = F.col("ci_low").isNull() | F.col("ci_high").isNull()
    below = F.when(undecided, "UNDECIDABLE").when(F.col("ci_high") <= F.col("bar"), "PASS").when(F.col("ci_low") > F.col("bar"), "FAIL").otherwise("UNDECIDABLE")
    numbers = [S.rounded(F.col(c)).alias(c) for c in ("rate", "rate_rowmean", "se_cluster", "ci_low", "ci_high")]
    return joined.select(*by, "check", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), *numbers, "direction", "bar", F.when(F.col("direction") == AT_LEAST, above).otherwise(below).alias("decision"))


def checks_verdict(checks: DataFrame, by: list[str], void: Column | None = None) -> DataFrame:
    """Of each group: checks passed, failed and undecided, and VOID where `void` holds of any, else FAIL
    if one failed, UNDECIDABLE if one is, else PASS."""
    count = lambda s: F.count_if(F.col("decision") == s)
    found = checks.groupBy(*by).agg(count("PASS").alias("passed"), count("FAIL").alias("failed"), count("UNDECIDABLE").alias("undecided"), F.max(F.coalesce(void, F.lit(False)) if void is not None else F.lit(False)).alias("__void"))
    verdict = F.when(F.col("__void"), "VOID").when(F.col("failed") > 0, "FAIL").when(F.col("undecided") > 0, "UNDECIDABLE").otherwise("PASS")
    return found.select(*by, "passed", "failed", "undecided", verdict.alias("verdict"))
