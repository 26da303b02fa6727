"""Statistics over a table of token scores: row, pos, char_off, a_c, b_c, p_c, a_ce, b_ce, p_ce."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.determinism import with_ordinal
from weft.operators.quantiles import order_statistics, summarised

#: Fixed values.
Z95 = 1.959963985
Z_DETECT = 2.801585
TOKEN_BINS = ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 10), (10, 20), (20, 40), (40, 80), (80, 160), (160, 320), (320, 640), (640, 10**9))
DIGITS = 6


def finite(x: Column) -> Column:
    """Null for NaN and infinities: a missing number is no zero."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def rounded(x: Column) -> Column:
    return F.round(x.cast("double"), DIGITS)


def summary(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """n, mean, sd, min, max, median, standard error and 95 % interval; what is not finite is dropped."""
    found = summarised(df, value, by, {"median": 0.5})
    se = F.col("sd") / F.sqrt("n")
    return found.select(
        *by, "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"), "low", "high", rounded(F.col("median")).alias("median"),
        rounded(se).alias("se"), rounded(F.col("mean") - Z95 * se).alias("ci_low"), rounded(F.col("mean") + Z95 * se).alias("ci_high"),
    )


def percentile_modes(df: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """A quantile by the conventions in use: linear, floor index, rounded index, upper median."""
    n, at = F.col("n"), F.lit(q) * (F.col("n") - 1)
    ranks = {"floor_index": F.floor(at), "__next": F.ceil(at), "rounded_index": F.bround(at, 0), "upper_median": F.floor(n / 2)}
    found = order_statistics(df, F.col(value), by, ranks)
    linear = F.col("floor_index") + (F.col("__next") - F.col("floor_index")) * (at - F.floor(at))
    return found.select(*by, rounded(linear).alias("linear"), "floor_index", "rounded_index", "upper_median")


def cluster_stats(df: DataFrame, value: Column, row: str, by: list[str]) -> DataFrame:
    """Mean of row means with its standard error over rows, beside the one over tokens."""
    rows = df.groupBy(*by, row).agg(F.avg(value.cast("double")).alias("m"), F.count("*").alias("k"), F.sum(value.cast("double")).alias("s"), F.sum((value * value).cast("double")).alias("s2"))
    n, mean = F.sum("k"), F.sum("s") / F.sum("k")
    naive = F.when(n > 1, F.sqrt(F.greatest((F.sum("s2") - n * mean * mean) / (n - 1), F.lit(0.0)) / n))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"), n.cast("long").alias("n_tokens"), rounded(F.avg("m")).alias("row_mean"), rounded(F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se_cluster"), rounded(naive).alias("se_naive"),
    )


def bin_table(spark, bins=TOKEN_BINS) -> DataFrame:
    return spark.createDataFrame([(k, lo, hi, f"{lo}-{hi - 1}" if hi < 10**9 else f"{lo}+") for k, (lo, hi) in enumerate(bins)], "bin_no int, lo long, hi long, bin string")


def bin_number(x: Column, bins=TOKEN_BINS) -> Column:
    return F.coalesce(*(F.when((x >= lo) & (x < hi), F.lit(k)) for k, (lo, hi) in enumerate(bins)))


def position_bins(scores: DataFrame, x: str = "pos", least: int = 30, bins=TOKEN_BINS, keep_empty: bool = True) -> DataFrame:
    """Gain of aligned over blank by bins, with both standard errors; empty bins have nulls or go."""
    d = F.col("a_c").cast("double") - F.col("b_c").cast("double")
    placed = scores.withColumn("bin_no", bin_number(F.col(x), bins)).where(F.col("bin_no").isNotNull()).withColumn("d", d)
    rows = placed.groupBy("bin_no", "row").agg(
        F.count("*").alias("k"), F.avg("d").alias("m"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("s2"),
        *(F.sum(F.col(c).cast("double")).alias(c) for c in ("a_c", "b_c", "a_ce", "b_ce")),
    )
    n, gain = F.sum("k"), F.sum("s") / F.sum("k")
    naive = F.when(n > 1, F.sqrt(F.greatest((F.sum("s2") - n * gain * gain) / (n - 1), F.lit(0.0)) / n))
    cluster = F.stddev_samp("m") / F.sqrt(F.count("*"))
    table = rows.groupBy("bin_no").agg(
        n.cast("long").alias("n_tokens"), F.count("*").alias("n_rows"), rounded(F.sum("a_c") / n).alias("acc_aligned"), rounded(F.sum("b_c") / n).alias("acc_blank"),
        rounded(gain * 100).alias("gain_pts"), rounded(F.avg("m") * 100).alias("gain_pts_rowmean"), rounded(naive * 100).alias("se_naive_pts"), rounded(cluster * 100).alias("se_cluster_pts"),
        rounded(F.sum("a_ce") / n).alias("ce_aligned"), rounded(F.sum("b_ce") / n).alias("ce_blank"),
    )
    joined = F.broadcast(bin_table(scores.sparkSession, bins)).join(table, "bin_no", "left" if keep_empty else "inner")
    filled = F.coalesce("n_tokens", F.lit(0))
    return joined.withColumn("n_tokens", filled).withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn("underpowered", F.col("n_tokens") < least).drop("hi")


def bucket_table(scores: DataFrame, x: str, width: int, n_buckets: int) -> DataFrame:
    """Sum and count of the paired gain for each row and uniform bucket; the last takes the rest."""
    bucket = F.least(F.floor(F.col(x) / width), F.lit(n_buckets - 1)).cast("int")
    return scores.groupBy("row", bucket.alias("bucket")).agg(F.sum(F.col("a_c").cast("long") - F.col("b_c").cast("long")).alias("sum_d"), F.count("*").alias("cnt"))


def collapse_point(buckets: DataFrame, by: list[str], width: int, baseline: int, least: int, frac: float = 0.5) -> DataFrame:
    """Where the gain falls below a part of its baseline and stays there, or why that is unknown.

    buckets: by, bucket, sum_d, cnt (already added up over rows)."""
    first = baseline // width
    base = buckets.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("bucket") < first, F.col("cnt"))), F.lit(0)).alias("base_n"), F.coalesce(F.sum(F.when(F.col("bucket") < first, F.col("sum_d"))), F.lit(0)).alias("base_sum"),
        F.max(F.when(F.col("cnt") > 0, F.col("bucket"))).alias("last_filled"),
    )
    joined = buckets.where((F.col("bucket") >= first) & (F.col("cnt") >= least)).join(base, by)
    below = joined.withColumn("below", F.col("sum_d") / F.col("cnt") < F.lit(frac) * F.try_divide(F.col("base_sum"), F.col("base_n")))
    later = Window.partitionBy(*by).orderBy(F.col("bucket").desc())
    stays = below.withColumn("stays", F.min(F.col("below").cast("int")).over(later) == 1)
    found = stays.groupBy(*by).agg(
        F.count("*").alias("eligible"), F.min(F.when(F.col("stays"), F.col("bucket"))).alias("k_bucket"), F.min(F.when(F.col("below"), F.col("bucket"))).alias("first_below"), F.max("bucket").alias("last_eligible")
    )
    out = base.join(found, by, "left")
    status = (
        F.when(F.col("base_n") < least, "no_baseline_tokens").when(F.col("base_sum") <= 0, "no_reading").when(F.coalesce("eligible", F.lit(0)) == 0, "censored_short")
        .when(F.col("k_bucket").isNull(), "censored_right").when(F.col("k_bucket") == first, "ok_at_structural_floor").otherwise("ok")
    )
    ok = F.col("status").isin("ok", "ok_at_structural_floor")
    bound = F.when(F.col("status") == "censored_short", (F.coalesce("last_filled", F.lit(-1)) + 1) * width).when(F.col("status") == "censored_right", (F.col("last_eligible") + 1) * width)
    read = ok | (F.col("status") == "censored_right")
    return out.withColumn("status", status).select(
        *by, "status", F.col("base_n").cast("long").alias("baseline_n"), rounded(F.try_divide(F.col("base_sum") * 100, F.col("base_n"))).alias("baseline_gain_pts"),
        F.when(ok, F.col("k_bucket") * width).cast("long").alias("k_chars"), F.when(read, F.col("first_below") * width).cast("long").alias("k_first_crossing"), bound.cast("long").alias("k_lower_bound"), F.coalesce(F.col("k_bucket") == first, F.lit(False)).alias("at_floor"),
    )


def deepest_bin(table: DataFrame, by: list[str], frac: float = 0.5) -> DataFrame:
    """The deepest bin whose gain is at least a part of bin 0's; null with a reason if there is none."""
    zero = table.groupBy(*by).agg(F.max(F.when(F.col("bin_no") == 0, F.col("gain_pts"))).alias("gain0"))
    deep = table.join(zero, by).where((F.col("gain0") > 0) & (F.col("gain_pts") >= F.lit(frac) * F.col("gain0"))).groupBy(*by).agg(F.max_by("lo", "bin_no").alias("d50_lo"))
    reason = F.when(F.col("gain0").isNull(), "no_position_0").when(F.col("gain0") <= 0, "no_gain_at_0").otherwise("ok")
    return zero.join(deep, by, "left").select(*by, "gain0", "d50_lo", reason.alias("status"))


@F.pandas_udf(T.DoubleType())
def sign_test_p(more: pd.Series, less: pd.Series) -> pd.Series:
    """Exact two-sided binomial test; null without untied rows."""

    def one(a: int, b: int) -> float | None:
        n, k = int(a + b), int(min(a, b))
        if n == 0:
            return None
        if n > 5000:  # same sum in logarithms
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
            top = max(logs)
            return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in logs))
        return float(min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n))

    return pd.Series([one(a, b) for a, b in zip(more, less, strict=True)], dtype="float64")


def row_signs(scores: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose aligned mean is above, below or equal to the blank mean, and the sign test."""
    d = F.sum(F.col("a_c").cast("long") - F.col("b_c").cast("long"))
    rows = scores.groupBy(*by, "row").agg(d.alias("d"))
    counts = rows.groupBy(*by).agg(F.count_if(F.col("d") > 0).alias("more"), F.count_if(F.col("d") < 0).alias("less"), F.count_if(F.col("d") == 0).alias("tied"))
    return counts.withColumn("p", sign_test_p("more", "less"))


def paired_delta(scores: DataFrame, by: list[str], x: str, aligned: str = "a_ce") -> DataFrame:
    """Mean difference on rows that have both, relative to the aligned mean, with interval and flag."""
    a, b = F.col(aligned).cast("double"), F.col(x).cast("double")
    both = scores.where(a.isNotNull() & b.isNotNull())
    se = F.stddev_samp(b - a) / F.sqrt(F.count("*"))
    rel = F.try_divide(F.avg(b) - F.avg(a), F.avg(a))
    flag = F.when(rel.isNull(), "n/a").when(F.abs(rel) < 0.05, "<5%").when(F.abs(rel) < 0.2, "<20%").otherwise("grounded")
    return both.groupBy(*by).agg(F.count("*").alias("n"), rounded(F.avg(b - a)).alias("delta"), rounded(rel).alias("relative"), rounded(F.avg(b - a) - Z95 * se).alias("ci_low"), rounded(F.avg(b - a) + Z95 * se).alias("ci_high"), flag.alias("flag"))


def ratio_of_totals(df: DataFrame, top: str, bottom: str, by: list[str]) -> DataFrame:
    a, b = F.col(top).cast("double"), F.col(bottom).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), rounded(F.avg(a - b)).alias("mean_difference"), rounded(F.avg(F.when(b != 0, a / b))).alias("mean_ratio"), rounded(F.try_divide(F.sum(a), F.sum(b))).alias("ratio_of_totals"),
        F.count_if(a > b).alias("more"), F.count_if(a == b).alias("equal"), F.count_if(a < b).alias("less"),
    )


def macro_and_weighted(scores: DataFrame, by: list[str], loss: str, weight: Column) -> DataFrame:
    """One row: the token-weighted loss of each group averaged over groups, and over all tokens."""
    each = scores.groupBy(*by).agg(F.sum(F.col(loss) * weight).alias("s"), F.sum(weight).alias("w"))
    return each.agg(F.count("*").alias("groups"), rounded(F.coalesce(F.avg(F.col("s") / F.greatest(F.col("w"), F.lit(1))), F.lit(0.0))).alias("macro"), rounded(F.sum("s") / F.greatest(F.sum("w"), F.lit(1))).alias("weighted"))


def spearman(df: DataFrame, x: str, y: str, by: list[str], *ties: str) -> DataFrame:
    """Correlation of ranks without averaged ties (further keys break them); null below 5 rows or
    without variance. Ranks are numbered over ranges of each group, so no task sorts a whole one."""
    keys = [c for c in dict.fromkeys([*by, x, y, *ties])]
    ranked = with_ordinal(with_ordinal(df.select(*keys), x, *ties, name="__rx", by=by), y, *ties, name="__ry", by=by)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (F.count("*") >= 5)
    rho = F.corr(F.col("__rx").cast("double"), F.col("__ry").cast("double"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), rounded(F.when(varies, rho)).alias("rho"))


#: Groups whose sums a task holds before it sends them on.
_GROUPS = 256
#: Weights that a task holds at once, and columns of all groups that are multiplied with them in one go.
_WEIGHTS, _WIDE = 2_000_000, 128
#: Partial sums that are merged in the first of two steps.
_MERGED = 64
#: Tasks of a bootstrap by core: as many as cores and a few would take two rounds.
_TASKS = 4
#: The greatest of a row's Poisson numbers, as its 16 bits can tell.
_MOST_TIMES = 8


def poisson_times(keys: list[str], n_boot: int, seed: int) -> np.ndarray:
    """How often each row counts in replicates 1 to n_boot: Poisson numbers of mean 1 from 16 bits
    of sha256(seed|block|row), where a digest serves the sixteen replicates of its block."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    times = np.searchsorted(steps, np.arange(65536) / 65536.0, "right").astype(np.uint8)  # of each 16 bits
    blocks = [f"{seed}|{k}|".encode() for k in range(-(-n_boot // 16))]
    sha = hashlib.sha256
    digests = b"".join([sha(b + raw).digest() for raw in (key.encode() for key in keys) for b in blocks])
    return times[np.frombuffer(digests, ">u2")].reshape(len(keys), len(blocks) * 16)[:, :n_boot]


def replicate_sums(rows: DataFrame, row: str, by: list[str], sums: list[str], n_boot: int, seed: int) -> DataFrame:
    """by, and for each of the columns `sums` an array of its sum in every replicate.

    One pass over the rows: a batch's weights are a matrix of keys by replicates, which is
    multiplied with the columns of all groups and never becomes rows. Rows are dealt out by their
    key and rows of one key are next to one another, so a key's weights, which are most of the work,
    are made once for all of its groups, in several tasks for each core. A task sends one row of sums
    for each group it has seen. Rows with a null key count by the key "null"; null numbers count as 0."""
    context = rows.sparkSession.sparkContext
    dealt = rows.select(*dict.fromkeys([*by, row, *sums])).repartition(_TASKS * context.defaultParallelism, row).sortWithinPartitions(row)
    keyed = dealt.select(*by, F.coalesce(F.col(row).cast("string"), F.lit("null")).alias("__row"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__s{k}") for k, c in enumerate(sums)))
    schema = T.StructType([*(keyed.schema[c] for c in by), T.StructField("__part", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in sums)])
    n_sums = len(sums)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kinds = TaskContext.get().partitionId() // _MERGED, {}, []

        def frame() -> pa.RecordBatch:
            keys = [pa.array([key[k] for key in held], kind) for k, kind in enumerate(kinds)]
            totals = [pa.array([total[k] for total in held.values()], pa.list_(pa.float64())) for k in range(n_sums)]
            return pa.record_batch([*keys, pa.array([part] * len(held), pa.int32()), *totals], names=schema.names)

        for whole in batches:
            kinds = whole.schema.types[: len(by)]
            for at in range(0, whole.num_rows, step := max(1, _WEIGHTS // n_boot)):
                some = whole.slice(at, step)
                coded = [c.dictionary_encode(null_encoding="encode") for c in some.columns[: len(by) + 1]]
                key_of, keys = coded[-1].indices.to_numpy(), coded[-1].dictionary.to_pylist()
                values = np.array([c.to_numpy() for c in some.columns[len(by) + 1 :]])
                codes = np.zeros(some.num_rows, np.int64)
                for c in coded[:-1]:
                    _, codes = np.unique(codes * len(c.dictionary) + c.indices.to_numpy(), return_inverse=True)
                _, firsts = np.unique(codes, return_index=True)
                exact = (values == np.floor(values)).all() and np.abs(values).sum() * _MOST_TIMES < 1 << 24  # in single precision
                kind = np.float32 if exact else np.float64
                times = poisson_times(keys, n_boot, seed).astype(kind)
                wide = max(1, _WIDE // n_sums)
                for group in range(0, len(firsts), wide):
                    of = firsts[group : group + wide]
                    inside = slice(None) if len(firsts) <= wide else (codes >= group) & (codes < group + len(of))
                    cell = (codes[inside] - group) * len(keys) + key_of[inside]
                    spread = np.array([np.bincount(cell, v[inside], len(of) * len(keys)) for v in values]).reshape(n_sums * len(of), -1)
                    summed = (spread.astype(kind) @ times).astype(float).reshape(n_sums, len(of), -1)
                    for k, first in enumerate(of):
                        key = tuple(c.dictionary[c.indices[first].as_py()].as_py() for c in coded[:-1])
                        key = tuple(None if x is None or x != x else x for x in key)
                        held[key] = held.get(key, 0) + summed[:, k]
                if len(held) > _GROUPS:
                    yield frame()
                    held = {}
        if held:
            yield frame()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        for c in sums:
            out[c] = [np.sum(np.stack(pdf[c].to_numpy()), axis=0)]
        return out

    partial = keyed.mapInArrow(weigh, schema)
    merged = partial.groupBy(*by, "__part").applyInPandas(added, schema)
    return merged.withColumn("__part", F.lit(0)).groupBy(*by, "__part").applyInPandas(added, schema).drop("__part")


def array_quantile(values: Column, q: float) -> Column:
    """The quantile of a sorted array's numbers, linear between two; null of an empty one."""
    at = F.lit(q) * (F.size(values) - 1)
    low = F.get(values, F.floor(at).cast("int"))
    return F.when(F.size(values) > 0, low + (F.get(values, F.ceil(at).cast("int")) - low) * (at - F.floor(at)))


def bootstrap_rate(rows: DataFrame, hits: str, tokens: str, by: list[str], n_boot: int = 1000, seed: int = 42, level: float = 0.95, row: str = "row") -> DataFrame:
    """Pooled rate and mean of the rows' rates, with the cluster's standard error and a percentile
    interval over resampled rows; the interval is null for a single row.

    Rows count as often as a keyed Poisson number says instead of being drawn n of n with
    replacement: the number of rows of a replicate varies, and its rate is a ratio of sums
    either way. rows: by, row, hits, tokens, one for each row of a group."""
    each = replicate_sums(rows, row, by, [hits, tokens], n_boot, seed)
    rates = F.sort_array(F.array_compact(F.zip_with(hits, tokens, lambda h, t: F.when(t > 0, h / t))))
    ends = each.select(*(F.col(c).alias(f"__t{k}") for k, c in enumerate(by)), rates.alias("__r"))
    own = F.when(F.col(tokens) > 0, F.col(hits) / F.col(tokens))
    point = rows.groupBy(*by).agg(
        F.try_divide(F.sum(hits), F.sum(tokens)).alias("rate"), F.count("*").alias("n_rows"), F.avg(own).alias("rate_rowmean"), (F.stddev_samp(own) / F.sqrt(F.count(own))).alias("se_cluster")
    )
    joined = point.join(ends, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__t{k}")) for k, c in enumerate(by)), F.lit(True)))
    several = F.col("n_rows") > 1
    low, high = (F.when(several, array_quantile(F.col("__r"), (1 + s * level) / 2)) for s in (-1, 1))
    return joined.select(*by, "rate", "n_rows", "rate_rowmean", "se_cluster", low.alias("ci_low"), high.alias("ci_high"))


def bootstrap_collapse(per_row: DataFrame, by: list[str], width: int, baseline: int, least: int, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Interval of the collapse point and how often each status came up; per_row: bucket_table with `by`."""
    each = replicate_sums(per_row, "row", [*by, "bucket"], ["sum_d", "cnt"], n_boot, seed)
    numbered = each.select(*by, "bucket", F.posexplode(F.arrays_zip("sum_d", "cnt")).alias("b", "z")).select(*by, "bucket", "b", "z.*").where(F.col("cnt") > 0)
    found = collapse_point(numbered, [*by, "b"], width, baseline, least)
    statuses = ("ok", "ok_at_structural_floor", "censored_right", "censored_short", "no_reading", "no_baseline_tokens")
    points = found.groupBy(*by).agg(
        F.count("*").alias("n_boot"), F.count("k_chars").alias("n_resolved"), F.count_if("at_floor").alias("n_at_floor"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses if s != "ok_at_structural_floor"), F.sort_array(F.collect_list("k_chars")).alias("__k"),
    )
    return points.select(
        *(c for c in points.columns if c != "__k"), *(array_quantile(F.col("__k"), q).alias(name) for name, q in (("ci_low", 0.05), ("median", 0.5), ("ci_high", 0.95)))
    )


def gap_weights(scores: DataFrame, batch: list[str], beta: float, valid: Column) -> DataFrame:
    """1 + beta * max(b - a, 0), 0 where not valid, scaled to mean 1 over the valid tokens of a batch."""
    raw = F.when(valid, 1 + F.lit(beta) * F.greatest(F.col("b_ce") - F.col("a_ce"), F.lit(0.0))).otherwise(0.0)
    mean = F.try_divide(F.sum("__w").over(Window.partitionBy(*batch)), F.sum(valid.cast("int")).over(Window.partitionBy(*batch)))
    return scores.withColumn("__w", raw).withColumn("weight", rounded(F.coalesce(F.try_divide(F.col("__w"), mean), F.lit(0.0)))).drop("__w")


def ci_decision(low: Column, high: Column, bar: float | Column) -> Column:
    """PASS or FAIL only if the whole interval is on one side of the bar."""
    return F.when(low.isNull() | high.isNull(), "UNDECIDABLE").when(low >= bar, "PASS").when(high < bar, "FAIL").otherwise("UNDECIDABLE")
