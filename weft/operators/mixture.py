"""The dataset algebra: filters, slices, seeded samples, splits, unions, shares and plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.determinism import order_key, shuffled, with_ordinal

#: Tokens that a chat template adds to a row.
TEMPLATE_TOKENS = 256


class MixtureError(ValueError):
    """A mixture that cannot be built as asked."""


def image_limit(df: DataFrame, most: int | None, count: Column | None = None) -> DataFrame:
    """Rows with at most `most` images; None keeps all."""
    if most is None:
        return df
    if most < 0:
        raise MixtureError(f"a limit of {most} images")
    if count is None and "images" not in df.columns:
        raise MixtureError("no column images")
    return df.where((count if count is not None else F.size("images")) <= most)


def fits_budget(tokens: Column, images: Column, most: int, per_image: int) -> Column:
    """Unknown lengths (0, negative or null) fit."""
    known = F.coalesce(tokens, F.lit(-1))
    return (known <= 0) | (known + images * per_image + TEMPLATE_TOKENS <= most)


def token_budget(df: DataFrame, most: int | None, per_image: int, tokens: str = "original_token_length", images: Column | None = None) -> DataFrame:
    if most is None or tokens not in df.columns:
        return df
    return df.where(fits_budget(F.col(tokens), images if images is not None else F.size("images"), most, per_image))


def retention(df: DataFrame, most: int, per_image: int, by: list[str], tokens: Column, images: Column) -> DataFrame:
    kept = fits_budget(tokens, images, most, per_image)
    return df.groupBy(*by).agg(
        F.count("*").alias("rows_before"), F.count_if(kept).alias("rows_after"), F.round(F.count_if(kept) / F.count("*"), 6).alias("fraction"),
        (F.count("*") - F.count_if(kept)).alias("dropped"), F.max(F.when(tokens > 0, tokens + images * per_image + TEMPLATE_TOKENS)).cast("long").alias("longest"),
    )


def take_slice(df: DataFrame, keys: list[str], offset: int = 0, n: int | None = None) -> DataFrame:
    """Rows offset to offset + n in the order of the keys; n of 0 gives none, None all that follow."""
    if offset < 0 or (n is not None and n < 0):
        raise MixtureError(f"a slice from {offset} of {n} rows")
    numbered = with_ordinal(df, *keys, name="__at").where(F.col("__at") >= offset)
    return (numbered if n is None else numbered.where(F.col("__at") < offset + n)).drop("__at")


def bounded_sample(df: DataFrame, n: int, seed: int, *keys: str, by: list[str] | None = None) -> DataFrame:
    """The first n rows in seeded order, of each group if `by` is given; all of a smaller group."""
    if n <= 0:
        raise MixtureError(f"a sample of {n} rows")
    if not by:
        return df.withColumn("__order", order_key(seed, *keys)).orderBy("__order", *keys).limit(n).drop("__order")
    # rank and bound stand together, so that Spark keeps n rows of a group in each task before the shuffle
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order_key(seed, *keys), *keys))
    return df.withColumn("__at", rank).where(F.col("__at") <= n).drop("__at")


def split(df: DataFrame, ratio: float, seed: int, *keys: str, name: str = "split") -> DataFrame:
    """train for exactly floor(ratio * rows) rows in seeded order, validation for the rest."""
    if not 0 < ratio < 1:
        raise MixtureError(f"a split at {ratio}")
    numbered = shuffled(df, seed, *keys, name="__at")
    bound = int(df.count() * ratio)
    return numbered.withColumn(name, F.when(F.col("__at") < bound, "train").otherwise("validation")).drop("__at")


def union_all(*parts: DataFrame, pad: bool = False) -> DataFrame:
    """Union by name. Columns must agree, unless `pad` fills what is missing with nulls."""
    if not parts:
        raise MixtureError("nothing to unite")
    if not pad:
        first = {(f.name, f.dataType.simpleString()) for f in parts[0].schema}
        for p in parts[1:]:
            if odd := first ^ {(f.name, f.dataType.simpleString()) for f in p.schema}:
                raise MixtureError(f"columns differ: {sorted(odd)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=pad), parts)


def merge(*parts: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Union in seeded order, which the column `position` holds."""
    return shuffled(union_all(*parts), seed, *keys, name="position")


def share_table(lanes: DataFrame, rows: str, mean_tokens: str, readable: str) -> DataFrame:
    """Row and token shares of lanes with these columns, and their part that can be read."""
    whole = Window.partitionBy()  # one row for each lane
    tokens = F.col(rows) * F.col(mean_tokens)
    return lanes.select(
        "*", F.round(F.col(rows) / F.sum(rows).over(whole), 6).alias("row_share"), F.round(tokens / F.sum(tokens).over(whole), 6).alias("token_share"),
        F.round(F.sum(tokens * F.col(readable)).over(whole) / F.sum(tokens).over(whole), 6).alias("readable_overall"),
    )


def token_share_plan(lanes: DataFrame, total_rows: int, share: str, mean_tokens: str, available: str) -> DataFrame:
    """Rows of each lane for its share of the tokens: in proportion to share / mean tokens,
    rounded half to even, then cut to what there is; nothing is scaled up for it."""
    whole = Window.partitionBy()
    weight = F.col(share) / F.col(mean_tokens)
    planned = F.bround(F.lit(total_rows) * weight / F.sum(weight).over(whole), 0).cast("long")
    out = lanes.select("*", planned.alias("planned"), F.least(planned, F.col(available).cast("long")).alias("rows")).withColumn("clamped", F.col("rows") < F.col("planned"))
    tokens = F.col("rows") * F.col(mean_tokens)
    return out.withColumn("realised_share", F.round(tokens / F.sum(tokens).over(whole), 6))


def evenly_spaced(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """Rows at round(i * (N - 1) / (k - 1)), half to even, each once."""
    n = df.count()
    at = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 and n else [0]
    return with_ordinal(df, *keys).where(F.col("ordinal").isin(at))


def review_rows(df: DataFrame, subset: str, images: Column, n: int, seed: int, *keys: str) -> DataFrame:
    """Up to n rows of each subset, dealt round robin over image counts, the rarest count first."""
    counted = df.withColumn("__images", images)
    sizes = counted.groupBy(subset, "__images").agg(F.count("*").alias("__size"))
    # no subset needs more than n rows of one image count
    rank = F.row_number().over(Window.partitionBy(subset, "__images").orderBy(order_key(seed, *keys), *keys))
    first = counted.withColumn("__round", rank).where(F.col("__round") <= n)
    sizes = sizes.toDF("__subset", "__count", "__size")
    sized = first.join(sizes, F.col(subset).eqNullSafe(F.col("__subset")) & F.col("__images").eqNullSafe(F.col("__count"))).drop("__subset", "__count")
    dealt = Window.partitionBy(subset).orderBy("__round", "__size", "__images")
    return sized.withColumn("pick", F.row_number().over(dealt)).where(F.col("pick") <= n).drop("__round", "__size", "__images")


def leakage(train: DataFrame, validation: DataFrame, text: str) -> DataFrame:
    """One row: validation rows, distinct targets, repeated ones, and distinct targets that train holds."""
    targets = validation.select(F.sha2(text, 256).alias("h"))
    seen = targets.distinct().join(train.select(F.sha2(text, 256).alias("h")), "h", "left_semi").agg(F.count("*").alias("leaked"))
    sizes = targets.agg(F.count("*").alias("validation_rows"), F.count_distinct("h").alias("distinct_targets"))
    return sizes.withColumn("repeated", F.col("validation_rows") - F.col("distinct_targets")).crossJoin(seen)


def length_candidates(df: DataFrame, tokens: Column, images: Column, per_image: int, candidates: list[int]) -> DataFrame:
    """Kept and cut rows for each candidate length, and whether it is the smallest that keeps all whole."""
    need = tokens + images * per_image + TEMPLATE_TOKENS
    sums = df.agg(F.count("*").alias("n"), *(F.count_if((tokens <= 0) | (need <= c)).alias(f"k{c}") for c in candidates))
    rows = F.explode(F.array(*(F.struct(F.lit(c).cast("long").alias("max_length"), F.col(f"k{c}").alias("kept")) for c in sorted(candidates))))
    out = sums.select("n", rows.alias("r")).select("r.*", (F.col("n") - F.col("r.kept")).alias("cut"))
    best = F.min(F.when(F.col("cut") == 0, F.col("max_length"))).over(Window.partitionBy())
    return out.withColumn("chosen", F.coalesce(F.col("max_length") == best, F.lit(False)))


def greedy_pack(df: DataFrame, length: str, max_length: int, *keys: str, shards: int | None = None, shard_rows: int = 50_000) -> DataFrame:
    """Sequential first-come packing within shards (digits of the keys' md5): a pack is closed when
    the next row does not fit; rows longer than max_length are left out. There are as many
    shards as keep each at about `shard_rows` rows, unless a number is given; a shard is one task's."""
    import pandas as pd

    added = ("shard", T.IntegerType()), ("pack", T.IntegerType()), ("segment", T.IntegerType()), ("start", T.LongType())
    schema = T.StructType([*df.schema.fields, *(T.StructField(*a) for a in added)])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pack, used, segment, out = 0, 0, 0, []
        for n in pdf[length]:
            if used + n > max_length:
                pack, used, segment = pack + 1, 0, 0
            out.append((pack, segment, used))
            used, segment = used + n, segment + 1
        pdf[["pack", "segment", "start"]] = pd.DataFrame(out, index=pdf.index, columns=["pack", "segment", "start"])
        return pdf

    fitting = df.where((F.col(length) > 0) & (F.col(length) <= max_length))
    n = shards or max(1, -(-fitting.count() // shard_rows))
    dealt = fitting.withColumn("shard", (F.conv(F.substring(order_key(0, *keys), 1, 8), 16, 10).cast("long") % n).cast("int"))
    return dealt.groupBy("shard").applyInPandas(lambda p: fold(p.sort_values(list(keys)).reset_index(drop=True)), schema)
