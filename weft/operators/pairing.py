"""Correlated lookups: donors, verified pairs, placeholders, intervals and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.determinism import with_ordinal
from weft.functions.storage import small


def group_donor(df: DataFrame, group: str, key: str) -> DataFrame:
    """The next row of the same group, the first for the last; null for a group of one.

    Rows are numbered over ranges of each group and joined by number, so no task sorts a whole group."""
    numbered = with_ordinal(df, key, by=[group], name="__donor_at")
    sizes = numbered.groupBy(F.col(group).alias("__donor_s")).agg(F.count("*").alias("__donor_n"))
    sized = numbered.join(small(sizes), F.col(group).eqNullSafe(F.col("__donor_s"))).drop("__donor_s")
    after = sized.where(F.col("__donor_n") > 1).select(F.col(group).alias("__donor_g"), F.pmod(F.col("__donor_at") - 1, F.col("__donor_n")).alias("__donor_before"), F.col(key).alias("__donor"))
    return sized.join(after, F.col(group).eqNullSafe(F.col("__donor_g")) & (F.col("__donor_at") == F.col("__donor_before")), "left").select(*df.columns, F.col("__donor").alias("donor"))


def cyclic_donor(df: DataFrame, key: str) -> DataFrame:
    """The row after each in the order of the key, the first for the last (an equi join on ordinals)."""
    numbered = with_ordinal(df, key)
    n = df.count()
    after = numbered.select(F.pmod(F.col("ordinal") - 1, F.lit(n)).alias("ordinal"), F.col(key).alias("donor"))
    return numbered.join(after, "ordinal")


def verified_pairs(a: DataFrame, b: DataFrame, ordinal: str, text: str, prefix: bool = False) -> DataFrame:
    """Rows of one ordinal whose texts agree (or begin with one another); paired: do all agree?"""
    joined = a.select(ordinal, F.col(text).alias("x")).join(b.select(ordinal, F.col(text).alias("y")), ordinal)
    same = (F.col("x").startswith(F.col("y")) | F.col("y").startswith(F.col("x"))) if prefix else F.col("x") == F.col("y")
    return joined.select(ordinal, same.alias("same"))


def merge_placeholders(parts: Column, images: Column, strict: bool = False) -> Column:
    """Parts (struct<type, text>) with the k-th image in the k-th image part. Where their numbers
    differ the rest is null, or, if `strict`, the job fails."""
    number = lambda k: F.size(F.filter(F.slice(parts, 1, k + 1), lambda p: p["type"] == "image"))
    merged = F.transform(parts, lambda p, k: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.when(p["type"] == "image", F.get(images, number(k) - 1)).alias("image")))
    if not strict:
        return merged
    places, given = F.size(F.filter(parts, lambda p: p["type"] == "image")), F.coalesce(F.size(images), F.lit(0))
    return F.when(places == given, merged).otherwise(F.raise_error(F.concat(places.cast("string"), F.lit(" image parts for "), given.cast("string"), F.lit(" images"))))


def word_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words between single blanks with their places: key, word_idx, word, lo, hi (code points)."""
    pieces = df.select(key, F.posexplode(F.split(text, " ")).alias("word_idx", "word"))
    before = Window.partitionBy(key).orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("long")
    return pieces.withColumn("lo", start).withColumn("hi", F.col("lo") + F.length("word")).where(F.col("word") != "")


def pieces_with_places(df: DataFrame, key: str, pieces: Column, index: str, piece: str, gap: int = 0) -> DataFrame:
    """Pieces of a text that stand one after another, `gap` characters between them: key, index, piece, lo, hi (code points)."""
    each = df.select(key, F.posexplode(pieces).alias(index, piece))
    before = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("lo", F.coalesce(F.sum(F.length(piece) + gap).over(before), F.lit(0)).cast("long")).withColumn("hi", F.col("lo") + F.length(piece))


def token_spans(df: DataFrame, key: str, text: str, pattern: str = r"[ \n]*[^ \n]+|[ \n]+") -> DataFrame:
    """Tokens that tile the text (white space belongs to what follows it): key, token_idx, token, lo, hi."""
    return pieces_with_places(df, key, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "token_idx", "token")


def overlapping(spans: DataFrame, lo: int | Column, hi: int | Column) -> DataFrame:
    """Spans with a common character with [lo, hi)."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return spans.where((F.col("lo") < high) & (F.col("hi") > low))


def grid_cells(boxes: DataFrame, size: int) -> DataFrame:
    """Every grid cell that a box (x0, y0, x1, y1, half open) covers: boxes are exploded, nothing is crossed."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / size))
    return boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def mask_rects(boxes: DataFrame, by: list[str], pad: int) -> DataFrame:
    """One padded rectangle for all boxes of a group."""
    return boxes.groupBy(*by).agg((F.min("x0") - pad).alias("x0"), (F.min("y0") - pad).alias("y0"), (F.max("x1") + pad).alias("x1"), (F.max("y1") + pad).alias("y1"))
