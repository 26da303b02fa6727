"""Planning and decision arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of a soft token's side, tokens around an image.
PATCH = 48
IMAGE_FRAME = 2


def image_tokens(soft_tokens: int) -> int:
    return soft_tokens + IMAGE_FRAME


def soft_token_grid(height: Column, width: Column, budget: Column) -> tuple[Column, Column]:
    """Rows and columns of soft tokens: the picture is scaled to the budget's area, and sides are cut to whole tokens."""
    scale = F.sqrt(budget * float(PATCH * PATCH) / (height * width))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale / PATCH)).cast("long")
    return side(height), side(width)


def page_capacity(width: Column, height: Column, advance: Column, line_height: Column, margin: int = 40) -> tuple[Column, Column]:
    """Characters of a line and lines of a page in a font of one advance."""
    return F.floor((width - margin) / advance), F.greatest(F.lit(1), F.floor((height - margin) / line_height))


def floors(df: DataFrame, by: list[str], letters: str, tokens: str, charset: int, trailer: int = 2) -> DataFrame:
    """Loss of a model that reads nothing, over all tokens and with the supervised trailer; and its chance to guess."""
    n = F.sum(letters) * math.log(charset)
    return df.groupBy(*by).agg(
        F.round(n / F.sum(tokens), 6).alias("floor_all"), F.round(n / F.sum(F.col(tokens) + trailer), 6).alias("floor_supervised"),
        F.round(F.avg(F.pow(F.lit(float(charset)), -F.least(F.col(letters), F.lit(12)))), 12).alias("guess"),
    )


def first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """A verdict cascade: the first case that holds."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, name in cases[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def scaled_bar(bar: float, length: Column, reference: float) -> Column:
    """A bar for targets of another length, in proportion."""
    return F.lit(bar) * F.lit(reference) / length


def void_guard(prefix_delta: Column, least: float) -> Column:
    return F.when(prefix_delta.isNull() | (prefix_delta < least), "VOID").otherwise("OK")


def detectable(se: Column, z: float = 2.801585) -> Column:
    return z * se


def critical_width(height: int, budget: int, least_columns: int, most: int = 1 << 16) -> int | None:
    """The smallest width whose grid has the columns, by bisection; None if none has."""
    columns = lambda w: max(1, math.floor(w * math.sqrt(budget * PATCH * PATCH / (height * w)) / PATCH))
    low, high = 1, most
    if columns(high) < least_columns:
        return None
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if columns(mid) >= least_columns else (mid + 1, high)
    return low
