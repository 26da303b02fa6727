"""How much of a text fits how many pages, from one index of its lines.

The index of a text is where each line starts, made in one pass that stops where no page
needs more; what fits n pages, which pages a text takes and where a character stands are then
look-ups in it, so that no text is wrapped again for another limit.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.layout import Page

#: Fixed value: the least height of a page.
LEAST_HEIGHT = 64


def placed_lines(text: str, page: Page, cut: bool = True) -> Iterator[tuple[int, int, str]]:
    """(first place in the text, place behind its last character, line) of every line in order, made as
    they are asked for: words go on a line while they fit, with single blanks between. Longer ones
    are cut to full lines, or stand alone if not `cut`."""
    room, at = page.chars, 0
    for paragraph in text.split("\n"):
        place, end, line = at, at, ""
        for word in paragraph.split(" "):
            begun, done = at + len(word) - len(word.lstrip()), at + len(word.rstrip())
            joined = f"{line} {word}".strip()
            if len(joined) <= room or not (line or cut):
                if word.strip():
                    place, end = (place if line else begun), done
                line = joined
            else:
                if line:
                    yield place, end, line
                place, end, line = at, at + len(word), word
                while cut and len(line) > room:
                    yield place, place + room, line[:room]
                    place, line = place + room, line[room:]
            at += len(word) + 1
        yield place, end, line


def wrap_index(df: DataFrame, key: str, text: str, page: Page, max_pages: int | None = None, cut: bool = True) -> DataFrame:
    """key, starts (place of each line), ends (behind its last character), lengths (as shown), whole (is it all of the text's lines?).

    With `max_pages` a text is read as far as these pages go. A null text has one empty line."""
    most = None if max_pages is None else page.lines * max_pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                lines = list(islice(placed_lines(t or "", page, cut), most if most is None else most + 1))
                kept = lines[:most]
                out.append((k, [p for p, _, _ in kept], [e for _, e, _ in kept], [len(x) for _, _, x in kept], len(kept) == len(lines)))
            yield pd.DataFrame(out, columns=[key, "starts", "ends", "lengths", "whole"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, starts array<int>, ends array<int>, lengths array<int>, whole boolean")


def _filled(page: Page, pages: int) -> Column:
    """Lines of the first pages without empty ones at their end."""
    n = F.least(F.size("ends"), F.lit(page.lines * pages))
    filled = F.transform(F.slice("lengths", 1, n), lambda x, k: F.when(x > 0, k + 1).otherwise(0))
    return F.coalesce(F.array_max(filled), F.lit(0))


def fitting(index: DataFrame, page: Page, pages: int) -> DataFrame:
    """The index with lines_fit, empty ones at the end left out, chars_fit (the place behind the last
    of them), and all_fits: nothing of the text is left over."""
    lines = _filled(page, pages)
    behind = F.when(lines > 0, F.get("ends", lines - 1)).otherwise(0)
    rest = F.size("ends") > page.lines * pages
    return index.select("*", lines.alias("lines_fit"), behind.alias("chars_fit"), (F.col("whole") & ~rest).alias("all_fits"))


def page_of(index: DataFrame, page: Page, place: Column) -> Column:
    """The page, from 0, of the character at a place; null where the index does not reach."""

    @F.pandas_udf("int")
    def found(starts: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or x is None or x != x else max(0, bisect_right(s, x) - 1) // page.lines for s, x in zip(starts, at, strict=True)], dtype="Int32")

    return F.when(F.col("whole") | (place < F.element_at("ends", -1)), found("starts", place))


def tall_pages(df: DataFrame, key: str, text: str, page: Page) -> DataFrame:
    """key, lines, height and longest line of one page as high as its text, whose words are never cut."""
    index = wrap_index(df, key, text, page, cut=False)
    lines = F.size("starts")
    height = F.greatest(2 * F.lit(page.margin) + lines * page.line_height, F.lit(LEAST_HEIGHT))
    return index.select(key, lines.alias("lines"), height.alias("height"), F.array_max("lengths").alias("longest"))
