"""Joins of two tables on overlapping intervals, without cross joins.

Two intervals overlap where the start of one lies in the other, so the join is an equi join of
points and intervals, in both directions at once. An interval's bins are as wide as the power
of two that its length needs: it has two at most, however long it is. A point has one bin
for each width that occurs. Bins of many rows, which only keys of many rows can have, are
split on both sides by their counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.storage import small

#: Rows of one side of a bin that one task gets, about.
MOST_IN_BIN = 50_000
#: Kinds of posting: a's start in b's interval, b's start in a's.
_A_IN_B, _B_IN_A = 0, 1


def _level(low: Column, high: Column) -> Column:
    """Binary digits of length - 1: bins of 2^level are at least as wide as the interval."""
    last = high - low - 1
    return F.when(last <= 0, 0).otherwise(F.length(F.bin(last)))


def _bin(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def _place(kind: int, level: Column, number: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), level.alias("level"), number.alias("bin"))


def _postings(rows: DataFrame, by: list[str], kind_of_spans: int, levels: list[int]) -> DataFrame:
    """A row for each bin of the interval, and for each bin of its start among the other table's widths."""
    level = _level(F.col("__lo"), F.col("__hi"))
    own = F.when(F.col("__lo") < F.col("__hi"), F.transform(F.sequence(_bin(F.col("__lo"), level), _bin(F.col("__hi") - 1, level)), lambda x: _place(kind_of_spans, level, x)))
    starts = [_place(1 - kind_of_spans, F.lit(k), _bin(F.col("__lo"), F.lit(k))) for k in levels]
    places = F.concat(F.coalesce(own, F.array().cast("array<struct<kind:int,level:int,bin:bigint>>")), F.array(*starts).cast("array<struct<kind:int,level:int,bin:bigint>>"))
    return rows.select(*by, "__lo", "__hi", "__own", F.explode(places).alias("__at")).select(*by, "__at.*", "__lo", "__hi", "__own")


def _of_large_keys(posts: DataFrame, by: list[str], large: DataFrame | None) -> DataFrame:
    return posts if large is None else posts.join(small(large), by, "left_semi")


def _split(posts: list[DataFrame], by: list[str], large: DataFrame | None, most: int) -> tuple[list[DataFrame], list[str]]:
    """Both sides with the cell of a bin that a row is in; a bin of more than `most` rows of one side has several."""
    keys = [*by, "kind", "level", "bin"]
    sizes = [_of_large_keys(p, by, large).groupBy(*keys).agg(F.count("*").alias(n)) for p, n in zip(posts, ("__na", "__nb"), strict=True)]
    hot = sizes[0].join(sizes[1], keys).where((F.col("__na") > most) | (F.col("__nb") > most))
    hot = small(hot.select(*keys, F.ceil(F.col("__na") / most).cast("int").alias("__pa"), F.ceil(F.col("__nb") / most).cast("int").alias("__pb")))
    row, out = F.xxhash64("__lo", "__hi", "__own"), []
    for p, own, other in ((posts[0], "__pa", "__pb"), (posts[1], "__pb", "__pa")):
        placed = p.join(hot, keys, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("__pa", "__pb")})
        cells = placed.withColumn("__x", F.pmod(row, F.col(own))).withColumn("__y", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        out.append(cells.withColumnsRenamed({"__x": f"{own}c", "__y": f"{other}c"}).drop("__pa", "__pb"))
    return out, [*keys, "__pac", "__pbc"]


def interval_join(a: DataFrame, b: DataFrame, by: list[str] | None = None, a_span: tuple[str, str] = ("lo", "hi"), b_span: tuple[str, str] = ("lo", "hi"), suffix: str = "_b", most_in_bin: int = MOST_IN_BIN) -> DataFrame:
    """All pairs of rows with a.lo < b.hi and b.lo < a.hi (whole numbers, half open), of equal `by` columns.

    Other columns of b whose names a has get the suffix. Null bounds overlap nothing, null keys
    equal nothing; rows that repeat are each paired. An empty interval overlaps those around it."""
    by = list(by or [])

    def packed(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        low, high = (F.col(c).cast("long") for c in span)
        own = F.struct(*(F.col(c) for c in df.columns if c not in by))
        return df.select(*by, low.alias("__lo"), high.alias("__hi"), own.alias("__own")).where(low.isNotNull() & high.isNotNull())

    sides, levels, large = [packed(a, a_span), packed(b, b_span)], [], []
    for rows in sides:
        of_key = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.collect_set(F.when(F.col("__lo") < F.col("__hi"), _level(F.col("__lo"), F.col("__hi")))).alias("__levels"))
        one = of_key.agg(F.flatten(F.collect_set("__levels")).alias("levels"), F.max("__n").alias("n")).first()
        levels.append(sorted(set(one["levels"])))  # 64 numbers at most
        large.append((one["n"] or 0) > most_in_bin and of_key.where(F.col("__n") > most_in_bin).select(*by))
    posts = [_postings(sides[0], by, _B_IN_A, levels[1]), _postings(sides[1], by, _A_IN_B, levels[0])]
    keys = [*by, "kind", "level", "bin"]
    if found := [df for df in large if df is not False]:
        posts, keys = _split(posts, by, reduce(DataFrame.union, found).distinct() if by else None, most_in_bin)
    left, right = (p.withColumnsRenamed({c: x + c for c in ("__lo", "__hi", "__own")}) for p, x in zip(posts, "ab", strict=True))
    # each pair in one direction: the later start lies in the other interval, b's only if it is truly later
    a_low, b_low = F.col("a__lo"), F.col("b__lo")
    once = F.when(F.col("kind") == _A_IN_B, a_low >= b_low).otherwise(b_low > a_low)
    met = left.join(right, keys).where(once & (a_low < F.col("b__hi")) & (b_low < F.col("a__hi")))
    ours = [c for c in a.columns if c not in by]
    theirs = [F.col(f"b__own.{c}").alias(c + suffix if c in ours else c) for c in b.columns if c not in by]
    return met.select(*by, *(F.col(f"a__own.{c}").alias(c) for c in ours), *theirs)


def marked_tokens(tokens: DataFrame, marks: DataFrame, by: list[str], mark: str, after: int, index: str = "token_idx") -> DataFrame:
    """by, mark, first and last token that overlap a mark, their number, and the first token of the
    `after` ones behind them, as far as there are any (after_first null, after_n 0 at the end).

    tokens: by, index (0, 1, ...), lo, hi; marks: by, mark, lo, hi. Marks without a token are left out."""
    tokens = tokens.join(marks.select(*by).distinct(), by, "left_semi")  # most texts have no mark
    met = interval_join(tokens, marks.select(*by, mark, "lo", "hi"), by)
    of = met.groupBy(*by, mark).agg(F.min(index).cast("long").alias("first_token"), F.max(index).cast("long").alias("last_token"), F.count("*").alias("n_tokens"))
    sizes = tokens.groupBy(*by).agg((F.max(index) + 1).cast("long").alias("__n"))
    n = F.greatest(F.lit(0), F.least(F.lit(after), F.col("__n") - F.col("last_token") - 1)).cast("long")
    return of.join(sizes, by).select(*by, mark, "first_token", "last_token", "n_tokens", F.when(n > 0, F.col("last_token") + 1).alias("after_first"), n.alias("after_n"))


def tiles_text(tokens: DataFrame, texts: DataFrame, by: list[str], text: str, index: str = "token_idx") -> DataFrame:
    """by, tiled: the tokens (lo, hi) follow one another from 0 to the end of the text without gap or overlap."""
    before = F.lag("hi", 1, 0).over(Window.partitionBy(*by).orderBy(index))
    steps = tokens.withColumn("__fits", (F.col("lo") == before) & (F.col("hi") >= F.col("lo")))
    each = steps.groupBy(*by).agg(F.min(F.coalesce("__fits", F.lit(False)).cast("int")).alias("__all"), F.max_by("hi", index).alias("__end"))
    ends = texts.select(*by, F.length(text).alias("__length")).join(each, by, "left")
    return ends.select(*by, ((F.coalesce("__all", F.lit(1)) == 1) & (F.coalesce("__end", F.lit(0)) == F.coalesce("__length", F.lit(0)))).alias("tiled"))
