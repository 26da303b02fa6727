"""Sequential first-come packing over the whole order, in one chain of packs.

Where a pack ends depends on where it began, so packs are a chain of jumps: from the first row of
a pack to the first row that does not fit. Prefix sums over the whole order make a jump a
search by position. Rows are cut into blocks of positions; in each, every row where a pack from
the block before can end is followed to the block behind, by pointer doubling. The chain over
blocks is found by doubling too, as joins of these short tables, and last each block marks its own
packs from the row where the chain enters. No task sees more than a block and one pack behind it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.determinism import with_ordinal
from weft.functions.storage import checkpoint, small, stored

#: Positions of one block: rows of a task at most, as a row has one or more.
BLOCK = 2_000_000
#: Rows that are added up before the whole is.
_CHUNK = 65_536


def positions(df: DataFrame, length: str, *keys: str) -> DataFrame:
    """The rows with their number in the order of the keys and the sum of all lengths before."""
    numbered = checkpoint(with_ordinal(df, *keys, name="__at")).withColumn("__chunk", F.floor(F.col("__at") / _CHUNK))
    sums = numbered.groupBy("__chunk").agg(F.sum(length).cast("long").alias("__sum"))
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    starts = sums.select(F.col("__chunk").alias("__c"), "__sum").select("__c", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__chunk").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    own = numbered.withColumn("__own", F.coalesce(F.sum(length).over(inside), F.lit(0)).cast("long"))
    return own.join(small(starts), F.col("__chunk") == F.col("__c")).withColumn("__from", F.col("__before") + F.col("__own")).drop("__chunk", "__c", "__before", "__own")


def _jumps(pdf: pd.DataFrame, most: int) -> tuple[pd.DataFrame, int, np.ndarray]:
    """Rows in order, how many are the block's own, and for these the place of the first row that does not fit."""
    pdf = pdf.sort_values("__at", ignore_index=True)
    own = int(pdf["__mine"].sum())
    start, size = pdf["__from"].to_numpy(), pdf["__n"].to_numpy()
    return pdf, own, np.searchsorted(start + size, start[:own] + most, "right")


def _entries(block: int, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own, out = _jumps(pdf, most)
        out = out.copy()
        while len(inside := np.flatnonzero(out < own)):
            out[inside] = out[out[inside]]
        at = np.append(pdf["__at"].to_numpy(), -1)  # -1 behind the last row
        first = np.flatnonzero(pdf["__from"].to_numpy()[:own] - pdf["__block"].iloc[0] * block < most)
        return pd.DataFrame({"entry": at[first], "next": at[out[first]]})

    return run


def _marks(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own, jump = _jumps(pdf, most)
        at, start = pdf["__at"].to_numpy()[:own], pdf["__from"].to_numpy()[:own]
        first = np.zeros(own, bool)
        k = int(np.searchsorted(at, pdf["entry"].iloc[0]))
        while k < own:
            first[k] = True
            k = int(jump[k])
        pack = np.cumsum(first)  # 0: the pack began in the block before
        begun = np.flatnonzero(first)[np.maximum(pack - 1, 0)]
        return pd.DataFrame({"__at": at, "__from": start, "__block": pdf["__block"].to_numpy()[:own], "pack": pack.astype(np.int64), "first": np.where(pack > 0, at[begun], -1), "begin": np.where(pack > 0, start[begun], -1)})

    return run


def _chain(entries: DataFrame, blocks: int) -> DataFrame:
    """The entries on the chain from row 0: each round doubles how far it is known."""
    jump = entries
    reached = entries.where("entry = 0").select(F.col("entry").alias("at"))
    for _ in range(max(0, blocks - 1).bit_length()):
        further = reached.join(jump, F.col("at") == F.col("entry")).select(F.col("next").alias("at")).where("at >= 0")
        reached = checkpoint(reached.union(further))
        then = jump.toDF("__entry", "__next")
        jump = checkpoint(jump.join(then, F.col("next") == F.col("__entry")).select("entry", F.col("__next").alias("next")))
    return reached


def sequential_pack(df: DataFrame, length: str, most: int, *keys: str, block: int = BLOCK) -> DataFrame:
    """The rows with pack, segment (number in the pack) and start (sum of lengths before it in the
    pack), in the order of the keys: a pack is closed when the next row does not fit.

    Rows of no length, a null one, or of more than `most` are left out. Equal keys come in any order."""
    block = max(block, 2 * most)
    whole = positions(df.where((F.col(length) > 0) & (F.col(length) <= most)), length, *keys)
    placed = checkpoint(whole)
    of = F.floor(F.col("__from") / block)
    narrow = placed.select("__at", "__from", F.col(length).cast("long").alias("__n"), of.alias("__block"))
    ahead = narrow.where((F.col("__block") > 0) & (F.col("__from") - F.col("__block") * block < most)).withColumn("__block", F.col("__block") - 1)
    rows = stored(narrow.withColumn("__mine", F.lit(True)).union(ahead.withColumn("__mine", F.lit(False))))
    blocks = rows.agg(F.coalesce(F.max("__block"), F.lit(-1))).first()[0] + 1
    entries = checkpoint(rows.groupBy("__block").applyInPandas(_entries(block, most), "entry long, next long"))
    on_chain = _chain(entries, blocks).join(narrow, F.col("at") == F.col("__at")).select(F.col("__block").alias("__b"), F.col("at").alias("entry"))
    entered = rows.join(small(on_chain), F.col("__block") == F.col("__b")).drop("__b")
    marked = stored(entered.groupBy("__block").applyInPandas(_marks(most), "__at long, __from long, __block long, pack long, first long, begin long"))
    ends = marked.groupBy("__block").agg(F.max("pack").alias("__packs"), F.max("first").alias("__first"), F.max("begin").alias("__begin"))
    order = Window.orderBy("__b")  # a row for each block
    before = ends.withColumnRenamed("__block", "__b").select(
        "__b", F.coalesce(F.sum("__packs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.lag("__first").over(order).alias("__first"), F.lag("__begin").over(order).alias("__begin")
    )
    joined = marked.join(small(before), F.col("__block") == F.col("__b"))
    new = F.col("pack") > 0
    packed = joined.select(
        "__at", (F.col("__before") + F.col("pack") - 1).alias("pack"), (F.col("__at") - F.when(new, F.col("first")).otherwise(F.col("__first"))).alias("segment"),
        (F.col("__from") - F.when(new, F.col("begin")).otherwise(F.col("__begin"))).alias("start"),
    )
    return placed.drop("__from").join(packed, "__at").select(*df.columns, "pack", "segment", "start")
