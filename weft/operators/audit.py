"""Audits of lanes and scores: exposure, gates, merged reports, histograms, replays and row checks."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text as X
from weft.operators.conversation import message
from weft.operators.stats import bin_number, bin_table, rounded


class AuditError(ValueError):
    """A lane or table that is not what it is said to be."""


# --- tokens and characters


def token_exposure(tokens: DataFrame, marked: DataFrame, key: str, pos: str = "pos", lo: str = "lo", hi: str = "hi", char: str = "char_idx", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, pos, kept columns, n_marked, touching (a marked character in [lo, hi)) and pure (all of them are).

    Marks are bits of blocks of 64 characters: a token meets one row for each block that it reaches
    into, not one for each character. Tokens of one key, pos and kept columns are
    counted together; an empty one is neither."""
    shift = lambda x, by, way="right": F.call_function(f"shift{way}", x, F.lit(by) if isinstance(by, int) else by.cast("int"))
    low, high, at, block = F.col(lo).cast("long"), F.col(hi).cast("long"), F.col(char).cast("long"), F.col("__block")
    own = [key, pos, *keep]
    bit = shift(F.lit(1).cast("long"), at.bitwiseAND(63), "left")
    hits = marked.groupBy(F.col(key).alias("__key"), shift(at, 6).alias("__at")).agg(F.bit_or(bit).alias("__bits"))
    reached = F.when(high > low, F.sequence(shift(low, 6), shift(high - 1, 6)))
    pieces = tokens.select(*own, low.alias("__lo"), high.alias("__hi"), F.explode_outer(reached).alias("__block"))
    low, high = F.greatest(F.col("__lo") - block * 64, F.lit(0)), F.least(F.col("__hi") - block * 64, F.lit(64))
    mask = shift(shift(F.lit(-1).cast("long"), 64 - (high - low), "rightunsigned"), low, "left")
    part = pieces.select(*own, "__block", (high - low).alias("__n"), mask.alias("__mask"), (block.isNull() | (block == shift(F.col("__lo"), 6))).alias("__first"))
    joined = part.join(hits, (F.col(key) == F.col("__key")) & (block == F.col("__at")), "left")
    counted = joined.groupBy(*own).agg(
        F.coalesce(F.sum(F.bit_count(F.col("__bits").bitwiseAND(F.col("__mask")))), F.lit(0).cast("long")).alias("n_marked"), F.sum("__n").alias("__n"), F.count_if("__first").alias("__rows")
    )
    each = counted.select(*own, "n_marked", "__n", F.explode(F.array_repeat(F.lit(0), F.col("__rows").cast("int"))))  # tokens that repeat stay
    return each.select(*own, "n_marked", (F.col("n_marked") > 0).alias("touching"), F.coalesce(F.col("n_marked") == F.col("__n"), F.lit(False)).alias("pure"))


def exposure_by_bin(exposed: DataFrame, key: str, pos: str = "pos", bins=None) -> DataFrame:
    """Of each bin of positions: tokens, touching and pure ones, rows, and the share of rows with a pure token."""
    from weft.operators.stats import TOKEN_BINS

    bins = bins or TOKEN_BINS
    rows = exposed.withColumn("bin_no", bin_number(F.col(pos), bins)).where(F.col("bin_no").isNotNull()).groupBy("bin_no", key).agg(F.count("*").alias("n"), F.count_if("touching").alias("t"), F.count_if("pure").alias("p"))
    found = rows.groupBy("bin_no").agg(
        F.sum("n").alias("tokens"), F.sum("t").alias("touching"), F.sum("p").alias("pure"), F.count("*").alias("rows"), F.count_if(F.col("p") > 0).alias("rows_pure"),
        rounded(F.sum("p") / F.count("*")).alias("pure_per_row"), rounded(F.count_if(F.col("p") > 0) / F.count("*")).alias("share_rows_pure"),
    )
    return F.broadcast(bin_table(exposed.sparkSession, bins).select("bin_no", "bin")).join(found, "bin_no")


def positional_gain(scores: DataFrame, row: str, lo: int, hi: int) -> DataFrame:
    """Mean paired gain of each row's tokens at positions lo to hi - 1; null where it has none."""
    inside = F.when((F.col("pos") >= lo) & (F.col("pos") < hi), F.col("a_c").cast("double") - F.col("b_c").cast("double"))
    return scores.groupBy(row).agg(F.count(inside).alias("n"), rounded(F.avg(inside)).alias("gain"))


def cut_rows(tokens: DataFrame, row: str, pos: str, limit: int, width: int) -> tuple[DataFrame, DataFrame]:
    """One row of counts (rows, rows with positions from `limit` on, tokens there), and how many
    rows end in each bin of `width` positions below the limit."""
    ends = tokens.groupBy(row).agg(F.max(pos).alias("last"), F.count_if(F.col(pos) >= limit).alias("deep"))
    counts = ends.agg(F.count("*").alias("rows"), F.count_if(F.col("deep") > 0).alias("rows_cut"), F.coalesce(F.sum("deep"), F.lit(0)).alias("tokens_cut"))
    stops = ends.where(F.col("last") < limit).groupBy(F.floor(F.col("last") / width).cast("long").alias("bin")).agg(F.count("*").alias("rows_ending"))
    return counts, stops


def gap_statistics(scores: DataFrame, batch: list[str], beta: float, valid: Column) -> DataFrame:
    """Sum of positive gaps, largest raw weight and valid tokens of each batch."""
    gap = F.greatest(F.col("b_ce") - F.col("a_ce"), F.lit(0.0))
    return scores.groupBy(*batch).agg(rounded(F.coalesce(F.sum(F.when(valid, gap)), F.lit(0.0))).alias("gap_sum"), rounded(F.max(F.when(valid, 1 + F.lit(beta) * gap))).alias("max_weight"), F.count_if(valid).alias("n_valid"))


def word_times(words: DataFrame, times: DataFrame, word: str, start: str) -> DataFrame:
    """The start of each word by its number; null past the last one that has a time."""
    known = times.select(F.col(word).alias("__w"), F.col(start).alias("start"))
    return words.join(known, F.col(word) == F.col("__w"), "left").drop("__w")


# --- gates and reports


def anchor_gate(anchors: DataFrame, measured: DataFrame, keys: list[str], stats: list[str], tolerance: float) -> DataFrame:
    """PASS where every statistic is within the tolerance of its anchor, MISSING where none was measured, else FAIL."""
    own = measured.select(*keys, *(F.col(s).alias(f"__{s}") for s in stats))
    joined = anchors.join(own, keys, "left")
    absent = reduce(lambda a, b: a | b, (F.col(f"__{s}").isNull() for s in stats))
    near = reduce(lambda a, b: a & b, (F.abs(F.col(f"__{s}") - F.col(s)) <= tolerance for s in stats))
    off = [rounded(F.col(f"__{s}") - F.col(s)).alias(f"off_{s}") for s in stats]
    return joined.select(*keys, *off, F.when(absent, "MISSING").when(near, "PASS").otherwise("FAIL").alias("status"))


def merged_reports(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Both reports beside each other, each column under its report's name, and which report lacks the key."""
    x = a.select(*keys, *(F.col(c).alias(f"{names[0]}_{c}") for c in a.columns if c not in keys), F.lit(True).alias("__a"))
    y = b.select(*keys, *(F.col(c).alias(f"{names[1]}_{c}") for c in b.columns if c not in keys), F.lit(True).alias("__b"))
    lacks = F.when(F.col("__a").isNull(), names[0]).when(F.col("__b").isNull(), names[1])
    return x.join(y, keys, "full").withColumn("lacks", lacks).drop("__a", "__b")


def split_statistics(df: DataFrame, by: list[str], tokens: Column, pages: Column, marked: Column, chars: Column, per_page: int, lengths: list[int]) -> DataFrame:
    """Rows, tokens, pages, marked characters and their share, tokens with pages expanded, and the percentage of rows that fit each length."""
    need = tokens + pages * per_page
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(tokens).cast("long").alias("tokens"), F.sum(pages).cast("long").alias("pages"), F.sum(marked).cast("long").alias("marked"), F.sum(chars).cast("long").alias("chars"),
        rounded(F.try_divide(F.sum(marked), F.sum(chars))).alias("marked_share"), F.sum(need).cast("long").alias("expanded"), *(rounded(100 * F.count_if(need <= n) / F.count("*")).alias(f"fit_{n}") for n in lengths),
    )


def config_histogram(df: DataFrame, config: str, path: str, by: list[str]) -> DataFrame:
    """How many rows have each value at a path of their configuration; null where there is none."""
    return df.groupBy(*by, F.get_json_object(config, path).alias("value")).agg(F.count("*").alias("rows"))


def pooled_histogram(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """Rows of each bin between the edges (low end in, high end out, the last bin with its end), zeros included."""
    last = len(edges) - 2
    found = F.coalesce(*(F.when((F.col(value) >= a) & ((F.col(value) < b) | F.lit(k == last) & (F.col(value) == b)), F.lit(k)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    counted = df.groupBy(*by, found.alias("__bin")).agg(F.count("*").alias("__n"))
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))))
    whole = counted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col("__bin").isNotNull(), F.struct("__bin", "__n")))).alias("__found"))
    return whole.select(*by, "__found", bins.alias("b")).select(*by, "b.bin", "b.low", "b.high", F.coalesce(F.try_element_at("__found", F.col("b.bin")), F.lit(0)).alias("rows"))


def integrity(df: DataFrame, by: list[str], *values: str) -> DataFrame:
    """Least, largest and mean value of each metric, a row for each group and metric."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("v")) for v in values)))
    long = df.select(*by, pairs.alias("p"))
    return long.groupBy(*by, F.col("p.metric").alias("metric")).agg(F.count("p.v").alias("n"), rounded(F.min("p.v")).alias("low"), rounded(F.max("p.v")).alias("high"), rounded(F.avg("p.v")).alias("mean"))


def replay(stored: DataFrame, again: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows of both by key, how many agree in all columns, and rows that only one side has."""
    x = stored.select(F.col(key).alias("__k"), F.struct(*columns).alias("__x"))
    y = again.select(F.col(key).alias("__l"), F.struct(*columns).alias("__y"))
    joined = x.join(y, F.col("__k") == F.col("__l"), "full")
    return joined.agg(F.count_if(F.col("__k").isNotNull() & F.col("__l").isNotNull()).alias("both"), F.count_if(F.col("__x") == F.col("__y")).alias("same"), F.count_if(F.col("__l").isNull()).alias("only_stored"), F.count_if(F.col("__k").isNull()).alias("only_again"))


# --- rows


def fit_lines(lines: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """The first lines of each text whose characters, with a line feed between lines, stay within the budget."""
    used = F.sum(F.length(text) + 1).over(Window.partitionBy(key).orderBy(order)) - 1
    return lines.withColumn("used", used).where(F.col("used") <= budget)


def trimmed_mask(mask: Column, kept_chars: Column) -> Column:
    """Marked places that are still within the text."""
    return F.filter(mask, lambda k: k < kept_chars)


_PIECES = T.StructType([T.StructField(c, T.IntegerType()) for c in ("n_reference", "n_hypothesis", "positional", "recalled", "invented")])


def sentinel_score(df: DataFrame, reference: str, hypothesis: str, sentinel: str) -> DataFrame:
    """The rows with numbers of white-space pieces of both texts without the sentinel: n_reference,
    n_hypothesis, how many agree place by place (positional), how many of the reference's the
    other holds at all (recalled), and how many of the other's the reference does not (invented).

    Counts with repeats need a hash set of each text, which no built-in has; arrays of pieces go
    to Python by Arrow."""

    @F.pandas_udf(_PIECES)
    def count(own: pd.Series, other: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(own, other, strict=True):
            a, b = ([w for w in z if w != sentinel] if z is not None else [] for z in (x, y))
            in_a, in_b = set(a), set(b)
            rows.append((len(a), len(b), sum(v == w for v, w in zip(a, b, strict=False)), sum(w in in_b for w in a), sum(w not in in_a for w in b)))
        return pd.DataFrame(rows, columns=_PIECES.fieldNames())

    counted = df.withColumn("__counts", count(X.words(F.col(reference)), X.words(F.col(hypothesis))))
    return counted.select(*df.columns, *(F.col(f"__counts.{c}").alias(c) for c in _PIECES.fieldNames()))


def text_predicates(target: Column, prompt: Column) -> dict[str, Column]:
    """Is the target of small letters and blanks only, trimmed, and in the prompt?"""
    return {"plain": target.rlike("^[a-z ]*$"), "trimmed": target == F.trim(target), "in_prompt": (F.length(target) > 0) & prompt.contains(target)}


def alias_match(name: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The subset whose alias is the last part of the name, or else stands in it; null if none does."""
    leaf = F.element_at(F.split(F.lower(name), "/"), -1)
    exact = [F.when(leaf.isin(*map(str.lower, own)), F.lit(subset)) for subset, own in aliases.items()]
    inside = [F.when(reduce(lambda a, b: a | b, (F.lower(name).contains(x.lower()) for x in own)), F.lit(subset)) for subset, own in aliases.items()]
    return F.coalesce(*exact, *inside)


def skip_reason(native: Column, has_audio: Column, error: Column) -> Column:
    """Why a row has no native lane, or null."""
    return F.when(error.isNotNull(), F.concat(F.lit("error: "), error)).when(native.isNull(), "no native content").when(F.trim(native) == "", "empty native content").when(has_audio, "audio has no native lane")


def native_messages(native: Column, target: Column) -> Column:
    """A user turn with the native content and the assistant's target; null without native content."""
    return F.when(native.isNotNull(), F.array(message("user", native), message("assistant", target)))


def with_active_labels(df: DataFrame, labels: str, ignored: int = -100) -> DataFrame:
    """The rows; the first that has no label but ignored ones fails the job when it is read."""
    active = F.coalesce(F.exists(labels, lambda x: x != ignored), F.lit(False))
    return df.where(F.when(active, True).otherwise(F.raise_error(F.lit("a row without active labels")).cast("boolean")))


# --- lanes on disk


def same_revision(expected: str | None, found: str | None) -> None:
    """Raises where a revision was asked for and another, or none, was found."""
    if expected is not None and expected != found:
        raise AuditError(f"revision {found}, not {expected}")


def inventory(spark, root: str, subsets: list[str], splits: tuple[str, ...] = ("train", "validation")) -> list[dict]:
    """A manifest entry for each lane=.../split=... folder under the root, from counts of what is there; one that is missing raises."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for subset in subsets:
        if fs.exists(path(f"{root}/{subset}")):
            raise AuditError(f"{subset} lies flat under {root}; lanes are folders lane={subset}/split=...")
        for split in splits:
            if not fs.exists(path(f"{root}/lane={subset}/split={split}")):
                raise AuditError(f"no split {split} of {subset}")
    rows = spark.read.option("basePath", root).parquet(*(f"{root}/lane={s}" for s in subsets)).groupBy("lane", "split").count().collect()  # one row for each split
    found = {(r["lane"], r["split"]): r["count"] for r in rows}
    return [{"config_name": s, "path": f"lane={s}/split={p}", "split": p, "rows": found.get((s, p), 0), "source_dataset_id": s, "is_training_split": p == "train"} for s in subsets for p in splits]


def blocks_of_strings(spark, blocks: list[tuple[int, int]], groups: int, letters: int) -> DataFrame:
    """Random strings of each block (rows, seed), united; row ids go on from block to block."""
    from weft.operators.layout import random_strings

    parts, first = [], 0
    for k, (rows, seed) in enumerate(blocks):
        part = random_strings(spark, rows, groups, letters, seed)
        parts.append(part.select((F.col("row_id").cast("long") + first).cast("string").alias("row_id"), "target", F.lit(k).alias("block")))
        first += rows
    return reduce(DataFrame.unionByName, parts)

