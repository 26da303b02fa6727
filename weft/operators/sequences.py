"""Training sequences: ids and labels of conversations, packed position ids, counted drops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weft.functions.tokenizers import Tokenizer

#: What is not to be learned, and the marks around a turn.
IGNORED = -100
HEADER, TRAILER = "<|im_start|>{}\n", "<|im_end|>\n"


def row_ids(messages: list, soft_counts: list[int], tokenizer: Tokenizer, image_id: int, responses_only: bool = True) -> tuple[list[int], list[int]]:
    """Ids of a conversation, turn by turn with header and trailer, and their labels.

    The k-th image part stands for soft_counts[k] image ids. Only an assistant's texts and
    trailers are learned, or everything if not `responses_only`."""
    ids: list[int] = []
    labels: list[int] = []
    images = 0

    def put(tokens: list[int], learned: bool) -> None:
        ids.extend(tokens)
        labels.extend(tokens if learned or not responses_only else [IGNORED] * len(tokens))

    for m in messages:
        own = m["role"] == "assistant"
        put(tokenizer.encode(HEADER.format(m["role"])), False)
        for part in m["content"] if m["content"] is not None else []:
            if part["type"] == "image":
                if images >= len(soft_counts):
                    raise ValueError(f"image {images + 1} of a row of {len(soft_counts)}")
                put([image_id] * int(soft_counts[images]), False)
                images += 1
            else:
                put(tokenizer.encode(part["text"] or ""), own)
        put(tokenizer.encode(TRAILER), own)
    if images < len(soft_counts):
        raise ValueError(f"{images} image parts for {len(soft_counts)} images")
    return ids, labels


def labelled_ids(df: DataFrame, tokenizer: Tokenizer, image_id: int, messages: str = "messages", soft_counts: Column | None = None, responses_only: bool = True) -> DataFrame:
    """The rows with input_ids, labels and learned (labels that are not ignored). Rows whose images and
    image parts do not agree in number fail the job; null messages have no ids."""
    counts = F.array().cast("array<int>") if soft_counts is None else F.coalesce(soft_counts.cast("array<int>"), F.array().cast("array<int>"))

    @F.pandas_udf("struct<input_ids: array<int>, labels: array<int>>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for rows, soft in batches:
            out = [row_ids([] if r is None else list(r), list(s), tokenizer, image_id, responses_only) for r, s in zip(rows, soft, strict=True)]
            yield pd.DataFrame(out, columns=["input_ids", "labels"])

    both = df.withColumn("__made", made(messages, counts))
    return both.select(*df.columns, "__made.input_ids", "__made.labels").withColumn("learned", F.size(F.filter("labels", lambda x: x != IGNORED)))


def position_ids(segments: Column, length: int, restart: bool = True) -> Column:
    """Positions of a packed sequence of `length`: from 0 in each segment, and 0 on what is left over; or from 0 to the end."""
    if not restart:
        return F.sequence(F.lit(0), F.lit(length - 1))
    own = F.flatten(F.transform(F.filter(segments, lambda n: n > 0), lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))))
    return F.slice(F.concat(own, F.array_repeat(F.lit(0), length)), 1, length)


def packed_segments(packed: DataFrame, length: str) -> DataFrame:
    """pack, segments (their lengths in order) and used, from rows with pack and segment; a pack's rows are as many as fit it."""
    each = packed.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("segment", F.col(length).cast("long").alias("n")))).alias("s"))
    lengths = F.transform("s", lambda x: x["n"])
    return each.select("pack", lengths.alias("segments"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n).alias("used"))


def counted_drops(df: DataFrame, keep: Column) -> tuple[DataFrame, Observation]:
    """The rows to keep, and what will be known once they have been read in full: rows, kept and dropped."""
    kept = F.coalesce(keep, F.lit(False))
    seen = Observation()
    flagged = df.withColumn("__keep", kept).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("__keep").alias("kept"), F.count_if(~F.col("__keep")).alias("dropped"))
    return flagged.where("__keep").drop("__keep"), seen


def cycled(donors: Column, n: Column) -> Column:
    """n of the donor's images, from the first again after the last; null if the donor has none."""
    size = F.size(donors)
    return F.when((size > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(donors, k % size))).when(n == 0, F.slice(donors, 1, 0))


def time_coverage(df: DataFrame, by: list[str], duration: Column, pages: Column, page_duration: float) -> DataFrame:
    """Of each group: rows with pages, and mean, sd, least, median and greatest share of their pages' time
    that is sound, the rest being silence at the end."""
    from weft.operators.quantiles import summarised

    share = F.when(pages > 0, duration / (pages * page_duration))
    return summarised(df, share, by, {"median": 0.5})
