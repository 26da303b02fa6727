"""Benchmark decontamination with a broadcast hash set of test n-grams.

Items and documents are cut into words of lower-cased text. Every `width`
consecutive words of an item are a window; an item of fewer words is one window.
Window hashes go to the executors in blocks of at most `block_windows` windows (the
size bound of each broadcast), so a benchmark of any size is answered in one pass
over the documents, block by block. Each document window that hits a hash is verified
word for word. Hit words can then be cut out, or hit documents left out.

Defined results: null and empty texts have no words and hit nothing; an item without
words is never found; items that repeat count by their item_id once; rows of
documents that repeat are each answered; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._common import ALNUM, Words, chunks

WIDTH = 10
BLOCK_WINDOWS = 500_000
_BITS = 22


class Windows:
    """One block: hashes by window width, and for each hash the windows and items behind it."""

    def __init__(self) -> None:
        self.behind: dict[int, dict[int, list[tuple[bytes, str]]]] = defaultdict(lambda: defaultdict(list))
        self.size = 0

    def add(self, items: list[str], texts: list[str], width: int) -> None:
        words = Words(pa.array(texts, pa.large_string()), ALNUM)
        for i, item in enumerate(items):
            first, n = int(words.first[i]), int(words.counts[i])
            if not n:
                continue
            w = min(n, width)
            at = np.arange(first, first + n - w + 1)
            for h, k in zip(words.hash_runs(at, w).tolist(), at.tolist(), strict=True):
                entry = (b" ".join(words.word(k + j) for j in range(w)), item)
                if entry not in self.behind[w][h]:
                    self.behind[w][h].append(entry)
                    self.size += 1

    def freeze(self) -> dict:
        return {w: (np.sort(np.array(list(by), np.uint64)), {h: list(v) for h, v in by.items()}) for w, by in self.behind.items()}


def window_blocks(benchmark: DataFrame, item_column: str, text_column: str, width: int, block_windows: int) -> list:
    """Broadcasts of the windows; the driver holds one block and a few hundred items at a time."""
    spark, out, block = benchmark.sparkSession, [], Windows()
    pending: tuple[list, list] = ([], [])

    def close() -> None:
        nonlocal block
        if block.size:
            out.append(spark.sparkContext.broadcast(block.freeze()))
        block = Windows()

    for row in benchmark.select(F.col(item_column).cast("string"), F.coalesce(F.col(text_column), F.lit(""))).toLocalIterator():
        pending[0].append(row[0])
        pending[1].append(row[1])
        if len(pending[0]) >= 256:
            block.add(*pending, width)
            pending = ([], [])
            if block.size >= block_windows:
                close()
    if pending[0]:
        block.add(*pending, width)
    close()
    return out


def hits(words: Words, block: dict, bitmaps: dict) -> list[tuple[int, int, list[str]]]:
    """(first word, words, items) of each verified occurrence."""
    found = []
    for width, (sorted_hashes, behind) in block.items():
        hashes, at = words.runs(width)
        if width not in bitmaps:
            bitmaps[width] = np.zeros(1 << _BITS, bool)
            bitmaps[width][sorted_hashes >> np.uint64(64 - _BITS)] = True
        near = np.flatnonzero(bitmaps[width][hashes >> np.uint64(64 - _BITS)])
        near = near[np.isin(hashes[near], sorted_hashes)]
        for h, first in zip(hashes[near].tolist(), at[near].tolist(), strict=True):
            text = b" ".join(words.word(first + j) for j in range(width))
            if items := [item for window, item in behind[h] if window == text]:
                found.append((first, width, items))
    return found


def scan(documents: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """id (or the columns `keep`), n_words, n_hit, n_items, items_sha256, contaminated, and
    __spans: byte ranges (UTF-8) of the hit words, in order."""
    blocks = window_blocks(benchmark, item_column, item_text_column, width, block_windows)
    kept = keep or [id_column]
    chosen = documents.select(*(F.col(c) for c in kept), F.col(text_column).alias("__text"))
    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("__spans", T.ArrayType(pair))]
    schema = T.StructType([*chosen.schema.fields[:-1], *(T.StructField(*x) for x in added)])
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps: dict = {}
        for batch, texts in chunks(batches, "__text"):
            words = Words(texts, ALNUM)
            hit = np.zeros(len(words.starts), bool)
            items: dict[int, set[str]] = defaultdict(set)
            for k, block in enumerate(blocks):
                for first, w, own in hits(words, block.value, bitmaps if len(blocks) == 1 else {}):
                    hit[first : first + w] = True
                    items[int(words.text_of[first])].update(own)
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # the worker's copy; only the driver can unpersist
            n_hit = np.bincount(words.text_of[hit], minlength=words.texts)
            spans: list[list] = [[] for _ in range(words.texts)]
            for k in np.flatnonzero(hit).tolist():
                base = int(words.offsets[words.text_of[k]])
                spans[words.text_of[k]].append((int(words.starts[k]) - base, int(words.ends[k]) - base))
            columns = [
                words.counts,
                n_hit,
                [len(items.get(i, ())) for i in range(words.texts)],
                [hashlib.sha256(",".join(sorted(items.get(i, ()))).encode()).hexdigest() for i in range(words.texts)],
                n_hit > 0,
                [[{"start": a, "end": b} for a, b in s] for s in spans],
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=schema.names)

    return chosen.mapInArrow(run, schema)


def report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document, without its spans."""
    return scan(documents, benchmark, **options).drop("__spans")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The documents that no window hits, with all their columns."""
    names = documents.columns
    renamed = documents.toDF(*(f"__c{k}" for k in range(len(names))))
    flagged = scan(renamed, benchmark, keep=renamed.columns, text_column=f"__c{names.index(text_column)}", **options)
    return flagged.where(~F.col("contaminated")).select(*renamed.columns).toDF(*names)


def cut_spans(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """All documents and columns; hit words, and what stands between two of them in a row, are cut out."""
    names = documents.columns
    renamed = documents.toDF(*(f"__c{k}" for k in range(len(names))))
    text = f"__c{names.index(text_column)}"
    flagged = scan(renamed, benchmark, keep=renamed.columns, text_column=text, **options)

    @F.pandas_udf(T.StringType())
    def cut(texts, spans):
        import pandas as pd

        def one(t, s):
            if t is None or s is None or not len(s):
                return t
            raw, out, at = t.encode(), [], 0
            for x in s:
                between = raw[at : x["start"]]
                if at == 0 or any(ALNUM[b] for b in between):
                    out.append(between)
                at = x["end"]
            return b"".join([*out, raw[at:]]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return flagged.withColumn(text, cut(text, "__spans")).select(*renamed.columns).toDF(*names)
