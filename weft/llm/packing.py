"""Best-fit decreasing packing of documents into token sequences.

Lengths are whole numbers up to the capacity, so items of one length are alike and
bins with the same room left are alike. The plan is therefore made from the counts by
length alone, exactly as if item after item went to the tightest open bin: a segment
tree over room left finds that room in logarithmic time, and a whole group of like bins
is filled at once. Counts by length and plan are bounded by the capacity, whatever the
number of documents. Each piece then finds its place by its rank among pieces of its
length; ranks come from windows over (length, bucket), so no length is gathered in one task.

Defined results: null text counts as empty, which is one token (the end id); rows that
repeat are packed each; an empty table packs nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._common import checkpoint, chunks
from weft.llm.tokens import Encoder

CAPACITY = 1024
END_ID = 2
#: Pieces that one window of (length, bucket) has, about, if one length has all of them.
_WINDOW_ROWS = 200_000


class RoomTree:
    """Segment tree over room left: is any bin open with this much room?"""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, room: int, value: bool) -> None:
        k = room + self.size
        self.any[k] = value
        while k := k // 2:
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of `least` or more with an open bin."""
        k = least + self.size
        if self.any[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, items, first bin, offset): the items of that length and
    those ranks go to consecutive bins, each at the offset."""
    tree, open_bins, runs, bins = RoomTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, n: int) -> None:
        if not open_bins[room]:
            tree.set(room, True)
        open_bins[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                n = -(-left // (capacity // length))
                first, bins = bins, bins + n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            fills = [(first, full, each)] if full else []
            if full < n and left - full * each:
                fills.append((first + full, 1, left - full * each))
            for at, many, per_bin in fills:
                for k in range(per_bin):
                    runs.append((length, rank, many, at, capacity - room + k * length))
                    rank += many
                left -= many * per_bin
                if room - per_bin * length:
                    put(room - per_bin * length, at, many)
            used = sum(f[1] for f in fills)
            if used < n:
                put(room, first + used, n - used)
    return runs


def token_pieces(documents: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32 (and ids)."""
    chosen = documents.select(F.col(id_column), F.col(text_column).alias("__text"))
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([chosen.schema[0], *(T.StructField(*f) for f in fields)])
    encoder = Encoder(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text"):
            ids, first = encoder.encode(texts)
            rows, out = [], []
            for i in range(len(texts)):
                own = np.append(ids[first[i] : first[i + 1]], end_id).astype("<u4")
                start, end = 0, len(own) % capacity or min(len(own), capacity)
                piece = 0
                while start < len(own):
                    rows.append(i)
                    out.append((piece, start, end - start, zlib.crc32(own[start:end].tobytes())) + ((own[start:end].astype(np.int32),) if with_ids else ()))
                    piece, start, end = piece + 1, end, end + capacity
            arrow = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=schema.names)

    return chosen.mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` is read twice and should be a stored table."""
    spark = pieces.sparkSession
    by_length = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    total = sum(r["count"] for r in by_length)
    buckets = max(16, -(-total // _WINDOW_ROWS))
    runs = sorted(best_fit_plan({int(r["length"]): int(r["count"]) for r in by_length}, capacity))
    plan = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__bucket").orderBy(key, "piece", "ids_crc32")
    ranked = bucketed.withColumn("__row", F.row_number().over(within)).join(bases, ["length", "__bucket"]).withColumn("__rank", F.col("__base") + F.col("__row") - 1)
    ranked = ranked.select(*pieces.columns, "__rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = ranked.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first_rank, _, first_bin, offset = plan.value.T
        order = length << 48 | first_rank
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            k = np.searchsorted(order, batch.column(at).to_numpy() << 48 | rank, "right") - 1
            placed = [pa.array(first_bin[k] + rank - first_rank[k], pa.int64()), pa.array(offset[k], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *placed], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack(documents: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Where each piece of each document stands: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(documents, tokenizer_path, id_column=id_column, text_column=text_column, capacity=capacity, end_id=end_id)
    return place(checkpoint(pieces), capacity, id_column)


def sequences(documents: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids and lengths of their pieces, in order."""
    key = options.get("id_column", "doc_id")
    capacity = options.get("capacity", CAPACITY)
    placed = place(checkpoint(token_pieces(documents, tokenizer_path, with_ids=True, **options)), capacity, key)
    pieces = F.sort_array(F.collect_list(F.struct("offset", F.col(key).alias("id"), "length", "ids")))
    return placed.groupBy("sequence_id").agg(pieces.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def fewest(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound of the number of sequences: the tokens, or the pieces of more than half a sequence."""
    tokens = reduce(lambda s, x: s + x[0] * x[1], counts.items(), 0)
    return max(-(-tokens // capacity), sum(n for length, n in counts.items() if 2 * length > capacity))
