"""Importance resampling towards a target's distribution of hashed n-grams.

Documents become streams of buckets (crc32 of each run of words, modulo the number of
buckets), packed as 16-bit numbers with offsets of the documents, and stored in the
shared folder. Streams are then sorted and run-length encoded for counts, a task adding up
what it has read, and read again to gather the buckets' gains and add them up by document.
Only counts by bucket go through the driver. Draws are the highest scores, with Gumbel noise from a
hash of the id, numbered by ranges of a stored copy.

Defined results: null and empty texts have no features and weight 0; a null id is hashed as
an empty one and comes before all others; rows that repeat are each scored and ranked, equal
ones in any order; an empty table gives an empty result, and an empty target gains from counts
of 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.determinism import with_ordinal
from weft.llm._common import ALNUM, Words, chunks, stored

BUCKETS = 10_000
SEED = 7
#: Of documents with LEAST_WORDS words or more, SHARE of PER are drawn.
LEAST_WORDS, SHARE, PER = 20, 25, 100
#: Words of more bytes are hashed one by one.
_LONG = 48
_STREAM = "ids array<{}>, words binary, offsets binary, stream binary"


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of data[start:end], each carried on from `before`."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    state = ~(np.zeros(len(starts), np.uint32) if before is None else before)[order]
    first, left = starts[order], sizes[order]
    long = int(np.searchsorted(-left, -_LONG))
    for i in range(long):
        span = data[first[i] : first[i] + left[i]]
        state[i] = ~np.uint32(zlib.crc32(span.tobytes(), int(~state[i])))
    for k in range(int(left[long]) if long < len(left) else 0):
        some = slice(long, int(np.searchsorted(-left, -k)))
        state[some] = _CRC[(state[some] ^ data[first[some] + k]) & 255] ^ (state[some] >> 8)
    out = np.empty(len(starts), np.uint32)
    out[order] = ~state
    return out


def bucket_stream(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, buckets of its words and pairs of words, and where each text's begin."""
    words = Words(texts, ALNUM)
    one = crc32_spans(words.data, words.starts, words.ends)
    n = max(0, len(one) - 1)
    at = np.flatnonzero(words.text_of[:n] == words.text_of[1:])
    spaced = ~(_CRC[(~one[at] ^ 0x20) & 255] ^ (~one[at] >> 8))
    two = crc32_spans(words.data, words.starts[at + 1], words.ends[at + 1], spaced)
    owner = np.concatenate([words.text_of, words.text_of[at]])
    order = np.argsort(owner, kind="stable")
    stream = (np.concatenate([one, two])[order] % np.uint32(buckets)).astype("<u2")
    return words.counts, stream, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def streams(table: DataFrame, id_column: str, text_column: str, buckets: int) -> DataFrame:
    """A stored row for each chunk of texts: ids, words of each, offsets (one more), and the packed stream."""
    chosen = table.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = _STREAM.format(chosen.schema["id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            counts, stream, offsets = bucket_stream(texts, buckets)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (counts.astype("<i8"), offsets.astype("<i8"), stream)]
            yield pa.RecordBatch.from_arrays([ids, *packed], names=["ids", "words", "offsets", "stream"])

    return stored(chosen.mapInArrow(run, schema))


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: a row from each task and bucket, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"), kind="stable")  # a radix sort
                if len(ordered):
                    runs = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                    total[ordered[runs]] += np.diff(np.append(runs, len(ordered)))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in all documents, one added to each count."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def noise(seed: int, key: object) -> int:
    """Gumbel noise in thousandths from 32 bits of sha256(seed:key)."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))))


def scored(packed: DataFrame, gains: np.ndarray, id_column: str, seed: int) -> DataFrame:
    """id, n_features, n_words, weight and score of each document, from the streams."""
    schema = T.StructType([T.StructField(id_column, packed.schema["ids"].dataType.elementType), *(T.StructField(c, T.LongType()) for c in ("n_features", "n_words", "weight", "score"))])
    shared = packed.sparkSession.sparkContext.broadcast(gains)  # `buckets` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0)[k].values
                counts, offsets, stream = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((1, "<i8"), (2, "<i8"), (3, "<u2")))
                sizes = np.diff(offsets)
                some = np.flatnonzero(sizes)
                weight = np.zeros(len(sizes), np.int64)
                if len(some):
                    weight[some] = np.add.reduceat(shared.value[stream], offsets[some]) // sizes[some]
                score = weight + np.array([noise(seed, x) for x in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (sizes, counts, weight, score))], names=schema.names)

    return packed.mapInArrow(run, schema)


def resample(
    documents: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_id: str = "item_id", target_text: str = "text", *,
    buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, share: int = SHARE, per: int = PER,
) -> DataFrame:
    """id, n_features, weight, score and rank of every document; rank is null for those not drawn."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError(f"{buckets} buckets do not fit 16 bits")
    packed = streams(documents, id_column, text_column, buckets)
    gains = bucket_gains(bucket_counts(packed, buckets), bucket_counts(streams(target, target_id, target_text, buckets), buckets))
    rows = stored(scored(packed, gains, id_column, seed).withColumn("__down", -F.col("score")))
    enough = rows.where(F.col("n_words") >= least_words)
    drawn = share * enough.count() // per
    ranked = with_ordinal(enough, "__down", id_column, name="__at").withColumn("rank", F.when(F.col("__at") < drawn, F.col("__at") + 1))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).union(rest).select(id_column, "n_features", "weight", "score", "rank")
