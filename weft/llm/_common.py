"""Helpers shared by the corpus operators: bounded Arrow chunks, vectorised word
segmentation over UTF-8 bytes, checkpoints in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from weft.functions.storage import checkpoint, owned_dir, release, shared_dir, stored, written  # noqa: F401  for the operators here

#: Bytes of text that are held in numpy arrays at once; one longer text is a chunk of its own.
CHUNK_BYTES = 2_000_000

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> pa.Array:
    """The column as large strings, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with about `size` bytes of text each, and their texts."""
    for batch in batches:
        texts = strings(batch.column(text))
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + 1 : texts.offset + len(texts) + 1]
        start, base = 0, int(ends[0] - pc.binary_length(texts[0]).as_py())
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (one entry more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    return data, offsets - first


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


#: Word bytes of `[^\x20\x09-\x0D]+` and, after lower-casing A-Z, of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20240607).integers(1 << 63, size=256, dtype=np.uint64) | _U(1)


@lru_cache(maxsize=2)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], from one prefix sum over all bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = 1 << max(10, int(len(data)).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(int(_MUL), size)[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * _powers(int(_INV), size)[starts] + (ends - starts).astype(np.uint64) * _STEP)


class Words:
    """Words of a chunk: byte spans, the text each stands in, and 64-bit hashes."""

    def __init__(self, texts: pa.Array, letters: np.ndarray):
        raw, self.offsets = utf8(texts)
        self.data = LOWER[raw]
        self.texts = len(texts)
        inside = letters[self.data]
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        before[edges], after[edges - 1] = False, False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.text_of = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.text_of, minlength=self.texts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = hash_spans(self.data, self.starts, self.ends)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of `width` consecutive words of one text, and the index of each run's first word."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.flatnonzero(self.text_of[:n] == self.text_of[width - 1 :])
        return self.hash_runs(at, width), at

    def hash_runs(self, at: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.full(len(at), width, np.uint64)
            for k in range(width):
                out = out * _STEP + self.hashes[at + k]
            return mix(out)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted, one text after another, and
    where each text begins. A text of fewer words than `width` has its whole
    sequence as one shingle; one without words has none."""
    hashes, at = words.runs(width)
    owner = words.text_of[at]
    for short in range(1, width):
        which = np.flatnonzero(words.counts == short)
        hashes = np.concatenate([hashes, words.hash_runs(words.first[which], short)])
        owner = np.concatenate([owner, which])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=words.texts))])
