"""Named sources, and parquet scans that open only the files they need."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READERS: dict[str, Callable[..., DataFrame]] = {}


def source(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a reader (spark, path, **options) under a name."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _READERS[name] = f
        return f

    return register


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    if name not in _READERS:
        raise KeyError(f"no source {name}; there are {sorted(_READERS)}")
    return _READERS[name](spark, path, **options)


@source("parquet")
def parquet(spark: SparkSession, path: str, revision: str | None = None) -> DataFrame:
    return spark.read.parquet(path if revision is None else f"{path}/revision={revision}")


@source("jsonl")
def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def _plain_name(path: str) -> str:
    """The name of a file behind its URL."""
    return re.sub("^file:/+", "file:/", unquote(path))


@source("parquet_slice")
def parquet_slice(spark: SparkSession, path: str, rows: int | None = None, offset: int = 0, schema: str | None = None, whole_files: bool = False) -> DataFrame:
    """Rows offset to offset + rows (all that follow if None), files in name order and rows as
    they stand in them.

    Row counts come from the footers: files are counted in growing runs, no column is read, and
    counting ends where the slice does. Files outside the slice are not opened by the result,
    and files behind it not at all if the schema is given (else one may be, to learn it). With
    `whole_files` all rows of the files that the slice touches are kept."""
    if offset < 0 or (rows is not None and rows < 0):
        raise ValueError(f"a slice from {offset} of {rows} rows")
    whole = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    files, reader = sorted(map(_plain_name, whole.inputFiles())), spark.read.schema(whole.schema).option("basePath", path)
    taken, cuts, total, at, run = [], [], 0, 0, 1
    end = float("inf") if rows is None else offset + rows
    while at < len(files) and total < end:
        some = files[at : at + run]
        counted = reader.parquet(*some).groupBy(F.col("_metadata.file_path").alias("file")).count()
        n_rows = {_plain_name(r["file"]): r["count"] for r in counted.collect()}
        for f in some:
            n = n_rows.get(f, 0)
            low, high = max(0, offset - total), min(n, end - total)
            if low < high:
                taken.append(f)
                if low or high < n:
                    cuts.append((f, low, high))
            total += n
        at, run = at + run, 2 * run
    if not taken:
        return spark.createDataFrame([], whole.schema)
    kept = F.lit(True)
    for f, low, high in cuts:  # the first and the last file at most
        row, here = F.col("_metadata.row_index"), F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/") == f
        kept = kept & (~here | ((row >= low) & (row < high)))
    out = reader.parquet(*taken)
    return out.where(kept) if cuts and not whole_files else out


@source("parquet_head")
def parquet_head(spark: SparkSession, path: str, rows: int, schema: str | None = None) -> DataFrame:
    """The first files, in name order, that hold `rows` rows, whole; row counts come from the footers."""
    return parquet_slice(spark, path, rows, schema=schema, whole_files=True)


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 (frames, or frames by channels) and the rate, of 8- or 16-bit PCM."""
    with wave.open(io.BytesIO(data)) as f:
        raw, channels, width, rate = f.readframes(f.getnframes()), f.getnchannels(), f.getsampwidth(), f.getframerate()
    if width not in (1, 2):
        raise ValueError(f"samples of {width} bytes")
    values = np.frombuffer(raw, "<i2").astype(np.float32) / 32768 if width == 2 else (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    return values if channels == 1 else values.reshape(-1, channels), rate


@source("wav")
def wav(spark: SparkSession, path: str, pattern: str = r"([0-9])_([^_/]+)_([0-9]+)\.wav$") -> DataFrame:
    """digit, speaker, take, rate and samples of the WAV files whose names fit; unreadable ones have null samples."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    named = files.select("path", *(F.regexp_extract("path", pattern, k).alias(n) for k, n in enumerate(("digit", "speaker", "take"), 1)), "content").where(F.col("digit") != "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from weft.functions.media import mono

        for pdf in batches:
            out = []
            for data in pdf["content"]:
                try:
                    samples, rate = decode_wav(bytes(data))
                    out.append((rate, mono(samples).tolist()))
                except (ValueError, EOFError, wave.Error):
                    out.append((None, None))
            yield pdf.drop(columns="content").assign(rate=pd.array([o[0] for o in out], "Int32"), samples=[o[1] for o in out])

    return named.mapInPandas(run, "path string, digit string, speaker string, take string, rate int, samples array<float>")


def resampled(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """The samples at another rate, by a windowed sinc of 16 zero crossings below both rates' bounds."""
    if rate == wanted or not len(samples):
        return samples
    cut = min(1.0, wanted / rate)
    n, reach = -(-len(samples) * wanted // rate), int(np.ceil(16 / cut))
    out = np.empty(n, np.float32)
    for first in range(0, n, 8192):
        at = np.arange(first, min(first + 8192, n)) * (rate / wanted)
        near = np.floor(at).astype(int)[:, None] + np.arange(-reach + 1, reach + 1)
        away = at[:, None] - near
        weight = cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / reach, -1, 1)))
        inside = (near >= 0) & (near < len(samples))
        out[first : first + len(at)] = (np.where(inside, samples[np.clip(near, 0, len(samples) - 1)], 0) * weight).sum(1)
    return out


@source("flac")
def flac(spark: SparkSession, path: str, rate: int = 16_000, most_seconds: float | None = None) -> DataFrame:
    """uid (the file's name), rate, seconds, samples (mono, at `rate`) and problem of the FLAC files.

    Clips longer than `most_seconds` are left out before they are resampled; a file that cannot
    be read has null samples and says why."""
    from weft.sources.flac import FlacError, whole_samples

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.flac").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.flac$", 1).alias("uid"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for uid, data in zip(pdf["uid"], pdf["content"], strict=True):
                try:
                    limit = None if most_seconds is None else most_seconds + 0.1
                    whole, own, depth = whole_samples(bytes(data), limit)
                except (FlacError, IndexError) as e:
                    out.append((uid, None, None, None, str(e)))
                    continue
                if most_seconds is None or len(whole) <= most_seconds * own:
                    values = (whole.mean(axis=1) / (1 << (depth - 1))).astype(np.float32)
                    out.append((uid, rate, len(whole) / own, resampled(values, own, rate).tolist(), None))
            yield pd.DataFrame(out, columns=["uid", "rate", "seconds", "samples", "problem"]).astype({"rate": "Int32", "seconds": "Float64"})

    return named.mapInPandas(run, "uid string, rate int, seconds double, samples array<float>, problem string")


@source("speech")
def speech(spark: SparkSession, path: str, rate: int = 16_000, most_seconds: float | None = None) -> DataFrame:
    """Clips of FLAC files beside their transcripts (`*.trans.txt`, lines `<uid> TEXT`); clips
    without a text, and texts without a clip that could be read, are left out."""
    from weft.sources.text import read_transcripts

    clips = flac(spark, path, rate, most_seconds).where(F.col("samples").isNotNull()).drop("problem")
    lines = spark.read.option("pathGlobFilter", "*.trans.txt").option("recursiveFileLookup", "true")
    texts = read_transcripts(spark, path, lines).where(F.col("text") != "").dropDuplicates(["uid"])
    return clips.join(texts, "uid")


def within_duration(df: DataFrame, samples: str, rate: str, page_seconds: float, max_pages: int) -> DataFrame:
    """Clips that fit on the pages (asked before anything is rendered)."""
    return df.where(F.size(samples) / F.col(rate) <= page_seconds * max_pages)
