"""Page layout in a font of one advance, word boxes, masks and their targets."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.storage import small

MARGIN = 40
LEAST_FONT = 14
#: Characters of the texts whose masked rows a task holds at once, about.
_LETTERS = 1_000_000


@dataclass(frozen=True)
class Page:
    """Canvas and font in pixels; advance: the width of each character."""

    width: int = 1024
    height: int = 1024
    advance: int = 8
    line_height: int = 17
    margin: int = MARGIN // 2

    @property
    def chars(self) -> int:
        return max(1, (self.width - 2 * self.margin) // self.advance)

    @property
    def lines(self) -> int:
        return max(1, (self.height - 2 * self.margin) // self.line_height)


def _fill(words: list[str], room: int) -> Iterator[str]:
    """Lines of one paragraph: words go on a line while they fit, longer ones are cut to full lines."""
    line = ""
    for word in words:
        joined = f"{line} {word}".strip() if line or word else ""
        if len(joined) <= room:
            line = joined
            continue
        if line:
            yield line
        full = (len(word) - 1) // room
        yield from (word[k * room : (k + 1) * room] for k in range(full))
        line = word[full * room :]
    yield line


def wrap(text: str, page: Page) -> list[str]:
    """All lines, empty ones included; every line feed begins a new one."""
    return [line for paragraph in text.split("\n") for line in _fill(paragraph.split(" "), page.chars)]


def wrapped(df: DataFrame, key: str, text: str, page: Page) -> DataFrame:
    """key, page, line (from 0, in its page) and text of every line; null text has one empty line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n // page.lines, n % page.lines, line) for k, t in zip(pdf[key], pdf[text], strict=True) for n, line in enumerate(wrap(t or "", page))]
            yield pd.DataFrame(rows, columns=[key, "page", "line", "text"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, page int, line int, text string")


def word_boxes(lines: DataFrame, key: str, page: Page) -> DataFrame:
    """Boxes of the words on wrapped lines, numbered in reading order."""
    found = lines.select(key, "page", "line", F.posexplode(F.split("text", " ")).alias("k", "word"), F.split("text", " ").alias("all"))
    before = F.length(F.array_join(F.slice("all", 1, F.col("k")), " ")) + (F.col("k") > 0).cast("int")
    left = F.lit(page.margin) + before * page.advance
    top = F.lit(page.margin) + F.col("line") * page.line_height
    boxes = found.where(F.col("word") != "").select(key, "page", "line", "k", "word", left.alias("x0"), top.alias("y0"), (left + F.length("word") * page.advance).alias("x1"), (top + page.line_height).alias("y1"))
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("page", "line", "k")
    return boxes.withColumn("index", F.row_number().over(order) - 1).drop("k")


def _boxes(rows: list[int], texts: list[str], page: Page) -> tuple[np.ndarray, list[pa.Array]]:
    """Of every word of the texts: its row, and page, line, word, box and index."""
    shown = [(row, n, line) for row, text in zip(rows, texts, strict=True) for n, line in enumerate(wrap(text, page)) if line]
    row, number = (np.array([s[k] for s in shown], np.int32) for k in (0, 1))
    words = pc.split_pattern(pa.array([s[2] for s in shown], pa.string()), " ")
    of = np.diff(words.offsets.to_numpy())
    words = words.flatten()
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    row, number = np.repeat(row, of), np.repeat(number, of)
    ends = np.cumsum(size + 1)
    left = ends - size - 1
    first = np.cumsum(of) - of
    left -= np.repeat(left[first], of)
    if not size.all():  # empty words have a place, but no box
        full = size > 0
        row, number, left, size, words = row[full], number[full], left[full], size[full], words.filter(pa.array(full))
    index = np.arange(len(row)) - np.searchsorted(row, row)
    x0, y0 = page.margin + left * page.advance, page.margin + number % page.lines * page.line_height
    numbers = [number // page.lines, number % page.lines, x0, y0, x0 + size * page.advance, y0 + page.line_height, index]
    made = [pa.array(n.astype(np.int32)) for n in numbers]
    return row, [*made[:2], words, *made[2:]]


def text_boxes(df: DataFrame, key: str, text: str, page: Page) -> DataFrame:
    """`word_boxes` of the lines of each text, made text by text: words are neither sorted nor shuffled.

    Only texts that share a key are numbered together, by `word_boxes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, letters = batch.column(1).to_pylist(), [], 0
            for k, t in enumerate(texts):
                if t:
                    rows.append(k)
                    letters += len(t)
                if rows and (letters >= _LETTERS or k == len(texts) - 1):
                    row, made = _boxes(rows, [texts[r] for r in rows], page)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *made], names=[key, "page", "line", "word", "x0", "y0", "x1", "y1", "index"])
                    rows, letters = [], 0

    own = df.select(key, text)
    shared = own.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select("__key")
    schema = f"{key} {df.schema[key].dataType.simpleString()}, page int, line int, word string, x0 int, y0 int, x1 int, y1 int, index int"
    if shared.isEmpty():
        return own.mapInArrow(run, schema)
    shared, same = small(shared), F.col(key).eqNullSafe(F.col("__key"))
    return own.join(shared, same, "left_anti").mapInArrow(run, schema).union(word_boxes(wrapped(own.join(shared, same, "left_semi"), key, text, page), key, page))


def visible_prefix(lines: list[str], page: Page, max_pages: int) -> list[str]:
    """Lines of the first pages, without empty ones at the end."""
    shown = lines[: page.lines * max_pages]
    while shown and not shown[-1]:
        shown.pop()
    return shown


@dataclass(frozen=True)
class MaskSpec:
    rate: tuple[float, float] = (0.1, 0.4)
    run: tuple[int, int] = (1, 4)
    gap: int = 1
    sentinel: str = "[gap]"


def keyed_random(*key: object) -> random.Random:
    """The same numbers for the same key, on whatever worker."""
    return random.Random(hashlib.sha256("|".join(map(str, key)).encode()).digest())


def mask_runs(rng: random.Random, n: int, spec: MaskSpec) -> list[tuple[int, int]]:
    """Runs (first word, words) that cover about a rate of the words, drawn from the spec's
    range, with a gap between runs; tries are bounded, so a full row may stay below its rate."""
    if n <= 0:
        return []
    want = max(1, min(n, round(rng.uniform(*spec.rate) * n)))
    free, runs, covered = [True] * n, [], 0
    for _ in range(200 * want):
        if covered >= want:
            break
        size = max(1, min(rng.randint(*spec.run), want - covered, n))
        first = rng.randrange(n - size + 1)
        around = slice(max(0, first - spec.gap), first + size + spec.gap)
        if all(free[around]):
            free[around] = [False] * len(free[around])
            runs.append((first, size))
            covered += size
    return sorted(runs)


def mask_target(words: list[str], runs: list[tuple[int, int]], spec: MaskSpec) -> dict:
    """Visible words with one sentinel for each run, and where the sentinels stand."""
    hidden = {first + k for first, size in runs for k in range(size)}
    starts = {first for first, _ in runs}
    pieces = [(spec.sentinel if k in starts else w, k in starts) for k, w in enumerate(words) if k in starts or k not in hidden]
    ends = list(accumulate((len(p) + 1 for p, _ in pieces), initial=0))
    seen = list(accumulate((not s for _, s in pieces), initial=0))
    return {
        "target": " ".join(p for p, _ in pieces), "visible": [p for p, s in pieces if not s], "masked": sorted(hidden),
        "sentinel_starts": [ends[k] for k, (_, s) in enumerate(pieces) if s], "sentinel_visible": [seen[k] for k, (_, s) in enumerate(pieces) if s],
    }


def masked(df: DataFrame, key: str, text: str, seed: int, spec: MaskSpec | None = None) -> DataFrame:
    """key, target, run starts and sizes, masked words, sentinel places of each text's words.

    Rows are handed on whenever their texts have `_LETTERS` characters: a word is an object of
    its own here, many times as large as in its text."""
    spec = spec or MaskSpec()
    names = [key, "target", "run_start", "run_size", "masked", "visible", "sentinel_starts", "sentinel_visible", "n_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, letters = [], 0
            for k, t in zip(pdf[key], pdf[text], strict=True):
                words = (t or "").split()
                runs = mask_runs(keyed_random(seed, k), len(words), spec)
                made = mask_target(words, runs, spec)
                rows.append((k, made["target"], [r[0] for r in runs], [r[1] for r in runs], [words[i] for i in made["masked"]], made["visible"], made["sentinel_starts"], made["sentinel_visible"], len(words)))
                letters += len(t or "")
                if letters >= _LETTERS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, letters = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, target string, run_start array<int>, run_size array<int>, masked array<string>, visible array<string>, sentinel_starts array<int>, sentinel_visible array<int>, n_words int")


def sentinel_problems(df: DataFrame, sentinel: str) -> DataFrame:
    """An array `problems`: what the stored sentinel columns say that the target does not."""
    n = F.size("sentinel_starts")
    text = F.transform("sentinel_starts", lambda s: F.substring(F.col("target"), s + 1, F.lit(len(sentinel))))
    return df.withColumn(
        "problems",
        F.array_compact(F.array(
            F.when(n != F.size("run_start"), "sentinels and runs"), F.when(n != F.size("sentinel_visible"), "sentinels and places"), F.when(F.exists(text, lambda t: t != sentinel), "no sentinel at its place"),
            F.when(F.size("visible") + F.aggregate("run_size", F.lit(0), lambda a, b: a + b) != F.col("n_words"), "words lost"),
        )),
    )


def mask_statistics(df: DataFrame) -> DataFrame:
    """One row: spread of the masked rate (over the population), runs a row, masked words that are also visible."""
    size = F.aggregate("run_size", F.lit(0), lambda a, b: a + b)
    rate = size / F.col("n_words")
    also = F.size(F.filter("masked", lambda w: F.array_contains(F.col("visible"), w)))
    return df.where("n_words > 0").agg(
        F.count("*").alias("n"), F.avg(rate).alias("mean_rate"), F.stddev_pop(rate).alias("sd_rate"), F.min(rate).alias("low_rate"), F.max(rate).alias("high_rate"), F.avg(F.size("run_start")).alias("runs_per_row"),
        F.sum(size).cast("long").alias("masked_words"), F.sum(also).cast("long").alias("also_visible"),
    )


def run_lengths(df: DataFrame, most: int) -> DataFrame:
    """How many runs have each length from 1 to `most`; lengths without runs have 0."""
    counts = df.select(F.explode("run_size").alias("size")).groupBy("size").count()
    return df.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("size")).join(counts, "size", "left").select("size", F.coalesce("count", F.lit(0)).alias("runs"))


def random_strings(spark, rows: int, groups: int, letters: int, seed: int) -> DataFrame:
    """row_id and target: groups of letters a to z from md5 hashes of seed, row and place."""
    digest = lambda g, k: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), g.cast("string"), k.cast("string")).cast("binary"))
    place = lambda g, k: F.chr(F.conv(F.substring(digest(g, k), 1, 8), 16, 10).cast("long") % 26 + 97)
    group = lambda g: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(letters)), lambda k: place(g, k)), "")
    return spark.range(rows).select(F.col("id").cast("string").alias("row_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(groups)), group), " ").alias("target"))
