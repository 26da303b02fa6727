"""Lanes made from other tables: descriptions, speech pages, random strings, poisoned and masked text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text as X
from weft.operators import conversation as C
from weft.operators import layout as L


def description_rows(df: DataFrame, source: str, split: str, ordinal: Column) -> DataFrame:
    """Pictures with texts of struct<user, assistant>: the first text is asked and answered; rows without one go."""
    first = F.get("texts", 0)
    kept = df.where(F.coalesce(first["assistant"], F.lit("")) != "")
    return C.canonical(kept, source=source, split=split, instruction=F.coalesce(first["user"], F.lit("")), target=first["assistant"], identity=ordinal.cast("string"), modality="image-text", images=F.col("images").cast(T.ArrayType(C.IMAGE)), n_images=1)


def speech_rows(df: DataFrame, source: str, split: str, ordinal: Column, instruction: str, page_seconds: float = 10.0, max_pages: int = 4) -> DataFrame:
    """Clips (audio struct<array, sampling_rate>, text) as log-mel pages. Clips that need more
    pages are left out before anything is rendered; the page count goes into the row's configuration."""
    n, rate = F.size("audio.array"), F.col("audio.sampling_rate")
    seconds = n / rate
    pages = F.greatest(F.lit(1), F.ceil(seconds / page_seconds))
    fits = df.where((n > 0) & (seconds <= page_seconds * max_pages))
    config = F.to_json(F.struct(F.round(seconds, 3).alias("duration_sec"), (pages * page_seconds > seconds).alias("last_page_padded"), F.lit(page_seconds).alias("page_duration_sec"), pages.cast("int").alias("pages")))

    @F.pandas_udf(T.ArrayType(C.IMAGE))
    def render(samples: pd.Series, rates: pd.Series) -> pd.Series:
        import numpy as np

        from weft.functions import media

        def one(s, r):
            signal = media.resample(media.mono(np.asarray(s, np.float32)), int(r))
            return [{"bytes": media.png(p), "path": None} for p in media.log_mel_pages(signal, page_seconds, max_pages)]

        return pd.Series([one(s, r) for s, r in zip(samples, rates, strict=True)])

    made = fits.select("*", render("audio.array", "audio.sampling_rate").alias("__pages"))
    rows = C.canonical(made, source=source, split=split, instruction=F.lit(instruction), target=F.col("text"), identity=C.row_id(df, ordinal, "id"), modality="audio", config=config, images=F.col("__pages"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    first = F.get("messages", 0)
    asked = F.struct(first["role"].alias("role"), F.concat(F.array_repeat(image, F.size("images")), first["content"]).alias("content"))
    return rows.withColumn("messages", F.concat(F.array(asked), F.slice("messages", 2, 10))).to(C.CANONICAL)


def random_string_rows(spark, rows: int, groups: int, letters: int, seed: int, source: str = "random-strings", split: str = "train", instruction: str = "Read the letters.") -> tuple[DataFrame, dict]:
    """Rows of random letters, and the loss of a model that reads none of them."""
    df = L.random_strings(spark, rows, groups, letters, seed)
    config = C.config_json(charset_size=26, groups=groups, letters=letters, seed=seed)
    made = C.canonical(df, source=source, split=split, instruction=F.lit(instruction), target=F.col("target"), identity=F.col("row_id"), modality="image-text", config=config)
    tokens = groups * letters + groups - 1
    nats = groups * letters * math.log(26)
    return made, {"rows": rows, "nats_per_row": nats, "floor": nats / tokens, "floor_supervised": nats / (tokens + 2)}


def poisoned_rows(df: DataFrame, source: str, rate: float, seed: int, limit: int | None = None) -> DataFrame:
    """Canonical text rows whose targets have letters replaced; the mask, the rate that came
    out and the row it was made from come with it. Empty targets are left out."""
    target = X.assistant_text(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.array_join(F.transform(m["content"], lambda p: p["text"]), "").alias("text"))))
    texts = df.withColumn("__t", X.truncate_tokens(target, limit)).where(F.col("__t") != "")
    out, places = X.poisoned(F.col("__t"), rate, F.lit(seed), F.col("source_dataset_id"), F.col("split"), F.col("row_id"))
    made = texts.select(*df.columns, out.alias("__p"), places.alias("poison_mask"), F.length("__t").alias("__n"))
    asked = F.filter("messages", lambda m: m["role"] == "user")
    return made.select(
        *(F.col(c) for c in df.columns if c not in ("messages", "source_dataset_id", "original_token_length")), F.concat(asked, F.array(C.message("assistant", F.col("__p")))).alias("messages"), F.lit(source).alias("source_dataset_id"),
        X.token_length(F.col("__p")).alias("original_token_length"), "poison_mask", (F.size("poison_mask") / F.col("__n")).cast("float").alias("poison_rate"), F.col("row_id").alias("source_row_id"),
    )


def masked_rows(df: DataFrame, key: str, text: str, seeds: tuple[int, int] = (1, 2), spec: L.MaskSpec | None = None) -> DataFrame:
    """Two masks of each text with different targets; texts whose masks agree are left out."""
    a, b = L.masked(df, key, text, seeds[0], spec), L.masked(df, key, text, seeds[1], spec)
    other = b.select(F.col(key).alias("__k"), F.col("target").alias("other_target"), F.col("run_start").alias("other_start"), F.col("run_size").alias("other_size"))
    joined = a.join(other, F.col(key) == F.col("__k")).drop("__k")
    return joined.where(F.col("target") != F.col("other_target"))


def assembled(messages: Column, header: str = "<{}>", trailer: str = "</>", image: str = "[image]", expand: int = 1) -> Column:
    """Chat pieces in order, struct<text, supervised>: header, images (each `expand` times), text,
    trailer; only what the assistant says, with its trailer, is supervised."""
    piece = lambda t, s: F.struct(t.alias("text"), s.alias("supervised"))

    def of(m: Column) -> Column:
        own = m["role"] == "assistant"
        parts = F.flatten(F.transform(m["content"], lambda p: F.when(p["type"] == "image", F.array_repeat(piece(F.lit(image), F.lit(False)), expand)).otherwise(F.array(piece(F.coalesce(p["text"], F.lit("")), own)))))
        before, _, after = header.partition("{}")
        return F.concat(F.array(piece(F.concat(F.lit(before), m["role"], F.lit(after)), F.lit(False))), parts, F.array(piece(F.lit(trailer), own)))

    return F.flatten(F.transform(messages, of))


def centroids(weights: DataFrame, by: list[str], place: str, weight: str) -> DataFrame:
    """Weighted mean place of each group; null without weight."""
    return weights.groupBy(*by).agg(F.try_divide(F.sum(F.col(place) * F.col(weight)), F.sum(weight)).alias("centroid"))


def word_index(tokens: DataFrame, key: str, pos: str, boundary: Column) -> DataFrame:
    """Number of the word of each token: how many begin up to it, from 0."""
    from pyspark.sql import Window

    return tokens.withColumn("word_idx", F.sum(boundary.cast("int")).over(Window.partitionBy(key).orderBy(pos)) - 1)


def layer_profile(values: DataFrame, layer: str, value: str, band: tuple[int, int]) -> DataFrame:
    """Mean of each layer, the mean over a band of layers, and the layer with the largest mean."""
    each = values.groupBy(layer).agg(F.avg(value).alias("mean"))
    whole = each.agg(F.avg(F.when(F.col(layer).between(*band), F.col("mean"))).alias("band_mean"), F.max_by(layer, "mean").alias("best_layer"))
    return each.crossJoin(F.broadcast(whole))  # one row


def excess(own: DataFrame, donor: DataFrame, key: str, score: str) -> DataFrame:
    """Mean score on the own target less that on a donor's; both have key and score."""
    joined = own.select(key, F.col(score).alias("own")).join(donor.select(key, F.col(score).alias("other")), key)
    return joined.agg(F.count("*").alias("n"), F.avg("own").alias("own"), F.avg("other").alias("other"), F.avg(F.col("own") - F.col("other")).alias("excess"))


def pixel_collisions(a: DataFrame, b: DataFrame, ordinal: str, images: str) -> DataFrame:
    """Rows of one ordinal in two rungs whose first pictures are the same bytes."""
    digest = F.md5(F.get(images, 0)["bytes"])
    x, y = a.select(ordinal, digest.alias("md5")), b.select(F.col(ordinal).alias("__o"), digest.alias("__md5"))
    return x.join(y, (F.col(ordinal) == F.col("__o")) & (F.col("md5") == F.col("__md5"))).select(ordinal, "md5")


def widen_pages(df: DataFrame, width: int) -> DataFrame:
    """Canonical rows with wider pages; the configuration says from what, and how long a pixel lasts.

    Pages must be the grey PNGs that this library writes; a page of that width stays as it is."""

    @F.pandas_udf(T.ArrayType(C.IMAGE))
    def wide(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from weft.functions import media

        for series in images:
            yield pd.Series([[{"bytes": media.png(media.resize_width(media.read_png(bytes(i["bytes"])), width)), "path": i["path"]} for i in row] for row in series])

    from weft.sources.text import rewrite_config

    return df.withColumn("images", wide("images")).withColumn("render_config", rewrite_config("render_config", {"canvas_width": width})).to(df.schema)
