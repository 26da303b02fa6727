"""Page fit, foreign PNGs, sound from pages, tokenizers, and the life of stored tables."""

from __future__ import annotations

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import media, sound, storage
from weft.functions import text as X
from weft.functions.tokenizers import Characters, FileTokenizer, Tokenizer, token_ids
from weft.operators import fit, layout
from weft.operators.conversation import fill_token_length

PAGE = layout.Page(width=120, height=90, advance=10, line_height=20, margin=5)  # 11 characters, 4 lines


def texts():
    draw = random.Random(8)
    pool = ["a", "bb", "ccc", "dddddd", "eleven char", "x" * 12, "y" * 40, "", "\n", "\n\n", "ü"]
    return ["", "\n\n\n", "word", None] + [" ".join(draw.choices(pool, k=draw.randint(1, 30))).replace(" \n", "\n") for _ in range(120)]


def test_index_has_the_lines_of_wrapping():
    for text in texts():
        lines = list(fit.placed_lines(text or "", PAGE))
        assert [x for _, _, x in lines] == layout.wrap(text or "", PAGE)
        for place, end, line in lines:
            assert not line or line.split() == text[place:end].split()


def test_fit_of_any_number_of_pages(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "k long, t string")
    index = fit.wrap_index(df, "k", "t", PAGE, 3)
    for pages in (1, 2, 3):
        got = {r.k: r for r in fit.fitting(index, PAGE, pages).collect()}
        for k, text in rows:
            lines = layout.wrap(text or "", PAGE)
            shown = layout.visible_prefix(lines, PAGE, pages)
            r = got[k]
            assert (r.lines_fit, r.all_fits) == (len(shown), len(lines) <= PAGE.lines * pages)
            assert " ".join((text or "")[: r.chars_fit].split()).replace(" ", "") == "".join(shown).replace(" ", "")
    whole = fit.wrap_index(df, "k", "t", PAGE)
    places = whole.withColumn("at", F.element_at("starts", -1)).withColumn("page", fit.page_of(whole, PAGE, F.col("at")))
    assert {r.k: r.page for r in places.collect()} == {k: (len(layout.wrap(t or "", PAGE)) - 1) // PAGE.lines for k, t in rows}


def test_tall_pages_never_cut_words(spark):
    df = spark.createDataFrame([(1, "aa bb " + "x" * 30 + " cc"), (2, None), (3, "a\n\nb")], "k long, t string")
    got = {r.k: (r.lines, r.height, r.longest) for r in fit.tall_pages(df, "k", "t", PAGE).collect()}
    assert got == {1: (3, 70, 30), 2: (1, 64, 0), 3: (3, 70, 1)}


def encoded(pixels, colour, depth=8, kinds=(0, 1, 2, 3, 4), palette=b""):
    """A PNG with another filter on each row, chosen in turn."""
    height, width = pixels.shape[:2]
    samples = media._SAMPLES[colour]
    flat = pixels.reshape(height, width * samples)
    if depth == 16:
        flat = np.stack([flat, 255 - flat], 2).reshape(height, -1)
    elif depth < 8:
        bits = (flat[:, :, None] >> np.arange(depth - 1, -1, -1) & 1).reshape(height, -1).astype(np.uint8)
        flat = np.packbits(bits, axis=1)
    step, raw, above = max(1, samples * depth // 8), b"", [0] * flat.shape[1]
    for y in range(height):
        row, kind = flat[y].tolist(), kinds[y % len(kinds)]
        out = []
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - [0, a, b, (a + b) // 2, nearest][kind]) & 255)
        raw += bytes([kind, *out])
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(raw)
    body = chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"tEXt", b"a\0b") + body + chunk(b"IEND", b"")


def test_foreign_pngs():
    draw = np.random.default_rng(1)
    for colour, samples in ((0, 1), (2, 3), (4, 2), (6, 4)):
        x = draw.integers(0, 256, (11, 7, samples)).astype(np.uint8)
        for depth in (8, 16):
            got = media.read_png(encoded(x, colour, depth))
            assert np.array_equal(got, x[:, :, 0] if samples == 1 else x)
    x = draw.integers(0, 4, (6, 9, 1)).astype(np.uint8)
    assert np.array_equal(media.read_png(encoded(x, 0, 2)), x[:, :, 0] * 85)
    colours = draw.integers(0, 256, (4, 3)).astype(np.uint8)
    assert np.array_equal(media.read_png(encoded(x, 3, 4, palette=colours.tobytes())), colours[x[:, :, 0]])
    page = draw.integers(0, 256, (5, 8)).astype(np.uint8)
    assert np.array_equal(media.read_png(media.png(page)), page)
    assert media.grey(np.array([[[255, 0, 0], [0, 255, 0], [255, 255, 255]]], np.uint8)).tolist() == [[76, 150, 255]]
    good = encoded(x, 0, 2)
    for bad in (b"", good[:30], good[:28] + b"\x01" + good[29:], b"x" + good[1:]):
        with pytest.raises((ValueError, struct.error)):
            media.read_png(bad)


def test_sound_comes_back_from_pages():
    for name, signal in sound.test_signals(0.6).items():
        spectrum = sound.stft(signal)
        assert np.abs(sound.istft(spectrum, len(signal)) - signal)[200:-200].max() < 1e-9
        back = sound.sound_of_power(np.abs(spectrum) ** 2, len(signal), 40)
        size, again = np.abs(spectrum), np.abs(sound.stft(back))
        assert np.linalg.norm(again - size) < 0.35 * np.linalg.norm(size), name
        page = media.log_mel_pages(signal, 0.6)[0]
        heard = sound.sound_of_page(page, 0.6, rounds=32)
        other = media.log_mel_pages(heard.astype(np.float32), 0.6)[0]
        near = media.fidelity(media.from_pixels(page), media.from_pixels(other))
        assert near["corr"] > 0.85 and near["mae"] < 0.1, (name, near)


def test_pages_of_other_shapes_are_repaired():
    page = media.log_mel_pages(sound.test_signals(0.5)["vowel"], 0.5)[0]
    mel = sound.mel_of_page(page, page.shape[1])
    wide = media.resize(page, 160, 2 * page.shape[1])
    colours = np.stack([wide] * 3, 2)
    again = sound.mel_of_page(colours, page.shape[1])
    assert again.shape == mel.shape and np.abs(np.log10(again) - np.log10(mel)).mean() < 0.15
    assert sound.round_trip(page, 160, 2 * page.shape[1])["rmse_over_sd"] < 0.1 < sound.round_trip(page, 10, 7)["rmse_over_sd"]
    assert sound.stretch_equivalence(page, 80, page.shape[1], 2 * page.shape[1])["rmse_over_sd"] < 0.02
    assert np.array_equal(media.resize(page, *page.shape), page)
    smooth, noisy = (sound.hop_redundancy(x) for x in (sound.test_signals(0.5)["vowel"], np.random.default_rng(0).normal(size=8000)))
    assert smooth["residual_over_sd"] < noisy["residual_over_sd"]


def test_tokenizers_of_ones_own(spark):
    import public_tokenizers

    bpe = FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert isinstance(bpe, Tokenizer) and isinstance(Characters(), Tokenizer)
    rows = [(0, "Hello world, a longer text with several tokens"), (1, ""), (2, None), (3, "日本語 ü")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = df.select("k", X.token_length(F.col("t"), bpe).alias("n"), X.truncate_tokens(F.col("t"), 3, bpe).alias("p"), token_ids(F.col("t"), bpe).alias("ids")).collect()
    for r, (_, t) in zip(sorted(got), rows, strict=True):
        ids = None if t is None else bpe.encode(t)
        assert (r.n, r.ids) == (None if t is None else len(ids), ids)
        assert r.p == (t if t is None or len(ids) <= 3 else bpe.decode(ids[:3]))
    assert [r.p for r in df.select(X.truncate_tokens(F.col("t"), 3, Characters()).alias("p")).collect()] == ["Hel", "", None, "日本語"]
    with pytest.raises(ValueError, match="limit"):
        X.truncate_tokens(F.col("t"), 0, bpe)
    said = "messages array<struct<role:string,content:array<struct<type:string,text:string>>>>, original_token_length long"
    row = spark.createDataFrame([([("user", [("text", "x")]), ("assistant", [("text", "four words are here")])], -1)], said)
    assert fill_token_length(row, bpe).first().original_token_length == len(bpe.encode("four words are here"))


def test_stored_tables_go_with_their_owner(spark, tmp_path):
    def left():
        folder = storage.shared_dir(spark).removeprefix("file:")
        return {x for x in os.listdir(folder) if x.startswith(("scratch-", "table-"))} if os.path.isdir(folder) else set()

    before = left()

    def build():
        a = storage.stored(spark.range(10))
        return storage.checkpoint(a.withColumn("x", F.col("id") * 2)).where("x > 4")

    out = storage.written(spark, build, str(tmp_path / "out"))
    assert out.count() == 7 and left() == before

    def failing():
        storage.stored(spark.range(3))
        assert left() != before
        raise RuntimeError("half way")

    with pytest.raises(RuntimeError):
        storage.written(spark, failing, str(tmp_path / "none"))
    assert left() == before
    with storage.scratch(spark) as outer:
        storage.stored(spark.range(2))
        with storage.scratch(spark) as inner:
            storage.stored(spark.range(2))
        assert inner != outer and os.path.isdir(outer.removeprefix("file:")) and not os.path.exists(inner.removeprefix("file:"))
    assert left() == before
