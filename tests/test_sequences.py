"""Ids, labels, positions, drops and occupancy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import media
from weft.functions.tokenizers import Characters
from weft.operators import pairing as P
from weft.operators import sequences as Z

MESSAGES = "messages array<struct<role:string,content:array<struct<type:string,text:string>>>>, soft array<int>"


def test_only_what_the_assistant_says_is_learned(spark):
    said = [("user", [("image", None), ("text", "hi")]), ("assistant", [("text", "yo"), ("text", None)])]
    df = spark.createDataFrame([(said, [3]), (None, [])], MESSAGES)
    full, empty = Z.labelled_ids(df, Characters(), 7, soft_counts=F.col("soft")).collect()
    text = "<|im_start|>user\n" + "\x07" * 3 + "hi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert full.input_ids == [ord(c) for c in text]
    learned = len("yo<|im_end|>\n")
    assert full.labels == [-100] * (len(text) - learned) + [ord(c) for c in text[-learned:]] and full.learned == learned
    assert (empty.input_ids, empty.labels, empty.learned) == ([], [], 0)
    whole = Z.labelled_ids(df, Characters(), 7, soft_counts=F.col("soft"), responses_only=False).first()
    assert whole.labels == whole.input_ids
    for soft in ([], [1, 1]):
        with pytest.raises(Exception, match="image"):
            Z.labelled_ids(spark.createDataFrame([(said, soft)], MESSAGES), Characters(), 7, soft_counts=F.col("soft")).collect()


def test_positions_restart(spark):
    rows = spark.createDataFrame([(0, 1, 2), (0, 0, 3), (1, 0, 4)], "pack long, segment long, n long")
    packs = Z.packed_segments(rows, "n").orderBy("pack")
    got = packs.select("segments", "used", Z.position_ids(F.col("segments"), 8).alias("p"), Z.position_ids(F.col("segments"), 8, restart=False).alias("q")).collect()
    assert [tuple(r) for r in got] == [([3, 2], 5, [0, 1, 2, 0, 1, 0, 0, 0], list(range(8))), ([4], 4, [0, 1, 2, 3, 0, 0, 0, 0], list(range(8)))]


def test_drops_are_counted(spark):
    df, seen = Z.counted_drops(spark.range(10), F.when(F.col("id") > 1, F.col("id") % 3 == 0))
    assert sorted(r.id for r in df.collect()) == [3, 6, 9]
    assert seen.get == {"rows": 10, "kept": 3, "dropped": 7}


def test_donors_with_several_images(spark):
    df = spark.createDataFrame([(["a", "b"], 5), (["a"], 0), ([], 2), (["a", "b", "c"], 2)], "d array<string>, n int")
    assert [r.c for r in df.select(Z.cycled(F.col("d"), F.col("n")).alias("c")).collect()] == [["a", "b", "a", "b", "a"], [], None, ["a", "b"]]
    parts = spark.createDataFrame([([("image", None), ("text", "x")], ["i"])], "p array<struct<type:string,text:string>>, i array<string>")
    assert parts.select(P.merge_placeholders(F.col("p"), F.col("i"), strict=True).alias("m")).first().m[0].image == "i"
    with pytest.raises(Exception, match="1 image parts for 2 images"):
        parts.select(P.merge_placeholders(F.col("p"), F.array(F.lit("i"), F.lit("j")), strict=True).alias("m")).collect()


def test_three_definitions_of_occupancy():
    page = np.full((20, 100), 255, np.uint8)
    page[:, :30] = 200  # a level, without structure
    page[:10, 30:40] = np.random.default_rng(0).integers(0, 255, (10, 10))
    got = media.occupancy(page, 10, 1000.0, 350.0)
    assert (got["cells"], got["floor"]) == (20, 0.0)
    assert got["active_10"] == 7 / 20 and got["structured"] == 1 / 20 and got["over_sound"] == 8 / 20
    assert media.occupancy(page, 10, 1000.0, 0.0)["over_sound"] == 0.0


def test_coverage_of_pages(spark):
    df = spark.createDataFrame([("a", 5000, 1), ("a", 15000, 2), ("a", 0, 0), ("b", 10000, 1)], "lane string, ms int, pages int")
    got = {r.lane: r for r in Z.time_coverage(df, ["lane"], F.col("ms"), F.col("pages"), 10000.0).collect()}
    assert (got["a"].n, got["a"].mean, got["a"].low, got["a"].high, got["a"].median) == (2, 0.625, 0.5, 0.75, 0.625)
    assert got["b"].n == 1 and got["b"].sd is None and got["b"].high == 1.0
