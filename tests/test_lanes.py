"""Lanes made from other tables."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from weft.functions import media
from weft.operators import lanes as N
from weft.operators.conversation import BASE_COLUMNS

from .test_sources import rows


def test_descriptions(spark):
    df = spark.createDataFrame([([(bytearray(b"x"), None)], [("what", "a cat")]), ([], []), ([], [("q", "")])], "images array<struct<bytes:binary,path:string>>, texts array<struct<user:string,assistant:string>>")
    got = N.description_rows(df, "d", "train", F.lit(3)).collect()
    assert len(got) == 1 and got[0].row_id == "3" and [p.type for p in got[0].messages[0].content] == ["image", "text"]


def test_speech_pages(spark):
    tone = np.sin(np.arange(24_000) / 5).astype(float).tolist()
    df = spark.createDataFrame([((tone, 16_000), "hello", "u1"), ((tone * 4, 16_000), "too long", "u2")], "audio struct<array:array<float>,sampling_rate:int>, text string, id string")
    got = N.speech_rows(df, "speech", "train", F.lit(0), "Write down what is said.", 1.0, 2).collect()
    assert [r.row_id for r in got] == ["u1"] and len(got[0].images) == 2
    assert json.loads(got[0].render_config) == {"duration_sec": 1.5, "last_page_padded": True, "page_duration_sec": 1.0, "pages": 2}
    assert [p.type for p in got[0].messages[0].content] == ["image", "image", "text"]
    assert media.read_png(bytes(got[0].images[0].bytes)).shape == (80, 100)
    wide = N.widen_pages(spark.createDataFrame(got, N.C.CANONICAL), 200).first()
    assert media.read_png(bytes(wide.images[1].bytes)).shape == (80, 200) and json.loads(wide.render_config)["canvas_width"] == 200


def test_generated_lanes(spark):
    made, floor = N.random_string_rows(spark, 5, 2, 3, 1)
    assert made.columns == BASE_COLUMNS and made.count() == 5 and floor["floor_supervised"] < floor["floor"]
    again, _ = N.random_string_rows(spark, 5, 2, 3, 1)
    assert made.collect() == again.collect()
    source = rows(spark, 30, "a").withColumn("messages", F.array(N.C.message("user", F.lit("say")), N.C.message("assistant", F.lit("some letters here, 123"))))
    poisoned = N.poisoned_rows(source, "p", 0.5, 3).collect()
    assert all(len(r.messages[1].content[0].text) == 22 and r.messages[1].content[0].text.endswith(", 123") and 0 <= r.poison_rate < 1 for r in poisoned)
    assert len({r.messages[1].content[0].text for r in poisoned}) > 20 and {r.source_row_id for r in poisoned} == {str(k) for k in range(30)}
    words = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(30))) for k in range(5)], "k long, t string")
    assert N.masked_rows(words, "k", "t").where("target = other_target").count() == 0


def test_chat_pieces(spark):
    messages = F.array(N.C.message("user", F.lit("q"), 1), N.C.message("assistant", F.lit("a")))
    got = spark.range(1).select(N.assembled(messages, expand=2).alias("p")).first().p
    assert [(x.text, x.supervised) for x in got] == [("<user>", False), ("[image]", False), ("[image]", False), ("q", False), ("</>", False), ("<assistant>", False), ("a", True), ("</>", True)]


def test_alignment(spark):
    df = spark.createDataFrame([("a", 0, 1.0, True), ("a", 2, 1.0, False), ("a", 4, 2.0, True), ("b", 1, 0.0, True)], "k string, p int, w double, first boolean")
    assert {r.k: r.centroid for r in N.centroids(df, ["k"], "p", "w").collect()} == {"a": 2.5, "b": None}
    assert [r.word_idx for r in N.word_index(df, "k", "p", F.col("first")).orderBy("k", "p").collect()] == [0, 0, 1, 0]
    profile = N.layer_profile(df, "p", "w", (0, 2)).first()
    assert profile.best_layer == 4 and abs(profile.band_mean - 2 / 3) < 1e-9
    assert N.excess(df, df.withColumn("w", F.lit(0.5)), "p", "w").first().excess == 0.5
