"""Text functions, statistics and plans on fixed cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import decisions as D
from weft.functions import media
from weft.functions import text as X
from weft.functions.determinism import shuffled
from weft.operators import conversation as C
from weft.operators import layout as L
from weft.operators import mixture as M
from weft.operators import series as R
from weft.operators import stats as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


WER_CASES = [("hello world", "hello world", 0.0), ("", "", 0.0), ("", "hello", 0.0), ("hello world", "", 1.0), ("hello world", "hello there", 0.5), ("hello world", "hello beautiful world", 0.5), ("hello world", "hello", 0.5), ("hello world", "foo bar", 1.0)]


def test_word_error_rates(spark):
    df = spark.createDataFrame(WER_CASES, "r string, h string, want double")
    for r in df.select("want", X.wer(F.col("r"), F.col("h")).alias("got")).collect():
        assert r.got == r.want
    assert one(spark, X.wer(F.lit(""), F.lit("x"), "lower"), X.wer(F.lit(""), F.lit(""), "lower"), X.wer(F.lit("Ab-c"), F.lit("ab c"), "letters")) == (1.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        X.wer(F.lit("a"), F.lit("b"), "other")


def test_other_metrics(spark):
    lit = F.lit
    assert one(spark, X.cer(lit("hello"), lit("hollo")), X.cer(lit(""), lit("a")), X.cer(lit("abc"), lit("")), X.cer(lit("hi"), lit("hi!"))) == (0.2, 0.0, 1.0, 0.5)
    assert one(spark, X.rouge_l(lit(""), lit("")), X.rouge_l(lit(""), lit("a")), X.rouge_l(lit("a b"), lit("c d")), X.rouge_l(lit("hello world"), lit("hello world"))) == (1.0, 0.0, 0.0, 1.0)
    assert one(spark, X.rouge_l(lit("the cat sat"), lit("cat the sat")))[0] == pytest.approx(2 / 3)
    for text, want in (("A", "A"), ("a", None), ("  B", "B"), ("", None), ("\t\n", None), ("C something", "C"), ("E", None), ("A\n", "A")):
        assert one(spark, X.strict_letter(lit(text))) == (want,)
    assert one(spark, X.retention(lit(0.6), lit(0.8)), X.retention(lit(0.3), lit(0.1), False), X.retention(lit(0.0), lit(0.1), False), X.retention(lit(None), lit(0.1)), X.retention(lit(0.8), lit(0.0))) == (pytest.approx(75), pytest.approx(100 / 3), None, None, None)


def test_conversation_schemas(spark):
    chat = spark.createDataFrame([([("system", "s"), ("human", "q"), ("gpt", "a")],), ([("gpt", "a"), ("human", "q")],)], "conversations array<struct<from:string,value:string>>")
    good, bad = C.instruction_pairs(chat)
    assert [(r.instruction, r.response) for r in good.collect()] == [("q", "a")] and bad.count() == 1
    with pytest.raises(C.AdapterError):
        C.instruction_pairs(chat, "fail")
    direct = spark.createDataFrame([("p", "o")], "prompt string, output string")
    assert [(r.instruction, r.response) for r in C.instruction_pairs(direct)[0].collect()] == [("p", "o")]
    with pytest.raises(C.AdapterError):
        C.instruction_pairs(spark.createDataFrame([("p",)], "prompt string"))


def test_choices(spark):
    lit = F.lit
    assert one(spark, X.answer_letter(lit(2), lit("x")), X.answer_letter(lit(None).cast("int"), lit(" b) yes")), X.answer_letter(lit(9), lit("zzz")), X.answer_letter(lit(None).cast("int"), lit(None).cast("string"))) == ("C", "B", "zzz", "")
    assert one(spark, X.question_text(lit("why"), F.array(lit("x"), lit("y")))) == ("Question: why\n\nA) x\nB) y",)
    assert one(spark, X.modality(lit("AV"), lit(False), lit(False)), X.modality(lit(""), lit(True), lit(True)), X.modality(lit("Video"), lit(True), lit(True))) == ("audio-visual", "audio-visual", "visual")
    assert one(spark, X.fixed_frames(F.array(lit(1), lit(2)), 4), X.fixed_frames(F.array(lit(1), lit(2)), 1)) == ([1, 2, 2, 2], [1])
    rows = C.choice_rows(spark.createDataFrame([("q", "x", "", "b")], "question string, option_a string, option_b string, answer string"), "quiz", "train", F.lit(0)).collect()
    assert rows[0].row_id == "0" and rows[0].messages[1].content[0].text == "B"


def test_row_ids_and_lengths(spark):
    df = spark.createDataFrame([("7", "ab", None), ("", "abc", -1), (None, "d", 9)], "id string, target_text string, original_token_length long").withColumn("messages", F.array(C.message("assistant", F.lit("zz"))))
    assert [r.x for r in df.select(C.row_id(df, F.lit(5), "id").alias("x")).collect()] == ["7", "5", "5"]
    assert [r.original_token_length for r in C.fill_token_length(df).collect()] == [2, 3, 9]
    assert one(spark, X.truncate_tokens(F.lit("abcdef"), 3), X.truncate_tokens(F.lit("a  b c"), 2, "whitespace"), X.truncate_tokens(F.lit("a  b"), 2, "whitespace")) == ("abc", "a b", "a  b")
    with pytest.raises(ValueError):
        X.truncate_tokens(F.lit("a"), 0)


def test_schema_errors(spark):
    kind = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"
    part = lambda t="text": [(t, "x")]
    cases = [([("user", part()), ("assistant", part())], []), ([("assistant", part()), ("user", part())], ["first role assistant", "last role user"]), ([("user", part("image")), ("assistant", part())], ["image count"]), ([("user", part())], ["fewer than 2 messages"]), (None, ["fewer than 2 messages"]), ([("user", part("audio")), ("tool", part()), ("assistant", part())], ["unexpected role", "invalid content type"])]
    df = spark.createDataFrame([(m,) for m, _ in cases], f"messages {kind}")
    assert [r.e for r in df.select(C.schema_errors(F.col("messages"), F.array().cast("array<string>")).alias("e")).collect()] == [e for _, e in cases]


def test_budget_and_limits(spark):
    rows = [(k, n, ["i"] * i) for k, (n, i) in enumerate(zip([100, 8000, 7000, 100, -1], [1, 1, 4, 0, 10], strict=True))]
    df = spark.createDataFrame(rows, "k int, original_token_length long, images array<string>")
    assert [r.k for r in M.token_budget(df, 8192, 282).collect()] == [0, 3, 4]
    assert M.token_budget(df, None, 282).count() == 5 and M.image_limit(df, None).count() == 5
    assert [r.k for r in M.image_limit(df, 3).collect()] == [0, 1, 3]
    for bad in (lambda: M.image_limit(df, -1), lambda: M.image_limit(df.drop("images"), 1), lambda: M.bounded_sample(df, 0, 1, "k"), lambda: M.union_all(), lambda: M.union_all(df, df.drop("k")), lambda: M.split(df, 1.5, 1, "k")):
        with pytest.raises(M.MixtureError):
            bad()


def test_seeded_orders(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    order = lambda d, seed: [r.k for r in shuffled(d, seed, "k").orderBy("ordinal").collect()]
    first = order(df, 1)
    assert first == order(df.repartition(7), 1) and first != order(df, 2) and sorted(first) == list(range(200))
    parts = M.split(df, 0.9, 42, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 180, "validation": 20}
    assert M.take_slice(df, ["k"], 5, 0).count() == 0 and [r.k for r in M.take_slice(df, ["k"], 198).orderBy("k").collect()] == [198, 199]


def test_token_share_plan(spark):
    lanes = spark.createDataFrame([("a", 0.5, 10.0, 10_000), ("b", 0.5, 30.0, 100)], "lane string, share double, mean double, there long")
    got = {r.lane: (r.planned, r.rows, r.clamped) for r in M.token_share_plan(lanes, 1000, "share", "mean", "there").collect()}
    assert got == {"a": (750, 750, False), "b": (250, 100, True)}


def test_greedy_pack(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate([5, 4, 3, 9, 11, 1])], "k int, n int")
    got = [(r.k, r["pack"], r.segment, r.start) for r in M.greedy_pack(df, "n", 10, "k", shards=1).orderBy("k").collect()]
    assert got == [(0, 0, 0, 0), (1, 0, 1, 5), (2, 1, 0, 0), (3, 2, 0, 0), (5, 2, 1, 9)]


def test_collapse_statuses(spark):
    gain = lambda b: 1.0 if b < 8 else 0.1
    cases = {
        "ok": [(b, gain(b) * 100, 100) for b in range(16)], "floor": [(b, (1.0 if b < 4 else 0.1) * 100, 100) for b in range(10)], "short": [(b, 100.0, 100) for b in range(3)], "right": [(b, 100.0, 100) for b in range(9)],
        "none": [(0, 1.0, 1), (9, 1.0, 100)], "blind": [(b, -5.0, 100) for b in range(9)],
    }
    df = spark.createDataFrame([(k, *r) for k, rows in cases.items() for r in rows], "rung string, bucket int, sum_d double, cnt long")
    got = {r.rung: (r.status, r.k_chars, r.k_lower_bound) for r in S.collapse_point(df, ["rung"], 25, 100, 10).collect()}
    assert got == {"ok": ("ok", 200, None), "floor": ("ok_at_structural_floor", 100, None), "short": ("censored_short", None, 75), "right": ("censored_right", None, 225), "none": ("no_baseline_tokens", None, None), "blind": ("no_reading", None, None)}


def test_sign_test_and_alarms(spark):
    df = spark.createDataFrame([(8, 2), (0, 0), (5, 5), (4000, 3900)], "a long, b long")
    p = [r.p for r in df.select(S.sign_test_p("a", "b").alias("p")).collect()]
    assert p[0] == pytest.approx(0.109375) and p[1] is None and p[2] == 1.0 and p[3] == pytest.approx(0.2654, abs=1e-3)
    series = spark.createDataFrame([(n, k, v) for n, vs in {"low": [0.04, 0.03, 0.02], "mixed": [0.04, 0.06, 0.04], "two": [0.01, 0.01]}.items() for k, v in enumerate(vs)], "lane string, idx int, value double")
    assert {r.lane: r.alarm for r in R.alarm(series, "lane", "idx", "value", 0.05, 3).collect()} == {"low": True, "mixed": False, "two": False}


def test_bootstrap_intervals_hold_the_rate(spark):
    rows = spark.range(400).select(F.lit("x").alias("lane"), F.col("id").alias("row"), (F.col("id") % 4 == 0).cast("int").alias("hits"), F.lit(1).alias("tokens"))
    r = S.bootstrap_rate(rows, "hits", "tokens", ["lane"], 100).first()
    assert r.rate == 0.25 and 0.19 < r.ci_low < 0.25 < r.ci_high < 0.31
    again = S.bootstrap_rate(rows.repartition(5), "hits", "tokens", ["lane"], 100).first()
    assert (again.rate, again.n_rows, again.rate_rowmean, again.ci_low, again.ci_high) == (r.rate, r.n_rows, r.rate_rowmean, r.ci_low, r.ci_high)
    assert again.se_cluster == pytest.approx(r.se_cluster) and r.se_cluster == pytest.approx(0.0217, abs=1e-4)
    one = S.bootstrap_rate(rows.limit(1), "hits", "tokens", ["lane"], 100).first()
    assert (one.n_rows, one.ci_low, one.ci_high, one.se_cluster) == (1, None, None, None)


def test_wrapping():
    page = L.Page(width=140, height=100, advance=10, line_height=20)  # 10 characters, 3 lines
    assert L.wrap("one two three", page) == ["one two", "three"]
    assert L.wrap("abcdefghijklmnopqrstu v", page) == ["abcdefghij", "klmnopqrst", "u v"]
    assert L.wrap("a\n\nb", page) == ["a", "", "b"] and L.wrap("", page) == [""]
    assert L.visible_prefix(["a", "", "b", "", ""], page, 1) == ["a", "", "b"]


def test_masks(spark):
    spec = L.MaskSpec()
    words = [f"w{k}" for k in range(60)]
    runs = L.mask_runs(L.keyed_random(1, "a"), 60, spec)
    assert runs == L.mask_runs(L.keyed_random(1, "a"), 60, spec) != L.mask_runs(L.keyed_random(2, "a"), 60, spec)
    assert all(b[0] > a[0] + a[1] for a, b in zip(runs, runs[1:], strict=False))
    made = L.mask_target(words, runs, spec)
    assert made["target"].split().count(spec.sentinel) == len(runs) and len(made["visible"]) + len(made["masked"]) == 60
    assert all(made["target"][s:].startswith(spec.sentinel) for s in made["sentinel_starts"])
    df = L.masked(spark.createDataFrame([(1, " ".join(words)), (2, None)], "k long, t string"), "k", "t", 1, spec)
    assert all(not r.problems for r in L.sentinel_problems(df, spec.sentinel).collect())
    broken = df.withColumn("sentinel_starts", F.transform("sentinel_starts", lambda s: s + 1))
    assert any(r.problems for r in L.sentinel_problems(broken, spec.sentinel).collect())


def test_pictures_and_sound():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (20, 33), dtype=np.uint8)
    assert (media.read_png(media.png(image)) == image).all()
    assert media.fill_rects(image, [(2, 3, 5, 6), (4, 4, 4, 9)])[3:6, 2:5].sum() == 0
    assert len(media.tiles(image)) == 2 and media.patches(image, 4).shape == (40, 16)
    assert media.resize_width(image, 33) is image and media.resize_width(image, 66).shape == (20, 66)
    tone = np.sin(2 * np.pi * 440 * np.arange(32_000) / 16_000).astype(np.float32)
    values = media.log_mel(tone)
    assert values.shape == (80, 200) and 0 <= values.min() and values.max() <= 1
    assert values[np.argmax(media.mel_matrix()[:, 11]), 100] == values[:, 100].max() > values[60, 100]
    assert [p.shape for p in media.log_mel_pages(tone, 1.5)] == [(80, 150)] * 2
    with pytest.raises(ValueError):
        media.log_mel_pages(tone, 0.5, 2)
    with pytest.raises(ValueError):
        media.mono(np.zeros((2, 2)))
    assert media.centre(np.arange(10), 4).tolist() == [3, 4, 5, 6] and media.centre(np.ones(2), 5).tolist() == [0, 1, 1, 0, 0]
    assert media.fidelity(tone, tone)["snr_db"] == float("inf")


def test_planning(spark):
    assert D.critical_width(160, 560, 60) == min(w for w in range(1, 3000) if max(1, int(w * (560 * 2304 / (160 * w)) ** 0.5 // 48)) >= 60)
    assert one(spark, D.first_match([(F.lit(False), "a"), (F.lit(True), "b")], "c"), S.ci_decision(F.lit(0.6), F.lit(0.7), 0.5), S.ci_decision(F.lit(0.4), F.lit(0.7), 0.5)) == ("b", "PASS", "UNDECIDABLE")
