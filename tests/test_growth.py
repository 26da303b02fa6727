"""What keeps the cost of a query from growing faster than its input."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weft.functions import sound
from weft.functions import text as X
from weft.functions.tokenizers import Characters, token_count_and_prefix
from weft.operators import audit, intervals, layout
from weft.operators import stats as S
from weft.plans import QUERIES
from weft.plans import evaluate as E
from weft.plans import reports as R


def test_page_fidelity_deals_its_rows(spark, sf_dir):
    assert QUERIES["page_fidelity"](spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_overlapping_frames_add_up():
    draw = np.random.default_rng(3)
    for n, size, hop in ((1, 400, 160), (7, 400, 160), (9, 64, 64), (5, 10, 16), (6, 12, 5)):
        frames, want = draw.random((n, size)), np.zeros((n - 1) * hop + size)
        np.add.at(want, (np.arange(n) * hop)[:, None] + np.arange(size), frames)
        assert np.array_equal(sound._added(frames, hop), want)


def test_rated_checks_reads_its_observations_once(spark):
    seen = spark.range(200).selectExpr("'a' as lane", "'span' as check", "id % 40 as row", "cast(id % 2 as int) as hit")
    found = R.rated_checks(seen, ["lane"], {"span": (R.AT_LEAST, 0.1)}, n_boot=50)
    assert "Range (" not in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert [(r.n, r.n_rows, r.rate, r.decision) for r in found.collect()] == [(200, 40, 0.5, "PASS")]


def test_sums_of_many_groups_are_those_of_each(spark):
    rows = [(g, k, float((g * k) % 7), 1.0) for g in range(70) for k in range(12)] + [(None, 3, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, row long, a double, b double").repartition(2, "row")
    got = {r.g: (r.a, r.b) for r in S.replicate_sums(df, "row", ["g"], ["a", "b"], 20, 5).collect()}
    times = S.poisson_times([str(k) for k in range(12)], 20, 5).astype(float)
    assert len(got) == 71 and list(got[None][0]) == list(2 * times[3])
    for g in range(70):
        assert list(got[g][0]) == list(np.array([(g * k) % 7 for k in range(12)]) @ times) and list(got[g][1]) == list(times.sum(0))


def test_bootstraps_deal_rows_by_key_over_several_tasks_for_each_core(spark):
    rows = spark.range(60).selectExpr("id % 3 as g", "id % 20 as row", "1.0D as a").repartition(3, "g")
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert re.search(rf"hashpartitioning\(row#\d+L?, {tasks}\), REPARTITION_BY_NUM", plan_of(spark, S.replicate_sums(rows, "row", ["g"], ["a"], 20, 5)))


def test_bootstraps_of_fractions_and_large_numbers(spark):
    draw = np.random.default_rng(4)
    values = [[float(x) for x in draw.random(30)], [float(x) for x in draw.integers(1 << 40, 1 << 41, 30)]]
    df = spark.createDataFrame([(k, values[0][k], values[1][k]) for k in range(30)], "row long, a double, b double")
    got, times = S.replicate_sums(df, "row", [], ["a", "b"], 40, 5).first(), S.poisson_times([str(k) for k in range(30)], 40, 5).astype(float)
    for have, each in zip((got.a, got.b), values, strict=True):
        np.testing.assert_allclose(have, np.array(each) @ times, rtol=1e-14)


def test_scores_of_a_row_need_one_exchange(spark, sf_dir):
    from weft.plans.stat_queries import scores

    assert plan_of(spark, scores(spark, sf_dir).groupBy("lane", "row").agg(F.max("pos"))).count("Exchange") == 1


def test_shipments_meet_as_different_spans(spark, sf_dir, monkeypatch):
    met = []
    join = intervals.interval_join
    monkeypatch.setattr(intervals, "interval_join", lambda a, b, by: met.append((a, b)) or join(a, b, by))
    QUERIES["shipments_around"](spark, sf_dir)
    (a, b), span = met[0], ["k", "lo", "hi"]
    assert a.count() == a.select(*span).distinct().count() and b.count() == b.select(*span).distinct().count()


def test_masked_rows_are_handed_on_in_small_frames(spark, monkeypatch):
    caught = []

    class Frame:
        schema = spark.createDataFrame([("a", "b c")], "k string, t string").schema

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            caught.append(run)

    layout.masked(Frame(), "k", "t", 5)
    texts = pd.DataFrame({"k": [str(k) for k in range(40)], "t": ["word " * 40_000] * 39 + [None]})
    frames = list(caught[0](iter([texts])))
    assert len(frames) >= 7 and [k for f in frames for k in f["k"]] == texts["k"].tolist()


def test_one_encoding_gives_length_and_prefix(spark, sf_dir):
    df = spark.createDataFrame([(1, "abcdef"), (2, ""), (3, None), (4, "abc")], "k int, t string")
    got = df.select("k", token_count_and_prefix(F.col("t"), Characters(), 3).alias("x")).select("k", "x.*").orderBy("k").collect()
    assert [(r.n, r.prefix) for r in got] == [(6, "abc"), (0, ""), (None, None), (3, "abc")]
    plan = QUERIES["bpe_lengths"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(text") == 1


def test_poison_hashes_in_one_pass(spark):
    df = spark.createDataFrame([("x1", "Grüße, 12 Wörter! 𝒜b"), ("x2", None), (None, "abc def")], "k string, t string")
    out, places = X.poisoned(F.col("t"), 0.5, F.lit(4), F.col("k"))
    found = df.select("k", "t", out.alias("o"), places.alias("p"))
    assert "regexp" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()).lower() and "RLIKE" not in plan
    for r in found.collect():
        key, text = "|".join(x for x in ("4", r.k) if x is not None), r.t or ""
        number = lambda *x: int(hashlib.md5("|".join((key, *x)).encode()).hexdigest()[:8], 16) / 2**32
        hits = [i for i, c in enumerate(text) if c.isalpha() and number(str(i + 1)) < 0.5]
        assert r.p == hits and r.o == "".join(chr(97 + int(number("letter", str(i + 1)) * 26)) if i in hits else c for i, c in enumerate(text))


def plan_of(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_tokens_meet_blocks_of_marks(spark):
    spans = [(0, 0, 10), (1, 10, 64), (2, 64, 128), (3, 60, 300), (4, 130, 130), (5, -70, -3), (6, None, 5), (0, 0, 10)]
    tokens = spark.createDataFrame([(row, *s) for row in (1, 2, None) for s in spans], "row int, pos int, lo int, hi int")
    at = [-64, -5, -4, 3, 3, 63, *range(64, 128), 128, 299, 300]
    found = audit.token_exposure(tokens, spark.createDataFrame([(1, c) for c in at] + [(None, 3)], "row int, char_idx int"), "row")
    inside = lambda lo, hi: len({c for c in at if lo <= c < hi}) if lo is not None else 0
    want = []
    for row in (1, 2, None):
        for pos, lo, hi in spans:
            n = (row == 1) * inside(lo, hi) * (2 if pos == 0 else 1)  # rows of one token are counted together
            want.append((row or 0, pos, n, n > 0, pos == 2 and row == 1))
    assert plan_of(spark, found).count("Join") == 1
    assert sorted((r.row or 0, r.pos, r.n_marked, r.touching, r.pure) for r in found.collect()) == sorted(want)


def test_exposed_scores_are_not_joined_again(spark, sf_dir):
    plan = plan_of(spark, QUERIES["exposed_delta"](spark, sf_dir))
    assert (plan.count("Join"), plan.count("+- Window ")) == (1, 1)
    assert plan_of(spark, QUERIES["exposure_by_bin"](spark, sf_dir)).count("+- Window ") == 1


def test_boxes_are_made_text_by_text(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(layout, "_LETTERS", 40)
    page = layout.Page(width=120, height=100)
    texts = ["one two  three\n\nfour", "\n \n", "", None, "a\t b  \tc " * 9, "é\U0001f600" * 30 + " end", "x" * 40 + "\t y", "last"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(9, "same key twice " * 5), (None, "no key"), (10, " lead")]
    df = spark.createDataFrame(rows, "doc long, t string").coalesce(1)
    for repeated in (df, df.union(spark.createDataFrame([(9, "again\nand again\n\n")], df.schema))):
        got = [tuple(r) for r in layout.text_boxes(repeated, "doc", "t", page).collect()]
        want = layout.word_boxes(layout.wrapped(repeated, "doc", "t", page), "doc", page)
        assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in want.collect()) and len(got) > 40
    assert layout.text_boxes(df, "doc", "t", page).dtypes == want.dtypes
    assert not any(x in plan_of(spark, QUERIES["word_boxes"](spark, sf_dir)) for x in ("Window", "Exchange", "Sort"))


def test_only_documents_with_marks_are_cut_into_tokens(spark, sf_dir):
    scans = [x for x in plan_of(spark, QUERIES["interval_tokens"](spark, sf_dir)).splitlines() if "FileScan" in x]
    assert scans and all("StringContains(text,@)" in x for x in scans)


def test_variants_stay_side_by_side(spark, sf_dir):
    for name in ("grounding_ablation", "prefix_ablation"):
        plan = plan_of(spark, QUERIES[name](spark, sf_dir))
        assert "Generate" not in plan and plan.count("Exchange") == 2


def test_wide_and_long_scores_have_one_ablation(spark):
    rows = [("a", k, k * 0.5 if k % 5 else None, k + 1.0 if k % 3 else None, 2.0 * k if k % 4 else None) for k in range(40)] + [("b", 1, None, 1.0, 2.0)]
    wide = spark.createDataFrame(rows, "s string, k int, aligned double, permuted double, blank double")
    long = wide.selectExpr("s", "k", "stack(3, 'aligned', aligned, 'permuted', permuted, 'blank', blank) as (variant, score)")
    assert E.ablation_of_wide(wide, ["s"]).collect() == E.ablation(long, "k", ["s"]).collect()
