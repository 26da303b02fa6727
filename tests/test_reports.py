"""Reports with intervals and decisions on small tables whose answers are known."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weft.operators import pairing as P
from weft.plans import reports as R

SCORES = "lane string, row int, pos int, char_off int, a_c int, b_c int, p_c int"


def score_rows(lane, n, length, right):
    """Rows whose first `right` tokens are read aligned only, later ones neither way."""
    return [(lane, i, p, p * 4, int(p < right), 0, 0) for i in range(n) for p in range(length)]


def test_ladder_knows_where_reading_ends(spark):
    rows = score_rows("dense", 40, 20, 5) + score_rows("thin", 40, 20, 15) + score_rows("blind", 40, 20, 0)
    df = spark.createDataFrame(rows, SCORES)
    density = spark.createDataFrame([("thin", 1.0), ("dense", 2.0), ("blind", 3.0)], "lane string, density double")
    got = {r.lane: r for r in R.ladder_report(df, "lane", density, 4, 30, 8, 5, 40).collect()}
    assert (got["dense"].k_chars, got["thin"].k_chars) == (20, 60)
    assert (got["dense"].k_low, got["dense"].k_high, got["dense"].n_resolved) == (20.0, 20.0, 40)
    assert got["dense"].no_later is True and got["thin"].no_later is None
    assert (got["blind"].status, got["blind"].k_chars, got["blind"].n_resolved, got["blind"].p) == ("no_reading", None, 0, None)
    assert (got["dense"].more, got["dense"].less, got["dense"].tied) == (40, 0, 0) and got["dense"].p == pytest.approx(2 / 2**40)


def test_decay_counts_rows_not_tokens(spark):
    df = spark.createDataFrame(score_rows("x", 10, 6, 3) + [("x", 99, p, p, 0, 1, 1) for p in range(3)], SCORES)
    got = {r.lo: r for r in R.decay_report(df, ["lane"], limit=4).collect()}
    assert got[0].n_rows == 11 and got[0].gain_pts == pytest.approx(100 * 9 / 11, abs=1e-5) and got[0].permuted_pts == got[0].gain_pts
    assert got[0].se_pts == pytest.approx(100 * (0.3636364**0.5) / 11**0.5, rel=1e-4)
    assert got[4].gain_pts == 0 and got[4].se_pts == 0 and (got[4].rows_all, got[4].rows_cut) == (11, 10)
    assert got[0].d50_lo == 2 and got[0].underpowered


def test_decisions_need_the_whole_interval(spark):
    seen = [("a", "span", i, 1) for i in range(60)] + [("a", "seen", i, i % 2) for i in range(60)] + [("a", "moved", i, 0) for i in range(60)] + [("b", "span", 0, 1), ("b", "span", 1, None)]
    seen += [("c", "span", i, 0) for i in range(30)]
    df = spark.createDataFrame(seen, "lane string, check string, row int, hit int")
    bars = {"span": (R.AT_LEAST, 0.6), "seen": (R.AT_LEAST, 0.5), "moved": (R.AT_MOST, 0.1)}
    checks = R.rated_checks(df, ["lane"], bars, n_boot=200)
    got = {(r.lane, r.check): r for r in checks.collect()}
    assert len(got) == 9
    assert {k: r.decision for k, r in got.items() if k[0] == "a"} == {("a", "span"): "PASS", ("a", "seen"): "UNDECIDABLE", ("a", "moved"): "PASS"}
    assert got["a", "seen"].ci_low < 0.5 < got["a", "seen"].ci_high and got["a", "seen"].n == 60
    assert (got["b", "span"].n_rows, got["b", "span"].rate, got["b", "span"].ci_low, got["b", "span"].decision) == (1, 1.0, None, "UNDECIDABLE")
    assert (got["b", "moved"].n, got["b", "moved"].rate, got["b", "moved"].decision) == (0, None, "UNDECIDABLE")
    assert got["c", "span"].decision == "FAIL"
    told = {r.lane: r.verdict for r in R.checks_verdict(checks, ["lane"]).collect()}
    assert told == {"a": "UNDECIDABLE", "b": "UNDECIDABLE", "c": "FAIL"}
    assert {r.lane: r.verdict for r in R.checks_verdict(checks.where("check <> 'seen'"), ["lane"], (F.col("check") == "span") & (F.col("n") < 2)).collect()} == {"a": "PASS", "b": "VOID", "c": "FAIL"}


def test_donors_of_groups(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 7), (None, 4), (None, 9)], "g string, k int")
    assert {(r.g, r.k): r.donor for r in P.group_donor(df, "g", "k").collect()} == {("a", 1): 2, ("a", 2): 3, ("a", 3): 1, ("b", 7): None, (None, 4): 9, (None, 9): 4}
