"""Interval joins and order statistics against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import intervals as I
from weft.operators import pairing as P
from weft.operators import quantiles as Q
from weft.operators import stats as S

SPAN = "k long, lo long, hi long, name string"


def plain_join(a, b, keyed=True):
    met = lambda x, y: None not in (x[1], x[2], y[1], y[2]) and x[1] < y[2] and y[1] < x[2] and (not keyed or (x[0] == y[0] and x[0] is not None))
    return sorted((x[3], y[3]) for x in a for y in b if met(x, y))


def spans(n, seed, widest, keys=3, reach=400):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        lo = draw.randint(-reach, reach)
        out.append((draw.randint(0, keys - 1), lo, lo + draw.choice([0, 1, 2, 5, draw.randint(0, widest)]), f"{seed}-{i}"))
    return out


@pytest.mark.parametrize(("widest", "most"), [(8, 50_000), (3000, 50_000), (3000, 7)])
def test_interval_join_finds_the_pairs_of_all_pairs(spark, widest, most):
    odd = [(0, None, 5, "n"), (None, 0, 9, "k"), (1, 10, 3, "back"), (1, 4, 4, "empty"), (2, -(2**40), 2**40, "whole"), (2, 5, 6, "one")]
    a, b = spans(150, 1, widest) + odd, spans(120, 2, widest) + [(k, lo, hi, f"b{n}") for k, lo, hi, n in odd]
    left, right = spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN)
    got = I.interval_join(left, right, ["k"], most_in_bin=most).select("name", "name_b").collect()
    assert sorted(map(tuple, got)) == plain_join(a, b)
    got = I.interval_join(left.drop("k"), right.drop("k"), most_in_bin=most).select("name", "name_b").collect()
    assert sorted(map(tuple, got)) == plain_join(a, b, keyed=False)


def test_interval_join_of_a_hot_bin_is_dealt_over_cells(spark):
    a = [(0, 10, 12, f"a{i}") for i in range(60)] + [(0, 10, 12, "same")] * 3
    b = [(0, 11, 13, f"b{i}") for i in range(40)]
    df = I.interval_join(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["k"], most_in_bin=10)
    assert sorted(map(tuple, df.select("name", "name_b").collect())) == plain_join(a, b)
    plan = df._jdf.queryExecution().toString()
    assert "__pac" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_interval_join_of_empty_tables(spark):
    none = spark.createDataFrame([], SPAN)
    some = spark.createDataFrame([(0, 1, 2, "x")], SPAN)
    for x, y in ((none, some), (some, none), (none, none)):
        assert I.interval_join(x, y, ["k"]).count() == 0


def test_marks_have_their_tokens_and_what_follows(spark):
    text = "one <gap> two\nthree <gap>"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    tokens = P.token_spans(docs, "doc_id", "text")
    assert [(r.token, r.lo, r.hi) for r in tokens.orderBy("token_idx").collect()] == [("one", 0, 3), (" <gap>", 3, 9), (" two", 9, 13), ("\nthree", 13, 19), (" <gap>", 19, 25)]
    marks = spark.createDataFrame([(1, 0, 4, 9), (1, 1, 20, 25), (1, 2, 90, 95)], "doc_id long, mark int, lo long, hi long")
    got = {r.mark: (r.first_token, r.last_token, r.n_tokens, r.after_first, r.after_n) for r in I.marked_tokens(tokens, marks, ["doc_id"], "mark", 2).collect()}
    assert got == {0: (1, 1, 1, 2, 2), 1: (4, 4, 1, None, 0)}
    assert {r.doc_id: r.tiled for r in I.tiles_text(tokens, docs, ["doc_id"], "text").collect()} == {1: True, 2: True, 3: True}
    broken = tokens.withColumn("lo", F.when(F.col("token_idx") == 2, F.col("lo") + 1).otherwise(F.col("lo")))
    assert {r.doc_id: r.tiled for r in I.tiles_text(broken, docs, ["doc_id"], "text").collect()}[1] is False
    assert {r.doc_id: r.tiled for r in I.tiles_text(tokens.where("token_idx < 4"), docs, ["doc_id"], "text").collect()}[1] is False


@pytest.mark.parametrize("few", [4096, 3])
def test_order_statistics_of_odd_numbers(spark, few, monkeypatch):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "CUTS", 5)
    draw = random.Random(few)
    values = {
        "even": [draw.uniform(-3, 3) for _ in range(400)], "whole": [float(draw.randint(0, 9)) for _ in range(300)], "wide": [10.0 ** draw.randint(-300, 300) * draw.choice([1, -1]) for _ in range(100)],
        "same": [2.5] * 50, "one": [-0.0], "tiny": [5e-324, 0.0, 1e-323, -5e-324], "close": [1.0 + k * 2.0**-52 for k in range(40)], None: [1.0, 2.0, 3.0],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("even", math.nan), ("even", math.inf), ("even", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    n = F.col("n")
    ranks = {"first": F.lit(0), "third": F.floor(n / 3), "last": n - 1, "beyond": n}
    got = {r.g: (r.n, r["first"], r.third, r["last"], r.beyond) for r in Q.order_statistics(df, F.col("v"), ["g"], ranks).collect()}
    want = {k: (len(vs), sorted(vs)[0], sorted(vs)[len(vs) // 3], sorted(vs)[-1], None) for k, vs in values.items()}
    assert got == want


def test_quantiles_are_numpys_without_a_window_over_a_group(spark):
    draw = np.random.default_rng(5)
    v = np.concatenate([draw.lognormal(size=3000), np.full(2000, 1.0)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    parts = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "all": 1.0}
    row = Q.quantiles(df, F.col("v"), [], parts).first()
    assert [row[c] for c in parts] == pytest.approx([np.quantile(v, q) for q in parts.values()])
    profile = Q.summarised(df.withColumn("g", F.lit(1)), F.col("v"), ["g"], parts).first()
    assert (profile.n, profile.low, profile.high) == (5000, v.min(), v.max()) and profile.sd == pytest.approx(v.std(ddof=1))


def test_spearman_equals_ranks_of_a_plain_sort(spark):
    draw = random.Random(3)
    rows = [(g, draw.randint(0, 9), draw.randint(0, 5), i) for g in ("a", "b") for i in range(200)] + [("few", 1, 1, 0), ("flat", 1, 1, 0), ("flat", 1, 2, 1), ("flat", 1, 3, 2), ("flat", 1, 4, 3), ("flat", 1, 5, 4)]
    got = {r.g: r.rho for r in S.spearman(spark.createDataFrame(rows, "g string, x int, y int, i int"), "x", "y", ["g"], "i").collect()}
    for g in ("a", "b"):
        own = [r for r in rows if r[0] == g]
        rank = lambda c: {r[3]: k for k, r in enumerate(sorted(own, key=lambda r: (r[c], r[3])))}
        x, y = rank(1), rank(2)
        assert got[g] == pytest.approx(np.corrcoef([x[r[3]] for r in own], [y[r[3]] for r in own])[0, 1], abs=1e-6)
    assert got["few"] is None and got["flat"] is None


def plain_times(key, b, seed):
    import hashlib

    digest = hashlib.sha256(f"{seed}|{b // 16}|{key}".encode()).digest()
    u = int.from_bytes(digest[2 * (b % 16) : 2 * (b % 16) + 2], "big") / 65536
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return sum(u >= s for s in steps)


def test_replicates_are_summed_row_by_row(spark):
    rows = [("x" if i % 3 else None, str(i), i % 5, i % 7) for i in range(60)] + [("x", "60", None, 2)]
    df = spark.createDataFrame(rows, "lane string, row string, hits long, tokens long").repartition(5)
    got = {r.lane: (r.hits, r.tokens) for r in S.replicate_sums(df, "row", ["lane"], ["hits", "tokens"], 20, 9).collect()}
    for lane in ("x", None):
        own = [r for r in rows if r[0] == lane]
        assert got[lane] == tuple([float(sum(plain_times(r[1], b, 9) * (r[c] or 0) for r in own)) for b in range(20)] for c in (2, 3))
    times = S.poisson_times([str(k) for k in range(4000)], 24, 3)
    assert times.shape == (4000, 24) and abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.03
