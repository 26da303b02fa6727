"""Sequential packs and nearest neighbours against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import neighbours as N
from weft.operators import packing as K


def plain_packs(rows, most):
    out, pack, used, segment = [], 0, 0, 0
    for key, n in sorted(r for r in rows if r[1] and 0 < r[1] <= most):
        if used + n > most:
            pack, used, segment = pack + 1, 0, 0
        out.append((key, n, pack, segment, used))
        used, segment = used + n, segment + 1
    return out


@pytest.mark.parametrize(("n", "most", "block"), [(900, 20, 40), (900, 20, 55), (400, 7, 10**6), (300, 1, 2), (1, 5, 10)])
def test_packs_of_one_chain(spark, n, most, block):
    draw = random.Random(n + most)
    rows = [(k, draw.choice([1, 2, draw.randint(1, most + 2)])) for k in range(n)] + [(n, None), (n + 1, 0), (n + 2, -3)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, n long, start_text string").repartition(7)
    got = K.sequential_pack(df, "n", most, "k", block=block)
    assert got.columns == ["k", "n", "start_text", "pack", "segment", "start"]
    assert sorted((r.k, r.n, r["pack"], r.segment, r.start) for r in got.collect()) == plain_packs(rows, most)


def test_packs_of_nothing(spark):
    df = spark.createDataFrame([(1, 50)], "k long, n long")
    assert K.sequential_pack(df, "n", 10, "k").count() == 0
    assert K.sequential_pack(df.limit(0), "n", 10, "k").count() == 0


def plain_nearest(rows, probes):
    out = {}
    for key, v, label in probes:
        near = min(((float(((np.array(v) - np.array(w)) ** 2).sum()), k, y) for k, w, y in rows if k != key), default=(0, 0, None))
        out[key] = (label, near[2])
    return out


def clustered(seed, n, width, clusters):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, width)) * 20
    of = draw.integers(0, clusters, n)
    of[: n // 3] = 0  # a hot cell
    values = centres[of] + draw.integers(-2, 3, (n, width)) / 2  # with ties and copies
    return [(k, [float(x) for x in values[k]], int(of[k]) * 10 + int(draw.integers(0, 3))) for k in range(n)]


@pytest.mark.parametrize(("width", "clusters", "group"), [(2, 8, 4096), (3, 5, 16), (12, 1, 40)])
def test_nearest_are_those_of_all_pairs(spark, monkeypatch, width, clusters, group):
    monkeypatch.setattr(N, "GROUP", group)
    rows = clustered(width, 220, width, clusters)
    df = spark.createDataFrame(rows, "k long, v array<double>, y int")
    got = {r.k: (r.y, r.nearest) for r in N.nearest_labels(df, "k", "v", "y").collect()}
    assert got == plain_nearest(rows, rows)
    some = N.nearest_labels(df, "k", "v", "y", probes=df.where("k % 11 = 0"), pivots=3)
    assert {r.k: (r.y, r.nearest) for r in some.collect()} == plain_nearest(rows, [r for r in rows if r[0] % 11 == 0])


def test_nearest_of_odd_tables(spark):
    kinds = "k long, v array<double>, y string"
    odd = [(1, [0.0, 0.0], "a"), (2, [1.0, 1.0], "b"), (None, [0.0, 0.0], "c"), (3, None, "d"), (4, [float("nan"), 0.0], "e"), (5, [None, 0.0], "f"), (6, [0.0, 0.0], None)]
    got = {r.k: (r.y, r.nearest) for r in N.nearest_labels(spark.createDataFrame(odd, kinds), "k", "v", "y").collect()}
    assert got == {1: ("a", None), 2: ("b", "a"), 6: (None, "a")}
    one = spark.createDataFrame(odd[:1], kinds)
    assert [tuple(r) for r in N.nearest_labels(one, "k", "v", "y").collect()] == [(1, "a", None)]
    assert N.nearest_labels(one.limit(0), "k", "v", "y").count() == 0


def test_cells_prune_what_is_far(spark, monkeypatch):
    rows = clustered(4, 300, 2, 30)
    df = spark.createDataFrame(rows, "k long, v array<double>, y int")
    sent, stored = [], N.stored

    def counted(table):
        out = stored(table)
        if out.columns == ["key", "v", "cell"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(N, "stored", counted)
    assert N.nearest_labels(df, "k", "v", "y").agg(F.count("nearest")).first()[0] == 300
    assert sent[0] == 300 and sent[1] < 300 * 17 / 3  # of 17 cells


def test_vectors_without_clusters_are_not_copied_for_their_cells(spark, monkeypatch):
    draw = np.random.default_rng(8)
    values = draw.normal(size=(900, 24)).astype(np.float32).astype(float)
    values[40:52] = values[3]  # copies, in several blocks
    rows = [(k, [float(x) for x in values[k]], k % 7) for k in range(900)]
    df = spark.createDataFrame(rows, "k long, v array<float>, y int")
    monkeypatch.setattr(N, "GROUP", 64)
    kept, stored = [], N.stored

    def counted(table):
        out = stored(table)
        if out.columns == ["key", "v", "cell"]:
            kept.append(out.count())
        return out

    monkeypatch.setattr(N, "stored", counted)
    got = {r.k: (r.y, r.nearest) for r in N.nearest_labels(df, "k", "v", "y").collect()}
    assert got == plain_nearest(rows, rows)
    assert sum(kept) <= 2 * 900  # 30 cells, nearly all of them open to each
    some = N.nearest_labels(df, "k", "v", "y", probes=df.where("k % 5 = 0"))
    assert {r.k: (r.y, r.nearest) for r in some.collect()} == plain_nearest(rows, [r for r in rows if r[0] % 5 == 0])


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e15])
def test_blocks_find_what_all_pairs_find(offset):
    import pyarrow as pa

    draw = np.random.default_rng(2)
    v = draw.integers(-3, 4, (300, 5)) + offset
    index = N.Pivots(list(range(9)), v[:9])
    cell, away = index.nearest(v)
    index.far, index.near = (np.array([f(away[cell == k], initial=i) for k in range(9)]) for f, i in ((np.max, -np.inf), (np.min, np.inf)))

    def block(ids):
        ids = ids[np.lexsort((ids, cell[ids]))]
        known = index.known(ids, v[ids])
        return N._Block(np.float64, pa.array(ids), pa.array(ids % 4), v[ids].tobytes(), cell[ids].tobytes(), known.tobytes())

    a, b = block(np.arange(0, 140)), block(np.arange(140, 300))
    N._meet(a, b, index, True)
    N._meet(a, block(np.arange(0, 140)), index, False)
    N._meet(b, block(np.arange(140, 300)), index, False)
    for one in (a, b):
        for k, d, near in zip(one.keys, one.best, one.near, strict=True):
            squares = ((v - v[k]) ** 2).sum(1)
            squares[k] = np.inf
            assert (d, near) == (squares.min(), squares.argmin())
