"""The language model: exact base scores, a real distribution, and better than the base."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weft.llm import lm_score
from weft.llm._common import stored, table


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def plain(rows, folds=5):
    held = {d: zlib.crc32(str(d).encode()) % folds == 1 for d, _ in rows}
    counts = Counter(t for d, x in rows if not held[d] for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return {d: (held[d], len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for d, x in rows}


@pytest.mark.parametrize("contexts", [lm_score.CONTEXTS, 8])
def test_counts_and_base_scores(spark, sf_dir, contexts):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()] + [(9001, None), (9002, ""), (9003, "Brand new"), (9004, "word " * 50_000)]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, score string")
    got = lm_score.score(df, contexts=contexts).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
        assert r.score <= 1e-9
    if contexts > 8:
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(12)]
    train = [(5 * k, " ".join(rng.choice(words, 6, p=np.arange(1, 13) / 78))) for k in range(200)]
    train = [(d, t) for d, t in train if zlib.crc32(str(d).encode()) % 5 != 1]
    known = sorted({w for _, t in train for w in t.split()})
    probes = [k for k in range(10_001, 20_000) if zlib.crc32(str(k).encode()) % 5 == 1]
    after = ["", "w11 ", "zz "]
    asked = [(a, w) for a in after for w in [*known, "unknown", None]]
    held = [(probes[i], a + w if w else a.strip()) for i, (a, w) in enumerate(asked)]
    heads = [(probes[500 + i], a.strip()) for i, a in enumerate(after)]
    df = spark.createDataFrame([*train, *held, *heads], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(df, contexts=40).collect()}
    # a text's score has its end token; texts of one word after the same start differ in word and end only
    end = {w: got[held[i][0]] for i, (a, w) in enumerate(asked) if a == "" and w}
    assert len(end) == len(known) + 1
    first_end = got[heads[0][0]]
    assert 10**first_end < 0.1
    pairs = {(a, w): got[held[i][0]] for i, (a, w) in enumerate(asked)}
    assert pairs["w11 ", "w10"] > pairs["w11 ", "unknown"]


def test_seating():
    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 50, 100_000])
    t = np.mean([lm_score.seat(customers, np.full(5, 0.5), 0.5, rng.integers(1 << 63, size=5, dtype=np.uint64)) for _ in range(300)], 0)
    assert t[0] == 0 and t[1] == 1 and abs(t[2] - 1.5) < 0.1 and 1 < t[3] < 50 and t[3] < t[4] < 1000


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (0, "a b"), (0, "a b"), (3, None)], "doc_id long, text string")
    got = lm_score.score(df).collect()
    assert len(got) == 4 and len({(r.n_tokens, r.base_score, r.score) for r in got if r.doc_id == 0}) == 1
    assert lm_score.score(df.limit(0)).count() == 0
    only = spark.createDataFrame([(k, "x y") for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 1], "doc_id long, text string")
    assert {(r.held_out, r.n_known, r.base_score, r.score) for r in lm_score.score(only).collect()} == {(True, 0, 0.0, 0.0)}


def test_rare_words_are_contexts(spark):
    """Words below 1/contexts of the tokens have a restaurant of their own, and know what follows them."""
    ids = [k for k in range(20_000) if zlib.crc32(str(k).encode()) % 5 != 1]
    probes = [k for k in range(30_000, 40_000) if zlib.crc32(str(k).encode()) % 5 == 1]
    train = [(ids[40 * k + j], f"rare{k} next{k}") for k in range(30) for j in range(5)] + [(ids[1500 + k], "the of " * 40) for k in range(20)]
    right = [(probes[k], f"rare{k} next{k}") for k in range(30)]
    wrong = [(probes[100 + k], f"rare{k} next{(k + 1) % 30}") for k in range(30)]
    df = spark.createDataFrame([*train, *right, *wrong], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score(df, contexts=8).collect()}
    assert all(got[a] > got[b] + 1 for (a, _), (b, _) in zip(right, wrong, strict=True))


def test_all_texts_together_have_probability_one(spark):
    """Over a closed vocabulary the probabilities of all texts of any length add up to one.

    P(b after a) is known up to a factor of each word, from texts of one word and of two;
    the sum over all texts does not depend on it."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(9)]
    ids = [k for k in range(5_000) if zlib.crc32(str(k).encode()) % 5 != 1]
    probes = [k for k in range(10_000, 20_000) if zlib.crc32(str(k).encode()) % 5 == 1]
    train = [(ids[k], " ".join(rng.choice(words, int(rng.integers(0, 7)), p=np.arange(1, 10) / 45))) for k in range(300)]
    known = sorted({w for _, t in train for w in t.split()})
    every = [*known, "never"]
    asked = ["", *every, *(f"{a} {b}" for a in every for b in every)]
    df = spark.createDataFrame([*train, *zip(probes, asked, strict=False)], "doc_id long, text string")
    for contexts in (lm_score.CONTEXTS, 4):
        got = {r.doc_id: 10**r.score for r in lm_score.score(df, contexts=contexts).collect() if r.held_out}
        p = {t: got[k] for k, t in zip(probes, asked, strict=False)}
        after = np.array([[p[f"{a} {b}"] / p[a] for b in every] for a in every])
        rest = np.linalg.solve(np.eye(len(every)) - after, np.ones(len(every)))
        assert p[""] + np.array([p[a] for a in every]) @ rest == pytest.approx(1, abs=1e-4)


def test_seating_against_the_whole_distribution():
    """Mean tables of three customers of one dish, over all seatings: weight w + v * tables opens one."""
    d, w, v = 0.4, 0.7, 0.3
    second = (w + v) / (1 - d + w + v)
    third = [(w + v * t) / (2 - d * t + w + v * t) for t in (1, 2)]
    mean = (1 - second) * (1 + third[0]) + second * (2 + third[1])
    rng = np.random.default_rng(3)
    t = lm_score.seat(np.full(200_000, 3), np.full(200_000, w), d, rng.integers(1 << 63, size=200_000, dtype=np.uint64), np.full(200_000, v))
    assert abs(t.mean() - mean) < 0.01


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, order in ((4, "doc_id"), (9, "text")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = stored(documents.orderBy(order))
            got.append({r.doc_id: r.score for r in lm_score.score(rows, contexts=500).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys()
    assert max(abs(got[0][d] - got[1][d]) for d in got[0]) < 1e-6


def test_binomial_draws():
    rng = np.random.default_rng(6)
    keys = rng.integers(1 << 63, size=100_000, dtype=np.uint64)
    for n, p in ((8, 0.01), (8, 0.5), (60, 0.97), (1000, 0.02), (5000, 0.3), (40, 0.0), (40, 1.0)):
        k = lm_score._binomial(np.full(len(keys), n), np.full(len(keys), p), lm_score._uniform(keys, 1), lm_score._uniform(keys, 2))
        assert k.min() >= 0 and k.max() <= n
        spread = math.sqrt(n * p * (1 - p))
        assert abs(k.mean() - n * p) <= 5 * spread / math.sqrt(len(k)) + 1e-9 and abs(k.std() - spread) <= 0.02 * spread + 1e-9
