"""Toxicity on held-out rows, its features, trees and calibration."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from weft.llm import queries, toxicity
from weft.llm._common import table

EMPTY = (np.empty(0, np.uint64), np.empty(0))


def auc(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in rows.items())
    held = [k for k in labels if rows[k].held_out]
    y = np.array([labels[k] for k in held])
    assert auc(np.array([rows[k].score for k in held]), y) > 0.93
    predicted = np.array([rows[k].predicted for k in held])
    assert y[predicted == 1].mean() > 0.85 and predicted[y == 1].mean() > 0.75


def test_labels_of_held_out_rows_are_not_used(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 1 - toxic else toxic end as toxic")
    assert toxicity.score(docs, labels).collect() == toxicity.score(docs, turned).collect()


def test_odd_rows(spark, sf_dir):
    rows = [(1, None, "x"), (2, "", "x"), (3, "you IDIOT!", "x"), (3, "you IDIOT!", "x"), (None, "plain words of a calm text", "x"), (4, "word " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, None), (1, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), table(spark, sf_dir, "labels")):
        got = toxicity.score(df, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    assert got[3].predicted == 1 and got[1].predicted == got[2].predicted == got[None].predicted == got[4].predicted == 0 and not got[None].held_out
    assert toxicity.score(df.limit(0), labels).count() == 0
    assert sorted((r.doc_id or 0) for r in toxicity.keep_clean(df, labels).collect()) == [0, 1, 2, 4]


def test_features():
    texts = pa.array(["You are an idiot.", "an 1d10t, all ALONE", "calm words", "", "sooo good!!"], pa.large_string())
    x = dict(zip(toxicity.FEATURES, toxicity.features(texts, EMPTY).T, strict=True))
    assert np.allclose(x["lexicon"], [0.25, 0, 0, 0, 0]) and x["near_second"][0] == 1 and np.allclose(x["hidden"], [0, 0.25, 0, 0, 0])
    assert x["capital_words"][1] == 0.25 and x["digit_words"][1] == 0.25 and x["repeats"][4] > 0 and x["exclaims"][4] > 0 and (x["log_words"][3] == 0)


def test_isotonic_and_trees():
    m, p = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert p.tolist() == [0, 0.5, 1] and m.tolist() == [1, 2.5, 4]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    assert auc(toxicity.boost(x[:1500], y[:1500]).margin(x[1500:]), y[1500:]) > 0.99
