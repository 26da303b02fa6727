"""Every registered query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pytest

from weft.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool | str):
        return value
    return round(float(value), 5)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    relation = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_verified_pairs_of_whole_documents(spark, tmp_path):
    texts = ["x" * 70, "x" * 70 + "y", "same text", "same text", "other " * 20 + "a", "other " * 20 + "b", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    ordered = sorted(texts)
    same = sum(b.startswith(a) or a.startswith(b) for a, b in zip(ordered, ordered[1:], strict=False))
    got = QUERIES["verified_pairs_whole"](spark, str(tmp_path)).first()
    assert (got.pairs, got.same) == (6, same) and 0 < same < 6


def test_poison_of_whole_documents(spark, tmp_path):
    texts = ["Grüße, 日本 \U0001f600 \U00020000 x1. " * 12, "short", "", "a\nb\t" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    uniform = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32

    def plain_poison(doc, text):
        hit = [c.isalpha() and uniform(9, doc, k) < 0.3 for k, c in enumerate(text, 1)]
        return "".join(chr(97 + int(uniform(9, doc, "letter", k) * 26)) if h else c for k, (h, c) in enumerate(zip(hit, text, strict=True), 1)), sum(hit)

    got = {r.doc_id: (r.poisoned, r.n_hit) for r in QUERIES["poison_text_whole"](spark, str(tmp_path)).collect()}
    assert got == {d: plain_poison(d, t) for d, t in enumerate(texts)}
    assert got[0][0][80:] != texts[0][80:]


@pytest.mark.parametrize("name", ["bootstrap_rate", "bootstrap_collapse"])
def test_bootstraps_take_the_replicates_of_their_operators(spark, sf_dir, monkeypatch, name):
    from weft.operators import stats

    asked, operator = [], getattr(stats, name)
    monkeypatch.setattr(stats, name, lambda *args, **options: asked.append(options) or operator(*args, **options))
    assert QUERIES[name](spark, sf_dir).count() > 0
    assert "n_boot" not in asked[0]


def test_caps_of_empty_documents(spark, tmp_path):
    lengths = [0, 250, 500, 1000, 3000, 9000, None, -4]
    spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.sql(ORACLES["duration_cap_whatif"])
    got = QUERIES["duration_cap_whatif"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    assert len(got) == 4 and all(math.isnan(r.readable) for r in got) and {r.cap: r.rows_kept for r in got} == {500: 4, 1000: 5, 2000: 5, 4000: 6}
