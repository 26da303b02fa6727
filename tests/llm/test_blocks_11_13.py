"""Hard negatives, importance resampling and license scans against plain versions and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import hard_negatives, importance, license_scan, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = ["", " \n ", "x", "Ünïcode 日本語 \U0001f600 words", "W" * 5000 + " " + "long " * 3000, "a\x0bb\x0cc\x00d", "same text here", "same text here"]


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_importance_resampling", "op13_license_scan"])
def test_same_rows_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, relation = queries.QUERIES[name](spark, sf_dir), db.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    order = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[relation.columns.index(c)]) for c in order) for r in relation.fetchall()), key=repr)
    assert got == want and got


# hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, score long, row string"


def plain_negatives(rows):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y, *_ in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, va, ya in fine:
        if a % 100:
            continue
        near = {(-sum(p * q for p, q in zip(va, v, strict=False)), i, y == ya) for i, v, y in fine}
        for ps, p, _ in sorted(x for x in near if x[2] and x[1] != a)[:5]:
            window = sorted({(s, i) for s, i, same in near if not same and 80 * -ps <= 100 * -s <= 100 * -ps})
            out |= {(a, p, rank, i, -ps, -s) for rank, (s, i) in enumerate(window[:5], 1)}
    return sorted(out)


def vectors(seed, n=260, width=4):
    draw = np.random.default_rng(seed)
    base = draw.integers(-2, 3, (n, width)) / 4  # many ties
    rows = [(i, [float(x) for x in base[i]], int(draw.integers(0, 3)), 1, "x") for i in range(n)]
    rows += [rows[100], rows[7], rows[7]]  # rows that repeat
    rows += [(300, [0.5, None, 0.5, 0.5], 1, 1, "x"), (301, None, 1, 1, "x"), (302, [0.5] * 4, None, 1, "x"), (None, [0.5] * 4, 1, 1, "x"), (400, [math.nan] * 4, 1, 1, "x"), (401, [math.inf] * 4, 1, 1, "x"), (500, [0.5, 0.25], 1, 1, "x"), (600, [], 2, 1, "x"), (-100, [1.0] * 4, 0, 1, "x")]
    return rows


@pytest.mark.parametrize("anchor_bytes", [hard_negatives.ANCHOR_BYTES, 200])
def test_negatives_of_all_pairs(spark, anchor_bytes):
    rows = vectors(1)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, anchor_bytes=anchor_bytes)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows) != []


def test_small_tiles_and_ties_of_one_vector(spark, monkeypatch):
    rows = [(i, [1.0, 0.5], i % 2, 1, "x") for i in range(400)]
    for tile in (hard_negatives.TILE, 64):
        monkeypatch.setattr(hard_negatives, "TILE", tile)
        got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).collect()
        assert sorted(map(tuple, got)) == plain_negatives(rows) and len(got) == 4 * 25


def test_products_beyond_the_range_of_doubles():
    a = np.array([[2.0**40, 1.0, -(2.0**40)], [1.0, 2.0, 3.0]])
    b = np.array([[2.0**20, 3.0, 2.0**20 - 1], [2.0**40, 2.0**40, 2.0**40], [4.0, 5.0, 6.0]])
    exact = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b.tolist()] for p in a.tolist()]
    assert hard_negatives.products(a, b).tolist() == exact


def test_no_anchors_and_empty_tables(spark):
    rows = spark.createDataFrame(vectors(2), VECTORS)
    assert hard_negatives.mine(rows, F.lit(False)).count() == 0
    assert hard_negatives.mine(rows.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    alone = hard_negatives.mine(rows.where("vec_id in (0, 1)"), F.col("vec_id") % 100 == 0)
    assert alone.count() == 0


# importance resampling


def plain_resampling(documents, target, buckets=10_000):
    def features(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    s, t = [0] * buckets, [0] * buckets
    for counts, table in ((s, documents), (t, target)):
        for _, text in table:
            for b in features(text):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + buckets) / ((s[k] + 1) * (sum(t) + buckets)))) for k in range(buckets)]
    out, enough = [], []
    for i, text in documents:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(words(text)) >= 20:
            enough.append(row)
    enough.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, row in enumerate(enough[: 25 * len(enough) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def some_documents(seed, n=80):
    draw = random.Random(seed)
    pool = [f"word{k}" for k in range(60)] + ["Ärger", "B2", "ABC", "日本"]
    texts = [" ".join(draw.choices(pool, k=draw.randint(0, 60))) for _ in range(n)]
    rows = list(enumerate(texts)) + [(1000 + k, x) for k, x in enumerate(ODD)] + [(2000, None), (5, texts[5]), (None, texts[6])]
    return rows


def test_resampling_by_plain_loops(spark):
    documents, target = some_documents(1), [(0, "word1 word2 B2 ABC word1 word2"), (1, None), (2, "")]
    df = spark.createDataFrame([(*r, 3, "c") for r in documents], "doc_id long, text string, score int, words string").repartition(4)
    bench = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resample(df, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampling(documents, target)
    assert sorted(map(tuple, importance.resample(df, bench.limit(0), buckets=7).collect()), key=repr) == plain_resampling(documents, [], 7)
    assert importance.resample(df.limit(0), bench).count() == 0
    with pytest.raises(ValueError, match="16 bits"):
        importance.resample(df, bench, buckets=70_000)


def test_crc_of_spans_is_zlibs():
    draw = np.random.default_rng(4)
    data = draw.integers(0, 256, 3000).astype(np.uint8)
    starts = draw.integers(0, 2500, 200)
    ends = starts + np.concatenate([draw.integers(0, 9, 150), draw.integers(0, 400, 50)])
    before = draw.integers(0, 2**32, 200).astype(np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before, strict=True)]
    assert importance.crc32_spans(data, starts, ends, before).tolist() == want
    assert importance.crc32_spans(data, starts[:0], ends[:0]).tolist() == []
    counts, stream, offsets = importance.bucket_stream(pa.array(["One two", "", "two"], pa.large_string()), 97)
    assert counts.tolist() == [2, 0, 1] and offsets.tolist() == [0, 3, 3, 4]
    assert sorted(stream[:3]) == sorted(zlib.crc32(x) % 97 for x in (b"one", b"two", b"one two"))


# license scans


def plain_licenses(documents, notices, share=90):
    out = []
    for i, text in documents:
        w = words(text)
        base = []
        for phrase, label in license_scan.PHRASES.items():
            own = phrase.split()
            base += [(k, label) for k in range(len(w)) if w[k : k + len(own)] == own]
        blocks = (text or "").split("\n") + [b for b in re.split(r"\n[ \t\x0B\f\r]*\n", text or "") if "\n" in b.strip("\n")]
        held = [(label, len(own & set(words(b))) / len(own)) for b in blocks for label, t in notices if (own := set(words(t))) if 100 * len(own & set(words(b))) >= share * len(own)]
        at = sorted(k for k, _ in base)
        labels = sorted({x for _, x in base} | {x for x, _ in held})
        out.append((i, len(w), len(base), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in base})), ",".join(labels), max((x for _, x in held), default=0.0)))
    return sorted(out, key=repr)


def licensed_documents(seed):
    draw = random.Random(seed)
    common = "the of and software this to license under any work is".split()
    rows = []
    for k in range(120):
        lines = []
        for _ in range(draw.randint(1, 5)):
            _, notice = draw.choice(license_scan.TEMPLATES)
            own = [x for x in notice.split() if draw.random() > draw.choice([0.0, 0.05, 0.3])] + draw.choices(common, k=draw.randint(0, 6))
            if draw.random() < 0.3:
                draw.shuffle(own)
            for at in range(draw.choice([0, 0, 1, 3])):
                own.insert(draw.randint(0, len(own)), draw.choice(["\n", "\n\n", "\n \t\n"]) if at else "\n")
            lines.append(" ".join(own))
        rows.append((k, draw.choice(["\n", "\n\n"]).join(lines)))
    rows += [(1000 + k, x) for k, x in enumerate([*ODD, "MIT License mit license MIT-LICENSE", "the general public license apache license.", "license", "mit\nlicense", "KIT License GPL", "general public\x00license"])]
    return rows + [(2000, None), (None, "Released under the MIT License."), (3, "other text of one id: MIT license"), rows[4]]


def test_blocks_of_all_templates(spark):
    documents = licensed_documents(1)
    df = spark.createDataFrame([(*r, 3, "c") for r in documents], "doc_id long, text string, score int, labels string").repartition(4)
    got = license_scan.scan(df)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == plain_licenses(documents, license_scan.TEMPLATES) and sum(r[7] > 0 for r in rows) > 30
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


def test_other_templates_and_shares(spark):
    documents = licensed_documents(2)
    df = spark.createDataFrame(documents, "doc_id long, text string")
    notices = [("x", "software the of license work"), ("y", "the"), ("x", "the"), ("z", "日本 \xc4rger"), ("w", "words 日本語")]
    odd = spark.createDataFrame([*notices, (None, "the"), ("none", ""), ("null", None)], "label string, text string")
    for share in (60, 100):
        got = license_scan.scan(df, odd, share=share)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_licenses(documents, notices, share)
    assert {r.labels for r in license_scan.scan(df, odd.limit(0), phrases={}).collect()} == {""}
    assert license_scan.scan(df.limit(0)).count() == 0


def test_templates_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "PART_WORDS", 40)
    documents = licensed_documents(3)
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert sorted(map(tuple, license_scan.scan(df).collect()), key=repr) == plain_licenses(documents, license_scan.TEMPLATES)
