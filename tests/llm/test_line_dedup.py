"""Line dedup against all pairs of lines."""

from __future__ import annotations

import json

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from weft.llm import line_dedup, queries
from weft.llm._common import table


def words(line):
    for x in "\t\x0b\x0c\r":
        line = line.replace(x, " ")
    return frozenset(w for w in line.lower().split(" ") if w)


def plain(rows):
    lines = sorted((d, k, words(x)) for d, t in rows for k, x in enumerate(t.split("\n")) if len(words(x)) >= 5)
    removed = {d: [] for d, _ in rows}
    for k, (d, n, own) in enumerate(lines):
        for _, _, other in lines[:k]:
            both = len(own & other)
            if 100 * both >= 80 * (len(own) + len(other) - both):
                removed[d].append(n)
                break
    return sorted((d, len(t.split("\n")), len(removed[d]), removed[d]) for d, t in rows)


def lines_around(words_, seed, n=40):
    rng = np.random.default_rng(seed)
    base = [f"v{x}" for x in range(words_)]
    out = []
    for _ in range(n):
        own = [w for w in base if rng.random() > 0.08] + [f"z{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(0, 12)))]
        out.append(" ".join(own))
    return out


def lines_with_edits(seed, n=60):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 60, 14)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(0, 14))] = f"w{rng.integers(0, 60)}"
        out.append(" ".join(own))
    return out


def test_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    extra = ["", "a", "\n\n", "one two three four five\nONE two\tthree four five", "long " * 9000 + " ".join(map(str, range(3000)))]
    extra += ["\n".join(lines_with_edits(s)[k : k + 5]) for s in range(4) for k in range(0, 60, 5)]
    extra += ["\n".join(" ".join(f"w{x}" for x in np.random.default_rng(900 + k).integers(0, 25, 8)) for _ in range(3)) for k in range(80)]
    extra += [x for size in (62, 66, 130) for x in lines_around(size, size)]
    rows += [(100_000 + k, t) for k, t in enumerate(extra)]
    df = spark.createDataFrame([(d, t, 3, "c") for d, t in rows], "doc_id long, text string, doc int, line string")
    got = {r.doc_id: r for r in line_dedup.report(df).collect()}
    for d, n, removed, which in plain(rows):
        assert (got[d].n_lines, got[d].n_removed, got[d].removed) == (n, removed, which), d
    texts = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    assert len(texts) == len(rows)
    for d, t in rows:
        assert texts[d].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[d].removed) and texts[d].doc == 3


def test_odd_tables(spark):
    line = "some words that make a line"
    df = spark.createDataFrame([(None, line), (1, None), (2, ""), (3, line + "\nshort"), (3, line + "\nshort"), (4, "x " + line)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in line_dedup.report(df).collect())
    assert got == [(0, 1, 0), (1, 0, 0), (2, 1, 0), (3, 2, 1), (3, 2, 1), (4, 1, 1)]
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup(df).where("text is not null").collect()) == [(0, line), (2, ""), (3, "short"), (3, "short"), (4, "")]
    assert line_dedup.report(df.limit(0)).count() == 0


def plain_whole(rows):
    lines = sorted((d, k, words(x)) for d, t in rows for k, x in enumerate(t.split("\n")) if words(x))
    removed = {d: [] for d, _ in rows}
    for k, (d, n, own) in enumerate(lines):
        if any(100 * len(own & x) >= 80 * len(own | x) for _, _, x in lines[:k]):
            removed[d].append(n)
    return sorted((d, len(removed[d]), removed[d]) for d, _ in rows)


def test_short_lines_of_the_query_and_the_pipeline(spark, tmp_path):
    """Lines of one to four distinct words, long ones of few words, and 4 against 5 words."""
    texts = ["Yes.\nread on\n\n   \nalpha beta gamma delta", "alpha beta gamma delta eps\nread  ON\nyes. no", "go " * 40 + "\nGO\nyes.", *(f"menu\nline {k} of many words here {k * 7}" for k in range(40))]
    rng = np.random.default_rng(5)
    texts += ["\n".join(" ".join(f"u{x}" for x in rng.integers(0, 9, int(rng.integers(1, 6)))) for _ in range(4)) for _ in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_whole(rows)
    got = queries.QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_removed, r.removed) for r in got) == want
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df, str(tmp_path)).collect()}
    assert left == {d: "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in gone) for d, _, gone in want}


def test_words_are_hashed_once(spark):
    df = spark.createDataFrame([(1, "a b\n \n\t\nc"), (2, None), (3, "")], "doc_id long, text string")
    sets = line_dedup._sets(df, "doc_id", "text", line_dedup.rarity_classes(df, "text"), 1)
    plan = sets._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert not any("xxhash64" in x for x in plan.splitlines() if "- Filter" in x)
    assert sorted((r.doc, r.line_no, r.n) for r in sets.collect()) == [(1, 0, 2), (1, 3, 1)]


def test_texts_are_cut_into_words_once(spark):
    """Counts come from the sets' hashes; sketches are those of all words and of three of four classes of hashes."""
    long = [" ".join(f"w{x}" for x in range(k)) for k in (57, 64, 200)]
    texts = ["a b\n \n\t\nc\tA", "B  a\nb a c", *long, " ".join(f"w{x}" for x in range(199, -1, -1))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = line_dedup._hashed(df, "doc_id", "text", 1)
    classes = line_dedup._classes(hashed.select("h"))  # needs no text
    hashes = {(r.doc, r.line_no): r.h for r in hashed.collect()}
    assert sorted(hashes) == [(0, 0), (0, 3), (1, 1), (2, 0), (3, 0), (4, 0)]

    def parity(values):
        out = 0
        for x in values:
            out ^= 1 << (x & 63)
        return out - (1 << 64) if out >> 63 else out

    for r in line_dedup._coded(hashed, classes).collect():
        h = hashes[r.doc, r.line_no]
        split = [parity([x for x in h if (x >> 30) & 3 == k]) if len(h) > line_dedup.LONG else 0 for k in (3, 0, 1)]
        assert (r.n, r.s0, [r.s1, r.s2, r.s3]) == (len(h), parity(h), split)
        assert r.codes == sorted(r.codes) and len(r.codes) == min(len(h), max(3, len(h) - -(-len(h) * 4 // 5) + 1))


def test_words_pass_few_interpreted_functions(spark, tmp_path):
    """Slices are columns, texts are cut once for the report, and sets are stored without dictionaries."""
    df = spark.createDataFrame([(1, " ".join(f"w{x}" for x in range(70)) + "\na b\n\nA  b"), (2, None)], "doc_id long, text string")

    def plan(frame):
        return frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))

    hashed = line_dedup._hashed(df, "doc_id", "text", 1)
    classes = line_dedup._classes(hashed)
    assert len(json.loads(classes)) == line_dedup.SLOTS and set(json.loads(classes)) == {0, 4}
    coded = line_dedup._coded(hashed, classes)
    assert "aggregate(slice(" not in plan(coded) and sorted(r.n for r in coded.collect()) == [2, 70]
    report = line_dedup.report(df, least_words=1)
    assert plan(report).count("split(") == 1
    assert sorted((r.doc_id, r.n_lines, r.removed) for r in report.collect()) == [(1, 4, [3]), (2, 0, [])]
    sets = line_dedup._stored_sets(df, "doc_id", "text", 1)
    for path in sets.inputFiles():
        group = pq.ParquetFile(path.removeprefix("file:")).metadata
        for k in range(group.num_row_groups):
            assert not any(group.row_group(k).column(c).has_dictionary_page for c in range(group.num_columns))
