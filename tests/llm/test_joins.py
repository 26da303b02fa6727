"""Jaccard join, components and url filters against plain versions."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest

from weft.llm import jaccard_join, queries, url_filter
from weft.llm._common import table
from weft.llm.components import connected_components


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def reach(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def plain_join(rows):
    sets = {k: shingles(t) for k, t in rows}
    pairs = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = reach(sets, pairs)
    return sorted((k, len(sets[k]), low[k]) for k in sets)


def near_copies(n, seed, words=60):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(0, words))] = f"x{rng.integers(0, 10**9)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    extra = [None, "", " \n ", "one two", "ONE  two", "one two three", "a b c d e", "a b c d e f", "long " * 20_000, *near_copies(120, 5), *near_copies(40, 6, 9), *["same text of all these rows here"] * 30]
    extra += [" ".join(["shared passage of many words in each of them"] + near_copies(1, 100 + k)) for k in range(40)]
    return rows + [(100_000 + k, t) for k, t in enumerate(extra)]


@pytest.mark.parametrize("most", [jaccard_join.MOST_IN_TREE, 25])
def test_join(spark, planted, most):
    df = spark.createDataFrame([(k, t, 7, "z") for k, t in planted], "doc_id long, text string, k1 int, comp string")
    assert sorted(map(tuple, jaccard_join.join(df, most_in_tree=most).collect())) == plain_join(planted)


def test_join_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "other"), (5, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(df).collect()), key=str) == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 1, 4), (5, 0, 5)], key=str)
    assert jaccard_join.join(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in jaccard_join.deduplicate(df.where("doc_id is not null")).collect()) == [3, 3, 4, 5]


def test_signature_tree_finds_all_links():
    rng = np.random.default_rng(2)
    for trial in range(20):
        base = rng.integers(1, 1 << 62, 200, dtype=np.uint64)
        sets = []
        for _ in range(150):
            part = base[: rng.integers(5, 200)] if trial % 2 else rng.choice(base, rng.integers(100, 200), replace=False)
            sets.append(np.unique(np.concatenate([part, rng.integers(1, 1 << 62, rng.integers(0, 15), dtype=np.uint64)])))
        pairs = [(a, b) for a, b in combinations(range(len(sets)), 2) if jaccard_join.linked(sets[a], sets[b])]
        want, got = reach(range(len(sets)), pairs), jaccard_join.SignatureTree(sets).link()
        assert len(set(zip(want.values(), got.tolist(), strict=True))) == len(set(want.values())) == len(set(got.tolist()))


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(100)]
    pairs = [(a, b) for a, b in pairs if a != b]
    nodes = {x for p in pairs for x in p}
    df = spark.createDataFrame([*pairs, (None, 4), (5, None), (7777, 7777)], "a long, b long")
    assert dict(map(tuple, connected_components(df).collect())) == reach(nodes, pairs)
    assert connected_components(df.limit(0)).count() == 0


PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="https://B.net/es/y?q=1&amp;r=2#f">'),
    (2, "https://b.net/es/y?q=1&r=2", None),
    (3, "http://c.org/", "<LINK href='http://a.net/x#top' rel=canonical>"),
    (4, "http://c.org", '<meta http-equiv="refresh" content="0; url=/moved">'),
    (5, "http://c.org/moved", "<p>text"),
    (6, "http://d.org/1", '<link rel="canonical" href="http://shop.com/1"><link rel="canonical" href="http://e.net/fr/2">'),
    (7, "http://e.net/fr/2", ""),
    (8, None, None),
    (9, "no url", "<link rel=canonical href=//a.net/x>"),
    (10, "http://WWW.Example.com/en/a", None),
    (11, "http://m.example.com/en/a?x", None),
    (12, "http://net/fr/", None),
    (13, "http://anet/fr/", None),
    (14, "http://lonely.org/a", '<link rel="stylesheet" href="http://b.net/es/y?q=1&r=2">'),
    (14, "http://lonely.org/a", None),
    (15, "http://shop.com", None),
]


def test_url_filter(spark, sf_dir):
    df = spark.createDataFrame([(*p, "v", "n") for p in PAGES], "page_id long, url string, html string, verdict string, node string")
    got = sorted(map(tuple, url_filter.judge(df).collect()), key=str)
    block, allow = "block", "allow"
    expected = [
        (1, "a.net", "/x", None, block), (2, "b.net", "/es/y", "net/es/", block), (3, "c.org", "/", None, block), (4, "c.org", "", None, block), (5, "c.org", "/moved", None, block),
        (6, "d.org", "/1", None, allow), (7, "e.net", "/fr/2", "net/fr/", block), (8, "", "", None, allow), (9, "", "", None, allow), (10, "www.example.com", "/en/a", "www.example.com/en/", allow),
        (11, "m.example.com", "/en/a", "example.com/en/", block), (12, "net", "/fr/", "net/fr/", block), (13, "anet", "/fr/", None, allow), (14, "lonely.org", "/a", None, allow), (14, "lonely.org", "/a", None, allow), (15, "shop.com", "", None, allow),
    ]
    assert got == sorted(expected, key=str)
    moved = spark.createDataFrame([("http://lonely.org/a", "http://b.net/es/y?q=1&r=2")], "from_url string, to_url string")
    assert {r.verdict for r in url_filter.judge(df, redirects=moved).where("page_id = 14").collect()} == {block}
    assert url_filter.judge(df.limit(0)).count() == 0
    assert queries.op8_url_filter(spark, sf_dir).count() == table(spark, sf_dir, "pages").count()


def test_url_filter_oracle(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    for rows in (None, PAGES):
        if rows is None:
            pages, df = f"select * from '{sf_dir}/pages.parquet'", table(spark, sf_dir, "pages")
        else:
            pages = "select * from (values " + ", ".join("(" + ", ".join("null" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + ") t(page_id, url, html)"
            df = spark.createDataFrame(rows, "page_id long, url string, html string")
        db.execute(f"create or replace view pages as {pages}")
        want = db.sql(queries.ORACLE_SQL["op8_url_filter"]).fetchall()
        got = url_filter.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_null_ids_link(spark):
    words = [f"v{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (None, " ".join([*words, "x"])), (2, " ".join([*words, "x", "y"])), (None, " ".join([*words, "x"])), (None, "all alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect() if r.component_id) == [(36, 1), (37, 1), (37, 1), (38, 1)]


@pytest.mark.parametrize("most", [jaccard_join.MOST_IN_TREE, 25])
def test_pairs_are_all_links(spark, planted, most):
    rows = [(k, t) for k, t in planted if k >= 100_000] + [(None, "a b c d e f")]
    found, members = jaccard_join.pairs(spark.createDataFrame(rows, "doc_id long, text string"), most_in_tree=most)
    sets = {}
    for k, t in rows:
        if k is not None and (own := frozenset(shingles(t))):
            sets.setdefault(own, []).append(k)
    want = sorted(tuple(sorted((min(sets[a]), min(sets[b])))) for a, b in combinations(sets, 2) if 100 * len(a & b) >= 80 * len(a | b))
    assert sorted(map(tuple, found.collect())) == want
    links = {k: sum(min(own) in p for p in want) for own in sets.values() for k in own}
    got = {r.doc_id: r for r in members.collect() if r.doc_id is not None}
    assert {k: (got[k].class_id, got[k].n_copies, got[k].n_links) for k in links} == {k: (min(own), len(own) + (k == 100_007), links[k]) for own in sets.values() for k in own}


def test_rules_by_join_judge_like_the_expression(spark, monkeypatch):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rules = [*url_filter.RULES, ("block", "org", "/m"), ("allow", "c.org", "/mo"), ("block", "net", "/"), ("allow", "b.net", "/es/y"), ("block", "c.org", "/mo")]
    want = sorted(map(tuple, url_filter.judge(df, rules).collect()), key=str)
    assert sorted(map(tuple, url_filter.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()), key=str) == want
    monkeypatch.setattr(url_filter, "MOST_RULES", 3)
    assert sorted(map(tuple, url_filter.judge(df, rules).collect()), key=str) == want
