"""HTML, secrets, packing, media and decontamination against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weft.llm import decontaminate, html_extract, media, packing, queries, secrets
from weft.llm._common import table

LONG = "word " * 30_000 + 'token = "abcdef123456"'
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, LONG), (None, "Der Text"), (5, "password: hunter22 and AKIA" + "A1" * 10 + " " + "0af" * 9), (6, "It's we'll '' … 日本語 \U0001f600\x00<|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, score string, piece int")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_html_pages():
    tree = html_extract.train()
    page = """<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice"><p>We set cookies on your device to make this site work better for all.</p></div>
    <article><h1>A &amp; B</h1><p>One   <b>two</b>
    three.</p><script>var t="</p><p>no</p>";</script><p>x&nbsp;y</p><div class="comments"><p>A reader wrote a rather long comment on this page today.</p></div></article><footer>Foot</footer></body></html>"""
    assert html_extract.main_text(page, tree) == "A & B\nOne two three.\nx y"
    for broken in (None, "", "<", "<p", "<article><p>Cut off in the mid", "<article><p>a<script>never closed <p>b"):
        assert isinstance(html_extract.main_text(broken, tree), str)
    assert html_extract.main_text("<article><p>Cut off in the mid", tree) == "Cut off in the mid"


def test_html_query(spark, sf_dir):
    rows = queries.op1_html_extraction(spark, sf_dir).collect()
    source = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    assert len(rows) == len(source)
    for r in rows:
        assert r.n_chars == len(r.text)
        assert "track(" not in r.text and "·" not in r.text.split("\n")[-1]
    empty = spark.createDataFrame([(1, None, None, "z")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_extract.extract(empty).collect()] == [(1, None, "", 0)]
    assert html_extract.extract(empty.limit(0)).count() == 0


def plain_spans(text):
    text, found = text or "", []
    for k, (kind, pattern, group, least) in enumerate((("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))):
        found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def test_secrets(spark, sf_dir, odd):
    for docs in (table(spark, sf_dir, "documents"), odd):
        got = sorted(map(tuple, secrets.scan(docs).collect()), key=str)
        expected = []
        for r in docs.select("doc_id", "text").collect():
            spans = plain_spans(r.text)
            joined = ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in spans)
            expected.append((r.doc_id, *(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
        assert [g[:5] for g in got] == [e[:5] for e in sorted(expected, key=str)]
    assert secrets.scan(odd.limit(0)).count() == 0


@pytest.mark.parametrize("rule", secrets.BASE_RULES + secrets.MORE_RULES, ids=lambda r: r.kind)
def test_trigram_queries_lose_nothing(rule):
    samples = ['API_KEY="abcdef12"', "apikey:zzzzzzz", "Passwd = 123456", "AKIA" + "Z" * 16, "0" * 30, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890", "AIza" + "b" * 35, "sk_live_" + "c" * 24, "eyJhbGciOiJ.eyJzdWIiOiIx.abcdefgh", "Bearer " + "t" * 22, "ftp://me:secret@host"]
    query = secrets.trigram_query(rule.pattern, rule.flags)

    def holds(q, text):
        return True if q is True else q in text if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, text) for x in q[1])

    matching = [s for s in samples if re.search(rule.pattern, s, rule.flags)]
    assert matching
    assert all(holds(query, s.lower()) for s in matching)
    assert (query is True) == (rule.kind == "hex")


def test_packing(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    for docs in (table(spark, sf_dir, "documents"), odd):
        rows = packing.pack(docs, queries.tokenizer_path()).collect()
        ids = sorted(((r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()), key=str)
        expected = []
        for doc, own in ids:
            size = len(own) % 1024 or min(len(own), 1024)
            cuts = [0, *range(size, len(own) + 1, 1024)]
            expected += [(doc, k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(expected, key=str)
        at = defaultdict(list)
        for r in rows:
            at[r.sequence_id].append((r.offset, r.length))
        for places in at.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 1024
        counts = defaultdict(int)
        for r in rows:
            counts[r.length] += 1
        assert len(at) <= packing.fewest(counts) * 11 / 9 + 1
    assert packing.pack(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_best_fit_decreasing_plan():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.choice([10, 37, 64]))
        items = sorted(rng.integers(1, capacity + 1, int(rng.integers(0, 200))).tolist(), reverse=True)
        rooms: list[int] = []
        for item in items:
            open_ = [(room, i) for i, room in enumerate(rooms) if room >= item]
            if open_:
                rooms[min(open_)[1]] -= item
            else:
                rooms.append(capacity - item)
        counts = {n: items.count(n) for n in set(items)}
        used = defaultdict(int)
        for length, _, many, first, _ in packing.best_fit_plan(counts, capacity):
            for k in range(many):
                used[first + k] += length
        assert sorted(capacity - x for x in used.values()) == sorted(rooms)


def test_sequences_hold_the_ids(spark, odd):
    rows = packing.sequences(odd, queries.tokenizer_path()).collect()
    assert all(len(r.ids) == sum(r.lengths) <= 1024 for r in rows)


def test_media(spark, sf_dir, odd):
    for docs in (table(spark, sf_dir, "documents"), odd):
        got = media.text_media(docs, keep_media=True).collect()
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append((r.text or "").encode())
        assert len(got) == sum(map(len, texts.values()))
        for r in got:
            payload = media.decode(bytes(r.media)).tobytes()
            raw = texts[r.doc_id][0]
            assert payload == raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
            assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)


def test_image_formats(spark):
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    assert (media.decode(media.encode_ppm(pixels)) == pixels).all()
    assert media.decode(b"P2\n# c\n2 2\n15\n0 5 10 15").ravel().tolist() == [0, 85, 170, 255]
    assert media.decode(b"P1\n3 1\n1 0 1").ravel().tolist() == [0, 255, 0]
    assert media.decode(b"P4\n3 1\n\xa0").ravel().tolist() == [0, 255, 0]
    rows = b"".join(pixels[y, :, ::-1].tobytes() + b"\0" * 3 for y in (1, 0))
    bmp = b"BM" + (54 + len(rows)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\x01\x00\x18\x00" + b"\0" * 24 + rows
    assert (media.decode(bmp) == pixels).all()
    plane = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert np.allclose(media.area_resize(plane, 3, 4), plane.reshape(3, 2, 4, 2).mean((1, 3)))
    images = spark.createDataFrame([(1, bytearray(media.encode_ppm(pixels))), (2, None), (3, bytearray(b"nothing"))], "id long, image binary")
    got = {r.id: r for r in media.tiles(images, "id", "image").collect()}
    assert (got[1].height, got[1].width) == (2, 3) and got[2].dhash is None and got[3].tile is None


def plain_hits(text, items, width=10):
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        w = min(width, len(own))
        windows = {tuple(own[k : k + w]) for k in range(len(own) - w + 1)} if w else set()
        for k in range(len(words) - w + 1 if w else 0):
            if tuple(words[k : k + w]) in windows:
                hit |= set(range(k, k + w))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 50])
def test_decontamination(spark, sf_dir, odd, block):
    bench = table(spark, sf_dir, "benchmark").unionByName(spark.createDataFrame([(900, "der TEXT"), (901, None), (902, "..."), (10, "a")], "item_id long, text string"))
    items = [(r.item_id, words_of(r.text)) for r in bench.collect()]
    for docs in (table(spark, sf_dir, "documents"), odd):
        got = sorted(map(tuple, decontaminate.report(docs, bench, block_windows=block).collect()), key=str)
        expected = sorted(((r.doc_id, *plain_hits(r.text, items)) for r in docs.collect()), key=str)
        assert got == expected
    assert not any(r.contaminated for r in decontaminate.report(odd, bench.limit(0)).collect())


def test_decontamination_in_several_blocks(spark):
    """More than the 256 items after which blocks are closed."""
    texts = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(600)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {texts[k]} after" if k % 3 else "clean text") for k in range(600)], "doc_id long, text string")
    assert len(decontaminate.window_blocks(bench, "item_id", "text", decontaminate.WIDTH, 50)) == 3
    items = [(r.item_id, words_of(r.text)) for r in bench.collect()]
    got = sorted(map(tuple, decontaminate.report(docs, bench, block_windows=50).collect()), key=str)
    assert got == sorted(((r.doc_id, *plain_hits(r.text, items)) for r in docs.collect()), key=str)
    assert sum(r[5] for r in got) == 400


def test_decontaminated_documents(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    bad = {r.doc_id for r in decontaminate.report(docs, bench).collect() if r.contaminated}
    assert bad
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    cut = decontaminate.cut_spans(docs, bench)
    assert cut.count() == docs.count() and not any(r.contaminated for r in decontaminate.report(cut, bench).collect())


def test_media_with_bad_headers(spark):
    bad = [b"P6 99999999999999 9999999999999 255\n", b"P5 100000 100000 255\n", b"BM" + b"\xff" * 60, b"P5 3 1 255\nab", b"P2 2 1 10 5 x"]
    df = spark.createDataFrame(list(enumerate(bad)), "k int, image binary")
    assert all(r.tile is None for r in media.tiles(df, "k", "image").collect())
    assert media.decode(b"P3 2 1 255 300 0 7 1 2 999").tolist() == [[[255, 0, 7], [1, 2, 255]]]


def test_area_resize_where_sizes_do_not_divide():
    rng = np.random.default_rng(1)
    plane = rng.integers(0, 256, (7, 11))
    fine = np.kron(plane, np.ones((5, 4)))  # 35 x 44: areas of 7 x 11 fine pixels are whole
    want = fine.reshape(5, 7, 4, 11).mean((1, 3))
    assert np.allclose(media.area_resize(plane, 5, 4), want)


def test_more_rules_take_whole_secrets(spark):
    token = "ghp_" + "Ab1" * 200
    text = f"x {token} y https://user.name%40x:" + "p" * 300 + "@host/ -----BEGIN " + "VERY " * 20 + "PRIVATE KEY----- xoxb-" + "1a-" * 150 + "z"
    df = spark.createDataFrame([(1, text), (2, "z" * 300_000 + "://")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    spans = [x.split(":") for x in got[1].split(",")]
    found = {kind: text[int(a) : int(b)] for kind, a, b in spans}
    assert found["github"] == token and found["slack"].endswith("-z") and found["private_key"].endswith("VERY PRIVATE KEY-----")
    assert found["url_login"].startswith("https://user") and found["url_login"].endswith("p@") and got[2] == ""
