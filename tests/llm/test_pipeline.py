"""The pipeline, stage by stage against the plain versions of its operators."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_blocks_1_5 import plain_hits, words_of
from tests.llm.test_joins import plain_join
from tests.llm.test_line_dedup import plain_whole
from weft.llm import toxicity
from weft.llm._common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    labels = table(spark, sf_dir, "labels")

    def keep(stage, df):
        out = stages[stage](spark, df, sf_dir)
        assert out.columns == names
        return spark.createDataFrame(out.collect(), docs.schema)

    clean = keep("toxicity", docs)
    rejected = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in clean.collect()} == set(rows) - rejected

    lined = keep("line_dedup", clean)
    gone = {d: which for d, _, which in plain_whole([(r.doc_id, r.text) for r in clean.collect()])}
    assert {r.doc_id: r.text for r in lined.collect()} == {d: "\n".join(x for k, x in enumerate(rows[d].text.split("\n")) if k not in gone[d]) for d in gone}
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = keep("ngram_jaccard_join", lined)
    assert {r.doc_id for r in single.collect()} == {d for d, _, low in plain_join([(r.doc_id, r.text) for r in lined.collect()]) if d == low}

    items = [(r.item_id, words_of(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    pure = keep("decontamination", single)
    assert {r.doc_id for r in pure.collect()} == {r.doc_id for r in single.collect() if not plain_hits(r.text, items)[4]}

    packed = stages["best_fit_packing"](spark, pure, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in pure.collect()}
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    digest = lambda rows_: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows_)
    assert digest(whole) == digest(packed)


ODD = "doc_id long, text string, lang string, source string, n_chars long, doc string, line int, label int, component_id long, contaminated boolean, piece int, score double, __c0 string"
LINE = "one line of words that comes up again in many of the texts here"
OWN = "the first of several sentences that only this text has and no other one"


def odd_rows():
    fill = ("en", "s", 1, "d", 2, 1, 3, True, 4, 0.5, "c")
    texts = [None, "", "\n\n", f"{LINE}\n{OWN}", LINE, "日本 \U0001f600\x00\x0b", "long " * 60_000, f"{LINE}\n{OWN}"]
    rows = [(k, t, *fill) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], rows[0], (None, None, *fill), (None, "a text whose id nobody knows but that is here all the same", *fill), (4, "other text of one id", *fill)]


def held(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_on_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(odd_rows(), ODD)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and held(clean) == held(docs)  # none of them is toxic

    lined = stages["line_dedup"](spark, docs, sf_dir)
    assert lined.columns == docs.columns and lined.count() == docs.count()
    texts = {}
    for r in lined.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert texts[0] == [None, None] and texts[1] == [""] and texts[2] == ["\n\n"]
    assert texts[3] == [f"{LINE}\n{OWN}"] * 3  # rows that repeat are one document
    assert texts[7] == [""] and None in texts[None] and "other text of one id" in texts[4]

    single = stages["ngram_jaccard_join"](spark, docs, sf_dir)
    assert single.columns == docs.columns
    ids = [r.doc_id for r in single.collect()]
    assert ids.count(3) == 3 and 7 not in ids and ids.count(None) == 2 and {0, 1, 2, 4, 5, 6} <= set(ids)

    pure = stages["decontamination"](spark, docs, sf_dir)
    assert pure.columns == docs.columns and held(pure) == held(docs)
    packed = stages["best_fit_packing"](spark, docs, sf_dir).collect()
    assert len([r for r in packed if r.piece == 0]) == docs.count()


def test_stages_and_run_on_an_empty_table(spark, sf_dir, tmp_path):
    empty = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == empty.columns)
    table(spark, sf_dir, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, sf_dir, t).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
