"""Audits, composites and lanes on disk."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weft.operators import audit as A
from weft.operators import conversation as C
from weft.plans import composites as K
from weft.sources.catalog import Catalog


def lane(spark, n, source):
    return C.canonical(spark.range(n), source=source, split="train", instruction=F.lit("say"), target=F.col("id").cast("string"), identity=F.col("id").cast("string"))


def test_exposure(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 3, 5), (1, 2, 5, 5), (2, 0, 0, 2)], "row int, pos int, lo int, hi int")
    marked = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 4)], "row int, char_idx int")
    got = sorted((r.row, r.pos, r.n_marked, r.touching, r.pure) for r in A.token_exposure(tokens, marked, "row").collect())
    assert got == [(1, 0, 1, True, False), (1, 1, 2, True, True), (1, 2, 0, False, False), (2, 0, 0, False, False)]


def test_rebuild_goes_on_where_it_stopped(spark, tmp_path):
    catalog, made = Catalog(spark, f"file://{tmp_path}/lanes"), []

    def lanes(fail):
        def make(name, n):
            made.append(name)
            if name == fail:
                raise OSError("broken off")
            return lane(spark, n, name)

        return {name: (lambda name=name, n=n: make(name, n)) for name, n in (("a", 20), ("b", 10))}

    with pytest.raises(OSError):
        K.rebuild(catalog, lanes("b"))
    entries = K.rebuild(catalog, lanes(None))
    assert made == ["a", "b", "b"]
    assert sorted((e["config_name"], e["split"], e["rows"]) for e in entries) == [("a", "train", 18), ("a", "validation", 2), ("b", "train", 9), ("b", "validation", 1)]
    assert {r.source_split for r in catalog.read("a", "validation").collect()} == {"train"}


def test_a_split_can_be_made_from_itself_and_survives_a_failed_write(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/lanes")
    catalog.commit(lane(spark, 6, "a"), "a", "train", source="a", training=True)
    catalog.commit(catalog.read("a", "train").where("row_id < '3'"), "a", "train", source="a", training=True, force=True)
    assert catalog.read("a", "train").count() == 3
    broken = catalog.read("a", "train").withColumn("row_id", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(PySparkException):
        catalog.commit(broken, "a", "train", source="a", training=True, force=True)
    assert catalog.read("a", "train").count() == 3 and catalog.lookup("a", "train")["rows"] == 3


def test_inventory(spark, tmp_path):
    root = f"file://{tmp_path}/lanes"
    catalog = Catalog(spark, root)
    catalog.commit(lane(spark, 4, "a"), "a", "train", source="a", training=True)
    with pytest.raises(A.AuditError, match="validation"):
        A.inventory(spark, root, ["a"])
    assert [(e["split"], e["rows"]) for e in A.inventory(spark, root, ["a"], ("train",))] == [("train", 4)]
    lane(spark, 1, "b").write.parquet(f"{root}/b")
    with pytest.raises(A.AuditError, match="flat"):
        A.inventory(spark, root, ["b"])


def test_guards(spark):
    A.same_revision(None, "x"), A.same_revision("x", "x")
    with pytest.raises(A.AuditError):
        A.same_revision("x", None)
    df = spark.createDataFrame([([1, -100],), ([-100],)], "labels array<int>")
    with pytest.raises(PySparkException, match="active labels"):
        A.with_active_labels(df, "labels").count()
    assert A.with_active_labels(df.limit(1), "labels").count() == 1


def test_mask_and_sentinels(spark):
    df = spark.createDataFrame([("a [gap] b c b", "a b [gap] x", [0, 4, 9])], "r string, h string, mask array<int>")
    row = A.sentinel_score(df, "r", "h", "[gap]").first()
    assert (row.n_reference, row.n_hypothesis, row.positional, row.recalled, row.invented) == (4, 3, 2, 3, 1)
    assert df.select(A.trimmed_mask(F.col("mask"), F.lit(5)).alias("m")).first().m == [0, 4]
