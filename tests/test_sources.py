"""Catalog, readers and streams."""

from __future__ import annotations

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import conversation as C
from weft.operators.mixture import MixtureError
from weft.sources import readers
from weft.sources.catalog import Catalog, CatalogError
from weft.sources.text import parse_metrics, read_metric_log, read_transcripts, rewrite_config
from weft.streaming.watch import complete_steps


def rows(spark, n, source):
    return C.canonical(spark.range(n), source=source, split="train", instruction=F.lit("say"), target=F.col("id").cast("string"), identity=F.col("id").cast("string"))


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/lanes")
    for name in ("a", "b"):
        entry = catalog.commit(rows(spark, 4, name), name, "train", source=name, training=True)
        assert entry["rows"] == 4
    with pytest.raises(CatalogError) as error:
        catalog.commit(rows(spark, 2, "a"), "a", "train", source="a", training=True)
    assert error.value.check == "exists"
    catalog.commit(rows(spark, 3, "a"), "a", "train", source="a", training=True, force=True)
    catalog.commit(rows(spark, 1, "a"), "a", "validation", source="a", training=False)
    assert [(e["config_name"], e["split"], e["rows"]) for e in catalog.manifest()["subsets"]] == [("b", "train", 4), ("a", "train", 3), ("a", "validation", 1)]
    assert catalog.lookup("a", "validation")["rows"] == 1 and catalog.lookup("c", "train") is None
    assert catalog.build("b", "train", lambda: 1 / 0, source="b", training=True).count() == 4
    mixture = catalog.mixture(seed=3)
    assert mixture.count() == 7 and {r.position for r in mixture.collect()} == set(range(7))
    assert catalog.mixture(["a"], most_rows=2, max_images=0, max_length=1000).count() == 2
    with pytest.raises(MixtureError):
        catalog.mixture(["c"])
    with pytest.raises(CatalogError):
        catalog.read("c", "train")


def test_text_sources(spark, tmp_path):
    (tmp_path / "run.log").write_text("start\n{'eval_lane_loss': '1.25', 'eval_loss': 2.5}\n{'eval_lane_loss': nan}\n")
    got = [(r.metric, r.number) for r in read_metric_log(spark, str(tmp_path / "run.log")).orderBy("line_no", "metric").collect()]
    assert got[:2] == [("eval/lane_loss", 1.25), ("eval/loss", 2.5)] and np.isnan(got[2][1])
    (tmp_path / "t.txt").write_text("u1 HELLO THERE\nu2\n")
    assert [tuple(r) for r in read_transcripts(spark, str(tmp_path / "t.txt")).collect()] == [("u1", "HELLO THERE"), ("u2", "")]
    df = spark.createDataFrame([('{"b": "x", "width": 1}',), ("no json",), (None,)], "c string")
    assert [r.x for r in df.select(rewrite_config("c", {"width": 2}).alias("x")).collect()] == ['{"b": "x", "width": 2}', '{"width": 2}', '{"width": 2}']
    assert parse_metrics(df.select(F.lit(1).alias("line_no"), F.col("c").alias("value"))).count() == 0


def test_readers(spark, tmp_path):
    data = io.BytesIO()
    with wave.open(data, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000)
        f.writeframes((np.sin(np.arange(800)) * 1000).astype("<i2").tobytes())
    (tmp_path / "7_ann_0.wav").write_bytes(data.getvalue())
    (tmp_path / "3_bob_1.wav").write_bytes(b"broken")
    got = {r.digit: r for r in readers.load(spark, "wav", str(tmp_path)).collect()}
    assert len(got["7"].samples) == 800 and got["7"].rate == 8000 and got["3"].samples is None
    with pytest.raises(KeyError):
        readers.load(spark, "nothing", "")
    spark.range(0, 30, 1, 3).write.parquet(str(tmp_path / "p"))
    assert readers.load(spark, "parquet_head", str(tmp_path / "p"), rows=15).count() == 20


def test_watch_stream(spark, tmp_path):
    rows_ = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (1, "a", 9.0), (3, "b", None)]
    spark.createDataFrame(rows_, "step long, metric string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("step long, metric string, value double").parquet(str(tmp_path / "in"))
    q = complete_steps(stream, ["a", "b"]).writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from watched").collect()] == [(1, 1.0, 2.0)]


def test_head_opens_only_the_files_of_the_slice(spark, tmp_path):
    import os

    folder = tmp_path / "a b+c"
    spark.range(0, 60, 1, 6).write.parquet(str(folder))
    files = sorted(f for f in os.listdir(folder) if f.startswith("part"))
    for f in files[4:]:
        (folder / f).write_bytes(b"not opened")
    for f in os.listdir(folder):
        if f.endswith(".crc"):
            os.remove(folder / f)
    head = readers.load(spark, "parquet_slice", str(folder), rows=13, offset=15, schema="id long")
    for f in (files[0], files[3]):
        os.remove(folder / f)
    assert sorted(r.id for r in head.collect()) == list(range(15, 28))


@pytest.mark.parametrize(("offset", "rows"), [(0, 0), (0, 1), (0, 20), (19, 2), (20, 20), (55, 50), (60, 1), (7, None), (99, None)])
def test_head_slices(spark, tmp_path, offset, rows):
    folder = str(tmp_path / "p")
    spark.range(0, 60, 1, 3).write.parquet(folder)
    spark.range(0).write.mode("append").parquet(folder)
    whole = [r.id for f in sorted(spark.read.parquet(folder).inputFiles()) for r in spark.read.parquet(f).collect()]
    got = readers.load(spark, "parquet_slice", folder, rows=rows, offset=offset)
    assert sorted(r.id for r in got.collect()) == sorted(whole[offset:] if rows is None else whole[offset : offset + rows])


def test_head_keeps_columns_of_folders_and_refuses_odd_slices(spark, tmp_path):
    folder = str(tmp_path / "p")
    spark.range(30).selectExpr("id", "id % 3 as lane").write.partitionBy("lane").parquet(folder)
    got = readers.load(spark, "parquet_slice", folder, rows=12)
    assert got.columns == ["id", "lane"] and got.count() == 12 and all(r.id % 3 == r.lane for r in got.collect())
    with pytest.raises(ValueError, match="slice"):
        readers.load(spark, "parquet_slice", folder, rows=-1)


def watched(spark, tmp_path, batches, name, **options):
    """What a stream tells of batches that come one after another."""
    source, schema = tmp_path / "in", "step long, metric string, value double, seq long"
    spark.createDataFrame([], schema).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = complete_steps(stream, ["a", "b"], **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for wait, rows in batches:
            import time

            time.sleep(wait)
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
    finally:
        q.stop()
    return sorted(map(tuple, spark.sql(f"select * from {name}").collect()), key=repr)


def test_stream_gives_the_first_values_of_the_batch(spark, tmp_path):
    batches = [(0, [(1, "a", 5.0, 7), (1, "a", 4.0, 3), (2, "b", 1.0, 1), (3, "a", None, 2)]), (0, [(1, "a", 9.0, 1), (1, "b", 2.0, 8), (2, "c", 1.0, 5), (3, "b", 6.0, 9)]), (0, [(1, "b", 3.0, 9), (2, "a", 8.0, 4), (2, "a", 7.0, None)])]
    got = watched(spark, tmp_path, batches, "firsts")
    rows = [r for _, b in batches for r in b]
    df = spark.createDataFrame(rows, "step long, metric string, value double, seq long")
    assert got == sorted(map(tuple, complete_steps(df, ["a", "b"]).collect())) == [(1, 9.0, 2.0), (2, 8.0, 1.0)]
    assert (3, None, 6.0) in [tuple(r) for r in complete_steps(df, ["a", "b"], unfinished=True).collect()]
    with pytest.raises(ValueError, match="arrival"):
        complete_steps(df.drop("seq"), ["a", "b"])


def test_steps_that_never_complete_leave_the_state(spark, tmp_path):
    batches = [(0, [(1, "a", 5.0, 1), (2, "a", 1.0, 2), (2, "b", 2.0, 3)]), (5, [(8, "a", 1.0, 4)]), (1, [(1, "b", 6.0, 5)])]
    got = watched(spark, tmp_path, batches, "leaving", keep="1 second", slack="1 second", unfinished=True)
    assert (2, 1.0, 2.0) in got and (1, 5.0, None) in got and (1, 5.0, 6.0) not in got
