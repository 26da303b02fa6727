"""Configurations, gates, preflight, evaluation and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weft.__main__ import main
from weft.plans import evaluate as E
from weft.plans import governance as G
from weft.plans import preflight
from weft.sources.catalog import Catalog

from .test_sources import rows


def test_configurations():
    config, digest = G.resolve({"a": {"b": 1}}, ["a.c=[1, 2]", "name=plain text"], {"a.b": 9, "seed": 42}, ["a.b"], {("name", "plain text"): ["a.c"]})
    assert config == {"a": {"b": 1, "c": [1, 2]}, "name": "plain text", "seed": 42}
    assert digest == G.config_hash(dict(reversed(config.items()))) != G.config_hash(config | {"seed": 1})
    with pytest.raises(G.GateError) as error:
        G.resolve({}, required=["x.y"])
    assert error.value.check == "config"
    with pytest.raises(ValueError):
        G.parse_override("nothing")


def test_gates(tmp_path):
    config = {"k": 1}
    with pytest.raises(G.GateError):
        G.require_preflight(str(tmp_path / "none"), config)
    path = G.save_manifest(G.run_manifest("preflight", config), str(tmp_path))
    assert G.require_preflight(str(tmp_path), config)["config_hash"] == G.config_hash(config)
    for bad in (lambda: G.require_preflight(str(tmp_path), {"k": 2}), lambda: G.load_manifest(path, "train"), lambda: G.run_manifest("other", config), lambda: G.assert_same({"a": 1}, {"a": 2})):
        with pytest.raises(G.GateError):
            bad()
    G.assert_same(G.fingerprint(), G.fingerprint())
    for n in (200, 1000, 30):
        (tmp_path / f"checkpoint-{n}").mkdir()
    assert G.latest_checkpoint(str(tmp_path)).endswith("checkpoint-1000")


def test_preflight_and_command_line(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/lanes"
    catalog = Catalog(spark, root)
    catalog.commit(rows(spark, 20, "a"), "a", "train", source="a", training=True)
    catalog.commit(rows(spark, 5, "b"), "b", "train", source="b", training=True)
    out = tmp_path / "artifacts"
    assert main(["preflight", root, str(out)]) == 0
    summary = json.loads((out / "summary.json").read_text())
    assert summary["total"] == {"raw_rows": 25, "valid_rows": 25, "failed_rows": 0} and summary["review_rows"] == 13
    assert len((out / "review.md").read_text().splitlines()) == 15
    broken = catalog.mixture().withColumn("messages", F.slice("messages", 2, 1))
    assert preflight.run(broken, {}, str(tmp_path / "x"))["total"]["failed_rows"] == 25
    assert main(["merge", root, str(tmp_path / "m"), "--lanes", "a"]) == 0 and spark.read.parquet(str(tmp_path / "m")).count() == 20
    assert main(["merge", root, str(tmp_path / "n"), "--lanes", "c"]) == 1 and main(["nothing"]) == 2
    capsys.readouterr()
    assert main(["shares", root, "--dry-run", "--set", "seed=7"]) == 0 and json.loads(capsys.readouterr().out)["config"]["seed"] == 7


def test_ablation(spark):
    df = spark.createDataFrame([(k, ["x"] * n) for k, n in enumerate([1, 1, 1, 2, 0])], "k long, images array<string>")
    made = E.variants(df, "k", "images")
    assert {r.variant: r["count"] for r in made.groupBy("variant").count().collect()} == {"aligned": 5, "permuted": 3, "blank": 5}
    scores = spark.createDataFrame([(1, "aligned", 1.0), (1, "permuted", 1.5), (1, "blank", 3.0), (2, "aligned", 2.0), (2, "blank", None), (3, "permuted", 9.0)], "k long, variant string, score double").withColumn("s", F.lit("x"))
    r = E.ablation(scores, "k", ["s"]).first()
    assert (r.n, r.n_permuted, r.delta_permuted, r.rel_permuted, r.n_blank, r.delta_blank) == (2, 1, 0.5, 0.5, 1, 2.0)
    lanes = spark.createDataFrame([("q", "wer", "image", 0.4), ("q", "wer", "native", 0.1), ("q", "em", "image", 0.5), ("q", "em", "native", 1.0)], "source string, metric string, lane string, value double")
    assert {x.metric: x.retention for x in E.lane_table(lanes, {"wer": False}).collect()} == {"wer": 25.0, "em": 50.0}
    assert E.training_effect(r and E.ablation(scores, "k", ["s"]), E.ablation(scores, "k", ["s"]), ["s"], "aligned").first().effect == 0.0
