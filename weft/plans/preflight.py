"""Preflight: validate a mixture, pick rows for review, leave artifacts and a manifest."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.conversation import schema_errors
from weft.operators.mixture import bounded_sample, review_rows
from weft.plans.governance import run_manifest, save_manifest


def review_markdown(rows: list) -> str:
    """A table of picked rows; bars and line feeds in texts are escaped."""
    clean = lambda t: str(t or "").replace("|", "\\|").replace("\n", " ")[:120]
    lines = ["| subset | row | images | instruction | target |", "|---|---|---|---|---|"]
    return "\n".join(lines + [f"| {clean(r.source_dataset_id)} | {clean(r.row_id)} | {r.n_images} | {clean(r.instruction)} | {clean(r.target)} |" for r in rows]) + "\n"


def run(mixture: DataFrame, config: dict, folder: str, most_rows: int = 10_000, per_subset: int = 8, seed: int = 42) -> dict:
    """Summary of at most `most_rows` rows by subset, those that come first in the order of a hash of
    their keys; writes summary, all of their failures, review and manifest."""
    os.makedirs(folder, exist_ok=True)
    rows = bounded_sample(mixture, most_rows, seed, "source_dataset_id", "source_split", "row_id").withColumn("errors", schema_errors(F.col("messages"), F.col("images")))
    counts = rows.groupBy("source_dataset_id").agg(F.count("*").alias("raw_rows"), F.count_if(F.size("errors") == 0).alias("valid_rows"), F.count_if(F.size("errors") > 0).alias("failed_rows"))
    by_subset = {r["source_dataset_id"]: {k: r[k] for k in ("raw_rows", "valid_rows", "failed_rows")} for r in counts.collect()}
    total = {k: sum(v[k] for v in by_subset.values()) for k in ("raw_rows", "valid_rows", "failed_rows")}
    failed = rows.where(F.size("errors") > 0).select("source_dataset_id", "row_id", "errors").orderBy("source_dataset_id", "row_id").collect()  # most_rows at most
    Path(f"{folder}/failures.jsonl").write_text("".join(json.dumps(r.asDict(), ensure_ascii=False) + "\n" for r in failed))
    text = lambda role: F.array_join(F.flatten(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: F.transform(F.filter(m["content"], lambda p: p["type"] == "text"), lambda p: p["text"]))), " ")
    shown = rows.where(F.size("errors") == 0).select("source_dataset_id", "source_split", "row_id", F.size("images").alias("n_images"), text("user").alias("instruction"), text("assistant").alias("target"))
    picked = review_rows(shown, "source_dataset_id", F.col("n_images"), per_subset, seed, "row_id").orderBy("source_dataset_id", "pick").collect()
    Path(f"{folder}/review.md").write_text(review_markdown(picked))
    summary = {"total": total, "subsets": by_subset, "review_rows": len(picked), "passed": total["failed_rows"] == 0}
    Path(f"{folder}/summary.json").write_text(json.dumps(summary, sort_keys=True, indent=1, ensure_ascii=False))
    save_manifest(run_manifest("preflight", config, summary=summary), folder)
    return summary
