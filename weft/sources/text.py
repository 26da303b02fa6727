"""Text sources: metric logs, transcripts, embedded configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

_PAIR = r"'(eval_[A-Za-z0-9_\-]+)': '?(-?[0-9.]+(?:[eE][-+]?[0-9]+)?|nan|inf|-inf)'?"


def metric_name(name: Column) -> Column:
    """eval_x as eval/x."""
    return F.regexp_replace(name, "^eval_", "eval/")


def parse_metrics(lines: DataFrame) -> DataFrame:
    """line_no, value -> line_no, metric, number for each 'eval_...' entry of a log line."""
    names = F.regexp_extract_all("value", F.lit(_PAIR), F.lit(1))
    numbers = F.regexp_extract_all("value", F.lit(_PAIR), F.lit(2))
    pairs = lines.select("line_no", F.explode(F.arrays_zip(names.alias("metric"), numbers.alias("number"))).alias("p"))
    return pairs.select("line_no", metric_name(F.col("p.metric")).alias("metric"), F.col("p.number").try_cast("double").alias("number"))


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Metric series of log files: file, metric, number and the order of evaluation in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"))
    return lines.join(parse_metrics(lines.select("line_no", "value")), "line_no").select("file", "line_no", "metric", "number")


def read_transcripts(spark: SparkSession, path: str, reader: DataFrameReader | None = None) -> DataFrame:
    """uid and text of lines `<uid> TEXT`."""
    parts = F.split("value", " ", 2)
    return (reader or spark.read).text(path).where(F.col("value") != "").select(F.get(parts, 0).alias("uid"), F.coalesce(F.get(parts, 1), F.lit("")).alias("text"))


def rewrite_config(column: str, values: dict[str, object]) -> Column:
    """A JSON object of plain values with some set anew, keys sorted, others kept; text that is no JSON counts as empty."""
    import json

    old = F.coalesce(F.from_json(F.when(F.json_array_length(F.concat(F.lit("["), F.col(column), F.lit("]"))) == 1, F.col(column)), "map<string,string>"), F.create_map().cast("map<string,string>"))
    fresh = F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, json.dumps(v)))) if values else F.create_map()
    kept = F.map_filter(old, lambda k, _: ~k.isin(*values))
    plain = F.transform_values(kept, lambda _, v: F.when(v.rlike(r"^(-?[0-9]+(\.[0-9]+)?|true|false|null)$"), v).otherwise(F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))))
    entries = F.array_sort(F.map_entries(F.map_concat(plain, fresh)))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}"))
