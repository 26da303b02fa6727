"""Watching metrics as they arrive: a step is told once, when all its metrics are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _first_values(wanted: DataFrame, metrics: list[str], order: str) -> DataFrame:
    of = lambda m, c: F.when(F.col("metric") == m, F.col(c))
    return wanted.groupBy("step").agg(*(F.min_by(of(m, "value"), F.when(F.col("metric") == m, F.struct(order, "value"))).alias(m) for m in metrics))


def _all_there(metrics: list[str]) -> Column:
    return F.size(F.array_compact(F.array(*(F.col(f"`{m}`") for m in metrics)))) == len(metrics)


def complete_steps(stream: DataFrame, metrics: list[str], order: str = "seq", keep: str = "7 days", slack: str = "10 seconds", unfinished: bool = False) -> DataFrame:
    """stream: step, metric, value and an arrival number `order`. One row (step, then a column for
    each metric with its first value, by the number, then the value) for each step once it is
    complete; works on batches and on streams.

    A stream holds of a step one number and one value for each metric, until `keep` after its
    last row. Within that time a step is told once; then its state goes, complete or not, so
    steps that never complete take no room for ever. With `unfinished` they are told as they go,
    what they lack as null; a batch tells them too. What is told cannot be taken back: a stream
    gives the batch's values as long as a step's first values are there when it completes.
    Time is that of arrival, and moves on as rows come, `slack` behind the newest (clocks may
    go back by that much). A stream without the column `order` counts rows as they arrive; a
    batch needs it. Rows without a value or number are left out."""
    numbered = order in stream.columns
    if not numbered:
        if not stream.isStreaming:
            raise ValueError(f"a batch needs the arrival number {order}")
        stream = stream.withColumn(order, F.lit(0))
    wanted = stream.where(F.col("metric").isin(metrics) & F.col("value").isNotNull() & F.col(order).isNotNull())
    if not stream.isStreaming:
        found = _first_values(wanted, metrics, order)
        return found if unfinished else found.where(_all_there(metrics))
    wait = _milliseconds(keep)

    def collect(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, seen = (state.get[0], list(state.get[1:])) if state.exists else (False, [None] * (2 * len(metrics)))
        row = lambda: pd.DataFrame([(key[0], *seen[1::2])], columns=["step", *metrics])
        if state.hasTimedOut:
            state.remove()
            if unfinished and not told:
                yield row()
            return
        latest = 0
        for pdf in parts:
            latest = max(latest, int(pdf["__arrived"].max().timestamp() * 1000))
            for m, number, value in zip(pdf["metric"], pdf[order], pdf["value"], strict=True):
                k = 2 * metrics.index(m)
                if seen[k] is None or (numbered and (int(number), float(value)) < (seen[k], seen[k + 1])):
                    seen[k : k + 2] = int(number), float(value)
        complete = None not in seen
        state.update((told or complete, *seen))
        state.setTimeoutTimestamp(latest + wait)
        if complete and not told:
            yield row()

    fields = ", ".join(f"`n_{m}` long, `{m}` double" for m in metrics)
    schema = "step long, " + ", ".join(f"`{m}` double" for m in metrics)
    chosen = wanted.select(F.col("step").cast("long").alias("step"), "metric", F.col(order).cast("long").alias(order), F.col("value").cast("double").alias("value"), F.current_timestamp().alias("__arrived"))
    return chosen.withWatermark("__arrived", slack).groupBy("step").applyInPandasWithState(collect, schema, f"told boolean, {fields}", "append", GroupStateTimeout.EventTimeTimeout)


#: Milliseconds of units of time.
_UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _milliseconds(span: str) -> int:
    number, unit = span.split()
    return int(float(number) * _UNITS[unit.rstrip("s")])


def windowed_means(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Mean value and count by event type and window of event time; late rows are waited for."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
