"""Hard negatives by blocked matrix products of anchors and candidates.

Anchors are stored in blocks of at most ANCHOR_BYTES, dealt by a hash of the whole row. One
block after the other goes to the executors, where tiles of it and of the candidates are
multiplied in float64; every sum below 2^53 is exact there, and products that could leave
that range are done over in whole numbers. A first pass keeps the best positives of each anchor,
a second the best negatives within the window of scores that each positive opens. What a task
keeps of an anchor is its first k so far, so tasks' lists merge in any order. No candidate is shuffled.

Defined results: rows with a null id, label or vector, or a null, NaN or infinite component,
take no part; components that a shorter vector lacks count as 0; rows of an anchor's own id are
no positives of it; an id counts once for each score it has, so rows that repeat change
nothing; rows of one anchor id that differ in vector or label are anchors of their own, one
after another; an anchor without positives, and a positive without negatives, gives no row;
scores beyond 64 bits are put at their ends; no anchors or an empty table give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._common import shared_dir

POSITIVES, NEGATIVES = 5, 5
#: A negative has from LOW to PER hundredths of the positive's score.
LOW, PER = 80, 100
SCALE = 256.0
#: Size of a block of anchors, the bound of each broadcast.
ANCHOR_BYTES = 8_000_000
#: Products that a task holds at once.
TILE = 2_000_000
#: Tasks whose lists are merged in the first of two steps.
_MERGED = 64
_EXACT = float(1 << 53)
_LEAST = np.int64(-(2**63) + 1)
_MOST = 2**63 - 1

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    """Whole numbers floor(scale * x), a row for each vector, zeros behind shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    size_a, size_b = np.abs(a).sum(1), np.abs(b).max(1, initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        out = a @ b.T
    if size_a.max(initial=0) * size_b.max(initial=0) < _EXACT:
        return out.astype(np.int64)
    large = size_a[:, None] * size_b >= _EXACT
    whole = np.where(large, 0, out).astype(np.int64)
    for i, j in np.argwhere(large).tolist():
        exact = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True))
        whole[i, j] = max(int(_LEAST), min(_MOST, exact))
    return whole


class Best:
    """The first k entries of each row so far: higher scores first, then smaller ids, each once."""

    def __init__(self, rows: int, k: int):
        self.k, self.rows = k, rows
        self.row = self.score = self.id = np.empty(0, np.int64)
        self.least = np.full(rows, _LEAST)

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, unique: bool) -> None:
        worth = allowed & (scores >= self.least[:, None])
        if unique and scores.shape[1] > self.k and np.count_nonzero(worth) > 4 * self.k * self.rows:
            at = scores.shape[1] - self.k
            worth &= scores >= np.partition(np.where(worth, scores, _LEAST), at, axis=1)[:, at, None]
        row, place = np.nonzero(worth)
        if not len(row):
            return
        row, score, own = np.concatenate([self.row, row]), np.concatenate([self.score, scores[row, place]]), np.concatenate([self.id, ids[place]])
        order = np.lexsort((own, -score, row))
        row, score, own = row[order], score[order], own[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (own[1:] != own[:-1])
        row, score, own = row[new], score[new], own[new]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept, last = rank < self.k, rank == self.k - 1
        self.least[row[last]] = score[last]
        self.row, self.score, self.id = row[kept], score[kept], own[kept]


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group, with rank; tasks' lists are merged in two steps."""
    order = (F.col("score").desc(), F.col("id"))
    for keys in ([*by, "part"], by):
        found = found.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.drop("part").distinct()


def _scanned(rows: DataFrame, block, scale: float, groups: int, k: int, allowed: Callable) -> DataFrame:
    """row, part, id, score: what each task keeps of its candidates for `groups` rows of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        n = len(own["id"])
        best = [Best(n, k) for _ in range(groups)]
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            vectors = _matrix(batch.column(2), scale)
            unique = len(np.unique(ids)) == len(ids)
            for at in range(0, len(ids), step := max(1, TILE // n)):
                some = slice(at, at + step)
                scores, same = products(own["matrix"], vectors[some]), own["label"][:, None] == labels[some]
                for g in range(groups):
                    best[g].add(scores, allowed(own, g, scores, same, ids[some]), ids[some], unique)
        part = TaskContext.get().partitionId() // _MERGED
        for g, b in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(b.row * groups + g), pa.array(np.full(len(b.row), part, np.int64)), pa.array(b.id), pa.array(b.score)], names=["row", "part", "id", "score"])

    return rows.mapInArrow(run, "row long, part long, id long, score long")


def _positive(own: dict, g: int, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return same & (own["id"][:, None] != ids)


def _negative(own: dict, g: int, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return ~same & own["open"][:, g, None] & (scores >= own["low"][:, g, None]) & (scores <= own["high"][:, g, None])


def _windows(found: list, n: int, positives: int, low: int, per: int) -> dict[str, np.ndarray]:
    """By anchor and positive: is there one, its id, and the least and the highest score of its negatives."""
    out = {"open": np.zeros((n, positives), bool), **{c: np.zeros((n, positives), np.int64) for c in ("positive", "low", "high")}}
    for r in found:
        at = r.row, r.rank - 1
        out["open"][at], out["positive"][at], out["high"][at] = True, r.id, r.score
        out["low"][at] = max(int(_LEAST), min(_MOST, -((-low * r.score) // per)))
    return out


def mine(
    rows: DataFrame, anchors: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", *,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, per: int = PER, scale: float = SCALE, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: condition on the rows' own columns. Components become floor(scale * x)."""
    spark = rows.sparkSession
    chosen = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"), anchors.alias("asked"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    valid = chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    candidates = valid.select("id", "label", "v")
    asked = valid.where("asked").select("id", "label", "v").distinct()
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    folder = f"{shared_dir(spark)}/hard-negatives-{uuid.uuid4().hex}"
    blocks = -(-n * (8 * width + 64) // anchor_bytes)
    if not n:
        return spark.createDataFrame([], _RESULT)
    asked.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)).cast("int")).repartition(blocks, "block").write.partitionBy("block").parquet(f"{folder}/anchors")
    stored = spark.read.parquet(f"{folder}/anchors")
    for k in range(blocks):
        table = stored.where(F.col("block") == k).select("id", "label", "v").orderBy("id").toArrow()
        if not table.num_rows:
            continue
        own = {"id": table["id"].to_numpy(), "label": table["label"].to_numpy(), "matrix": _matrix(table["v"], scale)}
        first = spark.sparkContext.broadcast(own)
        found = _first(_scanned(candidates, first, scale, 1, positives, _positive), ["row"], positives).collect()  # `positives` rows for each anchor of the block
        second = spark.sparkContext.broadcast(own | _windows(found, len(own["id"]), positives, low, per))
        kept = _first(_scanned(candidates, second, scale, positives, negatives, _negative), ["row"], negatives)
        named = [(a * positives + r.rank - 1, int(own["id"][a]), r.id, r.score) for r in found for a in (r.row,)]
        of = spark.createDataFrame(named, "row long, anchor_id long, positive_id long, positive_score long")
        out = kept.join(F.broadcast(of), "row").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.parquet(f"{folder}/found/block={k}")
        first.unpersist()
        second.unpersist()
    return spark.read.schema(_RESULT).parquet(f"{folder}/found").select(*(x.split()[0] for x in _RESULT.split(", ")))
