"""N-gram Jaccard join: which documents reach which by links between shingle sets.

1. Every text becomes its set of hashed five-word shingles; equal sets are one class.
2. Document frequencies of all shingles are counted in hash buckets: hashes travel
   packed (a few thousand to a row) with the class they belong to. Only shingles that
   two classes share go back to their class. A class with fewer shared shingles than a
   link needs is done; of the others, only the rarest shingles that a link cannot avoid
   (the prefix) are posted. Classes posted at one shingle whose sizes may fit are
   candidates of each other.
3. Connected candidates are verified together with signature trees: leaves hold token
   bitmaps, inner nodes the OR of their children with the range of set sizes; two nodes
   are compared only if sizes and the most that their bitmaps can overlap allow a link.
   Exact intersections decide. For components, nodes that are linked already are passed over;
   `pairs` passes over none and gives every link between different sets. More than
   `MOST_IN_TREE` connected candidates are dealt over pairs of blocks, one task each, so
   that no group is gathered in one task.

Defined results: null texts and texts without words have no shingles, no links and their
own id as component; a text of one to four words has its whole sequence as one shingle;
rows that repeat are each answered; rows of a null id link like all others, but null is
never a component id where another id is reached; other columns are ignored. Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._common import NOT_SPACE, Words, checkpoint, chunks, mix, partitions, shingle_sets
from weft.llm.components import connected_components

WIDTH = 5
#: A link: PER * intersection >= SHARE * union.
SHARE, PER = 80, 100
#: Hashes that one bucket has, about, and that a task gathers before it sends them.
BUCKET_HASHES, SEND_HASHES = 2_000_000, 1_500_000
MOST_IN_TREE = 4096
_LEAF, _FAN = 32, 4


def _least_overlap(n: np.ndarray | int):
    """Shingles that a set of n shares with each set it links to, at least."""
    return -(-n * SHARE // PER)


def class_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, whatever the order; empty sets have 0."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x51ED270B9A3B7C01, 0xA0761D6478BD642F):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
            out.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)))
    return out[0], out[1]


def set_keys(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, text_key, n_shingles and the class keys k1, k2 of each row."""
    chosen = documents.select(F.col(id_column), F.xxhash64(F.col(text_column)).alias("text_key"), F.col(text_column).alias("__text"))
    schema = T.StructType([*chosen.schema[:2], *(T.StructField(x, T.LongType()) for x in ("n_shingles", "k1", "k2"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text"):
            hashes, first = shingle_sets(Words(texts, NOT_SPACE), WIDTH)
            k1, k2 = class_keys(hashes, first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (np.diff(first), k1.view(np.int64), k2.view(np.int64)))], names=schema.names)

    return chosen.mapInArrow(run, schema)


# Packed rows: a bucket, and arrays as bytes.
_PACKED = "bucket int, hashes binary, refs binary, sizes binary, counts binary"


def _bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(by: np.ndarray, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that has values; the columns hold them, in given order."""
    order = np.argsort(by, kind="stable")
    found, start = np.unique(by[order], return_index=True)
    edges = np.append(start, len(by))
    sorted_columns = [c[order] for c in columns]
    arrays = [pa.array([c[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for c in sorted_columns]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *arrays], names=["bucket", "hashes", "refs", "sizes", "counts"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """All values of each bucket in this partition (one as a rule)."""
    kept: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for bucket, *blobs in zip(*columns, strict=True):
            kept.setdefault(bucket, []).append(blobs)
    for bucket in list(kept):
        rows = kept.pop(bucket)
        yield tuple(np.frombuffer(b"".join(r[k] for r in rows), d) for k, d in enumerate((np.uint64, np.uint64, np.int32, np.int32)))


def _post(documents: DataFrame, id_column: str, text_column: str, buckets: int) -> DataFrame:
    """All shingles of all classes, packed by bucket; a class that a task has seen is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0
        for _, texts in chunks(batches, "__text"):
            hashes, first = shingle_sets(Words(texts, NOT_SPACE), WIDTH)
            k1, _ = class_keys(hashes, first)
            n = np.diff(first)
            new = np.zeros(len(n), bool)
            for i, k in enumerate(k1.tolist()):
                if n[i] and k not in seen:
                    seen.add(k)
                    new[i] = True
            keep = np.repeat(new, n)
            waiting.append((hashes[keep], np.repeat(k1[new], n[new]), np.repeat(n[new], n[new]).astype(np.int32)))
            held += int(keep.sum())
            if held >= SEND_HASHES:
                yield _send(waiting, buckets)
                waiting, held = [], 0
        if held:
            yield _send(waiting, buckets)

    return documents.select(F.col(text_column).alias("__text")).mapInArrow(run, _PACKED)


def _send(waiting: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    """Hashes by bucket; refs and sizes once for each run of one class, counts: lengths of the runs."""
    hashes, refs, sizes = (np.concatenate(x) for x in zip(*waiting, strict=True))
    by = _bucket_of(hashes, buckets)
    order = np.argsort(by, kind="stable")
    by, hashes, refs, sizes = by[order], hashes[order], refs[order], sizes[order]
    new = np.ones(len(by), bool)
    new[1:] = (by[1:] != by[:-1]) | (refs[1:] != refs[:-1])
    run = np.flatnonzero(new)
    lengths = np.diff(np.append(run, len(by))).astype(np.int32)
    found, start = np.unique(by, return_index=True)
    edges = np.append(start, len(by))
    run_edges = np.append(np.searchsorted(run, start), len(run))
    cut = lambda c, e: pa.array([c[a:b].tobytes() for a, b in zip(e[:-1], e[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int32()), cut(hashes, edges), cut(refs[run], run_edges), cut(sizes[run], run_edges), cut(lengths, run_edges)], names=["bucket", "hashes", "refs", "sizes", "counts"]
    )


def _reply(buckets: int):
    """Shared shingles, with the number of classes that hold them, go back by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, refs, sizes, lengths in _unpack(batches):
            order = np.argsort(hashes)
            ordered = hashes[order]
            same = np.zeros(len(ordered) + 1, bool)
            same[1:-1] = ordered[1:] == ordered[:-1]
            at = order[same[1:] | same[:-1]]
            if not len(at):
                continue
            owner = np.searchsorted(np.cumsum(lengths), at, "right")
            h, r, n = hashes[at], refs[owner], sizes[owner]
            order = np.lexsort((r, h))
            h, r, n = h[order], r[order], n[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r, n = h[new], r[new], n[new]
            _, where, df = np.unique(h, return_inverse=True, return_counts=True)
            df = df[where].astype(np.int32)
            keep = df > 1
            if keep.any():
                yield _pack(_bucket_of(r[keep], buckets), buckets, h[keep], r[keep], n[keep], df[keep])

    return run


def _prefixes(buckets: int):
    """Of each class with enough shared shingles: the rarest that a link cannot avoid, posted by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, r, n, df in _unpack(batches):
            order = np.lexsort((h, df, r))
            h, r, n = h[order], r[order], n[order]
            new = np.ones(len(r), bool)
            new[1:] = r[1:] != r[:-1]
            first = np.flatnonzero(new)
            shared = np.diff(np.append(first, len(r)))
            posted = shared - _least_overlap(n[first].astype(np.int64)) + 1
            rank = np.arange(len(r)) - np.repeat(first, shared)
            keep = rank < np.repeat(posted, shared)
            if keep.any():
                yield _pack(_bucket_of(h[keep], buckets), buckets, h[keep], r[keep], n[keep], np.zeros(int(keep.sum()), np.int32))

    return run


def _local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges and the smallest node it reaches within them."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the classes posted at one shingle whose sizes may fit."""
    for h, r, n, _ in _unpack(batches):
        order = np.lexsort((r, n, h))
        h, r, n = h[order], r[order], n[order].astype(np.int64)
        joined = (h[1:] == h[:-1]) & (r[1:] != r[:-1]) & (n[1:] * SHARE <= n[:-1] * PER)
        at = np.flatnonzero(joined)
        if len(at):
            nodes, low = _local_components(r[at].view(np.int64), r[at + 1].view(np.int64))
            keep = nodes != low
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(low[keep], pa.int64())], names=["a", "b"])


class SignatureTree:
    """Levels from the leaves up; each node has a token bitmap, the range of set sizes and
    the most tokens that one of its sets has beyond its own bits."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        low = np.array([int(s[0]) for s in sets], np.uint64)
        self.order = np.lexsort((low, np.floor(np.log(sizes) / np.log(PER / SHARE))))
        self.sets = [sets[k] for k in self.order]
        self.sizes = sizes[self.order]
        bits = int(min(8192, max(256, 1 << int(2 * sizes.max() - 1).bit_length())))
        self.bitmaps = np.zeros((len(sets), bits // 64), np.uint64)
        flat = np.concatenate(self.sets)
        slot = (flat >> np.uint64(40)) & np.uint64(bits - 1)
        row = np.repeat(np.arange(len(sets)), self.sizes)
        np.bitwise_or.at(self.bitmaps, (row, (slot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (slot & np.uint64(63)))
        self.excess = self.sizes - np.bitwise_count(self.bitmaps).sum(1, dtype=np.int64)
        self.label = np.arange(len(sets))
        self.levels = []
        parts = (self.bitmaps, self.sizes, self.sizes, self.excess)
        width, starts = _LEAF, np.arange(0, len(sets), _LEAF)
        while True:
            parts = tuple(f.reduceat(p, starts) for f, p in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), parts, strict=True))
            self.levels.append((width, *parts))
            if len(parts[1]) == 1:
                break
            width, starts = width * _FAN, np.arange(0, len(parts[1]), _FAN)

    def _fits(self, level: int, a: int, b: int) -> bool:
        _, bitmaps, least, most, excess = self.levels[level]
        low, high = (int(least[a]), int(least[b])), (int(most[a]), int(most[b]))
        if min(high) * PER < max(low) * SHARE:
            return False
        need = max(_least_overlap(max(low)), -(-SHARE * sum(low) // (PER + SHARE)))
        return int(np.bitwise_count(bitmaps[a] & bitmaps[b]).sum()) + min(int(excess[a]), int(excess[b])) >= need

    def _leaves(self, a: int, b: int, links: list[tuple[int, int]] | None) -> None:
        i, j = np.arange(a * _LEAF, min((a + 1) * _LEAF, len(self.sets))), np.arange(b * _LEAF, min((b + 1) * _LEAF, len(self.sets)))
        x, y = self.sizes[i][:, None], self.sizes[j][None, :]
        bound = np.bitwise_count(self.bitmaps[i][:, None, :] & self.bitmaps[j][None, :, :]).sum(2, dtype=np.int64) + np.minimum(self.excess[i][:, None], self.excess[j][None, :])
        need = -(-SHARE * (x + y) // (PER + SHARE))
        ok = (bound >= need) & (np.minimum(x, y) * PER >= np.maximum(x, y) * SHARE)
        if a == b:
            ok &= i[:, None] < j[None, :]
        for p, q in np.argwhere(ok).tolist():
            p, q = int(i[p]), int(j[q])
            if links is not None:
                if linked(self.sets[p], self.sets[q]):
                    links.append((int(self.order[p]), int(self.order[q])))
            elif self.label[p] != self.label[q] and linked(self.sets[p], self.sets[q]):
                low, high = sorted((self.label[p], self.label[q]))
                self.label[self.label == high] = low

    def link(self, links: list[tuple[int, int]] | None = None) -> np.ndarray:
        """The component of each set, as the place of one of its sets; or, where a list is given,
        all links go into it."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            width = self.levels[level][0]
            if a != b and links is None:
                one, other = self.label[a * width : (a + 1) * width], self.label[b * width : (b + 1) * width]
                if (one == one[0]).all() and (other == one[0]).all():
                    continue
            if not self._fits(level, a, b):
                continue
            if level == 0:
                self._leaves(a, b, links)
                continue
            n = len(self.levels[level - 1][2])
            below = [(level - 1, x, y) for x in range(a * _FAN, min((a + 1) * _FAN, n)) for y in range(b * _FAN, min((b + 1) * _FAN, n)) if a != b or x <= y]
            stack += sorted(below, key=lambda t: t[1] == t[2])  # a node with itself comes first
        out = np.empty(len(self.sets), np.int64)
        out[self.order] = self.order[self.label]
        return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return PER * both >= SHARE * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], all_links: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; all sets of a task go into one tree."""

    def links(refs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        refs_ = np.array(refs, np.int64)
        if all_links:
            SignatureTree(sets).link(found := [])
            at = np.array(found, np.int64).reshape(-1, 2)
        else:
            root = SignatureTree(sets).link()
            own = np.flatnonzero(root != np.arange(len(refs)))
            at = np.column_stack([own, root[own]])
        return pa.RecordBatch.from_arrays([pa.array(refs_[at[:, k]], pa.int64()) for k in (0, 1)], names=["a", "b"])

    task, refs, sets, seen = None, [], [], set()
    for batch, texts in chunks(batches, "__text"):
        hashes, first = shingle_sets(Words(texts, NOT_SPACE), WIDTH)
        k1 = class_keys(hashes, first)[0].view(np.int64).tolist()
        keys = zip(batch.column("comp").to_pylist(), batch.column("part").to_pylist(), strict=True)
        for i, (now, ref) in enumerate(zip(keys, batch.column("ref").to_pylist(), strict=True)):
            if now != task:
                if len(sets) > 1:
                    yield links(refs, sets)
                task, refs, sets, seen = now, [], [], set()
            if ref == k1[i] and ref not in seen:  # another text under the same id is none of this class
                seen.add(ref)
                refs.append(ref)
                sets.append(hashes[first[i] : first[i + 1]].copy())
    if len(sets) > 1:
        yield links(refs, sets)


def _linked(keyed: DataFrame, documents: DataFrame, id_column: str, text_column: str, most_in_tree: int, all_links: bool) -> tuple[DataFrame, DataFrame]:
    """Classes (k1, k2, rep, n), and edges a, b (k1 of classes) that hold links."""
    spark = documents.sparkSession
    one = F.min(F.struct(F.col(id_column).isNull().alias("unknown"), F.col(id_column).alias("rep"), "text_key")).alias("one")
    classes = keyed.where(F.col("n_shingles") > 0).groupBy("k1", "k2").agg(one, F.first("n_shingles").alias("n")).select("k1", "k2", "one.rep", "one.text_key", "n")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_HASHES))
    edge = "a long, b long"

    def deal(df: DataFrame) -> DataFrame:
        return df.repartitionById(buckets, F.col("bucket"))

    shared = deal(_post(documents, id_column, text_column, buckets)).mapInArrow(_reply(buckets), _PACKED)
    posted = deal(deal(shared).mapInArrow(_prefixes(buckets), _PACKED)).mapInArrow(_candidates, edge)
    candidates = connected_components(posted).withColumnRenamed("node", "ref").withColumnRenamed("component", "comp")

    sized = candidates.groupBy("comp").agg(F.count("*").alias("size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(most_in_tree))).cast("int")
    members = candidates.join(sized, "comp").select("ref", "comp", blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("block", block).withColumn("other", other)
    members = members.select("ref", "comp", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("part"))
    reps = members.join(classes.select(F.col("k1").alias("ref"), "rep", F.col("text_key").alias("__key")), "ref")
    texts = documents.select(F.col(id_column).alias("__id"), F.xxhash64(F.col(text_column)).alias("__own"), F.col(text_column).alias("__text"))
    texts = texts.join(reps, F.col("__id").eqNullSafe(F.col("rep")) & (F.col("__own") == F.col("__key"))).select("comp", "part", "ref", "__text")
    tasks = max(partitions(spark), -(-total // (4 * BUCKET_HASHES)))
    dealt = texts.repartition(tasks, "comp", "part").sortWithinPartitions("comp", "part", "ref")
    return classes, dealt.mapInArrow(lambda batches: _verify(batches, all_links), edge)


def join(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_in_tree: int = MOST_IN_TREE) -> DataFrame:
    """id, n_shingles and component_id of each row."""
    keyed = checkpoint(set_keys(documents, id_column, text_column))
    classes, verified = _linked(keyed, documents, id_column, text_column, most_in_tree, False)
    found = connected_components(verified).withColumnRenamed("node", "k1")

    by_class = found.join(classes.select("k1", "rep"), "k1")
    lowest = by_class.groupBy("component").agg(F.min("rep").alias("low"))
    answers = classes.select("k1", "k2", "rep").join(by_class.select("k1", "component").join(lowest, "component").select("k1", "low"), "k1", "left")
    answers = answers.select("k1", "k2", F.coalesce("low", "rep").alias("component_id"))
    out = keyed.join(answers, ["k1", "k2"], "left")
    return out.select(id_column, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_column)).alias("component_id"))


def pairs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_in_tree: int = MOST_IN_TREE) -> tuple[DataFrame, DataFrame]:
    """The whole join: every link between different sets once, as low and high (smallest ids of
    the two sets, null for a set that only rows without an id have), and membership: id,
    class_id (smallest id of the rows with the same set), n_copies (rows with it) and n_links
    (links of the set to others). Its size is that of the result: a group in which all link has
    all its pairs."""
    keyed = checkpoint(set_keys(documents, id_column, text_column))
    classes, verified = _linked(keyed, documents, id_column, text_column, most_in_tree, True)
    edges = checkpoint(verified.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = edges.select(F.explode(F.array("a", "b")).alias("k1")).groupBy("k1").agg(F.count("*").alias("links"))
    copies = keyed.where(F.col("n_shingles") > 0).groupBy("k1", "k2").agg(F.count("*").alias("n_copies"))
    of_class = classes.select("k1", "k2", F.col("rep").alias("class_id")).join(copies, ["k1", "k2"]).join(ends, "k1", "left")
    members = keyed.join(of_class, ["k1", "k2"], "left")
    members = members.select(id_column, F.coalesce("class_id", id_column).alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"))
    named = classes.select("k1", "rep")
    low = edges.join(named.withColumnRenamed("k1", "a").withColumnRenamed("rep", "x"), "a")
    both = low.join(named.withColumnRenamed("k1", "b").withColumnRenamed("rep", "y"), "b")
    found = both.select(F.when(F.col("x").isNull() | (F.col("x") <= F.col("y")), F.col("x")).otherwise(F.col("y")).alias("low"), F.when(F.col("x").isNull() | (F.col("x") <= F.col("y")), F.col("y")).otherwise(F.col("x")).alias("high"))
    return found, members


def deduplicate(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One document of each component stays: the one with the smallest id (its rows, if the
    id repeats). Documents with a null id or without words stay."""
    found = join(documents, id_column, text_column, **options)
    gone = found.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).alias("__gone")).distinct()
    return documents.join(gone, documents[id_column] == gone["__gone"], "left_anti")
