"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every word of the training tokens, and the start of a text, is a context with a restaurant
of its own; all of these share one parent, the restaurant of single words, whose base is
uniform over the vocabulary and one unknown word. Customers are seated by Chinese
restaurant processes and reseated by blocked Gibbs sweeps: all customers of a dish in a
restaurant leave and come back one by one, given the tables of all others. BURN_IN sweeps
from a start with one table a cell are left out; each sweep after them is a sample, and
predictive probabilities are averaged over the samples. Sweeps run in parallel over
buckets: what stands in other buckets is as the sweep before left it (the usual
approximation of distributed Gibbs samplers). Discounts are estimated from how many cells
were seen once and twice, and stay.

Texts are taken in batches of about BATCH_BYTES. A batch sends its distinct cells (word and
context) with their training counts, packed, to hash buckets by word, so a dish and its
cells in all contexts are in one bucket. Only frequent words (1/CONTEXTS of the training
tokens or more, taken at six bytes each, so 3 * CONTEXTS at most) are dealt by word and
context; their place in the parent is kept on the driver. After each sweep a bucket sends the tables and customers of
its contexts to parts by the context's hash, which add them up and answer each bucket for
its own contexts; so no task and no driver holds all contexts. Each sweep stores the tables of
every bucket and starts from those of the sweep before, with random numbers drawn by cell and
word; so no state is kept in workers, a lost one costs its bucket's work only, and scores are
the same for any number of partitions and any order of the rows. In the end each bucket answers each batch
with the probabilities of its cells (float32) and the counts of its words; batches read
their texts again and add up. What is sent grows with the number of distinct cells of the
batches, and each sweep with the distinct contexts of the buckets. Contexts are told apart
by 40 bits of hash (of 10^9 words one in a thousand shares its restaurant), words by 64.
Batches are numbered by the order of the scan, whose splits are fixed for both scans
(spark.sql.leafNodeDefaultParallelism); if a second scan gave other batches all the same,
the checksums that travel with the cells would differ and the job would fail. So documents
have to come from files: store what comes out of a shuffle first.

Defined results: null and empty texts are one `end` token; rows that repeat (same id and
text) count as often as they stand, and each gets the same answer; a null id is a training
row; without training rows every probability is 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._common import NOT_SPACE, Words, checkpoint, chunks, hash_spans, mix, partitions, release, strings, utf8

FOLDS, HELD_OUT = 5, 1
#: Words of 1/CONTEXTS of the training tokens or more, at six bytes each, are dealt by word and context.
CONTEXTS = 16_384
#: Sweeps after the first seating that are left out, and all sweeps; those between are samples.
BURN_IN, SWEEPS = 1, 4
CHILD_STRENGTH, ROOT_STRENGTH = 1.0, 10.0
BUCKET_TOKENS = 1_500_000
#: Bytes of text in a batch, about; one longer text is a batch of its own.
BATCH_BYTES = 8_000_000
#: Low bits of a hash that contexts do without.
_CONTEXT_SHIFT = np.uint64(24)
SEED = 11

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END, _START = np.uint64(0x5BD1E995A3C4F0D7), np.uint64(0xB492B66FBE98F273)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_PACKED = "bucket int, batch long, check long, words binary, cell_words binary, contexts binary, cell_contexts binary, counts binary"
_SUMS = "part int, bucket int, ids binary, a binary, b binary, contexts binary, tables binary, customers binary, cells binary, roots binary"
_NAMES = [x.split()[0] for x in _SUMS.split(", ")]
#: Ids of the sums for the driver: frequent words have their number.
_ROOT, _SIZE, _CHILD_ONES, _ROOT_ONES = -1, -2, -3, -4


def remainder(ids: Column, folds: int) -> Column:
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(folds))


def frequent_words(training: DataFrame, text_column: str, contexts: int) -> np.ndarray:
    """Sorted hashes of the words that are 1/contexts of all words or more, at six bytes a word;
    as a word and its space have two bytes or more, 3 * contexts at most."""
    text = F.translate(F.col(text_column), _UPPER + "\t\n\x0b\x0c\r", _LOWER + "     ")
    total = (training.agg(F.sum(F.octet_length(text_column) + 1)).first()[0] or 0) / 6
    words = training.select(F.explode(F.split(text, " ")).alias("w")).where(F.col("w") != "")
    rows = words.groupBy("w").count().where(F.col("count") * contexts >= total).select("w").collect()
    raw = [r["w"].encode() for r in rows]
    sizes = np.array([len(x) for x in raw], np.int64)
    ends = np.cumsum(sizes)
    return np.unique(np.append(hash_spans(np.frombuffer(b"".join(raw), np.uint8), ends - sizes, ends), _END))


def _place(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place in the sorted array, or -1."""
    if not len(sorted_values):
        return np.full(len(values), -1)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return np.where(sorted_values[at] == values, at, -1)


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context (short hash of the word before) and text of every token, the end tokens last."""
    before = np.empty(len(words.hashes), np.uint64)
    before[1:] = words.hashes[:-1]
    filled = np.flatnonzero(words.counts)
    before[words.first[filled]] = _START
    last = np.full(words.texts, _START)
    last[filled] = words.hashes[words.first[filled + 1] - 1]
    return np.append(words.hashes, np.full(words.texts, _END)), np.append(before, last) >> _CONTEXT_SHIFT, np.append(words.text_of, np.arange(words.texts))


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash; sorted hashes have sorted parts."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _squeeze(values: np.ndarray) -> bytes:
    """Little integers by planes of bytes, compressed."""
    raw = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if values.itemsize > 1 else values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _squeeze_sorted(values: np.ndarray) -> bytes:
    """Rising numbers by their steps."""
    return _squeeze(np.diff(values, prepend=values.dtype.type(0)))


def _expand_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_expand(data, kind), dtype=kind)


@dataclass
class Cells:
    """Distinct cells of a batch, by bucket, word and context, and the tokens that are theirs."""

    bucket: np.ndarray
    word: np.ndarray
    context: np.ndarray
    cell_of: np.ndarray
    text_of: np.ndarray

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        found, start = np.unique(self.bucket, return_index=True)
        return found, np.append(start, len(self.bucket))


def _cells(texts: list[pa.Array], frequent: np.ndarray, buckets: int) -> Cells:
    parts, base = [], 0
    for t in texts:
        h, context, owner = _tokens(Words(t, NOT_SPACE))
        parts.append((h, context, owner + base))
        base += len(t)
    h, context, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    words, word_of = np.unique(h, return_inverse=True)
    found_contexts, context_of = np.unique(context, return_inverse=True)
    cells, cell_of = np.unique(word_of * len(found_contexts) + context_of, return_inverse=True)
    word, context = cells // len(found_contexts), found_contexts[cells % len(found_contexts)]
    with np.errstate(over="ignore"):
        mixed = mix(words)
        bucket = _part(np.where((_place(frequent, words) >= 0)[word], mix(words[word] + context * _STEP), mixed[word]), buckets)
    order = np.argsort(bucket.astype(np.int16) if buckets < 1 << 15 else bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Cells(bucket[order], words[word[order]], context[order], place[cell_of], owner)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds __batch: rows of a task in the order of the scan, BATCH_BYTES of text and one text at most to each."""
    before = 0
    for batch in batches:
        lengths = pc.binary_length(strings(batch.column("__text"))).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = before + np.cumsum(lengths) - lengths
        before += int(lengths.sum())
        place = batch.column("__place").to_numpy()
        number = (place >> 33 << 33) + starts // BATCH_BYTES
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "__batch"])


def _send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one batch that stand together as one row: keys, ends of the texts and the compressed texts."""
    for batch in _number(batches):
        numbers, places = (batch.column(c).to_numpy() for c in ("__batch", "__place"))
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)] if len(numbers) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            data, offsets = utf8(strings(batch.column("__text").slice(a, b - a)))
            blobs = (batch.column("__key").slice(a, b - a).to_numpy().tobytes(), _squeeze_sorted(offsets[1:].astype(np.int64)), _squeeze(data))
            columns = [pa.array([int(x)], pa.int64()) for x in (numbers[a], places[a])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in blobs)], names=["__batch", "__order", "keys", "ends", "texts"])


def _read_texts(row: dict) -> pa.RecordBatch:
    keys, ends, data = np.frombuffer(row["keys"], np.int64), _expand_sorted(row["ends"], np.int64), _expand(row["texts"], np.uint8)
    offsets = np.concatenate([np.zeros(1, np.int64), ends])
    texts = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["__batch"])), pa.array(keys), texts], names=["__batch", "__key", "__text"])


def _batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[pa.Array], dict[str, np.ndarray]]]:
    """Consecutive rows of one batch: its number, its texts in chunks, and other columns."""
    now, texts, columns = None, [], {n: [] for n in names}

    def done():
        return now, texts, {n: np.concatenate(c) for n, c in columns.items()}

    for batch, chunk in chunks(batches, "__text"):
        numbers = batch.column("__batch").to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if numbers[a] != now and now is not None:
                yield done()
                texts, columns = [], {n: [] for n in names}
            now = int(numbers[a])
            texts.append(chunk.slice(a, b - a))
            for n in names:
                columns[n].append(batch.column(n).slice(a, b - a).to_numpy(zero_copy_only=False))
    if now is not None:
        yield done()


def _checksum(keys: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(mix(keys.view(np.uint64) + np.arange(len(keys), dtype=np.uint64) * _STEP)).view(np.int64))


def _pack(documents: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, texts, columns in _batches(_number(batches), ["__key", "__train"]):
            cells, check = _cells(texts, frequent, buckets), _checksum(columns["__key"])
            counts = np.bincount(cells.cell_of, weights=columns["__train"][cells.text_of], minlength=len(cells.word))
            found, edges = cells.edges()
            blobs: list[list[bytes]] = [[] for _ in range(5)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                words, index = np.unique(cells.word[a:b], return_inverse=True)
                contexts, context_index = np.unique(cells.context[a:b], return_inverse=True)
                own = (_squeeze_sorted(words), _squeeze_sorted(index.astype(np.uint32)), _squeeze_sorted(contexts), _squeeze(context_index.astype(np.uint32)), _squeeze(counts[a:b].astype(np.uint32)))
                for column, v in zip(blobs, own, strict=True):
                    column.append(v)
            same = [pa.array(np.full(len(found), x), pa.int64()) for x in (number, check)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *same, *(pa.array(c, pa.binary()) for c in blobs)], names=["bucket", "batch", "check", "words", "cell_words", "contexts", "cell_contexts", "counts"])

    return documents.mapInArrow(run, _PACKED)


def _dealt(packed: DataFrame, buckets: int) -> DataFrame:
    """A checkpoint by bucket. Only a plan that is not adaptive tells later ones how it is
    dealt, so that groups by bucket are made without sending it again."""
    conf, name = packed.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpoint(packed.repartition(buckets, "bucket"))
    finally:
        conf.set(name, before)


@dataclass
class Sums:
    """What all buckets have together after a sweep, without contexts; arrays by frequent word."""

    frequent_customers: np.ndarray
    frequent_counts: np.ndarray
    frequent_tables: np.ndarray
    root_customers: float
    root_tables: float
    tokens: int
    words: int
    child_discount: float
    root_discount: float

    @property
    def root_new(self) -> float:
        """Probability that the parent asks its base, per word of it."""
        if self.root_customers == 0:
            return 1 / (self.words + 1)
        return (ROOT_STRENGTH + self.root_discount * self.root_tables) / (ROOT_STRENGTH + self.root_customers) / (self.words + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.maximum(customers - self.root_discount * tables, 0) / (ROOT_STRENGTH + self.root_customers) + self.root_new


def _draw_keys(hashes: np.ndarray, seed: int, sweep: int) -> np.ndarray:
    """What the random numbers of each cell or word are drawn by: the same in every bucket and order."""
    with np.errstate(over="ignore"):
        return mix(hashes + np.uint64(mix(np.array([seed * 1_000_003 + sweep], np.uint64))[0]))


def _uniform(keys: np.ndarray, number: int) -> np.ndarray:
    """The number-th random number of each key, above 0 and below 1."""
    with np.errstate(over="ignore"):
        return ((mix(keys + np.uint64(number) * _STEP) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _binomial(trials: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Successes by the inverted distribution at u; the normal one of u and v from a mean of 50 on."""
    q = np.minimum(p, 1 - p)
    mean = trials * q
    normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v) * np.sqrt(mean * (1 - q)) + mean
    few = mean < 50
    odds, term = q / (1 - q), np.where(few, (1 - q) ** np.where(few, trials, 0), 1)
    total, out, k = term.copy(), np.zeros(len(q)), 0
    while (above := few & (u > total) & (out < trials)).any() and k < 400:
        term = term * np.maximum(trials - k, 0) / (k + 1) * odds
        total, out, k = total + term, out + above, k + 1
    out = np.where(few, out, np.clip(np.rint(normal), 0, trials))
    return np.where(p > 0.5, trials - out, out)


def seat(customers: np.ndarray, new_table: np.ndarray, discount: float, keys: np.ndarray, per_table: np.ndarray | None = None) -> np.ndarray:
    """Tables of each dish after its customers came one by one; new_table: the weight of an
    empty table while the dish has none, per_table: what each of its tables adds to that.
    From 64 customers on, an eighth of those present comes at a time. keys: of each dish's draws."""
    out = np.minimum(customers, 1).astype(float)
    more_than_one = np.flatnonzero(customers > 1)
    order = more_than_one[np.argsort(-customers[more_than_one], kind="stable")]
    c, w, drawn = customers[order], new_table[order], keys[order]
    more = np.zeros(len(c)) if per_table is None else per_table[order]
    t = np.ones(len(c))
    present = 1
    while len(c) and (active := int(np.searchsorted(-c, -present, "left"))):
        come = max(1, present // 8) if present >= 64 else 1
        group = np.minimum(come, c[:active] - present)
        weight = w[:active] + more[:active] * t[:active]
        p = weight / (present - discount * t[:active] + weight)
        u = _uniform(drawn[:active], 2 * present)
        t[:active] += u < p if come == 1 else _binomial(group, np.clip(p, 0, 1), u, _uniform(drawn[:active], 2 * present + 1))
        present += come
    out[order] = t
    return out


@dataclass
class Bucket:
    """Training cells of one bucket; `state`: tables of cells, customers and tables in the parent of each word."""

    frequent: np.ndarray
    words: np.ndarray
    contexts: np.ndarray  # of all its cells, sorted
    cell_key: np.ndarray
    cell_count: np.ndarray
    counts: np.ndarray
    state: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __post_init__(self) -> None:
        self.base = len(self.contexts)
        self.cell_word, self.cell_context = self.cell_key // self.base, self.cell_key % self.base
        self.often = _place(self.frequent, self.words)

    def take(self, tables: np.ndarray, root_tables: np.ndarray) -> None:
        self.state = tables, np.bincount(self.cell_word, weights=tables, minlength=len(self.words)), root_tables

    def start(self) -> None:
        """One table a cell, and one a word in the parent."""
        tables = np.ones(len(self.cell_key))
        self.take(tables, np.minimum(np.bincount(self.cell_word, weights=tables, minlength=len(self.words)), 1))

    def sweep(self, number: int, seed: int, last: Sums, child_tables: np.ndarray) -> None:
        """From the state of the sweep before; child_tables: of its contexts in all buckets, then.

        A dish leaves its restaurant with all its tables, in the parent too, before it comes back."""
        tables, customers, root_tables = self.state
        several = np.flatnonzero(self.cell_count > 1)  # the others have one table
        tables, own = tables.copy(), tables[several]
        cell_word, cell_context = self.cell_word[several], self.cell_context[several]
        rare, at = self.often < 0, np.maximum(self.often, 0)
        above = np.where(rare, customers, last.frequent_customers[at])[cell_word] - own
        above_tables = np.minimum(np.where(rare, root_tables, last.frequent_tables[at])[cell_word], above)
        p = last.root(above, above_tables)
        others = child_tables[cell_context] - own
        with np.errstate(over="ignore"):
            cells = _draw_keys(mix(self.words)[cell_word] + self.contexts[cell_context] * _STEP, seed, number)
        tables[several] = seat(self.cell_count[several], (CHILD_STRENGTH + last.child_discount * others) * p, last.child_discount, cells, last.child_discount * p)
        customers = np.bincount(self.cell_word, weights=tables, minlength=len(self.words))
        unit = 1 / (last.words + 1)
        weight = (ROOT_STRENGTH + last.root_discount * (last.root_tables - root_tables)) * unit
        self.take(tables, seat(customers.astype(np.int64), weight, last.root_discount, _draw_keys(self.words, seed, number), np.full(len(weight), last.root_discount * unit)))

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and two numbers each for the driver."""
        _, customers, root_tables = self.state
        rare = (self.often < 0) & (self.counts > 0)
        often = np.flatnonzero((self.often >= 0) & (self.counts > 0))
        ones = [[(x == k).sum() for k in (1, 2)] for x in (self.cell_count, customers[rare])]
        ids = np.concatenate([self.often[often], [_ROOT, _SIZE, _CHILD_ONES, _ROOT_ONES]])
        first = np.concatenate([customers[often], [customers[rare].sum(), self.counts.sum(), ones[0][0], ones[1][0]]])
        second = np.concatenate([self.counts[often], [root_tables[rare].sum(), rare.sum(), ones[0][1], ones[1][1]]])
        return ids, first, second

    def by_context(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables and customers of its own cells by context."""
        return tuple(np.bincount(self.cell_context, weights=w, minlength=self.base).astype(np.uint64) for w in (self.state[0], self.cell_count))


def _bucket(stored: pa.Table, frequent: np.ndarray) -> tuple[Bucket, list[tuple]]:
    """One bucket, and what its batches sent: (batch, check, places of the words, cell keys)."""
    rows = list(zip(*(stored.column(k).to_pylist() for k in range(1, 8)), strict=True))
    own_words, own_contexts = ([_expand_sorted(r[k], np.uint64) for r in rows] for k in (2, 4))
    words, word_at = np.unique(np.concatenate(own_words), return_inverse=True)
    contexts, context_at = np.unique(np.concatenate(own_contexts), return_inverse=True)
    sends, counts, w, c = [], [], 0, 0
    for (batch, check, _, index, _, context_index, count), batch_words, batch_contexts in zip(rows, own_words, own_contexts, strict=True):
        places, context_places = word_at[w : w + len(batch_words)], context_at[c : c + len(batch_contexts)]
        w, c = w + len(places), c + len(context_places)
        sends.append((batch, check, places, places[_expand_sorted(index, np.uint32)] * len(contexts) + context_places[_expand(context_index, np.uint32)]))
        counts.append(_expand(count, np.uint32))
    del rows, own_words, own_contexts
    key, count = np.concatenate([x[3] for x in sends]), np.concatenate(counts)
    key, count = key[count > 0], count[count > 0]
    cells, index = np.unique(key, return_inverse=True)
    count = np.bincount(index, weights=count, minlength=len(cells)).astype(np.int64)
    total = np.bincount(cells // len(contexts), weights=count, minlength=len(words))
    return Bucket(frequent, words, contexts, cells, count, total), sends


@dataclass
class Known:
    """What a bucket has stored of one sweep: its state, and the totals of its contexts over all buckets."""

    cells: np.ndarray
    roots: np.ndarray
    child_tables: np.ndarray | None
    child_customers: np.ndarray | None


def _known(rows: pa.Table, contexts: int) -> Known:
    def joined(name: str) -> np.ndarray | None:
        own = rows.filter(pc.is_valid(rows.column(name))).sort_by("part").column(name).to_pylist()
        return np.concatenate([_expand(x, np.uint64) for x in own]).astype(float) if own else None

    out = Known(*(joined(name) for name in ("cells", "roots", "tables", "customers")))
    if any(x is not None and len(x) != contexts for x in (out.child_tables, out.child_customers)):
        raise RuntimeError("totals of other contexts")
    return out


def _by(rows: pa.Table, column: str) -> dict[int, pa.Table]:
    return {k: rows.filter(pc.equal(rows.column(column), k)) for k in pc.unique(rows.column(column)).to_pylist()}


def _row(part: int, bucket: int | None, **values: bytes | None) -> dict:
    return dict.fromkeys(_NAMES) | {"part": part, "bucket": bucket} | values


_SUMS_ARROW = pa.schema([(n, pa.int32() if n in ("part", "bucket") else pa.binary()) for n in _NAMES])


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a part over all buckets: one row with each id once, and for each bucket the totals
    of the contexts that it sent. States pass."""
    held = list(batches)
    for part, own in _by(pa.Table.from_batches(held), "part").items() if held else ():
        yield from own.filter(pc.is_valid(own.column("cells"))).to_batches()
        numbers = own.filter(pc.is_valid(own.column("ids")))
        rows = []
        if len(numbers):
            ids, a, b = (np.concatenate([np.frombuffer(x, kind) for x in numbers.column(n).to_pylist()]) for n, kind in (("ids", np.int64), ("a", float), ("b", float)))
            found, at = np.unique(ids, return_inverse=True)
            rows.append(_row(part, None, ids=found.tobytes(), **{n: np.bincount(at, weights=x, minlength=len(found)).tobytes() for n, x in (("a", a), ("b", b))}))
        sent = own.filter(pc.is_valid(own.column("contexts")))
        buckets = sent.column("bucket").to_pylist()
        if buckets:
            contexts = [_expand_sorted(x, np.uint64) for x in sent.column("contexts").to_pylist()]
            found, at = np.unique(np.concatenate(contexts), return_inverse=True)
            ends = np.cumsum([len(x) for x in contexts])
            totals = {}
            for name in ("tables", "customers"):
                values = sent.column(name).to_pylist()
                if values[0] is None:
                    totals[name] = values
                    continue
                total = np.bincount(at, weights=np.concatenate([_expand(x, np.uint64) for x in values]), minlength=len(found)).astype(np.uint64)
                totals[name] = [_squeeze(total[at[e - len(x) : e]]) for x, e in zip(contexts, ends, strict=True)]
            rows += [_row(part, k, tables=t, customers=c) for k, t, c in zip(buckets, totals["tables"], totals["customers"], strict=True)]
        if rows:
            yield from pa.Table.from_pylist(rows, _SUMS_ARROW).to_batches()


def _discount(ones: float, twos: float) -> float:
    """The usual estimate from how many things were seen once and twice."""
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def _sums(rows: list, frequent: np.ndarray, sweep: int, past: list[Sums], seed: int) -> Sums:
    numbers = [np.concatenate([np.frombuffer(r[n], kind) for r in rows]).tolist() if rows else [] for n, kind in (("ids", np.int64), ("a", float), ("b", float))]
    found = {k: (a, b) for k, a, b in zip(*numbers, strict=True)}
    often = np.array([found.get(k, (0.0, 0.0)) for k in range(len(frequent))])
    (rare_customers, rare_tables), (tokens, rare_words) = found.get(_ROOT, (0.0, 0.0)), found.get(_SIZE, (0.0, 0.0))
    customers = often[:, 0]
    words = int(rare_words + (often[:, 1] > 0).sum())
    if sweep == 0:
        tables = np.minimum(customers, 1)
        discounts = _discount(*found.get(_CHILD_ONES, (0, 0))), _discount(*found.get(_ROOT_ONES, (0, 0)))
    else:
        last = past[-1]
        discounts = last.child_discount, last.root_discount
        unit = 1 / (last.words + 1)
        weight = (ROOT_STRENGTH + last.root_discount * (last.root_tables - last.frequent_tables)) * unit
        tables = seat(customers.astype(np.int64), weight, last.root_discount, _draw_keys(frequent, seed, sweep), np.full(len(weight), last.root_discount * unit))
    return Sums(customers, often[:, 1], tables, float(rare_customers + customers.sum()), float(rare_tables + tables.sum()), int(tokens), words, *discounts)


def score(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, contexts: int = CONTEXTS, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = SEED) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    spark = documents.sparkSession
    if spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) is None:  # else an executor that comes or goes changes the splits
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(spark.sparkContext.defaultParallelism))
    samples = range(burn_in + 1, sweeps + 1)
    out = F.coalesce(remainder(F.col(id_column), folds) == held_out, F.lit(False))
    text = F.coalesce(F.col(text_column), F.lit(""))
    chosen = documents.select(F.col(id_column).alias("__id"), text.alias("__text"), out.alias("__held_out"), F.xxhash64(F.lit(seed), id_column, text).alias("__key"))
    frequent = frequent_words(chosen.where(~F.col("__held_out")), "__text", contexts)
    place = F.monotonically_increasing_id()
    scanned = chosen.select("__text", "__key", (~F.col("__held_out")).alias("__train"), place.alias("__place"))
    size = chosen.agg(F.sum(F.octet_length("__text")), F.count("*")).first()
    buckets = max(partitions(spark), -(-((size[0] or 0) // 6 + size[1]) // BUCKET_TOKENS))
    stored = _dealt(_pack(scanned, frequent, buckets), buckets)
    release(spark)

    parts = max(partitions(spark), buckets // 8)

    past: list[Sums] = []
    kept: list[DataFrame] = []
    for s in range(sweeps + 1):

        def one(rows: pa.Table, known: pa.Table | None, s: int, last: Sums | None) -> pa.Table:
            number = rows.column("bucket")[0].as_py()
            bucket, _ = _bucket(rows, frequent)
            if known is None:
                bucket.start()
            else:
                before = _known(known, bucket.base)
                bucket.take(before.cells, before.roots)
                bucket.sweep(s, seed, last, before.child_tables)
            ids, *numbers = bucket.sums()
            tables, customers = bucket.by_context()
            part_of = _part(bucket.contexts << _CONTEXT_SHIFT, parts)
            out = []
            for part in np.union1d(ids % parts, part_of).tolist():
                i, j = np.searchsorted(part_of, [part, part + 1])
                mine = ids % parts == part
                values = {n: x[mine].tobytes() for n, x in zip(("ids", "a", "b"), (ids.astype(np.int64), *(x.astype(float) for x in numbers)), strict=True)} if mine.any() else {}
                if i < j:
                    values |= {"contexts": _squeeze_sorted(bucket.contexts[i:j]), "tables": _squeeze(tables[i:j]), "customers": _squeeze(customers[i:j]) if s == 0 else None}
                out.append(_row(part, number, **values))
            cells, _, roots = bucket.state
            out.append(_row(number % parts, number, cells=_squeeze(cells.astype(np.uint64)), roots=_squeeze(roots.astype(np.uint64))))
            return pa.Table.from_pylist(out, _SUMS_ARROW)

        grouped, now, then = stored.groupBy("bucket"), s, past[-1] if past else None
        if not kept:
            sent = grouped.applyInArrow(lambda rows: one(rows, None, now, then), _SUMS)
        else:
            sent = grouped.cogroup(kept[-1].groupBy("bucket")).applyInArrow(lambda rows, known: one(rows, known, now, then), _SUMS)
        added = checkpoint(sent.repartitionById(parts, F.col("part")).mapInArrow(_add_sums, _SUMS))
        rows = added.where(F.col("bucket").isNull()).select("ids", "a", "b").collect()  # 3 * contexts + 5 ids at most
        past.append(_sums(rows, frequent, s, past, seed))
        kept.append(added.where(F.col("bucket").isNotNull()).select("bucket", F.lit(s).alias("sweep"), "part", "tables", "customers", "cells", "roots"))
        del sent, added
        release(spark)

    def answer(rows: pa.Table, known: pa.Table) -> pa.Table:
        """For each batch: probabilities of its cells, and counts of their words."""
        number = rows.column("bucket")[0].as_py()
        bucket, sends = _bucket(rows, frequent)
        states = {s: _known(own, bucket.base) for s, own in _by(known, "sweep").items()}
        often, at = bucket.often >= 0, np.maximum(bucket.often, 0)
        counts = np.where(often, past[0].frequent_counts[at], bucket.counts).astype(np.uint64)
        context_customers, roots = states[0].child_customers, []
        for s in samples:
            bucket.take(states[s].cells, states[s].roots)
            _, customers, tables = bucket.state
            roots.append(past[s].root(np.where(often, past[s].frequent_customers[at], customers), np.where(often, past[s].frequent_tables[at], tables)))
        replies = []
        for batch_number, check, places, key in sends:
            word, context = key // bucket.base, key % bucket.base
            cell = _place(bucket.cell_key, key)
            p = np.zeros(len(key))
            for s, root in zip(samples, (r[word] for r in roots), strict=True):
                sums = past[s]
                own = np.where(cell >= 0, np.maximum(bucket.cell_count[cell] - sums.child_discount * states[s].cells[cell], 0), 0) if len(bucket.cell_key) else np.zeros(len(key))
                customers = context_customers[context]
                child = (own + (CHILD_STRENGTH + sums.child_discount * states[s].child_tables[context]) * root) / (CHILD_STRENGTH + customers)
                p += np.where(customers > 0, child, root) / len(samples)
            replies.append((batch_number, number, check, _squeeze(np.log10(p).astype(np.float32)), _squeeze(counts[places])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*replies, strict=True), kinds, strict=True)], names=["__batch", "__order", "check", "p", "counts"])

    unit = 1 / (past[0].tokens + 0.5 * (past[0].words + 1))
    schema = "__key long, n long, known long, base double, p double"

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: the answers to a batch by bucket, then its texts in their order."""
        answers: dict[int, list] = {}

        def texts_only() -> Iterator[pa.RecordBatch]:
            for part in batches:
                for k in range(len(part)):
                    r = part.slice(k, 1).to_pylist()[0]
                    if r["keys"] is None:
                        answers.setdefault(r["__batch"], []).append((r["check"], _expand(r["p"], np.float32), _expand(r["counts"], np.uint64)))
                    else:
                        yield _read_texts(r)

        for number, texts, columns in _batches(texts_only(), ["__key"]):
            got = answers.pop(number)
            cells, keys = _cells(texts, frequent, buckets), columns["__key"]
            if any(check != _checksum(keys) for check, _, _ in got) or sum(len(p) for _, p, _ in got) != len(cells.word):
                raise RuntimeError("a second scan of the documents gave other batches")
            _, edges = cells.edges()
            counts = np.concatenate([c[np.unique(cells.word[a:b], return_inverse=True)[1]] for (_, _, c), a, b in zip(got, edges[:-1], edges[1:], strict=True)]).astype(float)
            values = (np.concatenate([p for _, p, _ in got]).astype(float), np.log10((counts + 0.5) * unit), counts > 0)
            p, base, known = (np.bincount(cells.text_of, weights=v[cells.cell_of], minlength=len(keys)) for v in values)
            n = np.bincount(cells.text_of, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(p)], names=["__key", "n", "known", "base", "p"])

    totals = kept[0]
    for s in samples:
        totals = totals.union(kept[s])
    replies = stored.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(answer, "__batch long, __order long, check long, p binary, counts binary")
    texts = scanned.drop("__train").mapInArrow(_send_texts, "__batch long, __order long, keys binary, ends binary, texts binary")
    replies = replies.withColumn("is_text", F.lit(False))
    together = replies.unionByName(texts.withColumn("is_text", F.lit(True)), allowMissingColumns=True)
    together = together.repartition(max(partitions(spark), buckets // 2), "__batch").sortWithinPartitions("__batch", "is_text", "__order")
    sums_of = together.mapInArrow(add_up, schema).dropDuplicates(["__key"])
    joined = chosen.drop("__text").join(sums_of, "__key")
    return joined.select(
        F.col("__id").alias(id_column), F.col("__held_out").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(past[0].tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("p").alias("score"), F.pow(F.lit(10.0), -F.col("p") / F.col("n")).alias("perplexity"),
    )
