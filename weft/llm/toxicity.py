"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed lexicon and of a lexicon learned from
labels, how often lexicon words stand near the second person, capitals, punctuation,
repeated letters, and words that hide a lexicon word behind digits or signs. The labelled
rows (at most `most_labelled`, those with the smallest hashes of their ids, the bound of all
that the driver gathers for the fit) are dealt by hash into a part that the lexicon is
learned from, one for the trees and one for the calibration, so that none judges its own
work. Of the words that `least_texts` texts of that part have, the `most` that tell labels
apart best are the learned lexicon. A score is 99 % the calibrated probability and 1 % the
trees' own, so that texts on one step of the calibration keep their order.

Defined results: null and empty texts have no words and get the score of a text with all
features 0; a row is held out if crc32 of its id as text leaves `held_out` modulo
`folds`, and a null id is not; labels that are null are left out, of several for one id
the larger holds, and of several texts the smallest; without labels of both kinds the score is a fixed function of the
lexicon's density; rows that repeat are each answered; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._common import LOWER, NOT_SPACE, byte_set, chunks, hash_spans, utf8

MOST_LABELLED = 16_000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3

#: Words that insult, and words of the second person.
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools clown loser losers pathetic worthless disgusting scum trash garbage filth vermin ugly"
    " hate kill die shut crap damn bitch bastard asshole dick shit shitty fuck fucking fucker whore slut retard retarded jerk creep freak pig pigs nazi imbecile"
    " dämlich dumm dummkopf trottel arschloch scheiße scheisse abschaum müll versager wichser hurensohn blöd widerlich"
    " imbécile connard connasse salaud salope merde débile ordure raclure minable pauvre crétin dégueulasse"
    " imbécil estúpido estúpida tonto idiota basura escoria mierda puta cabrón gilipollas asqueroso inútil patético"
).split()
SECOND_PERSON = "you your yours youre yourself yourselves u ur du dich dir dein deine euch ihr sie tu toi te ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
#: Signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
NEAR = 5

_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_CAPITAL = byte_set((0x41, 0x5A))
_ASCII_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_SIGN = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_DIGIT = byte_set((0x30, 0x39))
_PLAIN = LOWER.copy()
_DECODED = LOWER.copy()
for _sign, _letter in STANDS_FOR.items():
    _DECODED[ord(_sign)] = ord(_letter)
_DECODABLE = _LETTER | np.isin(np.arange(256), [ord(x) for x in STANDS_FOR])

FEATURES = (
    "log_words lexicon lexicon_log learned learned_log learned_most hidden hidden_log second near_second capitals capital_words exclaims questions signs digit_words repeats beyond_ascii"
).split()


def word_hash(words: list[str]) -> np.ndarray:
    raw = [w.lower().encode() for w in words]
    ends = np.cumsum([len(x) for x in raw])
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)


class Text:
    """Words of a chunk of texts (cut at white space), as hashes of their letters."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = utf8(texts)
        self.n = len(texts)
        inside = NOT_SPACE[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[self.offsets[self.offsets < len(inside)]] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        ends = self.offsets[self.offsets > 0]
        after[ends - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.owner = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.words = np.bincount(self.owner, minlength=self.n)
        self.plain = self._hash(_LETTER, _PLAIN)
        self.decoded = self._hash(_DECODABLE, _DECODED)

    def _hash(self, kept: np.ndarray, to: np.ndarray) -> np.ndarray:
        keep = kept[self.data]
        place = np.concatenate([[0], np.cumsum(keep)])
        return hash_spans(to[self.data[keep]], place[self.starts], place[self.ends])

    def bytes_in(self, which: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(which[self.data] if len(which) == 256 else which)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words_with(self, which: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(which[self.data])])
        return total[self.ends] - total[self.starts]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=flags, minlength=self.n)


def _lookup(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place in the sorted array of known hashes, or -1."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return np.where(known[at] == hashes, at, -1)


_LEXICON_HASHES, _SECOND_HASHES = np.unique(word_hash(LEXICON)), np.unique(word_hash(SECOND_PERSON))


def features(texts: pa.Array, learned: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """FEATURES of each text; learned: sorted word hashes and their weights."""
    t = Text(texts)
    known, weights = learned
    plain = _lookup(t.plain, _LEXICON_HASHES) >= 0
    at = _lookup(t.plain, known)
    weight = np.where(at >= 0, weights[at] if len(weights) else 0.0, 0.0)
    hidden = ~plain & (at < 0) & ((_lookup(t.decoded, _LEXICON_HASHES) >= 0) | (_lookup(t.decoded, known) >= 0))
    second = _lookup(t.plain, _SECOND_HASHES) >= 0
    insult = plain | hidden | (weight > 0)
    index = np.flatnonzero(insult)
    places = np.flatnonzero(second)
    near = np.zeros(len(insult))
    if len(index) and len(places):
        k = np.searchsorted(places, index)
        for side in (np.minimum(k, len(places) - 1), np.maximum(k - 1, 0)):
            near[index[(np.abs(places[side] - index) <= NEAR) & (t.owner[places[side]] == t.owner[index])]] = 1
    most = np.zeros(t.n)
    np.maximum.at(most, t.owner, weight)
    letters = t.words_with(_ASCII_LETTER)
    capital = t.words_with(_CAPITAL)
    mixed = (t.words_with(_LETTER) > 0) & (t.words_with(_DIGIT) > 0)
    same = np.zeros(len(t.data), bool)
    if len(same) > 2:
        same[2:] = (t.data[2:] == t.data[1:-1]) & (t.data[2:] == t.data[:-2]) & _LETTER[t.data[2:]]
    n = np.maximum(t.words, 1)
    size = np.maximum(np.diff(t.offsets), 1)
    count = {name: t.per_text(x) for name, x in (("plain", plain), ("weight", weight), ("hidden", hidden), ("second", second), ("near", near), ("insult", insult))}
    return np.column_stack([
        np.log1p(t.words), count["plain"] / n, np.log1p(count["plain"]), count["weight"] / n, np.log1p(count["weight"]), most, count["hidden"] / n, np.log1p(count["hidden"]),
        count["second"] / n, count["near"] / np.maximum(count["insult"], 1), t.bytes_in(_CAPITAL) / np.maximum(t.bytes_in(_ASCII_LETTER), 1), t.per_text((letters > 1) & (letters == capital)) / n,
        t.bytes_in(byte_set((0x21, 0x21))) / size, t.bytes_in(byte_set((0x3F, 0x3F))) / size, t.bytes_in(_SIGN) / size, t.per_text(mixed) / n, t.bytes_in(same) / size, t.bytes_in(byte_set((0x80, 0xFF))) / size,
    ])


def learn_lexicon(rows: DataFrame, most: int = 500, least_texts: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Words much likelier in toxic texts (__text, __toxic): hashes and log odds (shrunk), at
    most `most`. Texts are counted by word where they are; only the words chosen come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text"):
            t, toxic = Text(texts), batch.column("__toxic").to_numpy()
            order = np.lexsort((t.owner, t.plain))
            word, owner = t.plain[order], t.owner[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
            words, where = np.unique(word[new], return_inverse=True)
            bad, all_ = np.bincount(where, weights=toxic[owner[new]], minlength=len(words)), np.bincount(where, minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(bad), pa.array(all_.astype(float))], names=["word", "bad", "n"])

    size = rows.agg(F.sum("__toxic"), F.count("*")).first()
    share = min(max((size[0] or 0.0) / max(size[1], 1), 1e-6), 1 - 1e-6)
    counted = rows.select("__text", "__toxic").mapInArrow(run, "word long, bad double, n double").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where(F.col("bad") >= least_texts)
    odds = F.log((F.col("bad") + 4 * share) / (F.col("n") - F.col("bad") + 4 * (1 - share))) - float(np.log(share / (1 - share)))
    kept = counted.select("word", odds.alias("odds")).where(F.col("odds") > 1.0).orderBy(F.col("odds").desc(), "word").limit(most).collect()
    words = np.array([r["word"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r["odds"] for r in kept])[order]


@dataclass
class Trees:
    """Boosted regression trees on the log odds; each tree is a list of (feature, edge, left, right, value)."""

    base: float
    trees: list[list[tuple[int, float, int, int, float]]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            feature, edge, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                k = at[rows]
                at[rows] = np.where(x[rows, feature[k]] <= edge[k], left[k], right[k])
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.12, least: int = 20, bins: int = 48, shrink: float = 2.0) -> Trees:
    """Gradient boosting with second-order leaf values over quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    out = Trees(float(np.log(share / (1 - share))), [])
    margin = np.full(len(y), out.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        nodes: list[list] = []

        def grow(rows: np.ndarray, left_depth: int, g=g, h=h, nodes=nodes) -> int:
            me = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, -1, -1, rate * total_g / (total_h + shrink)])
            best = (1e-3, -1, 0)
            if left_depth and len(rows) >= 2 * least:
                for f in range(x.shape[1]):
                    k = len(edges[f]) + 1
                    if k == 1:
                        continue
                    b = binned[rows, f]
                    gs, hs, ns = np.cumsum(np.bincount(b, g[rows], k))[:-1], np.cumsum(np.bincount(b, h[rows], k))[:-1], np.cumsum(np.bincount(b, minlength=k))[:-1]
                    gain = gs**2 / (hs + shrink) + (total_g - gs) ** 2 / (total_h - hs + shrink) - total_g**2 / (total_h + shrink)
                    gain[(ns < least) | (len(rows) - ns < least)] = -1
                    if gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] >= 0:
                go = binned[rows, best[1]] <= best[2]
                nodes[me][0], nodes[me][1] = best[1], float(edges[best[1]][best[2]])
                nodes[me][2] = grow(rows[go], left_depth - 1)
                nodes[me][3] = grow(rows[~go], left_depth - 1)
            return me

        grow(np.arange(len(y)), depth)
        out.trees.append([tuple(n) for n in nodes])
        margin += Trees(0.0, out.trees[-1:]).margin(x)
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins (block means) and their calibrated probabilities."""
    blocks: list[list[float]] = []
    for m, v in sorted(zip(margin.tolist(), y.tolist(), strict=True)):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


@dataclass
class Model:
    learned: tuple[np.ndarray, np.ndarray]
    trees: Trees | None
    steps: tuple[np.ndarray, np.ndarray] | None

    def score(self, texts: pa.Array) -> np.ndarray:
        x = features(texts, self.learned)
        if self.trees is None:
            return 1 - np.exp(-20 * (x[:, 1] + x[:, 6]))
        margin = self.trees.margin(x)
        return np.clip(0.99 * np.interp(margin, *self.steps) + 0.01 / (1 + np.exp(-margin)), 0, 1)


def fit(rows: DataFrame) -> Model:
    """rows: __text, __toxic, __part (0 to 99) and __order. Below 45 the lexicon is learned,
    below 80 the trees, then the calibration. Features are made where the texts are."""
    learned = learn_lexicon(rows.where(F.col("__part") < 45))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text"):
            x = pa.FixedSizeListArray.from_arrays(pa.array(features(texts, learned).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], names=["toxic", "part", "at", "x"])

    made = rows.where(F.col("__part") >= 45).select("__toxic", "__part", "__order", "__text").mapInArrow(run, "toxic double, part long, at long, x array<double>")
    found = made.toPandas()
    x = np.array(found["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, found["toxic"].to_numpy(), found["at"].to_numpy()))  # the same whatever the partitions
    x, toxic, part = x[order], found["toxic"].to_numpy(float)[order], found["part"].to_numpy()[order]
    grow, fix = part < 80, part >= 80
    if any(k.sum() < 20 or len(set(toxic[k].tolist())) < 2 for k in (grow, fix)):
        return Model((np.empty(0, np.uint64), np.empty(0)), None, None)
    trees = boost(x[grow], toxic[grow])
    return Model(learned, trees, isotonic(trees.margin(x[fix]), toxic[fix]))


def remainder(ids: Column, folds: int) -> Column:
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(folds))


def train(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, most_labelled: int = MOST_LABELLED) -> Model:
    usable = labels.where(F.col(label_column).isNotNull() & (remainder(F.col(id_column), folds) != held_out))
    sample = usable.groupBy(F.col(id_column).alias("__id")).agg(F.max(label_column).cast("double").alias("__toxic")).orderBy(F.xxhash64("__id"), "__id").limit(most_labelled)
    chosen = documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    # one text for each labelled id, however often its rows repeat
    labelled = chosen.join(F.broadcast(sample), "__id").groupBy("__id", "__toxic").agg(F.min("__text").alias("__text"))
    rows = labelled.select("__text", "__toxic", F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(100)).alias("__part"), F.xxhash64("__id").alias("__order"))
    return fit(rows)


def _scored(documents: DataFrame, model: Model, kept: list[str], text_column: str) -> DataFrame:
    chosen = documents.select(*(F.col(c) for c in kept), F.col(text_column).alias("__text"))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("__score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(texts), pa.float64())], names=schema.names)

    return chosen.mapInArrow(run, schema)


def score(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    model = train(documents, labels, id_column, text_column, **options)
    out = F.coalesce(remainder(F.col(id_column), options.get("folds", FOLDS)) == options.get("held_out", HELD_OUT), F.lit(False))
    return _scored(documents, model, [id_column], text_column).select(id_column, out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame, text_column: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    model = train(documents, labels, text_column=text_column, **options)
    names = documents.columns
    renamed = documents.toDF(*(f"__c{k}" for k in range(len(names))))
    return _scored(renamed, model, renamed.columns, f"__c{names.index(text_column)}").where(F.col("__score") < threshold).drop("__score").toDF(*names)
