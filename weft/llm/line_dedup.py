"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its lower-cased words. A line goes when an earlier line (smaller
id, then smaller line number) has a Jaccard similarity of SHARE % or more to it; lines
of fewer than `least_words` distinct words stay.

1. Lines are reduced to sets: one row for each different set of words, at its earliest
   place, with 32 bits of each word's hash. All later lines of a set go. Partial aggregates
   keep a line that makes up a third of the corpus out of any one task.
2. Rarity: words of all sets are counted in SLOTS hashed slots. A word's code has its
   slot's frequency class above its hash, so sorted codes run from rare to common. A set
   goes on with its rarest codes, its size and a parity sketch.
3. Near copies at once: sets that share two neighbours among the first or the last codes of
   their prefix are compared with the first and the few before them. This is linear in the size of a group, and settles most lines that
   have a match, so that no group of near copies meets in all its pairs below.
4. Prefix filter: each set posts the rarest words that a match of no more words cannot avoid,
   and the rarest that one of no fewer cannot avoid, which are half as many. The join of both
   is by word and band of sizes, so that a set meets only sets that are four fifths of it or
   more; position and sketch filters, and that the later one is still open, are conditions of
   the join itself.
5. Jaccard on the words decides in both cases.

Codes may collide, which only adds candidates: prefix, position and size filters hold for
multisets of codes as well. Sets are told apart by 128 bits of hash.

Defined results: null text has no lines and stays null; empty lines stay; rows that
repeat (same id and text) are one document, and all get its answer; where rows of one id
differ in text, a line number that stays in one stays in all; a null id comes before all
others; an empty table gives an empty result; other columns are kept by `dedup` and
ignored elsewhere.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._common import owned_dir, release, stored, written

SHARE, PER = 80, 100
LEAST_WORDS = 5
#: What the registered query and the pipeline take: every line that has a word.
ALL_LINES = 1
SLOTS = 131_072
#: Rows (id, line number) that are sent to all executors at most; more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: A code is a number of 31 bits: 7 of its class above so many of its hash.
_HASH_BITS = 24
#: Sizes of one band differ by this factor at most.
_BAND = 2.0
#: Parity sketches of 64 bits: of all words and, for lines of more than LONG words, of the
#: words in three of four hash classes (the fourth follows from them).
_SKETCH = ("s0", "s1", "s2", "s3")
LONG = 56
#: The postings are joined in so many parts, by code, one after the other: less disk at once.
_PARTS = 2
#: Sets of one key are compared with the first and so many before them, in groups of about so many.
_BACK, _MOST_MET = 16, 2000
#: Codes that are kept of every set, for the quick comparison.
_RAREST = 3
#: How tables that are mostly hashes are stored: Parquet would look for repeats that they do not have.
_NO_REPEATS = {"parquet.enable.dictionary": "false"}
#: White space inside lines.
_WHITE = " \t\x0b\x0c\r"


def _plain(text: Column) -> Column:
    """Lower case, with spaces as the only white space inside lines."""
    other = reduce(Column.__or__, (text.contains(c) for c in _WHITE[1:]))
    return F.lower(F.when(other, F.translate(text, _WHITE[1:], "    ")).otherwise(text))


def _word_set(line: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(_plain(line), " ")), "")


def lines_of(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc, line_no and line of every line, in the order of the text."""
    return documents.select(F.col(id_column).alias("doc"), F.posexplode(F.split(F.col(text_column), "\n")).alias("line_no", "line"))


def _classes(hashed: DataFrame) -> str:
    """A class for each slot, four times the binary logarithm of its count in the sets' hashes, as a
    JSON array of SLOTS small numbers: Java keeps one object for each of these."""
    h = F.col("h")
    # a row for two slots: half the keys stay in the small, fast table of Spark's aggregates
    counted = hashed.select(F.explode("h").alias("h")).groupBy(F.shiftright(_slot(h), 1).alias("pair")).agg(F.count("*").alias("both"), F.sum(h.bitwiseAND(1)).alias("odd"))
    pairs = hashed.sparkSession.range(SLOTS // 2).select(F.col("id").cast("int").alias("pair")).join(counted, "pair", "left")

    def of_slot(count: Column) -> Column:
        return F.least(F.lit(127), F.floor(4 * F.log2(F.coalesce(count, F.lit(0)) + 1))).cast("int")

    two = F.array(of_slot(F.col("both") - F.col("odd")), of_slot(F.col("odd")))
    listed = F.sort_array(F.collect_list(F.struct("pair", two.alias("classes"))))  # SLOTS / 2 rows, whatever the input
    return pairs.agg(F.to_json(F.flatten(F.transform(listed, lambda s: s["classes"]))).alias("classes")).first()["classes"]


def _slot(hashed: Column) -> Column:
    return hashed.bitwiseAND(SLOTS - 1)


def rarity_classes(documents: DataFrame, text_column: str) -> str:
    """The classes of the words of a table's lines."""
    return _classes(_hashed(documents, text_column, text_column, ALL_LINES))


def _far(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Words of only one of two sets, at least: bits in which their sketches differ."""
    d0, d1, d2, d3 = (a[c].bitwiseXOR(b[c]) for c in _SKETCH)
    rest = d0.bitwiseXOR(d1).bitwiseXOR(d2).bitwiseXOR(d3)
    return F.when((a["n"] > LONG) & (b["n"] > LONG), F.bit_count(rest) + F.bit_count(d1) + F.bit_count(d2) + F.bit_count(d3)).otherwise(F.bit_count(d0))


def _near(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Size and sketch filters. Sets of n and m that match share (n + m) * SHARE / (SHARE + PER)
    words or more, and differ in the rest."""
    n, m = a["n"], b["n"]
    few, both = F.lit(PER - SHARE), F.lit(SHARE + PER)
    sizes = (n * PER >= m * SHARE) & (m * PER >= n * SHARE)
    return sizes & (F.bit_count(a["s0"].bitwiseXOR(b["s0"])) * both <= (n + m) * few) & (_far(a, b) * both <= (n + m) * few)


def _before(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """a stands before b; a null id before all others."""
    doc, other = a["doc"], b["doc"]
    first = (doc.isNull() & other.isNotNull()) | F.coalesce(doc < other, F.lit(False))
    return first | (doc.eqNullSafe(other) & (a["line_no"] < b["line_no"]))


def _prefix_length(n: Column) -> Column:
    """Of a set of n words, so many of the rarest that a match of n words or fewer has one of them."""
    return n - F.ceil(n * SHARE / PER).cast("int") + 1


def _short_prefix_length(n: Column) -> Column:
    """The same for matches of n words or more."""
    return n - F.ceil(n * (2 * SHARE) / (SHARE + PER)).cast("int") + 1


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(_BAND)).cast("int")


def _hashed(documents: DataFrame, id_column: str, text_column: str, least_words: int) -> DataFrame:
    """doc, line_no and 32 bits of the words' hashes (h, in order) of every different set of words, at
    its earliest place; ends: where the first three of four classes of hashes end, if it is long."""
    lines = documents.select(F.col(id_column).alias("doc"), F.posexplode(F.split(_plain(F.col(text_column)), "\n")).alias("line_no", "line"))
    if least_words == 1:  # a condition on the hashes would have Spark make them twice
        lines, enough = lines.where(F.trim("line") != ""), F.lit(True)
    else:
        enough = F.size("h") >= least_words
    hashes = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    whole = lines.select("doc", "line_no", F.sort_array(hashes).alias("h")).where(enough)
    # sets are told apart by all bits
    halves = F.transform("h", lambda h: F.shiftright(h, 32).cast("int"))
    first = [F.lit(k << 62) for k in (-1, 0, 1)]  # of each class but the lowest
    mixed = F.when(F.size("h") > LONG, F.sort_array(F.concat("h", F.array(*first))))
    ends = F.array(*(F.coalesce(F.array_position("mixed", x).cast("int") - (k + 1), F.size("h")) for k, x in enumerate(first)))
    keyed = whole.withColumn("mixed", mixed).select("doc", "line_no", halves.alias("h"), ends.alias("ends"), F.xxhash64("h").alias("k1"), F.xxhash64(F.lit(1), "h").alias("k2"))
    return keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc", "line_no", "h", "ends")).alias("e")).select("e.*")


def _coded(hashed: DataFrame, rarity: str) -> DataFrame:
    """doc, line_no, n, sketch and rarest codes of every set."""
    classes = F.from_json(F.lit(rarity), "array<int>")

    def code(h: Column) -> Column:
        # never null, which lets Spark sort plain numbers
        return F.coalesce(F.shiftleft(F.get(classes, _slot(h)), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 32 - _HASH_BITS)), F.lit(0))

    def parity(values: Column) -> Column:
        # a shift takes the last six bits of its number
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h)))

    n = F.size("h")
    bounds = [F.lit(0), *(F.get("ends", k) for k in range(3)), n]
    # Only long sets are sliced, and each slice is used twice, so that Spark keeps it as a column: inside
    # of an aggregate it would be interpreted, a boxed number for each word.
    slices = [F.when(n > LONG, F.slice("h", a + 1, b - a)).alias(f"q{k}") for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    short = [parity(F.col("h")), *[F.lit(0).cast("long")] * 3]
    parts = [F.when(F.col(f"q{k}").isNotNull(), parity(F.col(f"q{k}"))).otherwise(x).alias(f"p{k}") for k, x in enumerate(short)]
    codes = F.slice(F.sort_array(F.transform("h", code)), F.lit(1), F.greatest(_prefix_length(n), F.lit(_RAREST)))
    coded = hashed.select("doc", "line_no", "h", *slices).select("doc", "line_no", n.alias("n"), *parts, codes.alias("codes"))
    whole = reduce(Column.bitwiseXOR, (F.col(f"p{k}") for k in range(4)))
    return coded.select("doc", "line_no", "n", whole.alias("s0"), *(F.col(f"p{k}").alias(f"s{k}") for k in (1, 2, 3)), "codes")


def _sets(documents: DataFrame, id_column: str, text_column: str, rarity: str, least_words: int) -> DataFrame:
    """doc, line_no, n, sketch and rarest codes of every different set of words, at its earliest place."""
    return _coded(_hashed(documents, id_column, text_column, least_words), rarity)


def _stored_sets(documents: DataFrame, id_column: str, text_column: str, least_words: int) -> DataFrame:
    """The sets, stored; their hashes, from which words are counted, are stored on the way only."""
    spark = documents.sparkSession

    def build() -> DataFrame:
        # hashes do not compress
        hashed = stored(_hashed(documents, id_column, text_column, least_words), compression="snappy", **_NO_REPEATS)
        release(spark)
        return _coded(hashed, _classes(hashed))

    return written(spark, build, f"{owned_dir(spark)}/line-sets-{uuid.uuid4().hex}", compression="zstd", **_NO_REPEATS)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _same_place(a: str, b: str) -> Column:
    return F.col(f"{a}doc").eqNullSafe(F.col(f"{b}doc")) & (F.col(f"{a}line_no") == F.col(f"{b}line_no"))


def _few(places: DataFrame) -> bool:
    return places.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _small(places: DataFrame) -> DataFrame:
    """Few places are sent to all executors."""
    return F.broadcast(places) if _few(places) else places


def _matching(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, line_no of the later lines of the pairs (a..., b...) whose word sets match."""
    a, b = (pairs.select(F.col(f"{x}doc").alias("doc"), F.col(f"{x}line_no").alias("line_no")) for x in "ab")
    places = stored(a.union(b).distinct())
    if _few(places):  # only texts that have one are cut into lines
        named = _prefixed(places.select("doc").distinct(), "__")
        documents, places = documents.join(F.broadcast(named), F.col("doc").eqNullSafe(F.col("__doc")), "left_semi"), F.broadcast(places)
    lines, places = lines_of(documents, "doc", "text"), _prefixed(places, "__")
    found = stored(lines.join(places, _same_place("", "__"), "left_semi").select("doc", "line_no", _word_set(F.col("line")).alias("words")))
    both = pairs.join(_prefixed(found, "y"), _same_place("b", "y")).select("adoc", "aline_no", "ywords").join(_prefixed(found, "x"), _same_place("a", "x"))
    shared = F.size(F.array_intersect("xwords", "ywords"))
    match = shared * PER >= (F.size("xwords") + F.size("ywords") - shared) * SHARE
    return both.where(match).select(F.col("adoc").alias("doc"), F.col("aline_no").alias("line_no")).distinct()


def _quick_pairs(sets: DataFrame) -> DataFrame:
    """Each set with the nearest, by sketches, of the first and the last before it that share two
    neighbouring codes of its prefix, where the filters let the pair pass."""
    code = lambda k: F.get("codes", k)
    last = F.size("codes") - 1
    firsts = [F.lit(0), F.lit(1), *(F.greatest(last - k, F.lit(0)) for k in (4, 3, 2, 1))]  # edits bring rare words to the front, and leave the last of the prefix
    keys = F.array_distinct(F.array(*(F.xxhash64(code(i), code(i + 1)) for i in firsts)))
    keyed = sets.where(F.col("n") >= _RAREST).select("doc", "line_no", "n", *_SKETCH, F.explode(keys).alias("key"))
    # most keys are of one set alone: counts go first, rows only where keys are shared
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("of")).where(F.col("of") > 1).select(F.col("key").alias("__key"), "of"), **_NO_REPEATS)
    met = keyed.join(_small(shared), F.col("key") == F.col("__key"))
    # a large group is dealt over several, so that none is one task's
    part = F.pmod(F.xxhash64("doc", "line_no"), F.ceil(F.col("of") / _MOST_MET)).cast("int")
    place = Window.partitionBy("key", "part").orderBy("doc", "line_no")
    own = F.struct("doc", "line_no", "n", *_SKETCH)
    seen = met.withColumn("part", part).select(own.alias("a"), F.first(own).over(place).alias("e"), F.collect_list(own).over(place.rowsBetween(-_BACK, -1)).alias("before"))
    pairs = seen.select("a", F.explode(F.array_append("before", F.col("e"))).alias("b"))
    a, b = ({c: F.col(f"{x}.{c}") for c in ("doc", "line_no", "n", *_SKETCH)} for x in "ab")
    passed = pairs.where(_near(a, b) & _before(b, a)).select(a["doc"].alias("adoc"), a["line_no"].alias("aline_no"), F.struct(_far(a, b).alias("far"), b["doc"].alias("bdoc"), b["line_no"].alias("bline_no")).alias("e"))
    best = passed.groupBy("adoc", "aline_no").agg(F.min("e").alias("e"))
    return best.select("adoc", "aline_no", "e.bdoc", "e.bline_no")


def _open_pairs(sets: DataFrame, settled: DataFrame, part: int) -> DataFrame:
    """Pairs of an open set and an earlier one that pass prefix, size, position and sketch filters on a common word of the part."""
    known = sets.join(_prefixed(_small(settled), "__"), _same_place("", "__"), "left")
    known = known.select("doc", "line_no", "n", F.col("__line_no").isNull().cast("long").alias("open"), *_SKETCH, "codes")

    def post(df: DataFrame, length: Callable[[Column], Column]) -> DataFrame:
        """A row for each word of the prefix: its code and band, the code before it, and the set; small numbers share a column."""
        words = df.select("*", F.posexplode(F.slice("codes", F.lit(1), length(F.col("n")))).alias("pos", "code")).where(F.col("code") % _PARTS == part)
        word = F.shiftleft(F.col("code").cast("long"), 6).bitwiseOR(F.col("band"))
        previous = F.coalesce(F.get("codes", F.col("pos") - 1), F.lit(0)).cast("long")
        line = F.shiftleft(previous, 32).bitwiseOR(F.shiftleft(F.col("line_no").cast("long"), 1)).bitwiseOR(F.col("open"))
        size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos"))
        return words.select(word.alias("word"), *_SKETCH, "doc", line.alias("line"), size.alias("size"))

    def fields(x: str) -> dict[str, Column]:
        size, line = F.col(f"{x}size"), F.col(f"{x}line")
        own = {"n": F.shiftright(size, 32).cast("int"), "pos": size.bitwiseAND((1 << 32) - 1).cast("int"), "previous": F.shiftright(line, 32), "line_no": F.shiftright(line, 1).bitwiseAND((1 << 31) - 1).cast("int"), "open": line.bitwiseAND(1) == 1}
        return own | {c: F.col(f"{x}{c}") for c in ("doc", *_SKETCH)}

    larger = post(known.withColumn("band", _band(F.col("n"))), _prefix_length)
    # of its own size and of the largest that it can match
    bands = F.explode(F.array_distinct(F.array(_band(F.col("n")), _band(F.col("n") * PER / SHARE))))
    smaller = post(known.withColumn("band", bands), _short_prefix_length)
    a, b = fields("a"), fields("b")
    (n, i), (m, j) = ((x["n"], x["pos"]) for x in (a, b))
    # The first word that two matching sets have in common leaves enough behind it in both.
    places = F.least(n - i, m - j) * (SHARE + PER) >= (n + m) * SHARE
    # Where the words before are the same, those meet already.
    places = places & ((a["previous"] != b["previous"]) | (i == 0) | (j == 0))
    # Sets of one size meet twice; the later one is then the larger.
    first = _before(b, a)
    late = F.when(first, a["open"]).otherwise((n > m) & b["open"])
    met = _prefixed(larger, "a").hint("merge").join(_prefixed(smaller, "b"), (F.col("aword") == F.col("bword")) & (n >= m) & places & _near(a, b) & late)
    order = lambda x, y, c: (F.when(first, x[c]).otherwise(y[c]))
    return met.select(*(order(*xy, c).alias(f"{name}{c}") for name, xy in (("a", (a, b)), ("b", (b, a))) for c in ("doc", "line_no"))).distinct()


def kept_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc, line_no of the lines of `least_words` or more that stay."""
    spark = documents.sparkSession
    sets = _stored_sets(documents, id_column, text_column, least_words)
    own = documents.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    release(spark)
    settled = stored(_matching(stored(_quick_pairs(sets)), own))
    release(spark)
    parts = []
    for part in range(_PARTS):
        parts.append(stored(_open_pairs(sets, settled, part)))
        release(spark)
    pairs = stored(reduce(DataFrame.union, parts).distinct())
    gone = settled.union(stored(_matching(pairs, own)))
    release(spark)
    return sets.select("doc", "line_no").join(_prefixed(_small(gone), "__"), _same_place("", "__"), "left_anti")


def _kept_by_document(documents: DataFrame, id_column: str, text_column: str, least_words: int) -> DataFrame:
    kept = kept_lines(documents, id_column, text_column, least_words)
    return kept.groupBy(F.col("doc").alias("__doc")).agg(F.sort_array(F.collect_set("line_no")).alias("__kept"))


def _counts(line: Column, least_words: int) -> Column:
    """The line has so many words that it may go."""
    return line.rlike(r"[^ \t\x0B\f\r]") if least_words == 1 else F.size(_word_set(line)) >= least_words


def report(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """id, n_lines, n_removed and removed (line numbers from 0, in order) of each row."""
    kept = _kept_by_document(documents, id_column, text_column, least_words)
    # lines are used twice, so Spark keeps them as a column and cuts a text once
    cut = documents.select(F.col(id_column), F.split(F.col(text_column), "\n").alias("__lines"))
    n_lines = F.when(F.col("__lines").isNotNull(), F.size("__lines")).otherwise(0).cast("long")
    numbers = F.array_compact(F.transform("__lines", lambda x, k: F.when(_counts(x, least_words), k)))
    own = cut.select(F.col(id_column), n_lines.alias("n_lines"), F.coalesce(numbers, F.array().cast("array<int>")).alias("__numbers"))
    removed = F.array_except("__numbers", F.coalesce("__kept", F.array().cast("array<int>")))
    joined = own.join(kept, F.col(id_column).eqNullSafe(F.col("__doc")), "left")
    return joined.select(id_column, "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents, all columns, without the lines that go."""
    kept = _kept_by_document(documents, id_column, text_column, least_words)
    names = documents.columns
    renamed = documents.toDF(*(f"__c{k}" for k in range(len(names))))
    key, text = f"__c{names.index(id_column)}", f"__c{names.index(text_column)}"
    joined = renamed.join(kept, F.col(key).eqNullSafe(F.col("__doc")), "left")
    # one flag for each line up to the last that stays
    numbers = F.coalesce("__kept", F.array().cast("array<int>"))
    gaps = F.zip_with(numbers, F.concat(F.array(F.lit(-1)), numbers), lambda k, before: k - before - 1)
    stays = F.flatten(F.transform(F.array_compact(gaps), lambda gap: F.array_append(F.array_repeat(F.lit(False), gap), F.lit(True))))
    flagged = F.zip_with(F.split(F.col(text), "\n"), stays, lambda x, f: F.when(F.coalesce(f, F.lit(False)) | ~_counts(x, least_words), x))
    rest = F.array_join(F.array_compact(flagged), "\n")
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), rest)).select(*renamed.columns).toDF(*names)
