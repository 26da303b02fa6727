"""Text, conversation and metric functions as columns."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.tokenizers import Tokenizer, token_count, token_prefix

ANSWER_LETTERS = ("A", "B", "C", "D")


def words(text: Column) -> Column:
    """Split at white space, without empty pieces."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def char_prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def truncate_tokens(text: Column, limit: int | None, tokenizer: str | Tokenizer = "char") -> Column:
    """The text itself if it has no more tokens than the limit; tokenizer: char, whitespace or one of one's own."""
    if not isinstance(tokenizer, str):
        return token_prefix(text, tokenizer, limit)
    if limit is None:
        return text
    if limit <= 0:
        raise ValueError(f"a limit of {limit} tokens")
    if tokenizer == "char":
        return char_prefix(text, limit)
    return F.when(F.size(words(text)) <= limit, text).otherwise(F.array_join(F.slice(words(text), 1, limit), " "))


def token_length(text: Column, tokenizer: str | Tokenizer = "char") -> Column:
    if not isinstance(tokenizer, str):
        return token_count(text, tokenizer)
    return (F.length(text) if tokenizer == "char" else F.size(words(text))).cast("long")


def exact_match(reference: Column, hypothesis: Column) -> Column:
    return F.when(reference == hypothesis, 1.0).otherwise(0.0)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character edits by characters of the reference; 0 for an empty reference."""
    return F.when(F.length(reference) == 0, 0.0).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def strict_letter(text: Column) -> Column:
    """A, B, C or D if it is the first character after white space, else null."""
    found = F.regexp_extract(text, r"^\s*([ABCD])", 1)
    return F.when(found != "", found)


def retention(image: Column, native: Column, higher_is_better: bool = True) -> Column:
    top, bottom = (image, native) if higher_is_better else (native, image)
    return F.when(image.isNotNull() & native.isNotNull() & (bottom != 0), top / bottom * 100)


def edit_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two token lists, one numpy row at a time."""
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[w] for w in a]), np.array([codes[w] for w in b])
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for k, w in enumerate(x, 1):
        best = np.empty_like(row)
        best[0] = k
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        row = np.minimum.accumulate(best - steps) + steps  # insertions, from left to right
    return int(row[-1])


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two token lists."""
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[w] for w in a]), np.array([codes[w] for w in b])
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        row[1:] = np.maximum(row[1:], np.where(y == w, row[:-1] + 1, 0))
        row = np.maximum.accumulate(row)
    return int(row[-1])


@F.pandas_udf(T.LongType())
def word_edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Word edits between two arrays of words."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else edit_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def word_lcs(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else common_subsequence(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


#: How a word error rate reads its texts, and its value when the reference has no words.
WER_MODES = ("plain", "lower", "letters")


def wer_words(text: Column, mode: str) -> Column:
    if mode == "lower":
        return words(F.lower(text))
    if mode == "letters":
        return words(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "))
    return words(text)


def wer(reference: Column, hypothesis: Column, mode: str = "plain") -> Column:
    if mode not in WER_MODES:
        raise ValueError(f"no mode {mode}")
    a, b = wer_words(reference, mode), wer_words(hypothesis, mode)
    empty = F.lit(0.0) if mode == "plain" else F.when(F.size(b) > 0, 1.0).otherwise(0.0)
    return F.when(F.size(a) == 0, empty).otherwise(word_edits(a, b) / F.size(a))


def rouge_l(reference: Column, hypothesis: Column) -> Column:
    """F1 of the longest common subsequence of words; 1 if both are empty, 0 if one is."""
    a, b = words(reference), words(hypothesis)
    common = word_lcs(a, b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def types_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)))


def type_overlap(reference: Column, hypothesis: Column) -> tuple[Column, Column]:
    """Recall and precision over distinct words; null where there are none."""
    a, b = types_of(reference), types_of(hypothesis)
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) > 0, both / F.size(a)), F.when(F.size(b) > 0, both / F.size(b))


@F.pandas_udf(T.LongType())
def words_in_common(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Words that two arrays share, each as often as both have it; linear in their lengths."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(a, b, strict=True)], dtype="Int64")


def multiset_recall(reference: Column, hypothesis: Column) -> Column:
    """Share of the reference's words, with repeats, that the hypothesis holds as often; null without words."""
    a, b = words(reference), words(hypothesis)
    return F.when(F.size(a) > 0, words_in_common(a, b) / F.size(a))


# Conversations: arrays of struct<role, text> in order.


def first_turn(turns: Column, role: str, after: Column | None = None) -> Column:
    """Place (from 1) of the first turn of a role, after a place if given; 0 if there is none."""
    start = F.lit(0) if after is None else after
    at = F.filter(F.transform(turns, lambda t, k: F.when((t["role"] == role) & (k + 1 > start), k + 1)), lambda k: k.isNotNull())
    return F.coalesce(F.get(at, 0), F.lit(0))


def instruction_of(turns: Column) -> Column:
    """Text of the first user turn; null if there is none."""
    return F.coalesce(F.get(turns, first_turn(turns, "user") - 1)["text"], F.when(first_turn(turns, "user") > 0, ""))


def response_of(turns: Column) -> Column:
    """Text of the first assistant turn after the first user turn; null if there is none."""
    user = first_turn(turns, "user")
    at = F.when(user > 0, first_turn(turns, "assistant", user)).otherwise(0)
    return F.coalesce(F.get(turns, at - 1)["text"], F.when(at > 0, ""))


def assistant_text(turns: Column, mode: str = "first", separator: str = "") -> Column:
    """The first assistant turn, or all of them joined."""
    own = F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])
    if mode == "first":
        return F.coalesce(F.get(own, 0), F.lit(""))
    return F.array_join(own, separator)


def question_text(question: Column, options: Column) -> Column:
    """Question, an empty line, and one line for each option."""
    lettered = F.zip_with(F.array(*map(F.lit, ANSWER_LETTERS)), F.slice(options, 1, 4), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(") "), b)))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Question: "), question), F.lit("")), F.coalesce(F.array_compact(lettered), F.array().cast("array<string>"))), "\n")


def answer_letter(index: Column, label: Column) -> Column:
    """An index from 0 to 3, else a label that is or begins with a letter, else the label, else empty."""
    upper = F.upper(F.trim(label))
    by_label = F.when(F.substring(upper, 1, 1).isin(*ANSWER_LETTERS), F.substring(upper, 1, 1)).otherwise(label)
    return F.coalesce(F.when(index.between(0, 3), F.get(F.array(*map(F.lit, ANSWER_LETTERS)), index.cast("int"))), by_label, F.lit(""))


def modality(stated: Column, has_audio: Column, has_frames: Column) -> Column:
    value = F.lower(F.trim(stated))
    return (
        F.when(value.contains("audio-visual") | value.contains("audiovisual") | value.isin("av", "both"), "audio-visual")
        .when(value.contains("audio"), "audio")
        .when(value.contains("visual") | value.contains("video") | value.contains("vision"), "visual")
        .when(has_audio & has_frames, "audio-visual")
        .when(has_audio, "audio")
        .otherwise("visual")
    )


def fixed_frames(frames: Column, k: int) -> Column:
    """Exactly k frames: the last is repeated, or the rest is cut; none stays none."""
    n = F.size(frames)
    return F.when(n == 0, frames).otherwise(F.slice(F.concat(frames, F.array_repeat(F.get(frames, n - 1), k)), 1, k))


def poisoned(text: Column, rate: float, *key: Column) -> tuple[Column, Column]:
    """The text with each letter replaced at this rate by a keyed letter a to z, and the places of those.

    The numbers are those of determinism.below and uniform for (key, place from 1) and (key, "letter",
    place), whose md5 a loop over the letters makes at a fraction of what expressions take."""
    bound = math.ceil(rate * 4294967296.0)
    all_hit, least = bound >= 1 << 32, max(0, min(bound, (1 << 32) - 1)).to_bytes(4, "big")

    @F.pandas_udf("text string, places array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        md5, numbers = hashlib.md5, []
        for texts, keys in batches:
            out, places = [], []
            for t, k in zip(texts, keys, strict=True):
                own, letters = k.encode(), list(t)
                numbers += [b"%d" % n for n in range(len(numbers) + 1, len(t) + 1)]
                hits = [i for i, c in enumerate(letters) if c.isalpha() and (all_hit or md5(own + numbers[i]).digest() < least)]
                for i in hits:
                    first = int.from_bytes(md5(own + b"letter|" + numbers[i]).digest()[:4], "big")
                    letters[i] = chr(97 + (first * 26 >> 32))
                out.append("".join(letters))
                places.append(np.array(hits, np.int32))
            yield pd.DataFrame({"text": pd.Series(out, dtype=object), "places": pd.Series(places, dtype=object)})

    found = run(F.coalesce(text, F.lit("")), F.concat_ws("|", *(k.cast("string") for k in key), F.lit("")))
    return found["text"], found["places"]
