"""Tokenizers as columns: lengths, prefixes and budgets in the tokens that a model really sees.

A tokenizer is anything with `encode(text) -> list of ids` and `decode(ids) -> text` that can be
pickled. Texts go to it in Arrow batches; each worker opens a file's tokenizer once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@runtime_checkable
class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


@lru_cache(maxsize=4)
def _opened(path: str):
    from tokenizers import Tokenizer as File

    return File.from_file(path)


class FileTokenizer:
    """A tokenizer's JSON file, whose path every worker can read; special tokens are neither added nor shown."""

    def __init__(self, path: str):
        self.path = path

    def encode(self, text: str) -> list[int]:
        return _opened(self.path).encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return _opened(self.path).decode(list(ids), skip_special_tokens=True)


class Characters:
    """Code points as tokens."""

    def encode(self, text: str) -> list[int]:
        return list(map(ord, text))

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))


def _column(kind: T.DataType, one):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else one(t) for t in texts], dtype="Int64" if isinstance(kind, T.LongType) else object)

    return run


def token_ids(text: Column, tokenizer: Tokenizer) -> Column:
    """Ids of the text; null for null."""
    return _column(T.ArrayType(T.IntegerType()), lambda t: list(tokenizer.encode(t)))(text)


def token_count(text: Column, tokenizer: Tokenizer) -> Column:
    """Tokens of the whole text; null for null."""
    return _column(T.LongType(), lambda t: len(tokenizer.encode(t)))(text)


def token_prefix(text: Column, tokenizer: Tokenizer, limit: int | None) -> Column:
    """The text itself if it has no more tokens than the limit, else what its first ones decode to."""
    if limit is None:
        return text
    if limit <= 0:
        raise ValueError(f"a limit of {limit} tokens")

    def cut(t: str) -> str:
        ids = tokenizer.encode(t)
        return t if len(ids) <= limit else tokenizer.decode(ids[:limit])

    return _column(T.StringType(), cut)(text)


def token_count_and_prefix(text: Column, tokenizer: Tokenizer, limit: int) -> Column:
    """token_count as n and token_prefix as prefix, from one encoding of the text."""
    if limit <= 0:
        raise ValueError(f"a limit of {limit} tokens")

    @F.pandas_udf("n long, prefix string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, prefix = [], []
            for t in texts:
                ids = None if t is None else tokenizer.encode(t)
                n.append(None if t is None else len(ids))
                prefix.append(t if t is None or len(ids) <= limit else tokenizer.decode(ids[:limit]))
            yield pd.DataFrame({"n": pd.Series(n, dtype="Int64"), "prefix": pd.Series(prefix, dtype=object)})

    return run(text)
