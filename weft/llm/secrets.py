"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: text
that the rule matches must satisfy it. Texts are indexed in segments (a few
megabytes each): the postings of every trigram that some query names, found in one
pass over the segment's bytes. Postings are intersected and united as the query
says, and the rule runs over the whole text of each candidate. A rule without
mandatory trigrams runs over every text. Segments need no shuffle, and a rule costs
what its candidates cost.

Defined results: null text counts as empty; an empty list of spans has the digest of
the empty string; rows that repeat are each answered; other columns are ignored.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as _c
import re._parser as _p
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._common import LOWER, chunks, utf8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.A
    group: int = 0
    least: int = 1  # characters that `group` has at least; shorter matches are dropped


#: The three base kinds, in their order.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.A, 0, 20),
    Rule("hex", r"[0-9a-f]+", re.A, 0, 24),
)
#: Formats of well-known secrets, in the order in which spans that begin together are listed.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", re.A | re.I),
    Rule("url_login", r"(?<![a-z])[a-z][a-z0-9+.-]+://[A-Za-z0-9._%-]+:[^\s:@/\"']{3,}@"),
)

#: A query is True (any text), a trigram, ("and", queries) or ("or", queries). Strings a piece may stand for, at most.
_MOST_STRINGS = 48


def _both(a, b):
    if a is True or b is True:
        return b if a is True else a
    return a if a == b else ("and", (a, b))


def _either(queries: list):
    if any(q is True for q in queries):
        return True
    queries = list(dict.fromkeys(queries))
    return queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _of_strings(strings: set[str]):
    """What a text that holds one of these strings satisfies."""
    found = []
    for s in sorted(strings):
        if len(s) < 3:
            return True
        query = True
        for k in range(len(s) - 2):
            query = _both(query, s[k : k + 3])
        found.append(query)
    return _either(found)


def _lower(s: str) -> str:
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in s)


def _walk(items) -> list[tuple[set[str] | None, object]]:
    """Pieces in order: (all strings the piece stands for, True) or (None, its query)."""
    out: list[tuple[set[str] | None, object]] = []
    for op, arg in items:
        if op is _c.LITERAL:
            out.append(({_lower(chr(arg))} if arg < 128 else None, True))
        elif op is _c.IN:
            chars: set[str] | None = set()
            for kind, value in arg:
                if kind is _c.LITERAL and value < 128 and chars is not None:
                    chars.add(_lower(chr(value)))
                elif kind is _c.RANGE and value[1] < 128 and value[1] - value[0] < 8 and chars is not None:
                    chars |= {_lower(chr(c)) for c in range(value[0], value[1] + 1)}
                else:
                    chars = None
            out.append((chars, True))
        elif op is _c.SUBPATTERN:
            out += _walk(arg[3])
        elif op is _c.BRANCH:
            sides = [_flatten(_walk(x)) for x in arg[1]]
            if all(s is not None for s, _ in sides):
                out.append((set().union(*(s for s, _ in sides)), True))
            else:
                out.append((None, _either([_of_strings(s) if s is not None else q for s, q in sides])))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT):
            low, high, body = arg
            strings, query = _flatten(_walk(body))
            if low == 0 and high == 1 and strings is not None:
                out.append((strings | {""}, True))
            elif low == 0:
                out.append((None, True))
            elif strings is not None and low == high and len(strings) ** low <= _MOST_STRINGS:
                out += [(strings, True)] * low
            else:
                out.append((None, _of_strings(strings) if strings is not None else query))
        elif op is _c.AT:
            out.append(({""}, True))
        else:
            out.append((None, True))
    return out


def _flatten(pieces: list) -> tuple[set[str] | None, object]:
    """All strings of a sequence if they are few and known, else its query."""
    query, run, whole = True, {""}, True
    for strings, own in pieces:
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, whole = _both(query, _of_strings(run)), False
        query = _both(query, own)
        run = {""} if strings is None else set(strings) if len(strings) <= _MOST_STRINGS else {""}
    return (run, True) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str, flags: int = 0):
    """The Boolean query over trigrams of lower-cased text that each match of the pattern implies."""
    strings, query = _flatten(_walk(_p.parse(pattern, flags)))
    return _of_strings(strings) if strings is not None else query


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Index:
    """Postings of one segment: for each wanted trigram, the texts that hold it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, slots: np.ndarray, wanted: dict[str, int]):
        self.size, self.wanted = len(offsets) - 1, wanted
        low = LOWER[data].astype(np.uint32)
        found = slots[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]] if len(low) > 2 else np.empty(0, np.uint16)
        at = np.flatnonzero(found)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * self.size + text[inside])
        self.text, self.first = pairs % self.size, np.searchsorted(pairs, np.arange(len(wanted) + 2) * self.size)

    def postings(self, trigram: str) -> np.ndarray:
        k = self.wanted[trigram]
        return self.text[self.first[k] : self.first[k + 1]]

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings(query)
        parts = sorted(map(self.candidates, query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.wanted = {t: k + 1 for k, t in enumerate(sorted(set().union(*map(trigrams, self.queries))))}
        self._slots: np.ndarray | None = None
        self._compiled: list[re.Pattern] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slots": None, "_compiled": None}

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of each text: (start, rule, end) of all matches, sorted."""
        if self._slots is None:
            self._slots = np.zeros(1 << 24, np.uint16)
            for t, k in self.wanted.items():
                a, b, c = t.encode("ascii")
                self._slots[a << 16 | b << 8 | c] = k
            self._compiled = [re.compile(r.pattern, r.flags) for r in self.rules]
        index = Index(*utf8(texts), self._slots, self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        strings = texts.to_pylist()
        for k, (rule, query, compiled) in enumerate(zip(self.rules, self.queries, self._compiled, strict=True)):
            for i in index.candidates(query):
                for m in compiled.finditer(strings[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


def scan(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", more_rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of each text."""
    rules = BASE_RULES + tuple(more_rules)
    scanner, base = Scanner(rules), len(BASE_RULES)
    chosen = documents.select(F.col(id_column), F.col(text_column).alias("__text"))
    schema = T.StructType([chosen.schema[0], *(T.StructField(f"n_{r.kind}", T.LongType()) for r in BASE_RULES), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text"):
            found = scanner.scan(texts)
            counts = [pa.array([sum(k == kind for _, k, _ in spans) for spans in found], pa.int64()) for kind in range(base)]
            joined = [",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if k < base) for spans in found]
            digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string())
            spans_ = pa.array([",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans) for spans in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans_], names=schema.names)

    return chosen.mapInArrow(run, schema)
