"""Token ids of whole texts by a byte-level BPE vocabulary, chunk by chunk.

Texts are cut into pieces (words, numbers, signs, white space) with numpy over code
points; each distinct piece of a chunk is encoded once and the ids are gathered. Texts
with characters outside the blocks below go through the tokenizer itself.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from weft.llm._common import _INV, _MUL, _STEP, _powers, mix, utf8

_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
#: Code points that are classed here; the rest (and control characters) go to the tokenizer.
_BLOCKS = ((0x00, 0x24F), (0x370, 0x377), (0x400, 0x4FF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF))
_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0)
_TABLE = 0x3000
#: Pieces that a worker remembers at most; beyond it starts anew.
_REMEMBERED = 300_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(_TABLE, _UNKNOWN, np.uint8)
    for low, high in _BLOCKS:
        for c in range(low, high + 1):
            kind = unicodedata.category(chr(c))[0]
            out[c] = _SPACE if c in _SPACES else _LETTER if kind == "L" else _NUMBER if kind == "N" else _UNKNOWN if kind == "C" else _OTHER
    return out


def piece_starts(codes: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sorted starts of pieces; begins: of the texts that are not empty."""
    n = len(codes)
    text_start = np.zeros(n + 1, bool)
    text_start[begins] = True
    text_start[n] = True
    change = text_start.copy()
    change[1:n] |= kinds[1:] != kinds[:-1]
    start = change[:n].copy()
    # the last white space before other characters stands alone, or, if it is a blank, leads them
    last = np.flatnonzero((kinds == _SPACE) & change[1:] & ~text_start[1:])
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll after no blank are pieces, and what follows begins anew
    quote = np.flatnonzero(start & (codes == 0x27) & change[1:] & ~text_start[1:])
    quote = quote[kinds[quote + 1] == _LETTER]
    if len(quote):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        pair = ~text_start[np.minimum(quote + 2, n)]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = pair & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for which, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[which + 1] = False
            after = which + size
            after = after[(after < n)]
            start[after] = True
    return np.flatnonzero(start)


class Encoder:
    """encode(texts) gives the ids of all texts one after another and where each begins."""

    def __init__(self, path: str):
        self.path = path
        self._known: dict[int, int] | None = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_known": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state

    def _load(self) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        with open(self.path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self._ranks = {bytes(letters[x] for x in token): k for token, k in vocabulary.items() if all(x in letters for x in token)}
        self._bpe = tiktoken.Encoding("weft", pat_str=r"[\s\S]+", mergeable_ranks={t: k for t, k in self._ranks.items() if k < len(self._ranks)}, special_tokens={})._core_bpe
        self._whole = Tokenizer.from_file(self.path)
        self._whole.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self._known, self._used = {}, 0
        self._flat, self._edges = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        token = self._ranks.get(raw)
        return [token] if token is not None else self._bpe.encode_single_piece(raw)

    def _learn(self, hashes: list[int], pieces: list[str]) -> range:
        """Rows of pieces that were not known before."""
        base, found = len(self._known), [self._piece(p) for p in pieces]
        self._known.update(zip(hashes, range(base, base + len(hashes)), strict=True))
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        edges = self._used + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self._used += len(ids)
        if self._used > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty(self._used, np.uint32)])
        if base + len(hashes) >= len(self._edges):
            self._edges = np.concatenate([self._edges, np.empty(base + len(hashes), np.int64)])
        self._flat[self._used - len(ids) : self._used] = ids
        self._edges[base + 1 : base + 1 + len(hashes)] = edges
        return range(base, base + len(hashes))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._known is None:
            self._load()
        data, offsets = utf8(texts)
        joined = data.tobytes().decode("utf-8")
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = lead[offsets]
        kinds = np.full(len(codes), _UNKNOWN, np.uint8)
        small = codes < _TABLE
        kinds[small] = _classes()[codes[small]]
        odd = np.concatenate([[0], np.cumsum(kinds == _UNKNOWN)])
        odd = np.flatnonzero(odd[bounds[1:]] > odd[bounds[:-1]])
        begins = np.unique(bounds[:-1][bounds[1:] > bounds[:-1]])
        starts = piece_starts(codes, kinds, begins) if len(codes) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(codes)) if len(starts) else starts
        with np.errstate(over="ignore"):
            size = 1 << max(10, len(codes).bit_length())
            total = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(mix(codes.astype(np.uint64) + _STEP) * _powers(int(_MUL), size)[: len(codes)], out=total[1:])
            hashes = mix((total[ends] - total[starts]) * _powers(int(_INV), size)[starts] + (ends - starts).astype(np.uint64) * _STEP)
        if len(odd):
            skip = np.zeros(len(texts), bool)
            skip[odd] = True
            keep = ~skip[np.searchsorted(bounds, starts, "right") - 1]
            starts, ends, hashes = starts[keep], ends[keep], hashes[keep]
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) > _REMEMBERED:
            self._forget()
        rows = np.array([self._known.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(rows < 0)
        rows[new] = self._learn(distinct[new].tolist(), [joined[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        rows = rows[inverse]
        first = self._edges[rows]
        sizes = self._edges[rows + 1] - first
        out_ends = np.cumsum(sizes)
        pick = np.arange(int(out_ends[-1]) if len(out_ends) else 0) + np.repeat(first - out_ends + sizes, sizes)
        ids = self._flat[pick]
        piece_first = np.concatenate([[0], out_ends])[np.searchsorted(starts, bounds, "left")]
        if not len(odd):
            return ids, piece_first
        parts = [ids[piece_first[i] : piece_first[i + 1]] for i in range(len(texts))]
        for i, found in zip(odd.tolist(), self._whole.encode_batch([texts[int(i)].as_py() for i in odd], add_special_tokens=False), strict=True):
            parts[i] = np.array(found.ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
