"""Pre-tokens of byte-level BPE tokenizers, found for whole Arrow batches at once.

The pieces are those of the pattern that byte-level tokenizers share: a contraction, or a run of letters, of numbers
or of other characters, each with at most one space before it, or a run of white space without the space that goes to
the next piece. Whether a character is a letter, a number or white space is asked of the tokenizer library itself,
once per character and process. Added tokens inside a text are pieces of their own and cut the text.
"""

from __future__ import annotations

import json
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from tokenizers import Tokenizer

from verdure.llm import wordhash

_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
_CODES = wordhash.mix(np.arange(1000, 1256, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces(NamedTuple):
    """Byte ranges that follow each other without gaps. Document ``i`` has the pieces ``first[i]:first[i + 1]``."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    added: np.ndarray  # id of the added token, or -1


class Splitter:
    """Splits texts as the byte-level pre-tokenizer of ``tokenizer`` does."""

    def __init__(self, content: str):
        spec = json.loads(content)
        kind = spec["pre_tokenizer"]
        plain = kind["type"] == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        tokens = spec.get("added_tokens") or []
        simple = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens)
        if not plain or spec.get("normalizer") or not simple:
            raise ValueError("only byte-level tokenizers without prefix space and normalizer are supported")
        self.split = Tokenizer.from_str(content).pre_tokenizer.pre_tokenize_str
        # longer tokens win where two start at the same place
        self.added = sorted(((t["content"].encode(), t["id"]) for t in tokens), key=lambda t: -len(t[0]))
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)

    def _kind(self, code: int) -> int:
        """A character belongs to the run it does not part from."""
        for kind, probe in ((_LETTER, "a"), (_NUMBER, "0"), (_OTHER, "!")):
            if len(self.split(probe + chr(code))) == 1:
                return kind
        return _SPACE

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kinds[codes]
        if (kinds == _UNKNOWN).any():
            for code in np.unique(codes[kinds == _UNKNOWN]):
                self.kinds[code] = self._kind(int(code))
            kinds = self.kinds[codes]
        return kinds

    def _added_places(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Leftmost places of added tokens that do not cross the end of a document."""
        raw, found = data.tobytes(), []
        for text, number in self.added:
            at = raw.find(text)
            while at >= 0:
                if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + len(text), side="left"):
                    found.append((at, at + len(text), number))
                at = raw.find(text, at + 1)
        found.sort(key=lambda f: (f[0], f[0] - f[1]))
        out, reached = [], 0
        for place in found:
            if place[0] >= reached:
                out.append(place)
                reached = place[1]
        return out

    def pieces(self, texts: pa.Array) -> Pieces:
        data, offsets = wordhash.buffers(texts)
        n = len(data)
        none = np.zeros(0, np.int64)
        if n == 0:
            return Pieces(data, none, none, np.zeros(len(offsets), np.int64), none)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(codes) == n:
            at, place = None, offsets
        else:
            at = np.flatnonzero((data & 0xC0) != 0x80)
            place = np.searchsorted(at, offsets)
        added = self._added_places(data, offsets)
        hard = np.zeros(len(codes) + 3, bool)
        hard[place] = True
        hard[len(codes) :] = True
        spots = np.array([a[:2] for a in added], np.int64).reshape(-1, 2)
        spots = spots if at is None else np.searchsorted(at, spots)
        hard[spots] = True
        starts = self._starts(codes, hard)
        for a, b in spots:
            starts[a + 1 : b] = False
        begin = np.flatnonzero(starts)
        if at is not None:
            begin = at[begin]
        first = np.searchsorted(begin, offsets)
        ids = np.full(len(begin), -1, np.int64)
        for a, _, number in added:
            ids[np.searchsorted(begin, a)] = number
        return Pieces(data, begin, np.append(begin[1:], n), first, ids)

    def _starts(self, codes: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """Marks the first character of every piece. ``hard`` marks where the text is cut anyway."""
        n = len(codes)
        kinds = self._kinds(codes)
        starts = hard[:n].copy()
        starts[1:] |= kinds[1:] != kinds[:-1]
        # white space before something else: its last character stands alone or goes with what follows
        before = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~hard[1:n])
        starts[before] = True
        starts[before[codes[before] == 32] + 1] = False
        quotes = np.flatnonzero((codes[:-1] == 39) & starts[:-1] & ~hard[1:n])
        if len(quotes):
            padded = np.append(codes, [0, 0])
            one = padded[quotes + 1]
            two = np.where(hard[quotes + 2], 0, padded[quotes + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(quotes), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            for chosen, length in ((short, 2), (long, 3)):
                q = quotes[chosen]
                starts[q + 1] = False
                after = q + length
                starts[after[after < n]] = True
        return starts


@lru_cache(maxsize=4)
def splitter(content: str) -> Splitter:
    return Splitter(content)


def piece_hashes(p: Pieces) -> np.ndarray:
    """A 64-bit hash of the bytes of every piece."""
    if len(p.begin) == 0:
        return np.zeros(0, np.uint64)
    length = p.end - p.begin
    powers = np.cumprod(np.full(int(length.max()) + 1, _BASE, np.uint64))
    terms = powers[np.arange(len(p.data)) - np.repeat(p.begin, length)]
    terms *= _CODES[p.data]
    return wordhash.mix(np.add.reduceat(terms, p.begin))


class Memo:
    """Remembers a value per piece hash for one process; starts afresh when ``limit`` pieces are known."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.index: pd.Index = pd.Index(np.zeros(0, np.uint64))

    def look_up(self, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(slots, unknown, reset)``: the memo slot of every piece and the pieces whose value is asked for.

        The unknown pieces take the slots at the end of the memo, in their order.
        """
        inverse, values = pd.factorize(piece_hashes(p))
        slots = self.index.get_indexer(values)
        reset = len(self.index) + int((slots < 0).sum()) > self.limit and len(self.index) > 0
        if reset:
            self.index = pd.Index(np.zeros(0, np.uint64))
            slots = np.full(len(values), -1)
        fresh = slots < 0
        slots[fresh] = len(self.index) + np.arange(int(fresh.sum()))
        # codes are numbered by first occurrence
        first = np.flatnonzero(np.diff(np.maximum.accumulate(inverse), prepend=-1)) if len(inverse) else inverse
        self.index = self.index.append(pd.Index(values[fresh]))
        return slots[inverse], first[fresh], reset
