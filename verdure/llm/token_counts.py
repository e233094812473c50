"""Token counts of byte-level BPE tokenizers by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import wordhash
from verdure.llm.pretokens import Memo, splitter

_NEVER = np.int64(1 << 40)
LONG = 512  # bytes from which a piece is merged by ascending rank over linked positions


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    Counts the ids that the tokenizers library gives for the whole text without begin or end tokens. Added tokens
    inside a text count one each. ``over_limit`` is ``n_tokens > limit``. A null or empty text has no bytes and no
    tokens. Repeated rows and null ids are counted like any other row; other columns are not looked at. The tokenizer
    file is read once at the driver and sent to the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches):
        counter = _counter(content.value)
        for batch in batches:
            for part in wordhash.slices(batch, "text", 2 << 20):
                n_bytes, n_tokens = counter.count(part.column("text"))
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(n_bytes), pa.array(n_tokens)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@lru_cache(maxsize=2)
def _counter(content: str) -> Counter:
    return Counter(content)


class Counter:
    """Counts tokens per text; remembers the counts of pieces seen before."""

    def __init__(self, content: str):
        self.splitter = splitter(content)
        self.merges = Merges(content)
        self.memo = Memo()
        self.known = np.zeros(0, np.int64)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        p = self.splitter.pieces(texts)
        _, offsets = wordhash.buffers(texts)
        slots, fresh, reset = self.memo.look_up(p)
        known = np.zeros(0, np.int64) if reset else self.known
        lengths = p.end[fresh] - p.begin[fresh]
        symbols = p.data[wordhash._ranges(p.begin[fresh], lengths)]
        self.known = np.concatenate([known, self.merges.lengths(symbols, lengths)])
        tokens = np.where(p.added >= 0, 1, self.known[slots])
        total = np.concatenate([[0], np.cumsum(tokens)])
        return np.diff(offsets), total[p.first[1:]] - total[p.first[:-1]]


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """The merge rules of a tokenizer as sorted arrays: pair key, rank and the id that replaces the pair."""

    def __init__(self, content: str):
        model = json.loads(content)["model"]
        vocabulary = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        order = np.argsort(left * self.size + right)
        self.keys = np.append((left * self.size + right)[order], np.int64(1) << 62)
        self.ranks = np.append(order.astype(np.int64), _NEVER)
        self.made = np.append(np.array([vocabulary[a + b] for a, b in pairs], np.int64)[order], -1)
        self.start = np.array([vocabulary[s] for s in byte_symbols()], np.int64)

    def _rules(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the id it becomes; pairs without a rule have the rank ``_NEVER``."""
        keys = left * self.size + right
        at = np.searchsorted(self.keys, keys)
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], _NEVER), np.where(hit, self.made[at], -1)

    def lengths(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of symbols left of every sequence of bytes, after all merges."""
        out = lengths.astype(np.int64)
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._long(self.start[data[ends[i] - lengths[i] : ends[i]]])
        rows = np.flatnonzero((lengths > 1) & (lengths <= LONG))
        symbols = self.start[data[wordhash._ranges((ends - lengths)[rows], lengths[rows])]]
        owner = np.repeat(np.arange(len(rows)), lengths[rows])
        while len(symbols):
            inner = owner[1:] == owner[:-1]
            rank, made = self._rules(symbols[:-1], symbols[1:])
            rank[~inner] = _NEVER
            # the lowest rank of each sequence
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(np.append(rank, _NEVER), begin)
            width = np.diff(np.append(begin, len(owner)))
            active = lowest < _NEVER
            hit = (rank == np.repeat(lowest, width)[:-1]) & (rank < _NEVER)
            hit = _leftmost(hit)
            done = np.flatnonzero(~active)
            out[rows[owner[begin[done]]]] = width[done]
            at = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[at] = made[at]
            keep = np.repeat(active, width)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def _long(self, symbols: np.ndarray) -> int:
        """The same for one long sequence. A merge makes pairs of higher rank only, so one ascending sweep does."""
        n = len(symbols)
        symbols = symbols.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(at: np.ndarray) -> None:
            rank, _ = self._rules(symbols[at], symbols[after[at]])
            at, rank = at[rank < _NEVER], rank[rank < _NEVER]
            order = np.argsort(rank, kind="stable")
            values, cuts = np.unique(rank[order], return_index=True)
            for value, own in zip(values.tolist(), np.split(at[order], cuts[1:])):
                if value not in waiting:
                    heapq.heappush(heap, value)
                waiting.setdefault(value, []).append(own)

        alive = np.ones(n, bool)
        offer(np.arange(n - 1))
        left = n
        while heap:
            value = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(value)))
            at = at[alive[at] & (after[at] < n)]
            rank, made = self._rules(symbols[at], symbols[after[at]])
            at, made = at[rank == value], made[rank == value]
            if len(at) == 0:
                continue
            # in a chain of overlapping pairs every second one is free
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at, made = at[run % 2 == 0], made[run % 2 == 0]
            gone = after[at]
            symbols[at] = made
            alive[gone] = False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            near = np.concatenate([at[inner], before[at][before[at] >= 0]])
            offer(np.unique(near))
        return left


def _leftmost(hit: np.ndarray) -> np.ndarray:
    """Of directly following hits, which overlap, every second one counted from the left."""
    index = np.arange(len(hit))
    since = index - np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), index, 0))
    return hit & (since % 2 == 0)
