"""Byte-level BPE encoding and decoding with rank files, over length-bucketed padded numpy matrices."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import wordhash
from verdure.llm.pretokens import _LETTER, _NUMBER, _OTHER, _SPACE, _UNKNOWN, Memo, Splitter

_NEVER = np.int32(np.iinfo(np.int32).max)
WIDEST = 256  # bytes up to which a piece is a matrix row; a longer one is a matrix of its own, cut into rows
_CELLS = 1 << 20  # cells of one padded matrix


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs(doc_id, text)``: the ids tiktoken gives for the whole text.

    ``pattern`` must be ``public_tokenizers.PATTERN``; each of its matches is encoded separately, and no text is
    taken for a special token. A null or empty text has an empty list. Rows with equal or null ids are encoded like
    any other; other columns are not looked at. The rank file is read once at the driver and sent to the tasks.
    """
    content = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def run(batches):
        codec = _codec(content.value, pattern)
        for batch in batches:
            for part in wordhash.slices(batch, "text", 1 << 20):
                ids, bounds = codec.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``encoded(doc_id, ids)``: the bytes the ids stand for.

    A null or empty list gives no bytes, a null id inside a list adds none. An id that the rank file does not have
    is an error. The bytes need not be valid UTF-8, as ids may begin or end inside a character.
    """
    content = encoded.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def run(batches):
        vocabulary = _vocabulary(content.value)
        for batch in batches:
            for part in _runs_of_ids(batch):
                data, bounds = vocabulary.decode(part.column("ids"))
                decoded = pa.Array.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
                ).cast(pa.binary())
                columns = [part.column("doc_id"), part.column("ids"), decoded]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    narrow = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _runs_of_ids(batch: pa.RecordBatch, limit: int = 1 << 20):
    """Cuts a batch into runs of rows with about ``limit`` ids."""
    if batch.num_rows == 0:
        return
    total = np.cumsum(np.nan_to_num(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)))
    start = 0
    while start < batch.num_rows:
        used = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, used + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@lru_cache(maxsize=2)
def _vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


@lru_cache(maxsize=2)
def _codec(content: bytes, pattern: str) -> Codec:
    return Codec(content, pattern)


class Vocabulary:
    """Byte strings and ranks of a rank file; the rank is the id."""

    def __init__(self, content: bytes):
        pairs = [line.split() for line in content.splitlines() if line]
        self.ranks = {base64.b64decode(text): int(rank) for text, rank in pairs}
        size = max(self.ranks.values()) + 1
        texts = [b""] * size
        self.known = np.zeros(size, bool)
        for text, rank in self.ranks.items():
            texts[rank] = text
            self.known[rank] = True
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all lists one after the other, and where each list's bytes begin and end."""
        counts = np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = ids.flatten()
        missing = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        wrong = ~missing & ((values < 0) | (values >= len(self.known)))
        if wrong.any() or not self.known[values[~missing]].all():
            raise ValueError("an id is not in the vocabulary")
        lengths = np.where(missing, 0, self.lengths[values])
        data = self.data[wordhash._ranges(self.begin[values], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return data, total[np.concatenate([[0], np.cumsum(counts)])]


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of the two byte strings put together."""

    def __init__(self, vocabulary: Vocabulary):
        ranks = vocabulary.ranks
        found = [
            (ranks[text[:k]], ranks[text[k:]], rank)
            for text, rank in ranks.items()
            for k in range(1, len(text))
            if text[:k] in ranks and text[k:] in ranks
        ]
        left, right, made = np.array(found, np.int64).reshape(-1, 3).T
        bits = max(4, int(4 * len(found)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.made = np.full(1 << bits, _NEVER, np.int32)
        keys, at = (left << 32) | right, self._slot(left, right)
        waiting = np.arange(len(keys))
        while len(waiting):
            # the first of those that ask for a free slot gets it, the others move on
            free = waiting[self.keys[at[waiting]] == -1]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.made[at[placed]] = keys[placed], made[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            at[waiting] = (at[waiting] + 1) & self.mask

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id each pair becomes, which is also its rank; ``_NEVER`` for pairs that do not merge."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        keys, at = (left << 32) | right, self._slot(left, right)
        held = self.keys[at]
        out = np.where(held == keys, self.made[at], _NEVER)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


class PatternSplitter(Splitter):
    """Splits texts by the pattern; the kind of a character is asked of tiktoken, once per character."""

    def __init__(self, pattern: str):
        # a vocabulary that joins two bytes only if they stand in one match, after one of three probes
        ranks = {bytes([b]): b for b in range(256)}
        for probe in b"a0!":
            ranks |= {bytes([probe, b]): len(ranks) + b for b in range(256)}
        self.probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = []
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)

    def _kind(self, code: int) -> int:
        for kind, probe in ((_LETTER, "a"), (_NUMBER, "0"), (_OTHER, "!")):
            if self.probe.encode_ordinary(probe + chr(code))[0] > 255:
                return kind
        return _SPACE


class Codec:
    """Encodes Arrow texts; remembers the ids of pieces seen before."""

    def __init__(self, content: bytes, pattern: str):
        import public_tokenizers

        if pattern != public_tokenizers.PATTERN:
            raise ValueError("only the pattern of public_tokenizers is supported")
        self.vocabulary = _vocabulary(content)
        self.table = PairTable(self.vocabulary)
        self.splitter = PatternSplitter(pattern)
        self.single = np.array([self.vocabulary.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the rank file lacks single bytes")
        self.memo = Memo(1 << 18)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids begin and end."""
        p = self.splitter.pieces(texts)
        slots, fresh, reset = self.memo.look_up(p)
        if reset:
            self._forget()
        made, counts = self._merge(p.data, p.begin[fresh], p.end[fresh])
        self.known, self.counts = np.concatenate([self.known, made]), np.concatenate([self.counts, counts])
        begin = np.cumsum(self.counts) - self.counts
        tokens = self.counts[slots]
        ids = self.known[wordhash._ranges(begin[slots], tokens)]
        total = np.concatenate([[0], np.cumsum(tokens)])
        return ids, total[p.first]

    def _merge(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every piece, one piece after the other, and their number per piece."""
        lengths = end - begin
        counts = np.zeros(len(begin), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # pieces and their ids, piece by piece
        raw, ranks = data.tobytes(), self.vocabulary.ranks
        # a piece that is a token as a whole is never merged
        whole = np.array([ranks.get(raw[a:b], -1) for a, b in zip(begin.tolist(), end.tolist())], np.int32)
        hit = np.flatnonzero(whole >= 0)
        counts[hit] = 1
        parts.append((hit, whole[hit]))
        open_ = np.flatnonzero(whole < 0)
        for i in open_[lengths[open_] > WIDEST]:
            ids = self._long(self.single[data[begin[i] : end[i]]])
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        open_ = open_[lengths[open_] <= WIDEST]
        open_ = open_[np.argsort(lengths[open_], kind="stable")]
        # rows of a matrix differ in length by a half at most
        level = np.floor(np.log2(np.maximum(lengths[open_], 1)) * 2).astype(np.int64)
        for bucket in np.split(open_, np.flatnonzero(np.diff(level)) + 1):
            if len(bucket) == 0:
                continue
            width = int(lengths[bucket].max())
            for rows in np.split(bucket, range(_CELLS // width, len(bucket), _CELLS // width)):
                size = lengths[rows]
                matrix = np.full((len(rows), width), -1, np.int32)
                matrix[np.arange(width) < size[:, None]] = self.single[data[wordhash._ranges(begin[rows], size)]]
                matrix = self._merge_rows(matrix)
                counts[rows] = (matrix >= 0).sum(axis=1)
                parts.append((rows, matrix[matrix >= 0]))
        total = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in parts:
            out[wordhash._ranges(total[rows], counts[rows])] = ids
        return out, counts

    def _ranks(self, matrix: np.ndarray) -> np.ndarray:
        out = np.full((matrix.shape[0], matrix.shape[1] - 1), _NEVER, np.int32)
        inner = matrix[:, 1:] >= 0
        out[inner] = self.table.look_up(matrix[:, :-1][inner], matrix[:, 1:][inner])
        return out

    def _merge_rows(self, matrix: np.ndarray) -> np.ndarray:
        """Each round every row merges its leftmost pair of lowest rank and closes the gap; rows without one leave."""
        done = np.full_like(matrix, -1)
        rows = np.arange(len(matrix))
        ranks = self._ranks(matrix)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            lowest = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NEVER)
            over = lowest == _NEVER
            done[rows[over], : matrix.shape[1]] = matrix[over]
            rows, matrix, ranks, at, lowest = rows[~over], matrix[~over], ranks[~over], at[~over], lowest[~over]
            n, width = matrix.shape
            if n == 0:
                break
            line = np.arange(n)
            matrix[line, at] = lowest
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            matrix = matrix[keep].reshape(n, width - 1)
            # the rank of the merged pair goes, its neighbours get new ones
            keep = np.ones((n, width - 1), bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                left, right = matrix[ok, side[ok]], matrix[ok, np.minimum(side[ok] + 1, width - 2)]
                inner = right >= 0
                new = np.full(len(ok), _NEVER, np.int32)
                new[inner] = self.table.look_up(left[inner], right[inner])
                ranks[ok, side[ok]] = new
        return done

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        """One long piece as a matrix whose rows are its stretches: the lowest rank of each row is kept, so that a
        merge looks at the rows' minima and at the row it changes. Gaps are closed by links to the neighbours."""
        n = len(symbols)
        height = -(-n // WIDEST)
        symbols = symbols.copy()
        ranks = np.full(height * WIDEST, _NEVER, np.int32)
        ranks[: n - 1] = self.table.look_up(symbols[:-1], symbols[1:])
        grid = ranks.reshape(height, WIDEST)
        lowest = grid.min(axis=1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = np.ones(n, bool)
        pairs: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            key = (int(symbols[a]), int(symbols[b]))
            if key not in pairs:
                pairs[key] = int(self.table.look_up(symbols[[a]], symbols[[b]])[0])
            return pairs[key]

        while True:
            row = int(lowest.argmin())
            if lowest[row] == _NEVER:
                break
            at = row * WIDEST + int(grid[row].argmin())
            gone = after[at]
            symbols[at] = ranks[at]
            alive[gone] = False
            ranks[gone] = _NEVER
            after[at] = after[gone]
            ranks[at] = rank(at, after[at]) if after[at] < n else _NEVER
            if after[at] < n:
                before[after[at]] = at
            changed = {row, gone // WIDEST}
            if before[at] >= 0:
                ranks[before[at]] = rank(before[at], at)
                changed.add(before[at] // WIDEST)
            for r in changed:
                lowest[r] = grid[r].min()
        return symbols[alive]
