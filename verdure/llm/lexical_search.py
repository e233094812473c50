"""Ranked lexical search of a query set over all documents with the Best Position Algorithm."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdure.llm import wordhash
from verdure.session import materialize

BLOCK_BYTES = 4 << 20  # text of the items that are searched together and sent to the tasks
POSTINGS = 2 << 20  # postings that a task indexes at a time
DOCUMENTS = 1 << 16  # documents that a task indexes at a time
FIRST_DEPTH = 32  # positions of every list read in the first round; each round reads twice as many

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _byte_codes() -> np.ndarray:
    """A code per byte: ASCII letters, folded, digits and all bytes of other characters make terms, the rest is 0."""
    codes = wordhash.mix(np.arange(5001, 5257, dtype=np.uint64) * _STEP) | np.uint64(1)
    inside = np.zeros(256, bool)
    for first, last in ("09", "AZ", "az"):
        inside[ord(first) : ord(last) + 1] = True
    inside[128:] = True
    codes[~inside] = 0
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


_CODES = _byte_codes()


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring rows of ``docs(doc_id, text)`` for every item.

    Terms are runs of ASCII letters and digits and of all characters outside ASCII in the whole text, with only A-Z
    folded; they are compared by 64-bit hashes. With N documents that hold a term, L terms in all, n terms in the
    document and df documents that hold the term, the weight is ``w = floor(1000 ln((2N + 2) / (2df + 1)))``, and
    the score adds ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` with ``m = 25 + (75 * n * N) div L`` over the
    item's terms with repeats. Documents without a score above 0 are not returned. Equal scores rank by ascending
    doc_id, null ids last.

    The documents are read once per block of items of ``BLOCK_BYTES``, and the postings of the block's terms are
    written. Each task then builds impact lists for a bounded number of its documents at a time and searches them
    for every item, starting from the scores of its earlier documents; only its ``k`` best per item leave it, and
    two window steps merge them. Null and empty texts have no terms. Items that repeat in id and text count once;
    items with one id and several texts are ranked apart, each from 1. Other columns are not looked at.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        rows = items.where(block == b).collect()
        ranked = _search_block(docs, [(r["item_id"], r["text"]) for r in rows], k)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def _search_block(docs: DataFrame, rows: list[tuple[int | None, str]], k: int) -> DataFrame:
    queries = Queries(rows)
    context = docs.sparkSession.sparkContext
    terms = context.broadcast(queries.terms)
    postings = materialize(_postings(docs, terms), "postings")
    total = postings.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counts = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    n_docs, n_terms = total["documents"], total["terms"]
    weights = np.zeros(len(queries.terms), np.int64)
    for term, df in counts:
        weights[term] = weight(n_docs, df)
    shared = context.broadcast((queries.items, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value
        best = search_batches(batches, items, w, n_docs, n_terms, k)
        columns = [(i, *row) for i, held in enumerate(best) for row in held.rows()]
        names = ["item", "doc_id", "score"]
        types = [pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array([c[i] for c in columns], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(arrays, names)

    candidates = postings.mapInArrow(search, "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order)
    kept = candidates.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k).drop("rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    names = docs.sparkSession.createDataFrame([(i, q.item_id) for i, q in enumerate(queries.items)], "item int, item_id long")
    return ranked.where(F.col("rank") <= k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Item(NamedTuple):
    item_id: int | None
    terms: np.ndarray  # places in the sorted terms of the block
    repeats: np.ndarray


class Queries:
    """The items of a block and their distinct terms as ascending hashes."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        hashes, first = terms_of(pa.array([text for _, text in rows], pa.string()))
        self.terms, places = np.unique(hashes, return_inverse=True)
        self.items = []
        for (item_id, _), a, b in zip(rows, first[:-1], first[1:]):
            own, repeats = np.unique(places[a:b], return_counts=True)
            self.items.append(Item(item_id, own.astype(np.int64), repeats.astype(np.int64)))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, text by text, and where each text's terms begin and end."""
    data, offsets = wordhash.buffers(texts)
    n = len(data)
    codes = _CODES[data]
    inside = np.concatenate([[False], codes != 0, [False]])
    starts = inside[1:-1] & ~inside[:-2]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    starts[cuts] = inside[1:-1][cuts]
    begin = np.flatnonzero(starts)
    first = np.searchsorted(begin, offsets)
    if len(begin) == 0:
        return np.zeros(0, np.uint64), first
    reach = np.diff(np.append(begin, n))
    at = np.arange(int(begin[0]), n, dtype=np.int64)
    at -= np.repeat(begin, reach)
    # bytes after a term have code 0, so their place does not matter
    outside = codes[begin[0] :] == 0
    at[outside] = 0
    powers = np.cumprod(np.full(int(at.max()) + 1, _STEP, np.uint64))
    return wordhash.mix(np.add.reduceat(powers[at] * codes[begin[0] :], begin - begin[0])), first


def _postings(docs: DataFrame, terms) -> DataFrame:
    """``doc_id, n, terms, tfs``: number of terms and the counts of the block's terms, of documents with any term."""

    def run(batches):
        for batch in batches:
            for part in wordhash.slices(batch, "text", 2 << 20):
                yield count_terms(part, terms.value)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def count_terms(part: pa.RecordBatch, vocabulary: np.ndarray) -> pa.RecordBatch:
    hashes, first = terms_of(part.column("text"))
    n = np.diff(first)
    wide = max(1, len(vocabulary))
    place = np.searchsorted(vocabulary, hashes)
    hit = np.flatnonzero((np.append(vocabulary, np.uint64(0))[place] == hashes) & (place < len(vocabulary)))
    owner = np.repeat(np.arange(len(n)), n)[hit]
    pairs, tfs = np.unique(owner * wide + place[hit], return_counts=True)
    some = np.flatnonzero(n > 0)
    ends = pa.array(np.searchsorted(pairs, np.append(some, len(n)) * wide), pa.int32())
    ids = part.column("doc_id").cast(pa.int64()).take(pa.array(some))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pairs % wide, tfs)]
    return pa.RecordBatch.from_arrays([ids, pa.array(n[some], pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])


def search_batches(
    batches: Iterator[pa.RecordBatch], items: list[Item], weights: np.ndarray, n_docs: int, n_terms: int, k: int
) -> list[Best]:
    """The ``k`` best documents of the batches for every item; one piece of the batches is indexed at a time."""
    best = [Best(k) for _ in items]
    for chunk in _chunks(batches):
        lists = ImpactLists(chunk, weights, n_docs, n_terms)
        for item, held in zip(items, best):
            lists.search(item, held)
    return best


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of batches with a bounded number of documents and postings; a batch is bounded by its own slices."""
    waiting, postings, documents = [], 0, 0
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            size = len(part.column("terms").flatten())
            if waiting and (postings + size > POSTINGS or documents + part.num_rows > DOCUMENTS):
                yield pa.Table.from_batches(waiting)
                waiting, postings, documents = [], 0, 0
            waiting.append(part)
            postings, documents = postings + size, documents + part.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting)


class Best:
    """The ``k`` best documents of an item so far; a null id ranks after all others."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.nulls = np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        worth = scores > 0 if len(self.scores) < self.k else scores >= self.scores[-1]
        scores = np.concatenate([self.scores, scores[worth]])
        ids, nulls = np.concatenate([self.ids, ids[worth]]), np.concatenate([self.nulls, nulls[worth]])
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]

    def kth(self) -> int:
        """The score an unseen document must reach; 0 while there are fewer than k."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def rows(self) -> list[tuple[int | None, int]]:
        return [(None if null else int(i), int(s)) for s, i, null in zip(self.scores, self.ids, self.nulls)]


class ImpactLists:
    """Per term the documents by falling impact, and per document its postings for direct accesses."""

    def __init__(self, chunk: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        columns = {name: chunk.column(name).combine_chunks() for name in chunk.column_names}
        n = columns["n"].to_numpy(zero_copy_only=False)
        counts = columns["terms"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term = columns["terms"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = columns["tfs"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), counts)
        m = 25 + 75 * n * n_docs // max(1, n_terms)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        some = impact > 0
        self.term, self.doc, self.impact = term[some], doc[some], impact[some]
        self.first = np.searchsorted(self.doc, np.arange(len(n) + 1))
        self.nulls = columns["doc_id"].is_null().to_numpy(zero_copy_only=False)
        self.ids = columns["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
        self.order = np.lexsort((self.doc, -self.impact, self.term))
        self.place = np.empty(len(self.order), np.int64)
        self.place[self.order] = np.arange(len(self.order))
        self.begin = np.searchsorted(self.term[self.order], np.arange(len(weights) + 1))
        self.local = np.full(len(weights), -1, np.int64)

    def search(self, item: Item, held: Best) -> None:
        """Reads all lists of the item in parallel. Every document met is scored by direct accesses, which also mark
        its positions in the other lists. The best position of a list is the last one before which all are seen; no
        unseen document can score more than the impacts there add up to, and the search stops once that is strictly
        below the k-th score."""
        begin, end = self.begin[item.terms], self.begin[item.terms + 1]
        kept = end > begin
        begin, length, repeats = begin[kept], (end - begin)[kept], item.repeats[kept]
        if len(begin) == 0:
            return
        self.local[item.terms[kept]] = np.arange(len(begin))
        offset = np.cumsum(length) - length
        seen = np.zeros(int(length.sum()), bool)
        known = np.zeros(len(self.ids), bool)
        best = np.zeros(len(begin), np.int64)
        read, depth = 0, FIRST_DEPTH
        while True:
            run = np.clip(length - read, 0, depth)
            seen[wordhash._ranges(offset + read, run)] = True
            met = self.doc[self.order[wordhash._ranges(begin + read, run)]]
            fresh = np.unique(met[~known[met]])
            known[fresh] = True
            self._score(fresh, begin, offset, repeats, seen, held)
            read, depth = read + depth, depth * 2
            limit = 0
            for i in np.flatnonzero(best < length):
                rest = seen[offset[i] + best[i] : offset[i] + length[i]]
                gap = int(rest.argmin())
                best[i] = length[i] if rest[gap] else best[i] + gap
                if best[i] < length[i]:
                    limit += int(repeats[i]) * int(self.impact[self.order[begin[i] + best[i] - 1]])
            if limit == 0 or limit < held.kth():
                break
        self.local[item.terms[kept]] = -1

    def _score(self, docs, begin, offset, repeats, seen, held: Best) -> None:
        """Direct accesses to all lists for these documents, in runs of bounded size."""
        counts = self.first[docs + 1] - self.first[docs]
        total = np.cumsum(counts)
        start = 0
        while start < len(docs):
            used = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, used + POSTINGS // 2, side="right")))
            own, size = docs[start:stop], counts[start:stop]
            at = wordhash._ranges(self.first[own], size)
            which = self.local[self.term[at]]
            hit = which >= 0
            values = np.where(hit, self.impact[at] * repeats[which], 0)
            scores = np.add.reduceat(values, np.cumsum(size) - size)
            at, which = at[hit], which[hit]
            seen[offset[which] + self.place[at] - begin[which]] = True
            held.offer(scores, self.ids[own], self.nulls[own])
            start = stop
