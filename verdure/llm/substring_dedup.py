"""Removal of word windows that an earlier document already holds.

Documents are cut into slices of consecutive doc_ids. A slice sends each of its distinct window hashes once, so a
passage that a third of all documents share costs one entry per slice. Buckets of hash ranges compare the slices: a
window that a smaller slice also holds is in a document with a smaller doc_id, whatever that document is. The answer
is one bit per entry. Back in its slice, a window goes if its bit is set or if a smaller doc_id of the slice holds it.
Overlapping windows then merge into maximal removal intervals.

Windows are compared by a 64-bit Rabin-Karp hash of their word hashes. Among ``N`` windows about ``N**2 / 2**65`` pairs
of different windows are taken for equal: none in a billion windows, and a millionth of all windows at 100 TB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import wordhash

SLICE_BYTES = 24 << 20


def substring_dedup(docs: DataFrame, size: int = 13, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` for every row of ``docs(doc_id, text)``.

    A word goes if some ``size``-word window over it also starts in a document with a smaller doc_id. Windows are
    judged on the input. ``kept`` has the remaining words joined by one space; ``spans`` are the maximal runs of
    removed words as ``[start, end)``. A null or empty text has no words. Repeated doc_ids never remove each other's
    words. Rows with a null doc_id are left whole and remove nothing. Other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    cuts = docs.approxQuantile("doc_id", [k / slices for k in range(1, slices)], 0.2 / slices) if slices > 1 else []
    bounds = [-float("inf"), *sorted(set(cuts)), float("inf")]
    numbered = docs.withColumn("at", F.col("doc_id").cast("double"))
    if len(bounds) > 2:
        numbered = Bucketizer(splits=bounds, inputCol="at", outputCol="bin", handleInvalid="keep").transform(numbered)
    else:
        numbered = numbered.withColumn("bin", F.lit(0))
    # rows without an id need no order, so any even spread will do
    part = F.when(F.col("doc_id").isNotNull(), F.col("bin")).otherwise(len(bounds) + F.expr(f"pmod(xxhash64(text), {slices})"))
    sliced = numbered.select(part.cast("int").alias("slice"), "doc_id", "text")
    edges = _edges(slices)

    def send(table: pa.Table) -> pa.Table:
        hashes = np.unique(_slice_windows(table, size)[0])
        at = np.searchsorted(hashes, edges)
        full = np.flatnonzero(np.diff(at))
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "slice": pa.array(np.repeat(table["slice"][0].as_py(), len(full)), pa.int32()),
                "hashes": pa.array([_packed(hashes[at[b] : at[b + 1]]) for b in full], pa.binary()),
            }
        )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        parts = [_unpacked(h) for h in table["hashes"].to_pylist()]
        ends = np.cumsum([len(p) for p in parts])
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        known = np.zeros(len(hashes), bool)
        known[order[1:]] = hashes[1:] == hashes[:-1]
        bits = [np.packbits(k).tobytes() for k in np.split(known, ends[:-1])]
        return pa.table({"slice": table["slice"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        bits = dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist()))
        return _removed(table, size, edges, bits)

    sent = sliced.groupBy("slice").applyInArrow(send, "bucket int, slice int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(compare, "slice int, bucket int, bits binary")
    return (
        sliced.groupBy("slice")
        .cogroup(answers.groupBy("slice"))
        .applyInArrow(
            remove,
            "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long, end:long>>",
        )
    )


def _edges(buckets: int) -> np.ndarray:
    """Bounds of equal hash ranges; the last bound lies above every hash."""
    low = [(k << 64) // buckets for k in range(buckets)]
    return np.array([*low, (1 << 64) - 1], np.uint64)


def _packed(ascending: np.ndarray) -> bytes:
    """Differences by byte place, so that the empty high bytes lie together for the shuffle's compression."""
    steps = np.diff(ascending, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _parts(table: pa.Table):
    for batch in table.combine_chunks().to_batches():
        yield from wordhash.slices(batch, "text")


def _slice_windows(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes of the rows with an id, their rows, and the word counts of all rows."""
    hashes, rows, counts, done = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for part in _parts(table):
        w = wordhash.words(part.column("text"))
        n = np.diff(w.first)
        per_row = np.maximum(n - size + 1, 0)
        per_row[part.column("doc_id").is_null().to_numpy(zero_copy_only=False)] = 0
        runs = wordhash.windows(w.hashes, size)
        at = wordhash._ranges(w.first[:-1], per_row)
        # the highest value is left to the end of the last bucket
        hashes.append(np.minimum(runs[at], np.uint64((1 << 64) - 2)))
        rows.append(np.repeat(np.arange(done, done + len(n)), per_row))
        counts.append(n)
        done += len(n)
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(counts)


def _removed(table: pa.Table, size: int, edges: np.ndarray, bits: dict[int, bytes]) -> pa.Table:
    hashes, rows, counts = _slice_windows(table, size)
    ids = table["doc_id"].to_numpy(zero_copy_only=False)
    values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    at = np.searchsorted(values, edges)
    known = np.zeros(len(values), bool)
    for bucket, own in bits.items():
        a, b = at[bucket], at[bucket + 1]
        known[a:b] = np.unpackbits(np.frombuffer(own, np.uint8), count=b - a)
    # rows are in ascending order of doc_id, so the first occurrence has the smallest one
    gone = known[inverse] | (ids[rows[first]][inverse] < ids[rows]) if len(values) else np.zeros(0, bool)

    starts = np.concatenate([[0], np.cumsum(counts)])
    begin = starts[rows[gone]] + (np.flatnonzero(gone) - np.searchsorted(rows, rows[gone]))
    change = np.bincount(begin, minlength=starts[-1] + 1) - np.bincount(begin + size, minlength=starts[-1] + 1)[: starts[-1] + 1]
    dropped = np.cumsum(change)[:-1] > 0

    columns = {"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "spans": []}
    row = 0
    for part in _parts(table):
        w = wordhash.words(part.column("text"))
        n = part.num_rows
        own = dropped[starts[row] : starts[row + n]]
        removed = np.add.reduceat(np.append(own, False).astype(np.int64), w.first)[:-1] * (np.diff(w.first) > 0)
        columns["doc_id"].append(part.column("doc_id"))
        columns["n_words"].append(pa.array(np.diff(w.first)))
        columns["n_removed"].append(pa.array(removed))
        columns["kept"].append(_joined(w, ~own))
        columns["spans"].append(_spans(own, w.first))
        row += n
    schema = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "spans": _SPANS}
    return pa.table({c: pa.chunked_array(v, schema[c]) for c, v in columns.items()})


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _joined(w: wordhash.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of every document, joined by one space."""
    begin, length = w.begin[keep], (w.end - w.begin)[keep] + 1
    # each word is copied with the byte after it, which is then made a space
    data = np.append(w.data, np.uint8(32))[wordhash._ranges(begin, length)]
    ends = np.cumsum(length)
    data[ends - 1] = 32
    words = np.concatenate([[0], np.cumsum(keep)])[w.first]
    offsets = np.concatenate([[0], ends])[words]
    # the space after the last word of a document goes
    last = offsets[1:][np.diff(words) > 0] - 1
    data = np.delete(data, last)
    offsets = offsets - np.concatenate([[0], np.cumsum(np.diff(words) > 0)])
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return text.cast(pa.string())


def _spans(dropped: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of dropped words by document, counted from the document's first word."""
    before = np.concatenate([[False], dropped[:-1]]) if len(dropped) else dropped
    after = np.concatenate([dropped[1:], [False]]) if len(dropped) else dropped
    opens, closes = dropped & ~before, dropped & ~after
    inner = first[(first > 0) & (first < len(dropped))]
    opens[inner] = dropped[inner]
    closes[inner - 1] = dropped[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    base = first[np.searchsorted(first, start, side="right") - 1]
    offsets = np.searchsorted(start, first)
    pairs = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)
