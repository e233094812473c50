"""Token ids of documents in binary shard files with Elias-Fano coded boundaries.

A shard file holds the ids of consecutive documents one after the other (two or four bytes each, little-endian), then
the Elias-Fano codes of the document boundaries and of the doc_ids, then a trailer with the section sizes. Ids are
written as they come, so a task holds one batch and the boundaries of its shard only. The range of one document is two
selects.

Tasks write through ``pyarrow.fs`` under names of their own and return a manifest row per file. Spark commits the
manifest, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import os
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdure.llm import wordhash
from verdure.llm.elias_fano import EliasFano, encode
from verdure.llm.pretokens import Memo, splitter
from verdure.session import materialize, scratch_path

_MAGIC = b"VRDTOK01"
# bytes of the boundary code and of the doc_id code, documents, rows without id, ids, smallest doc_id, bytes per id
_TRAILER = struct.Struct("<QQQQQqB7x8s")
SHARD_IDS = 64 << 20
_READ_BYTES = 4 << 20


class Encoder:
    """Ids of whole texts. Every distinct pre-token is encoded once by the tokenizers library and remembered."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(content)
        self.splitter = splitter(content)
        self.memo = Memo()
        self._forget()

    def _forget(self) -> None:
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end_id`` after it, and their number by text."""
        p = self.splitter.pieces(texts)
        slots, fresh, reset = self.memo.look_up(p)
        if reset:
            self._forget()
        raw = p.data.tobytes()
        new = [raw[a:b].decode() for a, b in zip(p.begin[fresh].tolist(), p.end[fresh].tolist())]
        found = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
        lengths = np.array([len(f) for f in found], np.int64)
        self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.uint32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        begin = self.start[slots]
        lengths = self.start[slots + 1] - begin
        ids = self.ids[wordhash._ranges(begin, lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])[p.first]
        counts = np.diff(total)
        out = np.full(len(ids) + len(counts), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, counts + 1


@lru_cache(maxsize=2)
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes ``docs(doc_id, text)`` in ascending order of doc_id and returns the manifest.

    Manifest: ``shard, part, path, n_docs, n_ids``, one row per file; ``(shard, part)`` is the order of the files.
    Rows with a null doc_id come first. A null or empty text is the end id alone. Repeated rows are written as often
    as they occur; the order among equal doc_ids is that of their texts. Other columns are not looked at. ``folder``
    defaults to a new one below ``spark.checkpoint.dir``; it must be one that ``pyarrow.fs`` can open from all
    executors. The tokenizer file is read once at the driver and sent to the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    folder = folder or scratch_path(spark, "tokens")
    width = 2 if Tokenizer.from_str(content.value).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def write(batches):
        encoder, shard = _encoder(content.value), TaskContext.get().partitionId()
        writer, part = None, 0
        for batch in batches:
            for piece in wordhash.slices(batch, "text", 2 << 20):
                ids, counts = encoder.encode(piece.column("text"), end_id)
                writer = writer or _ShardWriter(folder, width)
                writer.add(piece.column("doc_id"), ids, counts)
                if writer.n_ids >= SHARD_IDS:
                    yield writer.close(shard, part)
                    writer, part = None, part + 1
        if writer:
            yield writer.close(shard, part)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "shard int, part int, path string, n_docs long, n_ids long"), "manifest")


class _ShardWriter:
    def __init__(self, folder: str, width: int):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        self.path = f"{folder}/{uuid.uuid4().hex}.tok"
        self.out = system.open_output_stream(f"{root}/{self.path.rsplit('/', 1)[1]}")
        self.width, self.n_ids, self.nulls = width, 0, 0
        self.ends, self.doc_ids = [np.zeros(1, np.int64)], []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.ends.append(self.n_ids + np.cumsum(counts))
        self.n_ids += len(ids)
        self.nulls += doc_ids.null_count
        self.doc_ids.append(doc_ids.drop_null().cast(pa.int64()).to_numpy())

    def close(self, shard: int, part: int) -> pa.RecordBatch:
        bounds, doc_ids = encode(np.concatenate(self.ends)), np.concatenate(self.doc_ids)
        low = int(doc_ids[0]) if len(doc_ids) else 0
        names = encode(doc_ids.view(np.uint64) - np.array([low], np.int64).view(np.uint64))
        n_docs = len(doc_ids) + self.nulls
        self.out.write(bounds + names)
        self.out.write(_TRAILER.pack(len(bounds), len(names), n_docs, self.nulls, self.n_ids, low, self.width, _MAGIC))
        self.out.close()
        row = {"shard": [shard], "part": [part], "path": [self.path], "n_docs": [n_docs], "n_ids": [self.n_ids]}
        schema = {"shard": pa.int32(), "part": pa.int32(), "path": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()}
        return pa.RecordBatch.from_pydict(row, pa.schema(list(schema.items())))


class ShardReader:
    """Random access to the documents of one shard file."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        trailer = self.file.read_at(_TRAILER.size, size - _TRAILER.size)
        bounds, names, self.n_docs, self.nulls, self.n_ids, self.low, self.width, magic = _TRAILER.unpack(trailer)
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a token file")
        at = size - _TRAILER.size - bounds - names
        self.bounds = EliasFano(self.file.read_at(bounds, at))
        self.names = EliasFano(self.file.read_at(names, at + bounds))

    def doc_ids(self, index: np.ndarray) -> pa.Array:
        known = index >= self.nulls
        steps = np.zeros(len(index), np.int64)
        steps[known] = self.names[index[known] - self.nulls]
        return pa.array(steps + self.low, mask=~known)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids ``start:stop`` of the shard as 32-bit numbers."""
        data = self.file.read_at((stop - start) * self.width, start * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def documents(self):
        """Batches of ``doc_id, start, n_tokens, ids``; ids are little-endian 32-bit numbers."""
        done = 0
        while done < self.n_docs:
            stop = min(done + 1024, self.n_docs)
            bounds = self.bounds[np.arange(done, stop + 1)]
            # as many whole documents as fit into one read, one at least
            stop = done + max(1, int(np.searchsorted(bounds, bounds[0] + _READ_BYTES // 4, side="right")) - 1)
            stop = min(stop, self.n_docs)
            bounds = bounds[: stop - done + 1]
            data = self.ids(int(bounds[0]), int(bounds[-1]))
            offsets = (bounds - bounds[0]) * 4
            blobs = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), stop - done, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
            )
            columns = [self.doc_ids(np.arange(done, stop)), pa.array(bounds[:-1]), pa.array(np.diff(bounds))]
            yield pa.RecordBatch.from_arrays([*columns, blobs.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
            done = stop


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the files that a manifest lists.

    ``start`` counts the ids of all documents before it over all files; ``ids`` is the binary of the ids as
    little-endian 32-bit numbers. An empty manifest gives no rows.
    """
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    # one row per file: dealt evenly, so that each task reads its share of files
    dealt = based.select("base", "path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches):
        for batch in batches:
            for base, path in zip(batch.column("base").to_pylist(), batch.column("path").to_pylist()):
                for rows in ShardReader(path).documents():
                    start = pc.add(rows.column("start"), base)
                    yield rows.set_column(1, "start", start)

    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
