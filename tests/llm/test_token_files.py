from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_token_counts import LIBRARY, PATH, SPECIAL, random_texts

from verdure.llm import token_files
from verdure.llm.elias_fano import EliasFano, encode
from verdure.llm.token_files import ShardReader, read_token_files, write_token_files


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 62)), st.integers(0, 40))
def test_elias_fano_gives_every_number_back(numbers, shift):
    values = np.sort(np.array(numbers, np.int64) >> shift)
    code = EliasFano(encode(values))
    assert np.array_equal(code[np.arange(len(values))], values)


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, 100_000))
    assert len(encode(values)) * 8 / len(values) < np.log2(values[-1] / len(values)) + 2.4


def expected(rows):
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def found(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in df.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("shard_ids", [300, 1 << 26])
def test_round_trip(spark, monkeypatch, shard_ids):
    monkeypatch.setattr(token_files, "SHARD_IDS", shard_ids)
    rows = [(i * 7 - 50, t) for i, t in enumerate(SPECIAL + random_texts(4, 60))]
    rows += [rows[0], rows[5], (-50, "other text"), (None, "no id"), (None, "no id"), (None, None), (2**61, "far")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    assert found(read_token_files(write_token_files(df, PATH))) == expected(rows)


def test_one_document_and_no_document(spark):
    df = spark.createDataFrame([(3, "a b"), (9, "c")], "doc_id long, text string")
    manifest = write_token_files(df, PATH, end_id=7)
    reader = ShardReader(manifest.orderBy("shard").first().path)
    bounds = reader.bounds[[0, 1]]
    assert reader.ids(*bounds).tolist()[-1] == 7
    assert read_token_files(write_token_files(df.limit(0), PATH)).count() == 0


def test_wide_ids(spark):
    df = spark.createDataFrame([(1, "wide"), (2, None)], "doc_id long, text string")
    rows = read_token_files(write_token_files(df, public_tokenizers.path("byte_bpe_50k.json"), end_id=70_000)).collect()
    assert [np.frombuffer(r.ids, "<u4")[-1] for r in rows] == [70_000, 70_000]
