from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from verdure.llm.bpe_codec import Codec, _read, decode_ids, encode_texts
from verdure.llm.queries import op11

PATHS = [public_tokenizers.path(f"byte_bpe_{n}50k.tiktoken") for n in ("", "multi_")]
PATTERN = public_tokenizers.PATTERN

SPECIAL = [
    None, "", " ", "\n", "  \n  x", "don't we'll they've I'm he'd 'sand ''s 're 'r 'l", " 's\n's !'s a's's 'S",
    "a<|endoftext|>b", "x" * 5000, "abc" * 1000, "aab" * 3000, "日本語 テキスト 123４５６ ½ ²", "e\u0301 \u200b\u00a0\u3000x\u2028y\x1c\x85z",
    "😀😀 👩‍👩‍👧 🇩🇪", "\t\t\tif x:\r\n\r\n  y", "1234567890 12,345.67 $%&", "a  b   c    d ", "\x00\x01\x7f", "it's", "'", "'s", "''",
    "İstanbul ǅ ß", "Donaudampfschifffahrtsgesellschaftskapitän" * 20, " " * 3000, "\n" * 700 + "x", "-" * 2000, "é" * 300,
]


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(seed, n=300):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "éüñçßÅΩж日本" + "0123456789²" + " " * 12 + "\n\t\u00a0" + "'''.,!?-$|<>"
    words = ["".join(rng.choices(letters, k=rng.choice([1, 3, 9, 40]))) for _ in range(200)]
    return [" ".join(rng.choices(words, k=rng.choice([1, 5, 60]))) for _ in range(n)]


def lists(codec, texts):
    ids, bounds = codec.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("widest", [3, 64, 256])
def test_ids_are_those_of_the_library(monkeypatch, path, widest):
    monkeypatch.setattr("verdure.llm.bpe_codec.WIDEST", widest)
    codec, own = Codec(_read(path), PATTERN), library(path)
    for texts in (SPECIAL, random_texts(1), random_texts(2), SPECIAL):
        assert lists(codec, texts) == [own.encode_ordinary(t or "") for t in texts]


def test_every_character_goes_to_the_same_piece():
    codec, own = Codec(_read(PATHS[1]), PATTERN), library(PATHS[1])
    codes = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}0 {chr(c)}!" for c in codes[i : i + 997]) for i in range(0, len(codes), 997)]
    assert lists(codec, texts) == [own.encode_ordinary(t) for t in texts]


def test_a_small_memo_and_empty_batches_change_nothing():
    codec, own = Codec(_read(PATHS[1]), PATTERN), library(PATHS[1])
    codec.memo.limit = 50
    for seed in range(3):
        texts = random_texts(seed, 20)
        assert lists(codec, texts) == [own.encode_ordinary(t) for t in texts]
    assert lists(codec, []) == [] and lists(codec, [None, ""]) == [[], []]


def test_round_trip_with_nulls_repeats_and_clashing_columns(frame):
    rows = [(i if i % 7 else None, t, "x", [1]) for i, t in enumerate(SPECIAL + random_texts(5, 40) + SPECIAL)]
    docs = frame(rows, "doc_id long, text string, decoded string, ids array<int>")
    got = decode_ids(encode_texts(docs, PATHS[1], PATTERN), PATHS[1])
    assert got.columns == ["doc_id", "ids", "decoded"]
    back = sorted((r.doc_id or 0, bytes(r.decoded)) for r in got.collect())
    assert back == sorted((i or 0, (t or "").encode()) for i, t, _, _ in rows)


def test_decoding_of_odd_lists(frame):
    rows = [(1, None), (2, []), (3, [None, 65, None]), (4, [65, 66])]
    own = library(PATHS[1])
    got = {r.doc_id: bytes(r.decoded) for r in decode_ids(frame(rows, "doc_id long, ids array<int>"), PATHS[1]).collect()}
    assert got == {1: b"", 2: b"", 3: own.decode_bytes([65]), 4: own.decode_bytes([65, 66])}
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode_ids(frame([(1, [50256])], "doc_id long, ids array<int>"), PATHS[1]).collect()


def test_empty_table(frame):
    assert decode_ids(encode_texts(frame([], "doc_id long, text string"), PATHS[1], PATTERN), PATHS[1]).collect() == []


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    own = library(PATHS[1])
    got = {r.doc_id: r for r in op11(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = own.encode_ordinary(d.text or ""), got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
