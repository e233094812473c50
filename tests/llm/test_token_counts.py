from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from verdure.llm.pretokens import splitter
from verdure.llm.token_counts import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONTENT = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)

SPECIAL = [
    None, "", " ", "\n", "  \n  x", "don't we'll they've I'm he'd 'sand ''s 're 'r 'l", " 's\n's !'s a's's 'S",
    "a<|endoftext|>b", "  <|endoftext|>  <|endoftext|><|endoftext|>'s", "<|endoftext", "|>", "x" * 5000, "abc" * 1000,
    "日本語 テキスト 123４５６ ½ ²", "e\u0301 \u200b\u00a0\u3000x\u2028y\x1c\x85z", "😀😀 👩‍👩‍👧 🇩🇪", "\t\t\tif x:\r\n\r\n  y",
    "1234567890 12,345.67 $%&", "a  b   c    d ", "\x00\x01\x7f", "it's", "'", "'s", "''", "x '", "İstanbul ǅ ß",
]


def random_texts(seed, n=300):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "éüñçßÅΩж日本" + "0123456789²" + " " * 12 + "\n\t\u00a0" + "'''.,!?-$|<>"
    return ["".join(rng.choices(letters, k=rng.choice([3, 20, 200, 2000]))) for _ in range(n)]


def expected(texts):
    return [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_pieces_are_those_of_the_library():
    split = splitter(CONTENT)
    for text in random_texts(1) + [t for t in SPECIAL if t and "<|endoftext|>" not in t]:
        p = split.pieces(pa.array([text]))
        got = [bytes(p.data[a:b]).decode() for a, b in zip(p.begin, p.end)]
        assert got == [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("long", [4, 512])
def test_counts_are_those_of_the_library(monkeypatch, long):
    monkeypatch.setattr("verdure.llm.token_counts.LONG", long)
    counter = Counter(CONTENT)
    for texts in (SPECIAL, random_texts(2), random_texts(3), SPECIAL):
        n_bytes, n_tokens = counter.count(pa.array(texts, pa.string()))
        assert n_tokens.tolist() == expected(texts)
        assert n_bytes.tolist() == [len((t or "").encode()) for t in texts]


def test_a_small_memo_changes_nothing():
    counter = Counter(CONTENT)
    counter.memo.limit = 50
    for seed in range(4):
        texts = random_texts(seed, 20)
        assert counter.count(pa.array(texts))[1].tolist() == expected(texts)
    assert np.array_equal(counter.count(pa.array([], pa.string()))[1], [])


def test_rows(spark):
    rows = [(None if i == 3 else i % 20, t, "clash") for i, t in enumerate(SPECIAL)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    got = [tuple(r) for r in token_counts(df, PATH, limit=4).collect()]
    want = [(d, len((t or "").encode()), n, n > 4) for (d, t, _), n in zip(rows, expected(SPECIAL))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_counts(df.limit(0), PATH).count() == 0
