from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from verdure.llm import lexical_search as module
from verdure.llm.lexical_search import lexical_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    """All scores of all rows, one after the other."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for doc_id, bag in bags:
            m = 100 - 75 + 75 * sum(bag.values()) * n_docs // n_terms
            score = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item_id, rank, s[2], s[3]) for rank, s in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.choice([1, 2, 2, 3]))) for _ in range(120)]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [rng.choice(" .-_").join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(n)]
    return texts + rng.choices(texts, k=n // 3)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    letters = "azAZ09/:@[`{ \t\n\x00\x7f\x80é日😀_-"
    texts = [None, "", "x", "É É", "a b"] + ["".join(rng.choices(letters, k=rng.choice([1, 10, 300]))) for _ in range(300)]
    hashes, first = terms_of(pa.array(texts, pa.string()))
    words = [t for text in texts for t in terms(text)]
    assert np.diff(first).tolist() == [len(terms(t)) for t in texts]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def local(docs, items, k=10):
    """The search of one task, in this process, over batches of 50 documents."""
    queries = module.Queries(items)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    batches = [
        module.count_terms(pa.record_batch([list(c) for c in zip(*docs[i : i + 50])], schema=schema), queries.terms)
        for i in range(0, len(docs), 50)
    ]
    n = [x for b in batches for x in b.column("n").to_pylist()]
    df = Counter(t for b in batches for row in b.column("terms").to_pylist() for t in row)
    weights = np.array([module.weight(len(n), df[t]) if t in df else 0 for t in range(len(queries.terms))], np.int64)
    parts = (b.slice(i, 5) for b in batches for i in range(0, b.num_rows, 5))
    best = module.search_batches(parts, queries.items, weights, len(n), sum(n), k)
    rows = [(q.item_id, rank, *row) for q, held in zip(queries.items, best) for rank, row in enumerate(held.rows(), 1)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("depth, postings, documents", [(1, 50, 7), (4, 3000, 40), (32, 1 << 20, 1 << 16)])
def test_against_all_scores(frame, monkeypatch, depth, postings, documents):
    docs = list(enumerate(corpus(depth, 300)))
    items = list(enumerate(corpus(depth + 1, 20))) + [(99, docs[3][1]), (100, "not there"), (101, "a a a b")]
    expected = brute(docs, items)
    monkeypatch.setattr(module, "FIRST_DEPTH", depth)
    monkeypatch.setattr(module, "POSTINGS", postings)
    monkeypatch.setattr(module, "DOCUMENTS", documents)
    assert local(docs, items) == expected
    got = lexical_search(frame(docs, "doc_id long, text string").repartition(3), frame(items, "item_id long, text string"))
    assert found(got) == expected


def test_lists_are_not_read_to_their_end():
    docs = [(i, " ".join(["rare"] * 9 if i < 20 else ["common"] * (1 + i % 9) + ["x"] * 20)) for i in range(5000)]
    rows = [(i, len(t.split()), t.split()[0] == "rare") for i, t in docs]
    table = pa.table({
        "doc_id": pa.array([r[0] for r in rows]), "n": pa.array([r[1] for r in rows]),
        "terms": pa.array([[1] if r[2] else [0] for r in rows], pa.list_(pa.int32())),
        "tfs": pa.array([[9] if r[2] else [1 + r[0] % 9] for r in rows], pa.list_(pa.int32())),
    })
    lists = module.ImpactLists(table, np.array([500, 6000]), 5000, 100000)
    scored = []
    score = lists._score
    lists._score = lambda fresh, *rest: (scored.extend(fresh.tolist()), score(fresh, *rest))
    held = module.Best(10)
    lists.search(module.Item(1, np.array([0, 1]), np.array([1, 1])), held)
    assert [i for i, _ in held.rows()] == list(range(10))
    assert len(scored) < 200


def test_ties_repeats_nulls_and_long_texts(frame):
    docs = [(i, "same words here") for i in range(50, 0, -1)] + [(None, "same words here"), (7, "same words here")]
    docs += [(60, None), (61, ""), (62, " .,"), (63, "other " * 40000 + "words"), (64, "Words")]
    items = [(1, "SAME words"), (1, "here"), (2, "words"), (2, "words"), (3, None), (4, ""), (None, "other"), (5, "w" * 9000)]
    docs_df = frame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, item_id string")
    items_df = frame([(*i, 2.0, "y") for i in items], "item_id long, text string, score double, doc_id string")
    assert found(lexical_search(docs_df, items_df)) == brute(docs, items)


def test_several_blocks_give_the_same(frame, monkeypatch):
    docs, items = list(enumerate(corpus(5, 60))), list(enumerate(corpus(6, 9)))
    monkeypatch.setattr(module, "BLOCK_BYTES", 2000)
    got = lexical_search(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"))
    assert found(got) == brute(docs, items)


def test_empty_tables(frame):
    none, one = frame([], "doc_id long, text string"), frame([(1, "a")], "doc_id long, text string")
    items, no_items = frame([(1, "a b")], "item_id long, text string"), frame([], "item_id long, text string")
    assert found(lexical_search(none, items)) == found(lexical_search(one, no_items)) == found(lexical_search(none, no_items)) == []
    assert found(lexical_search(one, items)) == brute([(1, "a")], [(1, "a b")])
