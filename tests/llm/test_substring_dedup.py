from __future__ import annotations

import random
import re

from verdure.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        spans, k = [], 0
        while k < len(w):
            if gone[k]:
                start = k
                while k < len(w) and gone[k]:
                    k += 1
                spans.append((start, k))
            else:
                k += 1
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), tuple(spans)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, tuple(map(tuple, r.spans))) for r in df.collect()), key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    pick = [f"wörd{k}" for k in range(30)]
    passages = [rng.choices(pick, k=rng.randrange(3, 20)) for _ in range(8)]
    rows = []
    for d in range(n):
        w = rng.choices(pick, k=rng.choice([0, 1, 4, 5, 30]))
        for _ in range(rng.randrange(3)):
            w += rng.choice(passages)
        rows.append((d * 3, rng.choice([" ", "\n", "\t "]).join(w)))
    rng.shuffle(rows)
    return rows


def test_random_passages_over_many_slices(spark):
    for seed, slice_bytes in ((1, 2000), (2, 10**9)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert found(substring_dedup(df, 5, slice_bytes)) == brute(rows, 5)


def test_special_rows_and_clashing_columns(spark):
    long = "x" * 200_000 + " a b c d e f " + "a b " * 30_000
    rows = [(5, long), (7, long), (7, "a b c d e f"), (None, "a b c d e f"), (None, None), (8, None), (9, ""), (10, " \n"), (2, "a b c"), (11, "a\x0bb c d e f"), (2, "b c d e f"), (3, "b c d e f")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, slice int, hashes string")
    for slice_bytes in (100_000, 10**9):
        assert found(substring_dedup(df, 5, slice_bytes)) == brute(rows, 5)
    assert substring_dedup(df.limit(0)).count() == 0
