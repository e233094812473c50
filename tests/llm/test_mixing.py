from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from verdure.llm import mixing
from verdure.llm.mixing import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, share, most):
    """Excess is dealt out again by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed, free = share * sum(sizes.values()), {}, list(names)
    while free:
        rest = total - sum(fixed.values())
        out = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return fixed | out
        fixed |= {s: most * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    return fixed


def brute(rows, weights=(3, 1, 2), share=1.5, most=2, like=lambda n: 1.0):
    docs = [(d, s, len(WORD.findall(t or "")), hashlib.md5(f"{'' if d is None else d}|{t or ''}".encode()).hexdigest()) for d, t, s in rows]
    sizes = {s: 0 for _, _, s in rows}
    for _, s, n, _ in docs:
        sizes[s] += n
    goal = targets(sizes, weights, share, most)
    out = []
    for s in sizes:
        own = [x for x in docs if x[1] == s]
        low, high = 0.0, 1e9
        for _ in range(200):
            scale = (low + high) / 2
            low, high = (scale, high) if sum(n * min(most, scale * like(n)) for _, _, n, _ in own) < goal[s] - 1e-9 else (low, scale)
        scale = high if sizes[s] else 0.0
        ranked, need = {}, goal[s]
        copies = {}
        for d, _, n, key in own:
            e = min(most, scale * like(n))
            if abs(e - round(e)) < 1e-9:
                e = round(e)
            copies[key] = math.floor(e)
            need -= copies[key] * n
            if e > copies[key]:
                u, p = (int(key[:12], 16) + 0.5) / 2**48, e - copies[key]
                odds = u / (1 - u) / (p / (1 - p))
                ranked[key] = (odds / (1 + odds), ranked.get(key, (0, 0))[1] + n)
        for key, (_, n) in sorted(ranked.items(), key=lambda x: (x[1][0], x[0])):
            if n / 2 > need + 1e-6:
                break
            copies[key] += 1
            need -= n
        out += [(d, n, sizes[s], round(goal[s], 6), copies[key] * n) for d, _, n, key in own]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["a"] * 10 + ["b", "c", "é", "\U0001f600", "Z", None, "￿"]
    return [(d, " ".join(["wörd"] * int(rng.paretovariate(0.8)) if rng.random() < 0.95 else []), rng.choice(names)) for d in range(n)]


@pytest.mark.parametrize("ranges", [4096, 3])
def test_mix(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    df = mix_sources(docs)
    assert found(df) == brute(rows)
    sums = df.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.t - r.target) <= r.most / 2 + 1e-6 for r in sums)
    assert found(mix_sources(docs.repartition(2))) == found(df)


def test_preferences_and_other_shares(spark):
    rows = corpus(2, 250)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    like = F.when(F.col("size") < 3, 0.5).when(F.col("size") > 30, 4.0)
    got = found(mix_sources(docs, (1, 1, 5, 0.5), 2.4, 3, like))
    assert got == brute(rows, (1, 1, 5, 0.5), 2.4, 3, lambda n: 0.5 if n < 3 else 4.0 if n > 30 else 1.0)
    assert {r.taken - 2 * r["size"] for r in mix_sources(docs, share=9.0).collect()} == {0}


def test_special_rows_and_clashing_columns(spark):
    long = "many words " * 30_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, long, None), (3, long, None), (4, "a", ""), (5, " ", "empty"), (6, "a b c", "x"), (None, None, None)]
    docs = spark.createDataFrame([(*r, 9, "k", 0.1) for r in rows], "doc_id long, text string, source string, taken int, key string, rank double")
    df = mix_sources(docs)
    assert found(df) == brute(rows)
    assert {r.key for r in df.collect()} == {"k"}
    assert mix_sources(docs.limit(0)).count() == 0
