from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from verdure.llm import ngram_join
from verdure.llm.ngram_join import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(folded)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows):
    """(doc_id, n_shingles, component_id, n_links) of every row by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    near = [[] for _ in sets]
    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets):
            if i != j and x and y and a is not None and b is not None and 100 * len(x & y) >= 90 * len(x | y):
                near[i].append(j)
    out = []
    for i, (d, x) in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component = None if d is None else min(sets[k][0] for k in seen)
        out.append((d, len(x), component, len(near[i])))
    return out


def found(df):
    return [tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect()]


def order(rows):
    return sorted(rows, key=repr)


def corpus(seed, groups=25, extra=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 30, 80, 200]))) for _ in range(extra)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([20, 60, 150]))
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = " ".join(copy)
            texts.append(rng.choice([text, text.upper(), text + "\n" + passage, passage + "\t" + text]))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_all_links_of_random_documents(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert order(found(jaccard_join(df))) == order(brute(rows))


def test_chunks_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 150)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(found(jaccard_join(df))) == order(brute(rows))


def test_special_rows_and_clashing_columns(spark):
    long = "long " + "x" * 300_000 + " word " + "many words " * 20_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (5, "ONE"), (None, "one"), (6, "one two"), (7, long), (8, long + "."), (9, "é É"), (10, "é é"), (11, "one\x85"), (12, "one two")]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, sig string, n long")
    assert order(found(jaccard_join(df))) == order(brute(rows))
    assert jaccard_join(df.limit(0)).count() == 0
    assert jaccard_join(df.where("text is null").withColumn("prefix", F.lit(1))).count() == 1


def test_large_sets_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 64)
    rows = corpus(5, groups=20, extra=20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(found(jaccard_join(df))) == order(brute(rows))


def test_salted_elements_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 2)
    rows = corpus(4, groups=12, extra=20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(found(jaccard_join(df))) == order(brute(rows))
