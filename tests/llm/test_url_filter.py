from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from verdure.llm.url_filter import build_cascade, url_verdicts

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("a.net", "", "block")]


def brute(url, rules):
    m = re.match(r"(?s:.*?)://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fit = [
        (len(h + (p or "")), len(h), h + (p or ""), v)
        for h, p, v in rules
        if h and m and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fit, key=lambda f: (f[0], f[1], f[2], f[3])) if fit else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_verdicts(spark):
    urls = [
        "http://x.com/en/1", "https://Example.COM/en/77?q=/de/", "http://example.com/en/8#a", "http://b.net/de/", "http://a.net",
        "http://www.a.net?x://y", "http://xa.net/de/1", "no scheme", None, "", "://com/en/", "http://com/en/", "http://com./en/",
        "a://b://c.com/en/", "http://user@example.com:80/en/7", "http://é.com/en/É", "http://x.com/en/" + "y" * 20_000, "HTTP://..com/en/",
        "http://example.com/en/77", "http://example.com/en/77", "line\n://a.net/\nb",
    ]
    rows = [(None if i == 2 else i, u, "x") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    extra = [*RULES, (None, "/", "block"), ("", "", "block"), ("b.net", None, "block"), ("com", "/en/", "block")]
    rules = spark.createDataFrame(extra, "host string, path string, verdict string")
    want = sorted(((d, *brute(u, extra)) for d, u, _ in rows), key=repr)
    assert found(url_verdicts(pages, rules)) == want
    assert url_verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_verdicts(pages, rules.limit(0), "block").collect()} == {"block"}


def test_many_rules(spark):
    rng = random.Random(5)
    names = [f"h{k}" for k in range(40)]
    rules = list({(".".join(rng.choices(names, k=rng.choice([1, 2]))), rng.choice(["", "/a", "/a/b"])): "" for _ in range(300)})
    rules = [(h, p, rng.choice(["block", "allow"])) for h, p in rules]
    rows = [(i, f"http://{'.'.join(rng.choices(names, k=3))}{rng.choice(['', '/', '/a/', '/a/bc'])}") for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = found(url_verdicts(pages, spark.createDataFrame(rules, "host string, path string, verdict string")))
    assert got == sorted(((d, *brute(u, rules)) for d, u in rows), key=repr)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("pmod(xxhash64(key), 10) = 0")
    cascade = build_cascade(listed, universe, 20_000)
    assert len(cascade.levels) > 2
    assert sum(len(b.words) for b in cascade.levels) * 64 < 2000 * 12
    wrong = universe.where(cascade.holds(F.col("key")) != F.expr("pmod(xxhash64(key), 10) = 0"))
    assert wrong.count() == 0
