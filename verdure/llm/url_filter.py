"""URL lists as Bloom filter cascades: exact membership of every key of a corpus, without joins.

A key is a host suffix followed by the start of a path. The first filter holds the listed keys. The next one holds the
keys of the corpus that wrongly pass the first, the one after it the listed keys that wrongly pass the second, and so
on until nothing passes wrongly. The first level that a key fails tells whether it is listed; this is right for every
key of the corpus the cascade was built over.

The first filter lets through about as many unlisted keys of the corpus as there are listed ones, the others one half.
With ``r`` listed keys among ``s`` keys a cascade has about ``r * (5 + 1.44 * log2(s / r))`` bits, so it goes into the
plan as a literal: a thousandth of the corpus never does.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Bloom:
    """One filter: ``words`` of 64 bits, tested at ``probes`` places per key."""

    level: int
    words: tuple[int, ...]
    probes: int

    def passes(self, key: Column) -> Column:
        # a constant, which the optimizer parses once and which stands in the plan once, however many probes there are
        bits = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        places = F.transform(F.sequence(F.lit(0), F.lit(self.probes - 1)), lambda k: _place(key, self.level, k, len(self.words) * 64))

        def is_set(place: Column) -> Column:
            word = F.get(bits, F.shiftright(place, 6).cast("int"))
            return F.call_function("shiftright", word, (place % 64).cast("int")) % 2 != 0

        return F.forall(places, is_set)


def _place(key: Column, level: int, probe: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), probe), F.lit(size).cast("long"))


def build_bloom(keys: DataFrame, level: int, count: int, rate: float) -> Bloom:
    """Filter over the column ``key``; ``count`` keys at a false positive rate of about ``rate``."""
    probes = max(1, round(-math.log2(rate)))
    n_words = max(1, math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 64))
    places = keys.select(F.explode(F.array(*[_place(F.col("key"), level, F.lit(k), n_words * 64) for k in range(probes)])).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    found = {r.word: r.bits for r in words.collect()}  # as many rows as the filter has words
    return Bloom(level, tuple(found.get(w, 0) for w in range(n_words)), probes)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the corpus is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, size: int) -> Cascade:
    """Cascade for the keys ``listed(key)`` over the keys ``universe(key)``, of which there are ``size`` at most.

    Repeated keys may occur in both. The universe is read once and only keys that pass the first filter are shuffled.
    """
    listed = materialize(listed.select("key").where("key is not null").distinct(), "listed")
    count = listed.count()
    if count == 0:
        return Cascade(())
    rate = min(0.5, math.sqrt(0.5) * count / max(1, size - count))
    levels = [build_bloom(listed, 0, count, rate)]
    passing = universe.select("key").where(levels[0].passes(F.col("key"))).distinct()
    wrong = materialize(passing.join(listed, "key", "left_anti"), "passing")
    held, count = listed, wrong.count()
    while count:
        levels.append(build_bloom(wrong, len(levels), count, 0.5))
        held, wrong = wrong, materialize(held.where(levels[-1].passes(F.col("key"))), "passing")
        count = wrong.count()
    return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    """The host of a URL, A-Z in lower case; empty without ``://`` or for a null."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """The path of a URL, from the host to ``?``, ``#`` or the end; empty without ``://`` or for a null."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    ``rules(host, path, verdict)`` with the verdicts ``block`` and ``allow``. A rule fits its host and all subdomains
    if the path starts with the rule's path. The rule of most characters wins, at equal length the one with the longer
    host; a rule listed under both verdicts blocks. Without a fitting rule ``rule`` is null and ``verdict`` is
    ``default``. A null url, or one without ``://``, has an empty host and path and fits no rule. Rules with a null or
    empty host fit nothing; a null path counts as empty. Repeated rows are judged each; other columns are not looked at.
    """
    rules = rules.where("host <> '' and verdict in ('block', 'allow')").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("labels")),
        lambda i: F.array_join(F.slice("labels", i, F.size("labels") - i + 1), "."),
    )
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    starts = F.filter(starts, lambda s: s.isNotNull()) if lengths else F.expr("cast(array() as array<string>)")
    keyed = split.withColumn("labels", labels).select("page_id", "host", "path", suffixes.alias("suffixes"), starts.alias("starts"))
    pairs = F.flatten(
        F.transform("suffixes", lambda h: F.transform("starts", lambda p: F.struct(h.alias("host"), F.concat(h, p).alias("key"))))
    )
    keyed = keyed.select("page_id", "host", "path", pairs.alias("keys"))
    size = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    universe = keyed.select(F.explode("keys.key").alias("key"))
    keys = rules.select("verdict", F.concat("host", "path").alias("key"))
    block, allow = (build_cascade(keys.where(F.col("verdict") == v), universe, size) for v in ("block", "allow"))

    def judged(pair: Column) -> Column:
        key = pair["key"]
        verdict = F.when(block.holds(key), "block").when(allow.holds(key), "allow")
        return F.struct(F.length(key).alias("size"), F.length(pair["host"]).alias("host"), key.alias("rule"), verdict.alias("verdict"))

    fitting = F.filter(F.transform("keys", judged), lambda k: k["verdict"].isNotNull())
    best = keyed.withColumn("best", F.array_max(fitting))
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
