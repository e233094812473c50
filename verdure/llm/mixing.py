"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document is expected to be taken ``c * preference`` times, at most ``most``
times, with ``c`` such that the expected words of the source are its target. The whole part of that number is certain.
For the rest ``p`` documents are ranked by their random odds ``u / (1 - u)`` divided by their inclusion odds
``p / (1 - p)``, and the lowest ranks are taken until the source has its words. ``u`` comes from a hash of id and text,
so reruns agree.

The cut in the ranking is found by word counts in ranges of the rank, twice refined, so that only the last narrow range
of a source is ever sorted in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 4096  # ranges of the rank per refinement
BROADCAST_SOURCES = 50_000  # sources up to which their targets are broadcast
_STEPS = 16.0  # preferences are rounded to 1/16 of a doubling


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in order of their code points, null last, get the weights in turn. All targets together are ``share`` times
    all sizes. No target exceeds ``most`` times the size of its source; the excess is shared by weight among the others
    until none exceeds. With a share above ``most`` every target is at its cap.
    """
    turn = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    caps = sizes.withColumn("weight", F.get(turn, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    caps = caps.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # sources fill up in the order of cap / weight; ``level`` is the target per weight once those before are full
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    caps = caps.withColumn("level", left / weight).withColumn("place", F.row_number().over(filling))
    open_ = F.col("cap") / F.col("weight") > F.col("level")
    caps = caps.withColumn("level", F.min_by(F.col("level"), F.when(open_, F.col("place"))).over(every))
    target = F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap"))
    return caps.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    preference: Column | None = None,
) -> DataFrame:
    """``docs(doc_id, text, source)`` with the columns ``size, source_size, target, copies, taken``.

    ``size`` is the number of words, ``copies`` how often the mix takes the document (0 to ``most``), ``taken`` is
    ``copies * size``. ``preference`` (a positive expression over the columns of ``docs`` and ``size``; null counts as
    1) makes documents of a source more or less likely; it is rounded to sixteenths of a doubling. The words taken from
    a source differ from its target by half a document at most. Rows with the same id and text are taken or left
    together, and count as one document here. A source without any word is left out of the mix. A null source is a
    source of its own; a null id or text is like an empty one. Other columns of ``docs`` stay unless they have one of
    the new names.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c not in added]
    text, name = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.md5(F.concat(name, F.lit("|"), text).cast("binary"))
    sized = docs.select(*own, word_count(F.col("text")).alias("size"))
    like = F.coalesce(preference, F.lit(1)) if preference is not None else F.lit(1)
    like = F.pow(F.lit(2.0), F.round(F.log2(like.cast("double")) * _STEPS) / _STEPS)
    narrow = sized.select(F.struct("source").alias("of"), "size", key.alias("key"), like.alias("like"))
    narrow = materialize(narrow, "sizes")

    kinds = narrow.groupBy("of", "like").agg(F.sum("size").alias("words"))
    sizes = kinds.groupBy("of").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select("of.source", "source_size"), weights, share, most)
    targets = targets.select(F.struct("source").alias("of"), "source_size", "target")
    plan = materialize(_scales(kinds, targets, most), "scales")
    cuts = materialize(_cuts(_ranked(_joined(narrow, plan), most), plan), "cuts")
    wide = sized.select(F.struct(*own).alias("doc"), "size", F.struct("source").alias("of"), key.alias("key"), like.alias("like"))
    taken = _ranked(_joined(wide, cuts), most)
    low = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("key") <= F.col("cut_key")))
    copies = F.col("whole") + F.coalesce(low, F.lit(False)).cast("int")
    return taken.select("doc.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _joined(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with the numbers of their source. ``of`` is a struct, so that null sources match too."""
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    return rows.join(per_source, "of")


def _scales(kinds: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``of, source_size, target, scale``: expected copies are ``least(most, scale * like)``.

    The kinds of a source reach ``most`` in descending order of ``like``; the scale is that of the first kind below it.
    """
    order = Window.partitionBy("of").orderBy(F.col("like").desc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = kinds.join(targets, "of")
    full = F.coalesce(F.sum("words").over(before), F.lit(0)) * float(most)
    pull = F.sum(F.col("words") * F.col("like")).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("at", F.when(pull > 0, (F.col("target") - full) / pull))
    scale = F.max(F.when(F.col("at") * F.col("like") < float(most), F.col("at")))
    # without a kind below, all are taken ``most`` times; without words nothing is
    limit = F.when(F.max("source_size") > 0, float(most) / F.min("like")).otherwise(0.0)
    found = rows.groupBy("of").agg(F.coalesce(scale, limit).alias("scale"))
    return targets.join(found, "of")


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``whole`` certain copies and the ``rank`` (0 to 1) among the documents with a rest; null without one."""
    # 48 bits, never 0 or 1
    u = (F.conv(F.substring("key", 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    expected = F.least(F.lit(float(most)), F.col("scale") * F.col("like"))
    rows = rows.withColumns({"whole": F.floor(expected).cast("int"), "part": expected - F.floor(expected), "u": u})
    odds = F.col("u") / (1 - F.col("u")) / (F.col("part") / (1 - F.col("part")))
    rows = rows.withColumn("odds", F.when(F.col("part") > 0, odds))
    return rows.withColumn("rank", F.col("odds") / (1 + F.col("odds"))).drop("part", "u", "odds")


def _cuts(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``cut_rank, cut_key`` of the last document that each source takes in addition; null if none."""
    certain = ranked.groupBy("of").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    need = plan.join(certain, "of").select("of", (F.col("target") - F.col("certain")).alias("need"))
    rest = ranked.where("rank is not null").select("of", "rank", "key", "size")
    for width in (1.0 / RANGES, 1.0 / RANGES**2):
        # the range of each source in which its words are reached, and what is left to take there
        parts = rest.withColumn("range", F.floor(F.col("rank") / width)).groupBy("of", "range").agg(F.sum("size").alias("words"))
        order = Window.partitionBy("of").orderBy("range")
        parts = parts.join(need, "of").withColumn("upto", F.sum("words").over(order))
        after = parts.where("upto >= need").groupBy("of").agg(F.min(F.struct("range", (F.col("need") - F.col("upto") + F.col("words")).alias("need"))).alias("at"))
        last = parts.groupBy("of").agg(F.max(F.struct("range", (F.col("need") - F.col("upto") + F.col("words")).alias("need"))).alias("end"))
        # rounding may leave a source a little short of its need with all of its words: its last range is cut then
        need = last.join(after, "of", "left").select("of", F.coalesce("at", "end").alias("at")).select("of", "at.range", "at.need")
        need = materialize(need, "ranges")
        inner = F.broadcast(need) if need.count() <= BROADCAST_SOURCES else need
        rest = rest.join(inner.select("of", "range"), "of").where(F.floor(F.col("rank") / width) == F.col("range")).drop("range")
        below = need.select("of", (F.col("range") * F.lit(width)).alias("floor"))
        need = need.select("of", "need")
    order = Window.partitionBy("of").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rest.groupBy("of", "rank", "key").agg(F.sum("size").alias("size")).join(need, "of")
    taken = rows.withColumn("upto", F.sum("size").over(order)).where("upto - size / 2 <= need")
    ends = taken.groupBy("of").agg(F.max(F.struct("rank", "key")).alias("end"))
    # if the range gives nothing, all ranks below it are still taken
    ends = below.join(ends, "of", "left").select(
        "of", F.coalesce("end.rank", "floor").alias("cut_rank"), F.coalesce("end.key", F.lit("")).alias("cut_key")
    )
    return plan.join(ends, "of", "left")
