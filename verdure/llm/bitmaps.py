"""Bitmaps of fixed size that let through the hashes of a set, and a few others."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24  # 2 MB at the driver and in every task, whatever the set's size


def bitmap_of(rows: DataFrame, column: str) -> np.ndarray:
    """Bitmap over the top bits of a 64-bit hash column."""
    cell = F.shiftrightunsigned(column, 64 - BITS)
    words = rows.select(F.shiftright(cell, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast({column} >>> {64 - BITS} & 63 as int))").alias("bit"))
    out = np.zeros(1 << BITS >> 6, np.uint64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # a row per word of the bitmap
        out[row.word] = np.int64(row.bits).view(np.uint64)
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set; never false for one that is."""
    cell = hashes >> np.uint64(64 - BITS)
    return (bitmap[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) > 0


def may_hold(rows: DataFrame, column: str, bits: int = 20) -> Column:
    """A test, as built-in expressions, whether the value of ``column`` may be among those of ``rows``.

    It is never false for a value that is; of other values it lets the more through the fuller its ``2 ** bits`` bits
    are. The bitmap is a constant of the plan whose size does not depend on the rows.
    """
    cell = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = rows.select(F.shiftright(cell, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))").alias("bit"))
    filled = {r.word: r.bits for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator()}
    listed = json.dumps([filled.get(w, 0) for w in range(1 << bits >> 6)], separators=(",", ":"))
    word = F.get(F.from_json(F.lit(listed), "array<bigint>"), F.shiftright(cell, 6).cast("int"))
    return F.call_function("shiftright", word, F.pmod(cell, F.lit(64)).cast("int")) % 2 != 0
