"""Binning of numbers into labelled classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(value: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed classes ``(edge, next edge]``; null outside the edges."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per class")
    out = F.when(value <= edges[0], None)
    for edge, label in zip(edges[1:], labels):
        out = out.when(value <= edge, label)
    return out


def encode(value: Column, codes: Mapping[str, int]) -> Column:
    """Code of a text value as double; null for values outside the table."""
    pairs = [F.lit(x) for item in codes.items() for x in (item[0], float(item[1]))]
    return F.try_element_at(F.create_map(*pairs), value)
