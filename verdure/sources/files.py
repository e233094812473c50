"""What lies in a folder: files, their first lines and their own columns.

The list of files is held by the driver, as it is for every file scan. Contents are read by Spark alone, so a folder may
be in any store that Spark reads.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Small reads of one file each that run at the same time.
AT_ONCE = 16
T = TypeVar("T")


class FirstLine(NamedTuple):
    path: str  # as the listing names the file
    file: str  # as a scan names it in its hidden column
    line: str


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of every file below ``root``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(root).select("path", "length")


def literal(path: str) -> str:
    """A path whose special characters are not taken for a pattern."""
    return re.sub(r"([\\*?\[\]{},^])", r"\\\1", path)


def each(items: Sequence[str], work: Callable[[str], T]) -> list[T]:
    """``work`` of every item, several at the same time."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(work, items))


def first_lines(spark: SparkSession, paths: Sequence[str]) -> list[FirstLine]:
    """The first line of every file that has one. A read stops at that line, however long the file is."""

    def look(path: str) -> FirstLine | None:
        lines = spark.read.option("recursiveFileLookup", "true").text(literal(path))
        row = lines.where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file")).first()
        return None if row is None else FirstLine(path, row["file"], row["value"])

    return [f for f in each(paths, look) if f is not None]


def split_header(line: str) -> list[str | None]:
    """Column names of a header line; a column without a name is None."""
    names = next(csv.reader([line.lstrip("﻿")], skipinitialspace=True), [])
    return [n.strip() or None for n in names]


def folder_columns(path: str) -> list[str]:
    """Columns that folders of the path carry, as ``site=A``."""
    return [part.split("=", 1)[0] for part in path.split("/")[:-1] if re.match(r"[^=]+=", part)]


def file_columns(spark: SparkSession, root: str) -> DataFrame:
    """``file, column, type`` from the own schema of every parquet and CSV file below ``root``.

    Only footers and first lines are read. A column carried by a folder name has the type ``folder``, a CSV column the
    type ``text``. ``file`` is the name a scan has for the file; a file without any column has one row of nulls.
    """
    paths = [r["path"] for r in listing(spark, root, "*.{parquet,csv,csv.gz}").select("path").collect()]

    def of_parquet(path: str) -> tuple[str, str, list[tuple[str, str]]]:
        table = spark.read.option("recursiveFileLookup", "true").parquet(literal(path))
        # the name comes from the plan of the scan, not from its rows; a scan writes a local root with one slash
        return path, re.sub(r"^file:/+", "file:/", table.inputFiles()[0]), [(f.name, f.dataType.simpleString()) for f in table.schema]

    found = each([p for p in paths if p.endswith(".parquet")], of_parquet)
    texts = [p for p in paths if not p.endswith(".parquet")]
    lines = {f.path: f for f in first_lines(spark, texts)}
    for path in texts:
        header = lines.get(path)
        names = [n for n in split_header(header.line) if n] if header else []
        found.append((path, header.file if header else path, [(n, "text") for n in dict.fromkeys(names)]))
    rows = []
    for path, file, columns in found:
        own = [*columns, *[(c, "folder") for c in folder_columns(path) if c not in dict(columns)]]
        rows += [(file, name, kind) for name, kind in own] or [(file, None, None)]
    return spark.createDataFrame(rows, "file string, column string, type string")


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """A table of parquet files, CSV files (plain or gzipped) or both, with columns matched by name.

    CSV files with the same header are read together, as texts by the names of their own header, and cast to the types
    of the parquet part; text that does not fit becomes null. Without any parquet file the types come from the
    texts. A column some files lack is null there. Columns in folder names belong to the table.
    """
    paths = sorted(r["path"] for r in listing(spark, root, "*.{parquet,csv,csv.gz}").select("path").collect())
    plain = set(paths)
    paths = [p for p in paths if not (p.endswith(".gz") and p.removesuffix(".gz") in plain)]
    binary, texts = [p for p in paths if p.endswith(".parquet")], [p for p in paths if not p.endswith(".parquet")]
    if not paths:
        raise ValueError(f"no parquet or CSV files below {root}")
    reader = lambda: spark.read.option("basePath", root)
    table = reader().option("mergeSchema", "true").parquet(*map(literal, binary)) if binary else None
    if not texts:
        return table
    groups: dict[str, list[str]] = {}
    for f in first_lines(spark, texts):
        groups.setdefault(f.line, []).append(f.path)
    kinds = {f.name: f.dataType for f in table.schema} if table is not None else None
    for line, files in groups.items():
        names = [n if n and n not in split_header(line)[:i] else f"_unnamed_{i}" for i, n in enumerate(split_header(line))]
        scan = reader().option("header", "true").option("nullValue", "NA")
        if kinds is None:
            part = scan.option("inferSchema", "true").csv([literal(p) for p in files])
            part = part.toDF(*names, *part.columns[len(names) :])
        else:
            part = scan.schema(", ".join(f"`{n}` string" for n in names)).csv([literal(p) for p in files])
            part = part.select(*[F.col(f"`{c}`").try_cast(kinds.get(c, "string")).alias(c) for c in part.columns])
        part = part.drop(*[n for n in names if n.startswith("_unnamed_")])
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    return table
