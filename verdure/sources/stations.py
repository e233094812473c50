"""Archives of station files: ``<site>_<kind>_<part>.csv``, plain or gzipped.

Tables of the same kind differ in their columns from site to site (one column per tree). The first line of a file is its
header, whatever stands in it, and only first lines are read to find the headers. Files with the same number of
columns then go through the CSV reader together, and each file's header says what its places mean.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.functions.clean import finite
from verdure.sources import files

# Kinds and parts in file names, names of the time columns, prefixes of metadata columns,
# missing-value text, dropped columns.
KINDS = ("env", "sapf", "plant", "site", "species", "stand")
PARTS = ("data", "flags", "md")
_NAME = rf"(?:^|[/=])([^/=]+)_({'|'.join(KINDS)})_({'|'.join(PARTS)})\.csv(?:\.gz)?(?:/|$)"
TIME = "TIMESTAMP"
METADATA_PREFIXES = ("si_", "st_", "sp_", "env_", "pl_", "is_")
MISSING = "NA"
EXCLUDED = ("pl_name", "swc_deep", "netrad", "seasonal_leaf_area")
RENAMED = {"TIMESTAMP_solar": "solar_TIMESTAMP"}
# Headers are broadcast up to so many characters in all, else joined.
_BROADCAST_TEXT = 8 << 20


def file_name_parts(path: Column) -> dict[str, Column]:
    """Site, kind and part named by a file (or by the folder a distributed job wrote it as)."""
    pick = lambda group: F.nullif(F.regexp_extract(path, _NAME, group), F.lit(""))
    return {"site": pick(1), "kind": pick(2), "part": pick(3)}


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, site, kind, part`` of all station files; of a plain and a gzipped copy the plain one counts."""
    found = files.listing(spark, root, "*.csv*").withColumns(file_name_parts(F.col("path"))).where("site IS NOT NULL")
    plain = found.select(F.concat("path", F.lit(".gz")).alias("path"))
    return found.join(plain, "path", "left_anti")


def site_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes per site, kind and part. Only the listing is read, not the content."""
    return (
        _listed(spark, root)
        .groupBy("site", "kind", "part")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )


class StationFile(NamedTuple):
    path: str
    file: str
    site: str
    kind: str
    part: str
    names: tuple[str | None, ...]

    @property
    def usable(self) -> bool:
        """Whether the header has what rows of this part need: a time, or any metadata column."""
        if self.part == "md":
            return any(n and n.startswith(METADATA_PREFIXES) for n in self.names)
        return TIME in self.names

    def places(self) -> dict[str, int]:
        """Place of every named column; of a repeated name the first."""
        return {n: i for i, n in reversed(list(enumerate(self.names))) if n}


def station_files(
    spark: SparkSession, root: str, kind: str | None = None, part: str | None = None, sites: DataFrame | None = None
) -> list[StationFile]:
    """The files of one kind and part, or all, with their headers; with ``sites`` only files of those sites.

    Files of other sites are dropped from the list, so nothing of them is read.
    """
    found = _listed(spark, root)
    if kind is not None:
        found = found.where((F.col("kind") == kind) & (F.col("part") == part))
    if sites is not None:
        found = found.join(sites.select("site"), "site", "left_semi")
    listed = {r["path"]: r for r in found.orderBy("path").collect()}
    heads = {f.path: f for f in files.first_lines(spark, list(listed))}
    out = []
    for path, row in listed.items():
        head = heads.get(path)
        names = files.split_header(head.line) if head else []
        names = tuple(RENAMED.get(n, n) if n != MISSING else None for n in names)
        out.append(StationFile(path, head.file if head else path, row["site"], row["kind"], row["part"], names))
    return out


def unusable_files(spark: SparkSession, root: str) -> DataFrame:
    """``site, kind, part, path, header`` of the files no reader takes: blank ones and those without a known header.

    Files without any bytes are not listed.
    """
    left = [f for f in station_files(spark, root) if not f.usable]
    rows = [(f.site, f.kind, f.part, f.path, ",".join(n or "" for n in f.names)) for f in left]
    return spark.createDataFrame(rows, "site string, kind string, part string, path string, header string")


def _usable(spark: SparkSession, root: str, kind: str, part: str, sites: DataFrame | None) -> list[StationFile]:
    found = [f for f in station_files(spark, root, kind, part, sites) if f.usable]
    if not found and sites is None:
        raise ValueError(f"no {kind} {part} files with a header below {root}")
    return found


def _rows(
    spark: SparkSession, found: Sequence[StationFile], about: Callable[[StationFile], tuple], schema: str, line: bool = False
) -> DataFrame:
    """Every row as ``file, cells`` with what ``about`` says of its file; ``line`` adds the row's place in the archive.

    Files of one width are one scan. ``about`` has one row per file.
    """
    known = spark.createDataFrame([(f.file, *about(f)) for f in found], f"file string, {schema}")
    if sum(len(f.file) + sum(len(n or "") + 8 for n in f.names) for f in found) <= _BROADCAST_TEXT:
        known = F.broadcast(known)
    place = [F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line")]
    scans = []
    width = lambda f: len(f.names)
    for wide, group in groupby(sorted(found, key=width), width):
        scan = (
            spark.read.schema(", ".join(f"c{i} string" for i in range(wide)))
            .options(header="true", nullValue=MISSING, ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true")
            .option("recursiveFileLookup", "true")
            .csv([files.literal(f.path) for f in group])
        )
        cells = F.array(*[f"c{i}" for i in range(wide)]).alias("cells")
        scans.append(scan.select(F.col("_metadata.file_path").alias("file"), cells, *(place if line else [])))
    if not scans:
        scans = [spark.createDataFrame([], "file string, cells array<string>" + (", line struct<file:string,start:long,id:long>" if line else ""))]
    return reduce(DataFrame.unionByName, scans).join(known, "file")


def _time(text: Column) -> Column:
    return F.coalesce(text.try_cast("timestamp_ntz"), F.try_to_timestamp(text).cast("timestamp_ntz"))


def _picked(
    spark: SparkSession, root: str, kind: str, part: str, wanted: Sequence[str], sites: DataFrame | None, line: bool = False
) -> DataFrame:
    """``site`` and the wanted columns as texts, absent ones null."""
    found = _usable(spark, root, kind, part, sites)
    about = lambda f: (f.site, [f.places().get(c) for c in wanted])
    rows = _rows(spark, found, about, "site string, places array<int>", line)
    picks = [F.get("cells", F.get("places", F.lit(i))).alias(c) for i, c in enumerate(wanted)]
    return rows.select("site", *picks, *(["line"] if line else []))


def read_wide(
    spark: SparkSession,
    root: str,
    kind: str,
    columns: Sequence[str],
    excluded: Sequence[str] = EXCLUDED,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Data tables with known columns, absent ones null: ``site, ts, solar_ts, <columns>``."""
    kept = [c for c in columns if c not in excluded]
    rows = _picked(spark, root, kind, "data", [TIME, "solar_TIMESTAMP", *kept], sites)
    return rows.select(
        "site",
        _time(F.col(TIME)).alias("ts"),
        _time(F.col("solar_TIMESTAMP")).alias("solar_ts"),
        *[finite(F.col(c).try_cast("double")).alias(c) for c in kept],
    )


def read_long(
    spark: SparkSession, root: str, kind: str, part: str, name: str, value: str, sites: DataFrame | None = None
) -> DataFrame:
    """Data or flag tables with any columns: ``site, ts, <name>, <value>``, one row per cell."""

    def about(f: StationFile) -> tuple:
        places = f.places()
        cells = [(n, i) for n, i in sorted(places.items(), key=lambda p: p[1]) if "timestamp" not in n.lower()]
        return f.site, places[TIME], cells

    found = _usable(spark, root, kind, part, sites)
    rows = _rows(spark, found, about, "site string, time int, columns array<struct<name: string, place: int>>")
    long = rows.select("site", _time(F.get("cells", F.col("time"))).alias("ts"), F.explode("columns").alias("_c"), "cells")
    cell = F.get("cells", F.col("_c.place"))
    typed = finite(cell.try_cast("double")) if part == "data" else F.nullif(cell, F.lit(""))
    return long.select("site", "ts", F.col("_c.name").alias(name), typed.alias(value))


def read_metadata(
    spark: SparkSession, root: str, kind: str, columns: Sequence[str], sites: DataFrame | None = None, line: bool = False
) -> DataFrame:
    """Metadata tables as texts: ``site, <columns>``; all rows, absent columns null. ``line`` orders rows as in the files."""
    return _picked(spark, root, kind, "md", list(columns), sites, line)


def read_greenness(spark: SparkSession, path: str) -> DataFrame:
    """Vegetation index table from CSV with its calendar columns."""
    from verdure.operators.greenness import prepare

    schema = "site string, date string, ndvi double, collection string, cloud_cover double"
    return prepare(spark.read.schema(schema).csv(path, header=True))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Test scores from the JSON summaries of many model runs, one row per run."""
    schema = "model_type string, metrics struct<test_r2: double, test_rmse: double>"
    rows = spark.read.schema(schema).json(path)
    return rows.select("model_type", "metrics.test_r2", "metrics.test_rmse")
