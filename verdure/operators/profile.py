"""Profiles of tables and of files already written."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.session import materialize
from verdure.sources import files

MIN_COLUMNS = 50
ESSENTIAL = ("sap_flow", "site")
LISTED = 10
# Columns whose presence in an output file is reported.
REPORTED = (
    "pl_name", "swc_deep", "netrad", "seasonal_leaf_area", "water_stress_index", "moisture_availability",
    "wind_stress", "light_efficiency", "ppfd_efficiency", "stomatal_conductance_proxy",
)


def _per_column(counts: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """The single row of counts turned into one row per column."""
    return counts.unpivot(["n_rows"], list(columns), "column", value)


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values and their share per column, from one pass over the table."""
    picks = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *picks)
    share = F.coalesce(F.try_divide(F.col("nulls") * F.lit(100.0), F.col("n_rows")), F.lit(0.0))
    return _per_column(counts, df.columns, "nulls").select("column", "nulls", share.alias("percent"))


def infinity_profile(df: DataFrame) -> DataFrame:
    """Infinite values per floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    picks = [F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))).alias(c) for c in floats]
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *picks)
    return _per_column(counts, floats, "infinities").select("column", "infinities")


def string_profile(df: DataFrame, exact: bool = True, listed: int = LISTED) -> DataFrame:
    """Distinct values per text column, with the values themselves where there are few.

    With ``exact=False`` the number of distinct values is a sketch and only columns near the limit
    are counted exactly, which spares shuffling every distinct value of a long column; ``is_exact`` says which.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    strings = df.select(*text)
    sketched = None
    near = text
    if not exact:
        sketch = strings.agg(*[F.approx_count_distinct(c).alias(c) for c in text])
        sketched = sketch.unpivot([], text, "column", "distinct_values")
        row = sketch.first()
        near = [c for c in text if row[c] <= 2 * listed]
    if not near:
        return sketched.select("*", F.lit(None).cast("string").alias("listed_values"), F.lit(False).alias("is_exact"))
    values = strings.select(*near).unpivot([], near, "column", "value").where("value IS NOT NULL").distinct()
    sizes = values.groupBy("column").agg(F.count("value").alias("distinct_values"))
    few = sizes.where(F.col("distinct_values") <= listed).select("column")
    lists = (
        values.join(F.broadcast(few), "column", "left_semi")
        .groupBy("column")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("listed_values"))
    )  # at most ``listed`` values per column
    if sketched is not None:
        far = sketched.where(~F.col("column").isin(*near))
        sizes = sizes.unionByName(far)
    out = sizes.join(lists, "column", "left")
    return out if exact else out.withColumn("is_exact", F.col("column").isin(*near))


def type_profile(df: DataFrame) -> DataFrame:
    """Number of columns per type name and the columns themselves."""
    kinds = df.sparkSession.createDataFrame(df.dtypes, "column string, type string")
    return kinds.groupBy("type").agg(F.count(F.lit(1)).alias("n_columns"), _names(F.col("column")).alias("columns"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, range and missing values of a numeric column."""
    return df.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.count_if(F.col(column).isNull()).alias("missing"),
    )


def file_rows(df: DataFrame) -> DataFrame:
    """Rows per input file; the path is a hidden column of every file scan."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def _names(chosen: Column) -> Column:
    """The column names for which ``chosen`` is not null, in order, as one text."""
    return F.array_join(F.sort_array(F.collect_set(chosen)), "|")


def dataset_profile(
    spark: SparkSession, root: str, target: str = "sap_flow", site: str = "site", reported: Sequence[str] = REPORTED
) -> DataFrame:
    """Per parquet and CSV file below ``root`` its rows and what its own columns are.

    Every file is judged by its own schema, so files of different schemas may lie side by side. Columns of folder names
    count as columns of the file. ``reported_columns`` and ``text_columns`` name the columns that should not be there
    and those of text type; the types of a CSV file are not known, so it has none. Row counts of parquet files come
    from their footers.
    """
    columns = materialize(files.file_columns(spark, root), "file-columns")
    name = F.col("column")
    shape = columns.groupBy("file").agg(
        F.count(name).alias("n_columns"),
        F.coalesce(F.bool_or(name == target), F.lit(False)).alias("has_target"),
        F.coalesce(F.bool_or(F.lower(name).contains("timestamp")), F.lit(False)).alias("has_timestamp"),
        F.coalesce(F.bool_or(name == site), F.lit(False)).alias("has_site"),
        _names(F.when(name.isin(*reported), name)).alias("reported_columns"),
        _names(F.when(F.col("type") == "string", name)).alias("text_columns"),
    )
    listed = files.listing(spark, root, "*.{parquet,csv,csv.gz}").select("path").collect()
    paths = [files.literal(r["path"]) for r in listed]
    whole = spark.read.option("recursiveFileLookup", "true")
    counts = []
    if binary := [p for p in paths if p.endswith(".parquet")]:
        counts.append(file_rows(whole.parquet(*binary)))
    if texts := [p for p in paths if not p.endswith(".parquet")]:
        lines = file_rows(whole.text(texts).where(F.trim("value") != ""))
        counts.append(lines.select("file", F.greatest(F.col("n_rows") - 1, F.lit(0)).alias("n_rows")))  # but the header
    if not counts:
        counts = [spark.createDataFrame([], "file string, n_rows long")]
    rows = reduce(DataFrame.unionByName, counts)
    return shape.join(rows, "file", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def output_acceptance(
    df: DataFrame,
    min_columns: int = MIN_COLUMNS,
    essential: Sequence[str] = ESSENTIAL,
    reported: Sequence[str] = REPORTED,
    by: Sequence[str] = (),
) -> DataFrame:
    """Verdict on written output, per group of ``by`` columns or over all.

    Output is accepted when it has enough columns, the essential ones and at least one row. Columns that should not be
    there are named. Also counted: text columns, columns with missing and with infinite values.
    """
    columns = [c for c in df.columns if c not in by]
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in by]
    texts = sum(isinstance(f.dataType, T.StringType) for f in df.schema)
    shape = len(df.columns) >= min_columns and all(c in df.columns for c in essential)
    missing = sum((F.max(F.col(c).isNull().cast("int")) for c in columns[1:]), F.max(F.col(columns[0]).isNull().cast("int")))
    infinite = [F.max((F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False))).cast("int")) for c in floats]
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(texts).alias("text_columns"),
        F.lit("|".join(sorted(c for c in reported if c in df.columns))).alias("reported_columns"),
        F.coalesce(missing, F.lit(0)).alias("missing_columns"),
        F.coalesce(sum(infinite[1:], infinite[0]) if infinite else F.lit(0), F.lit(0)).alias("infinite_columns"),
        (F.lit(shape) & (n > 0)).alias("accepted"),
    )


def run_summary(sites: DataFrame, status: str = "status", rows: str = "n_rows", columns: str = "n_columns") -> DataFrame:
    """Sites, rows and the widest table per outcome."""
    return sites.groupBy(status).agg(
        F.count(F.lit(1)).alias("sites"), F.sum(rows).alias("rows"), F.max(columns).alias("max_columns")
    )


def pending(sites: DataFrame, done: DataFrame, key: Sequence[str] = ("site",)) -> DataFrame:
    """Sites that still have to be processed."""
    return sites.select(*key).distinct().join(done.select(*key).distinct(), list(key), "left_anti")
