"""Writing feature tables, and reading and checking the label/feature text format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.operators.align import feature_list, fill_features
from verdure.sources.stations import MISSING


def _balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together where they fit a task, large keys cut into several tasks by AQE."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ("site",), compress: bool = True, mode: str = "error"):
    """Parquet, one folder per site, snappy or uncompressed. ``overwrite`` replaces only the folders it writes."""
    codec = "snappy" if compress else "uncompressed"
    out = _balanced(df, *by).write.mode(mode).option("compression", codec).option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*by).parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """An earlier output, or ``None`` where nothing has been written yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# Times keep their microseconds; the formats the writer takes by default end at milliseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def write_csv(df: DataFrame, path: str, by: Sequence[str] = ("site",), compress: bool = False, mode: str = "error"):
    """CSV with header, one folder per site, optionally gzipped."""
    out = _balanced(df, *by).write.mode(mode).option("header", "true").options(**_TIMES)
    if compress:
        out = out.option("compression", "gzip")
    out.partitionBy(*by).csv(path)


def write_station_files(
    df: DataFrame, root: str, kind: str, part: str = "data", site: str = "site", compress: bool = False
):
    """One folder ``file=<site>_<kind>_<part>.csv`` per site, readable as a station archive."""
    named = df.withColumn("file", F.concat(F.col(site), F.lit(f"_{kind}_{part}.csv"))).drop(site)
    out = _balanced(named, "file").write.mode("append").option("header", "true").option("nullValue", MISSING).options(**_TIMES)
    if compress:
        out = out.option("compression", "gzip")
    out.partitionBy("file").csv(root)


def to_labelled(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """Rows with a target as label and feature vector; missing features are 0."""
    features = list(features or feature_list(df.columns, target))
    filled = fill_features(df, features, target)
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(filled)
    return vectors.select(F.col(target).cast("double").alias("label"), "features")


def write_libsvm(df: DataFrame, path: str, target: str, features: Sequence[str] | None = None):
    """Label/feature text files; all tables written with one feature list can be read together."""
    to_labelled(df, target, features).write.format("libsvm").save(path)


def read_libsvm(spark: SparkSession, path: str | Sequence[str], n_features: int) -> DataFrame:
    """All label/feature files below one or several paths; the width is given, not searched for."""
    return spark.read.format("libsvm").option("numFeatures", str(n_features)).load(path)


def libsvm_line_check(lines: DataFrame, text: str = "value") -> DataFrame:
    """Adds ``is_valid``: a numeric label followed by ``integer:number`` tokens. Blank lines are valid."""
    tokens = F.split(F.trim(F.col(text)), r"\s+")
    label = F.try_element_at(tokens, F.lit(1)).try_cast("double").isNotNull()

    def good(token):
        index, number = F.substring_index(token, ":", 1), F.regexp_extract(token, r"^[^:]*:(.*)$", 1)
        return (
            token.contains(":") & index.rlike(r"^[+-]?\d+$") & F.coalesce(number.try_cast("double").isNotNull(), F.lit(False))
        )

    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    blank = F.trim(F.col(text)) == ""
    return lines.withColumn("is_valid", blank | (label & F.forall(rest, good)))
