"""Incremental jobs over arriving files.

Each run takes the files that arrived since the last one (``availableNow``) and stops. Progress is
kept in the checkpoint folder, so a run that dies is simply started again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from verdure.functions.codes import BAD_FLAGS
from verdure.operators.quality import is_bad
from verdure.session import materialize
from verdure.sources import files

Enrich = Callable[[DataFrame], DataFrame]


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: str | None = None, per_run: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if per_run:
        reader = reader.option("maxFilesPerTrigger", per_run)
    return reader.parquet(path)


Step = tuple[int, int]


def _folder(step: Step) -> str:
    return f"step={step[0]}_{step[1]}"


def _steps(spark: SparkSession, out: str) -> list[Step]:
    """The finished steps of a feature job, in order. A step is finished when its waiting readings are written."""
    try:
        listed = files.listing(spark, f"{out}/waiting", "*.parquet")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    parts = listed.select(F.regexp_extract("path", r"/step=(\d+_\d+)/", 1).alias("step")).distinct().collect()
    return sorted(tuple(int(n) for n in r["step"].split("_")) for r in parts)


def _take_step(
    step: Step, last: Step | None, arrived: DataFrame | None, env: DataFrame, out: str, enrich: Enrich, on: Sequence[str]
) -> None:
    """Joins arrived and waiting readings with the weather; those without weather wait for the next step.

    The joined rows are written first and count once the waiting ones are written too. A step that is taken again
    overwrites its own folders.
    """
    spark = env.sparkSession
    rows = arrived
    if last is not None:
        waiting = spark.read.parquet(f"{out}/waiting/{_folder(last)}")
        rows = waiting if rows is None else rows.unionByName(waiting)
    # looked at twice, and the weather must not change in between
    rows, env = materialize(rows, "arrived"), materialize(env, "weather")
    joined = enrich(rows.join(env, list(on), "inner"))
    joined.write.mode("overwrite").partitionBy("site").parquet(f"{out}/rows/{_folder(step)}")
    rows.join(env, list(on), "left_anti").write.mode("overwrite").parquet(f"{out}/waiting/{_folder(step)}")


def append_features(
    flow: DataFrame,
    env: DataFrame | Callable[[], DataFrame],
    out: str,
    checkpoint: str,
    enrich: Enrich = lambda df: df,
    on: Sequence[str] = ("site", "ts"),
    target: str = "sap_flow",
) -> StreamingQuery:
    """Joins arriving readings with weather, adds row-wise features and appends them by site.

    Readings whose weather has not come yet wait below ``out`` and are joined by a later run of this job, or by
    ``retry_waiting`` when no more readings arrive; no reading is lost, and none is joined twice. ``env`` is the weather
    known so far, or a function giving it anew for every micro-batch; a reading takes the rows of weather that are
    there when it is joined. ``read_features`` reads the result. Features that look back over rows need the whole
    series and stay in the batch job.
    """
    weather = env if callable(env) else lambda: env

    def save(batch: DataFrame, number: int) -> None:
        earlier = [s for s in _steps(batch.sparkSession, out) if s < (number, 0)]
        _take_step((number, 0), earlier[-1] if earlier else None, batch, weather(), out, enrich, on)

    return (
        flow.where(F.col(target).isNotNull())
        .writeStream.outputMode("append")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def retry_waiting(env: DataFrame, out: str, enrich: Enrich = lambda df: df, on: Sequence[str] = ("site", "ts")) -> int:
    """Joins the waiting readings with weather that came after them; returns how many still wait.

    Run it between runs of ``append_features``, never beside one.
    """
    steps = _steps(env.sparkSession, out)
    if not steps:
        return 0
    last = steps[-1]
    step = (last[0], last[1] + 1)
    _take_step(step, last, None, env, out, enrich, on)
    return env.sparkSession.read.parquet(f"{out}/waiting/{_folder(step)}").count()


def read_features(spark: SparkSession, out: str) -> DataFrame | None:
    """The joined rows of all finished steps; ``None`` before the first."""
    paths = [f"{out}/rows/{_folder(s)}" for s in _steps(spark, out)]
    filled = [p for p in paths if not files.listing(spark, p, "*.parquet").isEmpty()]
    if not filled:
        return None
    return spark.read.option("basePath", f"{out}/rows").parquet(*filled).drop("step")


def daily_flag_counts(flags: DataFrame, out: str, checkpoint: str, ts: str = "ts", flag: str = "flag") -> StreamingQuery:
    """Flag counts per site and day, kept as one folder of partial counts per micro-batch.

    Counts add up, so no state and no watermark is needed and the files of a site may arrive in any order
    of time. A micro-batch that is run again overwrites its own folder. Rows without a time have a null day.
    """

    def save(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("site", F.date_trunc("day", F.col(ts)).alias("day")).agg(
            F.count(flag).alias("total"), F.count_if(is_bad(F.col(flag), BAD_FLAGS)).alias("warn")
        )
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        flags.writeStream.outputMode("append")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_flag_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts of every site and day, added up over the micro-batches."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return rows.groupBy("site", "day").agg(F.sum("total").alias("total"), F.sum("warn").alias("warn"))
