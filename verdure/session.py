"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITING: dict[str, tuple[int, str | None]] = {}

# Settings every job here relies on. Partition counts are left to the cluster and to AQE.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app: str = "verdure", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is absent and the master is local;
    on a cluster the missing setting is an error, because executors could not share the folder.
    """
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _session_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/verdure-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="verdure-")
    return _LOCAL_FOLDERS[app]


def clear_scratch(spark: SparkSession) -> None:
    """Removes the tables this session wrote to the scratch folder, once no result needs them."""
    folder = _session_folder(spark)
    _delete(spark, folder)
    _LOCAL_FOLDERS.pop(spark.sparkContext.applicationId, None)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is executed meanwhile leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    session = spark._jsparkSession.sessionUUID()
    with _LOCK:
        threads, before = _WRITING.get(session) or (0, spark.conf.get(_CLEANUP, None))
        _WRITING[session] = threads + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            threads, before = _WRITING.pop(session)
            if threads > 1:
                _WRITING[session] = threads - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage so that values which depend on task layout (positions, partition ids) are
    fixed once and survive the loss of executors. Parquet keeps column pruning for later readers.
    The shuffle files of the write are removed at its end.
    """
    path = scratch_path(df.sparkSession, label)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` returned, once whatever was computed from them is written too."""
    for table in tables:
        _delete(table.sparkSession, table._scratch)
