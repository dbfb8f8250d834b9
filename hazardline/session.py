"""Spark session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hazardline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` adds or overrides settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship_code(builder.getOrCreate())


def ship_code(spark: SparkSession) -> SparkSession:
    """Give the workers this package, for clusters where it is not installed. Once per application."""
    context = spark.sparkContext
    if not getattr(context, "_hazardline_shipped", False):
        here = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='hazardline-code-')}/hazardline", "zip", here.parent, here.name)
        context.addPyFile(archive)
        context._hazardline_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder the cluster names; a local session gets its own."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="hazardline-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder so that later jobs reread it, whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, name: str = "stage", by: str | None = None, once: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, and later reads prune columns.

    ``by`` names a column whose values get folders of their own, so that a filter on it reads only those.

    The files go when the session ends, or earlier by ``drop_staged``. With ``once``, what this write shuffled is deleted
    as soon as it is done, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true" if once else before)
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_TIDY, before)
    context = spark.sparkContext
    if not hasattr(context, "_hazardline_staged"):
        context._hazardline_staged = []
        atexit.register(_drop_quietly, context)
    context._hazardline_staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_quietly(context) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        _drop(context, context._hazardline_staged)


def _drop(context, paths: list[str]) -> None:
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def _holding(paths: list[str], files: list[str]) -> list[str]:
    """The paths that any of the files lies under; a path may be written in several ways, so its own folder name decides."""
    folders = {part for f in files for part in f.split("/")}
    return [p for p in paths if p.rsplit("/", 1)[1] in folders]


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of tables from ``stage_table`` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        gone = _holding(getattr(context, "_hazardline_staged", []), table.inputFiles())
        _drop(context, gone)
        context._hazardline_staged = [p for p in context._hazardline_staged if p not in gone]


class Staging:
    """A scope for tables from ``stage_table``: on leaving it, all that were staged inside are deleted but those kept.

    >>> with Staging(spark) as scope:
    ...     result = scope.keep(stage_table(...))
    """

    def __init__(self, spark: SparkSession) -> None:
        self.context, self.kept = spark.sparkContext, []

    def __enter__(self) -> "Staging":
        self.before = list(getattr(self.context, "_hazardline_staged", []))
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept += table.inputFiles()
        return table

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            since = [p for p in getattr(self.context, "_hazardline_staged", []) if p not in self.before]
            held = _holding(since, self.kept)
            gone = [p for p in since if p not in held]
            _drop(self.context, gone)
            if gone:
                self.context._hazardline_staged = [p for p in self.context._hazardline_staged if p not in gone]
