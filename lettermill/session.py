"""Shared-folder scratch tables and skew-safe attribute joins."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPREAD = 32
_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_mine = threading.local()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    run without that setting; a fresh folder is then made once per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    already = sc.getCheckpointDir()
    if already:
        return already.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = sc.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="lettermill-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/lettermill/{label}-{uuid.uuid4().hex}"
    made = getattr(_mine, "paths", None)
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_released(spark: SparkSession) -> Iterator[None]:
    """Delete what this thread writes as scratch inside the block, at its end.

    For work whose results are stored elsewhere by then, such as a cycle.
    """
    outer, _mine.paths = getattr(_mine, "paths", None), []
    try:
        yield
    finally:
        made, _mine.paths = _mine.paths, outer
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of a session inside the block: ``spark.sql.`` and the name, with ``__`` for dots."""
    names = {f"spark.sql.{name.replace('__', '.')}": value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffles_released(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside the block, files of shuffles go with the job that wrote them, not when the driver
    happens to collect garbage.  For work whose steps are written, so that none is read again."""
    return settings(spark, classic__shuffleDependency__fileCleanup__enabled="true")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and makes sure
    that work with side effects is not repeated by a later action.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(*cols: str, buckets: int = _SPREAD) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def attach(
    rows: DataFrame,
    attributes: DataFrame,
    on: list[str],
    how: str = "left",
    salt_by: str = "uid",
    buckets: int = _SPREAD,
) -> DataFrame:
    """Join per-account or per-folder attributes to message rows.

    ``attributes`` has one row per ``on`` key.  One key may own a third of all
    rows, so each key is divided into ``buckets`` parts by ``salt_by`` and the
    small attribute side is repeated once per part.  Spark still broadcasts the
    attribute side by itself whenever its measured size allows that.
    """
    salted = attributes.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    )
    return (
        rows.withColumn("_salt", spread(salt_by, buckets=buckets))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of the application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a shipped archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="lettermill-ship-"), "lettermill_pkg.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
