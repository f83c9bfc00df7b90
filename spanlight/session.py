"""Session factory, table loading and lineage cutting."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "spanlight", **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, AQE, Arrow."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only in local mode, and only where that setting is absent, a temporary folder is made; on a cluster a folder of
    one machine would lose data, so there its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spanlight-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        if path.startswith("file://") and os.path.isdir(path[7:]):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there is removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/spanlight-{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def materialise(df: DataFrame, label: str = "step", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative plans; the files outlive lost executors. They are removed by :func:`discard`, or
    when the interpreter ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.partitionBy(*partition_by or []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanlight_path = path
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Remove the files of a table that :func:`materialise` gave (or one partition of them); nothing may read them any more."""
    path = getattr(df, "_spanlight_path", None)
    if path:
        _drop(df.sparkSession, f"{path}/{part}" if part else path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_spanlight_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spanlight-code-")) / "spanlight_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._spanlight_shipped = True
