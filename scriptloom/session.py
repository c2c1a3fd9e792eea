"""Session helpers: a local session with sane defaults, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; ``conf`` keys use ``__`` for dots."""
    root = str(PACKAGE_ROOT.parent)
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *paths])
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scriptloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; below a temporary one only in local mode. It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='scriptloom-files-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, folder)
    return folder


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the application has already ended
        return


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor (once per application).

    Local mode and a cluster whose PYTHONPATH already holds the package need nothing; for the
    others the driver packs the sources and Spark's file server hands them out.
    """
    context = spark.sparkContext
    if getattr(context, "_scriptloom_shipped", False):
        return
    context._scriptloom_shipped = True
    if str(PACKAGE_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="scriptloom-")) / "scriptloom_sources.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE_ROOT.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE_ROOT.parent))
    context.addPyFile(str(archive))
