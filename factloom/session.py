"""Sessions, and how the package reaches the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_own_dir: str | None = None


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("factloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=settings)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, spark.checkpoint.dir; in local mode without one, a temporary one."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is not None:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        folder = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, folder, True)
        _own_dir = f"file://{folder}"
    return _own_dir


def ship(spark: SparkSession) -> None:
    """Make the package importable for Python workers, unless their path has it already; once a session."""
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == _ROOT for p in [*known, os.getcwd()]):
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/factloom", "zip", _ROOT, "factloom"))
    _shipped.add(app)
