"""Results as JSON, bundles by name, and runs of a workspace (S-10, S-11, S-19, S-20, S-24)."""

from __future__ import annotations

import json
import sys
import uuid
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bundle import swap

#: Bytes that a result may have.
LIMIT = 536_870_912


class TooLarge(ValueError):
    """A result beyond its limit; nothing of it is left."""


def size_of_sections(sections: dict[str, DataFrame]) -> dict[str, int]:
    """Bytes of each section as JSON lines, from one sum a section."""
    one = lambda df: df.select(F.octet_length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("n")).agg(F.sum(F.col("n") + 1)).head()[0]
    return {name: int(one(df) or 0) for name, df in sections.items()}


def write_result(spark: SparkSession, sections: dict[str, DataFrame], folder: str, limit: int = LIMIT, pretty: bool = False) -> dict[str, int]:
    """Write each section as JSON lines, and an index of bytes, beside the folder, then move all in place (S-10).

    The bytes are known before anything is written; a result beyond the limit raises and leaves the old one as it was.
    """
    sizes = size_of_sections(sections)
    if sum(sizes.values()) > limit:
        raise TooLarge(f"{sum(sizes.values())} bytes; the limit is {limit}")
    stage = f"{folder.rstrip('/')}.{uuid.uuid4().hex[:8]}"
    for name, df in sections.items():
        df.write.option("ignoreNullFields", "false").json(f"{stage}/{name}")
    index = json.dumps(sizes, indent=2 if pretty else None)
    spark.createDataFrame([(index,)], "value string").coalesce(1).write.text(f"{stage}/index")
    swap(spark, stage, folder)
    return sizes


def print_result(sections: dict[str, DataFrame], out: TextIO | None = None, limit: int = LIMIT) -> int:
    """Write sections as JSON lines to a stream, row by row from the executors, within the limit (S-11). Returns the bytes.

    The size is checked first, so a stream never gets half a result.
    """
    out = out or sys.stdout
    total = sum(size_of_sections(sections).values())
    if total > limit:
        raise TooLarge(f"{total} bytes; the limit is {limit}")
    for name, df in sections.items():
        for row in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator():
            out.write(json.dumps(name) + "\t" + row[0] + "\n")
    return total


def compute_only(sections: dict[str, DataFrame]) -> None:
    """Compute every section and keep none (`--no-output`, S-11)."""
    for df in sections.values():
        df.write.format("noop").mode("overwrite").save()


def candidates(root: str, name: str) -> list[str]:
    """Folders that may hold a project's bundle, in order (S-19)."""
    base = root.rstrip("/")
    out = [f"{base}/{name}/clean", f"{base}/{name}"]
    for kind in ("service", "library-cli"):
        out += [f"{base}/{kind}/{name}/clean", f"{base}/{kind}/{name}"]
    return out


def find_bundle(spark: SparkSession, root: str, name: str) -> str | None:
    """The first of the candidates that holds a manifest (S-19)."""
    context = spark.sparkContext
    for folder in candidates(root, name):
        path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
        if path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
            return folder
    return None


def record_run(spark: SparkSession, store: str, project: str, steps: DataFrame) -> None:
    """Append a run's steps (step, ord, seconds, status) to the store of all workspaces (S-20, S-24)."""
    key = F.hex(F.xxhash64(F.lit(project)))
    steps.select(key.alias("workspace"), F.lit(project).alias("project"), F.current_timestamp().alias("updated_at"), "step", "ord", "seconds", "status").write.mode("append").partitionBy("workspace").parquet(store)


def workspaces(spark: SparkSession, store: str) -> DataFrame:
    """workspace, project, updated_at, runs of all workspaces, newest first (S-20)."""
    rows = spark.read.parquet(store)
    return rows.groupBy("workspace", "project").agg(F.max("updated_at").alias("updated_at"), F.countDistinct("updated_at").alias("runs")).orderBy(F.desc("updated_at"), "project")
