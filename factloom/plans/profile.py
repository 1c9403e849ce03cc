"""Seconds of steps, as rows (S-24, ST-04)."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Profile:
    """Collects (step, ord, seconds, status) of steps that run inside `with profile.step(name)`."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, float, str]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began, status = time.time(), "ok"
        try:
            yield
        except BaseException:
            status = "failed"
            raise
        finally:
            self.rows.append((name, len(self.rows), round(time.time() - began, 3), status))

    def percent(self, total: int) -> int:
        """Share of steps that are done, of so many (ST-03)."""
        return 100 * min(len(self.rows), total) // max(total, 1)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step string, ord int, seconds double, status string")


# How a step's progress reads in a log.
PROGRESS = r"^progress stage=(\S+) chunk=(\d+)/(\d+) status=(\w+)"


def progress_line(stage: str, chunk: int, total: int, status: str = "running") -> str:
    """A line that progress_events() reads."""
    return f"progress stage={stage} chunk={chunk}/{total} status={status}"


def progress_events(lines: DataFrame) -> DataFrame:
    """ord, stage, chunk, total, status of the log lines (ord, line) that tell of progress; others are passed over
    (ST-03). Row-local, so it reads a stream as well as a table."""
    part = lambda i: F.regexp_extract("line", PROGRESS, i)
    return lines.where(F.col("line").rlike(PROGRESS)).select("ord", part(1).alias("stage"), part(2).cast("int").alias("chunk"), part(3).cast("int").alias("total"), part(4).alias("status"))


def stage_percent(events: DataFrame) -> DataFrame:
    """stage, percent, status: how far each stage has come, by its largest chunk, and its last status (ST-03)."""
    share = F.floor(100 * F.max("chunk") / F.greatest(F.max("total"), F.lit(1)))
    return events.groupBy("stage").agg(F.least(share, F.lit(100)).cast("int").alias("percent"), F.max_by("status", "ord").alias("status"))
