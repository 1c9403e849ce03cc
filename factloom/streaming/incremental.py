"""Incremental facts (ST-01, ST-02): only files whose content or configuration changed are extracted again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["file_id", "content_hash", "config"]


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (id, content, configuration) the cache doesn't have."""
    return files.join(cache.select(*KEY).distinct(), KEY, "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, change: added, removed or changed; files that stayed are left out (ST-02)."""
    a, b = old.select(key, F.col(content).alias("__a")), new.select(key, F.col(content).alias("__b"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return both.select(key, kind.alias("change")).where("change is not null")


def refresh(files: DataFrame, cache: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fact rows of all files: cached ones where nothing changed, fresh ones elsewhere; rows of gone files go.

    cache: KEY and the fact columns.
    """
    kept = cache.join(files.select(*KEY).distinct(), KEY, "left_semi")
    todo = misses(files, cache)
    fresh = extract(todo).join(todo.select(*KEY), "file_id")
    return kept.unionByName(fresh.select(*kept.columns))


def watch(spark: SparkSession, folder: str, schema: str, cache: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A streaming query that extracts the files that arrive as Parquet rows (file_id, path, text, content_hash, config).

    Each batch appends the facts of its rows, one folder a batch, so a batch that runs twice writes once.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        latest = rows.dropDuplicates(KEY)
        extract(latest).join(latest.select(*KEY), "file_id").write.mode("overwrite").parquet(f"{cache}/epoch={epoch}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_windows(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key with a gap, late rows dropped by a watermark; for streams and tables alike (an extension)."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
