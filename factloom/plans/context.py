"""Context chunks under a byte budget (B-01 to B-08, S-15, S-16, P-19, P-20, P-23, T-07 to T-10, C-10).

Sizes are those of compact JSON with nulls. Chunks are planned over domains, on the driver; what fills them is chosen
per chunk in the workers.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import bucket_key
from ..operators import budget as B
from ..sources.bundle import size_of
from .analyze import Tables

BUDGET = 450_000


def packets(t: Tables) -> DataFrame:
    """domain, id, line, size, priority, required: one packet a contract, with what it calls and touches."""
    units = t.units.select(F.col("id").alias("unit_id"), "qualified_name", F.col("path").alias("unit_path"))
    held = t.resources.join(t.parts.withColumnRenamed("node", "unit_id"), "unit_id", "left").select(F.coalesce("part", "unit_id").alias("part"), F.col("name").alias("resource"), "mode").distinct()
    touched = t.reached_parts.select(F.col("source_id").alias("unit_id"), "part").join(held, "part")
    touched = touched.groupBy("unit_id").agg(F.slice(F.array_sort(F.collect_set("resource")), 1, 3).alias("resources"), F.max(F.when(F.col("mode") == "write", 1).otherwise(0)).alias("writes"))
    called = t.calls.join(units.select(F.col("unit_id").alias("target_id"), "qualified_name"), "target_id").groupBy(F.col("source_id").alias("unit_id")).agg(F.slice(F.array_sort(F.collect_set(T.last_segment(F.col("qualified_name")))), 1, 3).alias("called"))
    edges = t.features.select(F.col("root").alias("unit_id"), "resolved", F.col("dynamic").alias("dynamics"))
    rows = t.contracts.where("contract is not null").join(units, "unit_id").join(touched, "unit_id", "left").join(called, "unit_id", "left").join(edges, "unit_id", "left")
    line = T.one_line([F.col("contract"), T.short_name(F.col("qualified_name")), F.array_join("called", ","), F.array_join("resources", ",")])
    tags = F.array_compact(F.array(F.lit("endpoint"), F.when(F.size("resources") > 0, "resourceAccess"), F.when(F.col("writes") == 1, "sideEffect"), F.when(F.col("dynamics") > 0, "dynamicBoundary")))
    out = rows.select(bucket_key(F.col("unit_path")).alias("domain"), F.col("id"), line.alias("line"), tags.alias("tags"), (100 + F.least(F.coalesce("resolved", F.lit(0)), F.lit(100))).alias("priority"), F.coalesce(F.col("dynamics") > 0, F.lit(False)).alias("required"))
    return out.withColumn("size", size_of(out).cast("long"))


def chunks(t: Tables, budget: int = BUDGET) -> DataFrame:
    """chunk_id, domain, id, line, tags, size: packets that fit, best first, in chunks of connected domains."""
    rows = packets(t)
    signal = t.domains.select(F.col("bucket").alias("domain"), "score")
    domains = rows.groupBy("domain").agg(F.sum("size").alias("bytes")).join(signal, "domain", "left").na.fill(0, ["score"])
    listed = [(r.domain, min(int(r.bytes), budget), int(r.score)) for r in domains.orderBy("domain").collect()]  # one row a domain
    links = {(r.source_group, r.target_group): int(r.weight) for r in t.relations.groupBy("source_group", "target_group").agg(F.sum("weight").alias("weight")).collect()}
    plan = B.plan_chunks(listed, links, budget)
    where = rows.sparkSession.createDataFrame([(f"chunk-{i:04}", d) for i, c in enumerate(plan) for d in c], "chunk_id string, domain string")
    placed = rows.join(F.broadcast(where), "domain")  # one row a domain
    kinds = ", ".join(f"`{c}` {k}" for c, k in placed.dtypes)
    return placed.groupBy("chunk_id").applyInPandas(lambda pdf: B.fill_rows(pdf, budget), kinds).select("chunk_id", "domain", "id", "line", "tags", "size")


def coverage(t: Tables, chosen: DataFrame) -> DataFrame:
    """domain, coverage: full, partial or missing (B-08)."""
    n = chosen.groupBy("domain").agg(F.count("*").alias("taken"))
    every = packets(t).groupBy("domain").agg(F.count("*").alias("all"))
    planned = n.join(every, "domain").select("domain", (F.col("taken") == F.col("all")).alias("complete"))
    none = planned.limit(0).select("domain")
    return B.ledger(every.select("domain"), planned, none, none, "domain")


def write_chunks(chosen: DataFrame, folder: str) -> None:
    """One JSON folder a chunk (S-15)."""
    chosen.repartition("chunk_id").sortWithinPartitions("chunk_id", "domain", "id").write.mode("overwrite").partitionBy("chunk_id").json(folder)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a folder (S-16)."""
    return spark.read.schema("domain string, id string, line string, tags array<string>, size long, chunk_id string").json(folder)


def sniff(document: str) -> str:
    """What a result document is: an analysis (it has an overview), an overview itself, or unknown (S-18)."""
    try:
        value = json.loads(document)
    except ValueError:
        return "unknown"
    if not isinstance(value, dict):
        return "unknown"
    return "analysis" if "overview" in value else "overview" if "domains" in value else "unknown"

