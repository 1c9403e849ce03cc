"""Keys, references, upserts and merged reviews (V-01 to V-09, O-04, O-05)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def primary_keys(tables: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """name, repeated: rows of each table beyond the first of their key (V-01); two partial sums a table."""
    one = lambda name, df, key: df.groupBy(key).agg(F.count("*").alias("n")).agg(F.lit(name).alias("name"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return reduce(DataFrame.unionByName, [one(*t) for t in tables])


def foreign_keys(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """reference, missing: rows whose key has no parent (V-02)."""

    def one(name: str, child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
        keys = parent.select(F.col(key).alias("__k"))
        # children are counted by key first, so a hot key crosses the network once a task
        rows = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__k")).agg(F.count("*").alias("n"))
        return rows.join(keys, "__k", "left_anti").agg(F.lit(name).alias("reference"), F.coalesce(F.sum("n"), F.lit(0)).alias("missing"))

    return reduce(DataFrame.unionByName, [one(*c) for c in checks])


def require(checks: DataFrame, count: str) -> None:
    """Raise with the first offender if any check counts more than zero."""
    bad = checks.where(F.col(count) > 0).limit(1).collect()
    if bad:
        raise ValueError(f"integrity: {bad[0].asDict()}")


def missing_ids(all_ids: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Distinct ids that aren't present (O-05)."""
    return all_ids.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows, and old's rows of other keys (O-04)."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def first_suggestions(rows: DataFrame, known: DataFrame, key: str, text: str, order: Column) -> DataFrame:
    """The first suggestion of each id, with a warning for ids that aren't known (V-03)."""
    first = rows.groupBy(key).agg(F.min_by(text, order).alias(text))
    met = first.join(known.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    return met.select(key, text, F.when(F.col("__k").isNull(), "unknown id").alias("warning"))


def demote_rejected(reviews: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """A rejected group that has contract evidence is reviewed again instead (V-04)."""
    own = evidence.select(F.col(key).alias("__k")).distinct()
    met = reviews.join(own, F.col(key) == F.col("__k"), "left")
    return met.withColumn("decision", F.when((F.col("decision") == "reject") & F.col("__k").isNotNull(), "review").otherwise(F.col("decision"))).drop("__k")


def to_canonical(rows: DataFrame, key: str, ids: str, mapping: DataFrame) -> DataFrame:
    """An id list mapped to canonical ids, sorted, without repeats (V-05, J-26)."""
    flat = rows.select(key, F.explode_outer(ids).alias("id")).join(mapping, "id", "left")
    return flat.groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("canonical", "id"))).alias(ids))


def over_budget(rows: DataFrame, size: str, budget: int) -> DataFrame:
    """Diagnostics for rows that are larger than the budget (V-08)."""
    return rows.where(F.col(size) > budget).select(F.lit("warning").alias("severity"), F.lit("BUDGET_EXCEEDED").alias("code"), F.concat(F.col(size).cast("string"), F.lit(" bytes")).alias("message"))
