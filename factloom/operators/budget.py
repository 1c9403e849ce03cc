"""Budgets: running caps, byte parts, greedy filling, chunk plans (W-05, W-06, B-01 to B-08, T-01, T-02)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows before, by `order`, whose values are all different.

    Rows are sorted by range; one window adds up the ranges' totals, a row a range, and one runs within each range, so
    no task sees all rows.
    """
    dealt = cut(rows.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(F.sum(value).alias("__total"))
    totals = totals.select("__range", F.coalesce(F.sum("__total").over(before.orderBy("__range")), F.lit(0)).alias("__base"))
    own = F.coalesce(F.sum(value).over(before.partitionBy("__range").orderBy(order)), F.lit(0))
    return dealt.join(F.broadcast(totals), "__range").withColumn(name, F.col("__base") + own).drop("__range", "__base")  # a row a range


def running_budget(rows: DataFrame, group: str, order: list[Column], budget: int) -> DataFrame:
    """Rows that fit a budget that groups use up in order (W-06).

    Groups are counted first; the running sum is over one row a group, range by range, and only rows of groups that start
    within the budget are ranked.
    """
    before = running_sum(rows.groupBy(group).agg(F.count("*").alias("__n")), group, "__n", "__before")
    near = rows.join(before.where(F.col("__before") < budget).select(group, "__before"), group)
    ranked = near.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("__rank") <= budget - F.col("__before")).drop("__before", "__rank")


def split_parts(rows: DataFrame, group: str, order: str, size: str, target: int) -> DataFrame:
    """rows with `part`, from 1: a new part starts where the next row would exceed the target (W-05).

    The sum starts anew with each part, so it is a fold: rows come sorted within their group and stream through,
    batch by batch; only the running sum is kept.
    """
    cols = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, used = object(), 0, 0
        for pdf in batches:
            parts = []
            for g, n in zip(pdf[group], pdf[size]):
                if g != now:
                    now, part, used = g, 1, n
                elif used + n > target:
                    part, used = part + 1, n
                else:
                    used += n
                parts.append(part)
            pdf["part"] = parts
            yield pdf

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.repartition(group).sortWithinPartitions(group, order).select(*cols).mapInPandas(run, f"{kinds}, part int")


def scan_prefix(rows: DataFrame, order: str, size: str, most: int, budget: int) -> DataFrame:
    """The first `most` rows in order, less those that would exceed the byte budget; those are skipped and the scan
    goes on (S-02). The fold runs over order and size alone of at most `most` rows, in one task; whole rows don't move."""
    keys = rows.select(order, size)
    kinds = ", ".join(f"`{c}` {t}" for c, t in keys.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = 0
        for pdf in batches:
            keep = []
            for n in pdf[size]:
                fits = used + n <= budget
                used += n if fits else 0
                keep.append(fits)
            yield pdf[keep]

    kept = keys.orderBy(order).limit(most).coalesce(1).sortWithinPartitions(order).mapInPandas(run, kinds)
    return rows.join(kept.select(order), order, "left_semi").select(*(f"`{c}`" for c in rows.columns))  # the join puts `order` first


def fill_rows(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Rows (id, size, required, priority) that are taken: required ones always, then the rest by priority per byte,
    priority and id, each if it still fits (B-03)."""
    rank = pdf.assign(rate=pdf["priority"] * 1_000_000 // pdf["size"].clip(lower=1)).sort_values(["required", "rate", "priority", "id"], ascending=[False, False, False, True])
    used, taken = 0, []
    for required, size in zip(rank["required"], rank["size"]):
        fits = bool(required) or used + size <= budget
        used += size if fits else 0
        taken.append(fits)
    return rank[taken].drop(columns="rate")


def fill(rows: DataFrame, group: str, budget: int) -> DataFrame:
    """fill_rows() for each group, as a fold: rows come sorted within their group and stream through, batch by batch, so
    a group of any size needs no more memory than a batch. Rows that could never fit don't travel."""
    cols, kinds = rows.columns, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = object(), 0
        for pdf in batches:
            taken = []
            for g, required, size in zip(pdf[group], pdf["required"], pdf["size"]):
                if g != now:
                    now, used = g, 0
                fits = bool(required) or used + size <= budget
                used += size if fits else 0
                taken.append(fits)
            yield pdf.loc[taken, cols]

    rate = F.floor(F.col("priority") * 1_000_000 / F.greatest("size", F.lit(1)))
    small = rows.where(F.col("required") | (F.col("size") <= budget)).withColumn("__rate", rate)
    order = [F.col(group), F.col("required").desc(), F.col("__rate").desc(), F.col("priority").desc(), F.col("id")]
    return small.repartition(group).sortWithinPartitions(*order).mapInPandas(run, kinds)


def share_budget(rows: DataFrame, reserved: str, signal: str, budget: int) -> DataFrame:
    """rows with `bytes`: what they need, and the rest of the budget split by their signals (B-02)."""
    total = rows.agg(F.sum(reserved).alias("__need"), F.sum(signal).alias("__signal"))
    rest = F.greatest(F.lit(budget) - F.col("__need"), F.lit(0))
    part = F.when(F.col("__signal") == 0, 0).otherwise(F.floor(rest * F.col(signal) / F.col("__signal")))
    return rows.crossJoin(F.broadcast(total)).withColumn("bytes", F.col(reserved) + part).drop("__need", "__signal")  # one row


def plan_chunks(domains: list[tuple[str, int, int]], links: dict[tuple[str, str], int], budget: int) -> list[list[str]]:
    """Greedy chunks of (id, bytes, signal): the best signal starts a chunk, the strongest connection that fits joins
    it until none does; a domain that is too large stands alone (B-01)."""
    left = {d: (n, s) for d, n, s in domains}
    out = []
    while left:
        seed = min(left, key=lambda d: (-left[d][1], d))
        chunk, used = [seed], left.pop(seed)[0]
        while True:
            fits = [d for d in left if used + left[d][0] <= budget]
            weight = {d: sum(links.get((d, c), 0) + links.get((c, d), 0) for c in chunk) for d in fits}
            fits = [d for d in fits if weight[d] > 0]
            if not fits:
                break
            best = min(fits, key=lambda d: (-weight[d], -left[d][1], d))
            used += left.pop(best)[0]
            chunk.append(best)
        out.append(chunk)
    return out


def fit(features: list[tuple[str, int, int, bool]], flows: list[tuple[str, int, int]], base: int, budget: int) -> tuple[list[str], list[str], bool]:
    """Drop the weakest optional feature, then the weakest flow, until the rest fits (B-04); ids left, and whether it fits.

    features: id, bytes, priority, required; flows: id, bytes, score.
    """
    keep_f, keep_w = sorted(features, key=lambda f: (not f[3], -f[2], f[0])), sorted(flows, key=lambda w: (-w[2], w[0]))
    size = lambda: base + sum(f[1] for f in keep_f) + sum(w[1] for w in keep_w)
    while size() > budget and keep_f and not keep_f[-1][3]:
        keep_f.pop()
    while size() > budget and keep_w:
        keep_w.pop()
    return [f[0] for f in keep_f], [w[0] for w in keep_w], size() <= budget


def halve(items: list[tuple[str, int]], budget: int, compact: Callable[[tuple[str, int]], int]) -> list[list[str]]:
    """Parts that fit the budget, cut at the midpoint of the bytes; a single item is compacted, else it is an error
    (B-05 to B-07)."""
    todo, out = [list(items)], []
    while todo:
        part = todo.pop(0)
        if sum(n for _, n in part) <= budget:
            out.append([i for i, _ in part])
        elif len(part) == 1:
            if compact(part[0]) > budget:
                raise ValueError(f"{part[0][0]} doesn't fit")
            out.append([part[0][0]])
        else:
            half, used, cut = sum(n for _, n in part) / 2, 0, 0
            while cut < len(part) - 1 and (cut == 0 or used + part[cut][1] <= half):
                used += part[cut][1]
                cut += 1
            todo[:0] = [part[:cut], part[cut:]]
    return out


def ledger(all_ids: DataFrame, planned: DataFrame, suppressed: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """How each domain is covered: full or partial, suppressed, alias, or missing (B-08)."""
    named = planned.select(key, F.when(F.col("complete"), "full").otherwise("partial").alias("coverage"))
    named = named.unionByName(suppressed.select(key, F.lit("suppressed").alias("coverage"))).unionByName(aliases.select(key, F.lit("alias").alias("coverage")))
    return all_ids.join(named.dropDuplicates([key]), key, "left").withColumn("coverage", F.coalesce("coverage", F.lit("missing")))
