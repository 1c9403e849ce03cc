"""Merge gates, rejection reasons, clustering and buckets (C-01 to C-10, A-28)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least http, call, flow and resource similarity of the structural gate; strong http and resource.
HTTP, CALL, FLOW, RESOURCE = 0.20, 0.12, 0.12, 0.20
HTTP_STRONG, RESOURCE_STRONG = 0.60, 0.45

BUCKETS, OTHER = 32, "_other"


def legacy_gate(http: Column, call: Column, flow: Column) -> Column:
    """The first of three signals that is above zero; null for none (C-04)."""
    return F.when(http > 0, "http").when(call > 0, "call").when(flow > 0, "flow")


def structural_gate(http: Column, call: Column, flow: Column, resource: Column) -> Column:
    """Why two capabilities may merge by structure, null if they may not (C-04)."""
    signals = F.array_compact(F.array(F.when(http >= HTTP, "http"), F.when(call >= CALL, "call"), F.when(flow >= FLOW, "flow"), F.when(resource >= RESOURCE, "resource")))
    n = F.size(signals)
    return (
        F.when((n == 0) | ((n == 1) & (F.get(signals, F.lit(0)) == "call")), F.lit(None))
        .when((http >= HTTP_STRONG) & (resource >= RESOURCE), "http+resource")
        .when(resource >= RESOURCE_STRONG, "resource-strong")
        .when(http >= HTTP_STRONG, "http-strong")
        .when(n >= 2, F.concat_ws("+", F.get(signals, F.lit(0)), F.get(signals, F.lit(1))))
    )


def evidence_gate(strong: Column, medium: Column) -> Column:
    """One strong or two medium signs (C-04)."""
    return F.when(strong >= 1, "v2-strong").when(medium >= 2, "v2-medium")


def rejection(left_test: Column, right_test: Column, same_key: Column, gate: Column, combined: Column, least: float, strict_key: bool) -> Column:
    """Why a pair does not merge, null if it does (C-05)."""
    out = F.when(left_test != right_test, "test-production")
    if strict_key:
        out = out.when(~same_key, "different-key")
    return out.when(gate.isNull(), "no-signal").when(combined < least, "below-threshold")


def agglomerate(ids: list, similarity: np.ndarray, forbidden: np.ndarray, allowed: np.ndarray, threshold: float, most: int) -> tuple[list[list], list[tuple]]:
    """Average-linkage clusters and the log of merges (C-03).

    The most similar pair of clusters merges while its mean similarity reaches the threshold, or while there are
    more than `most` clusters; never across a forbidden pair, and only where some member pair is allowed. Ties go
    to the pair that comes first.
    """
    groups, log = [[i] for i in range(len(ids))], []
    total, ban, gate = similarity.astype(float).copy(), forbidden.copy(), allowed.copy()
    while len(groups) > 1:
        size = np.array([len(g) for g in groups], float)
        mean = total / np.outer(size, size)
        mean[ban | ~gate] = -1
        mean[np.tril_indices(len(groups))] = -1
        at = int(mean.argmax())
        i, j = divmod(at, len(groups))
        if mean[i, j] < 0 or mean[i, j] < threshold and len(groups) <= most:
            break
        log.append((ids[groups[i][0]], ids[groups[j][0]], float(mean[i, j])))
        groups[i] += groups.pop(j)
        for m, how in ((total, np.add), (ban, np.logical_or), (gate, np.logical_or)):
            m[i, :] = how(m[i, :], m[j, :])
            m[:, i] = how(m[:, i], m[:, j])
        total, ban, gate = (np.delete(np.delete(m, j, 0), j, 1) for m in (total, ban, gate))
    return [[ids[k] for k in sorted(g)] for g in groups], log


def cluster_partitions(pairs: DataFrame, items: DataFrame, by: str, threshold: float, most: int, bound: int = 4000) -> DataFrame:
    """agglomerate() inside each value of `by`, one group a task: by, item, cluster (its first item).

    pairs: by, left_key, right_key, combined, allowed, forbidden; items: by, item. The merge loop holds a square
    matrix, so a group of more than `bound` items is an error, not a cut.
    """
    kind = dict(items.dtypes)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(left["item"].tolist())
        if len(ids) > bound:
            raise ValueError(f"{key[0]}: {len(ids)} items are too many to cluster at once")
        at = {v: k for k, v in enumerate(ids)}
        s, ban, ok = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(ids)), bool), np.zeros((len(ids), len(ids)), bool)
        for a, b, v, good, bad in right[["left_key", "right_key", "combined", "allowed", "forbidden"]].itertuples(index=False):
            i, j = at[a], at[b]
            s[i, j] = s[j, i] = v
            ok[i, j] = ok[j, i] = good
            ban[i, j] = ban[j, i] = bad
        groups, _ = agglomerate(ids, s, ban, ok, threshold, most)
        return pd.DataFrame([(key[0], v, g[0]) for g in groups for v in g], columns=[by, "item", "cluster"])

    schema = f"{by} {kind[by]}, item {kind['item']}, cluster {kind['item']}"
    items, pairs = items.toDF(*items.columns), pairs.toDF(*pairs.columns)  # both may come from one table
    return items.groupBy(by).cogroup(pairs.groupBy(by)).applyInPandas(run, schema)


def cap_buckets(sizes: dict[str, int], most: int = BUCKETS) -> dict[str, str]:
    """Where each bucket goes so that at most `most` are left: the smallest nested one joins its parent, and when
    none is nested the smallest joins `_other` (C-02). A table of buckets is small; rows are mapped by a join."""
    now, goes = dict(sizes), {k: k for k in sizes}

    def move(a: str, b: str) -> None:
        now[b] = now.get(b, 0) + now.pop(a)
        for k, v in goes.items():
            if v == a:
                goes[k] = b

    while len(now) > most:
        nested = [(n, k) for k, n in now.items() if "/" in k]
        if nested:
            _, k = min(nested)
            move(k, k.rpartition("/")[0])
        else:
            _, k = min((n, k) for k, n in now.items())
            if k == OTHER and len(now) < 2:
                break
            if k == OTHER:
                _, k = min((n, k) for k, n in now.items() if k != OTHER)
            move(k, OTHER)
    return goes


def lead_aliases(rows: list[tuple[str, str, set]], equivalent: Callable[[str, str], bool], least: int = 80) -> dict[str, str]:
    """Greedy in id order: a group joins the first leader with an equivalent key and at least so much overlap in
    percent of the smaller set (C-10). rows: id, key, members."""
    leaders: list[tuple[str, str, set]] = []
    out = {}
    for id_, key, members in sorted(rows, key=lambda r: r[0]):
        for leader, its_key, its_members in leaders:
            small = min(len(members), len(its_members))
            if small and equivalent(key, its_key) and 100 * len(members & its_members) // small >= least:
                out[id_] = leader
                break
        else:
            leaders.append((id_, key, members))
            out[id_] = id_
    return out


def absorb_singletons(singles: DataFrame, candidates: DataFrame, child: str, parent: str) -> DataFrame:
    """The parent of each singleton by the first strategy that has one, best score, then smallest id (C-07, W-07).

    candidates: child, parent, strategy (its order), score.
    """
    best = candidates.groupBy(child).agg(F.min_by(F.struct(parent, "strategy"), F.struct("strategy", -F.col("score"), F.col(parent))).alias("b"))
    return singles.join(best, child).select(child, F.col(f"b.{parent}").alias(parent), F.col("b.strategy").alias("strategy"))


def merge_groups(rows: DataFrame, mapping: DataFrame, group: str) -> DataFrame:
    """rows with groups replaced by what they merged into (C-08). mapping: group, into."""
    return rows.join(mapping.select(F.col(group), "into"), group, "left").withColumn(group, F.coalesce("into", group)).drop("into")
