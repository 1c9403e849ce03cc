"""Domains by clustering capabilities over six signals (A-09 to A-20, A-28, C-03 to C-09, C-11, J-18, W-08).

Pairs come from what two capabilities share (a matching path, calls, reached units, resources, words), so there is no
product of all capabilities. The merge loop runs in one task per project, over capabilities, which are few.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import gates as G
from ..operators import graph as X
from ..operators import joins as J
from .analyze import Tables

WEIGHTS: Mapping[str, float] = {"http": 0.40, "call": 0.15, "flow": 0.15, "resource": 0.10, "path": 0.05, "lexical": 0.15}
SIGNALS = list(WEIGHTS)
MODES = ("legacyStrictKey", "structuralCrossKey")


def _of_units(t: Tables) -> DataFrame:
    """key, unit_id of every unit that a capability's entrypoints reach."""
    own = t.contracts.where("key is not null").select("key", "unit_id")
    pairs = own.join(t.reached_parts.withColumnRenamed("source_id", "unit_id"), "unit_id").select("key", "part").distinct()
    return X.members(pairs, t.parts, "unit_id").select("key", "unit_id")


def signal_pairs(t: Tables) -> DataFrame:
    """left_key, right_key and the six signals of all pairs that share any."""
    units = X.cut(_of_units(t))
    contracts = t.contracts.where("key is not null")
    route = F.regexp_replace("contract", r"^[^:]*:", "")
    paths = contracts.select("key", route.alias("path")).distinct()
    n_paths = paths.groupBy("key").agg(F.count("*").alias("n"))
    met = J.prefix_join(paths.select(F.col("key").alias("left_key"), F.col("path").alias("l")), paths.select(F.col("key").alias("right_key"), F.col("path").alias("r")), "l", "r").where("left_key < right_key")
    side = lambda k: n_paths.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"))
    http = met.groupBy("left_key", "right_key").agg(F.count("*").alias("m")).join(side("left_key"), "left_key").join(side("right_key"), "right_key")
    http = http.select("left_key", "right_key", F.least(F.col("m") / (F.col("n_left_key") * F.col("n_right_key")), F.lit(1.0)).alias("http"))

    size = units.groupBy("key").agg(F.count("*").alias("n"))
    owners = contracts.select("key", "unit_id").distinct()
    a, b = owners.select(F.col("key").alias("ka"), F.col("unit_id").alias("source_id")), owners.select(F.col("key").alias("kb"), F.col("unit_id").alias("target_id"))
    between = A.pair_counts(t.calls.join(a, "source_id").join(b, "target_id"), "ka", "kb")
    most = size.agg(F.max("n").alias("most"))
    call = between.crossJoin(F.broadcast(most)).select("left_key", "right_key", F.least(F.col("n") / F.col("most"), F.lit(1.0)).alias("call"))  # one row
    x, y = units.select(F.col("key").alias("left_key"), "unit_id"), units.select(F.col("key").alias("right_key"), "unit_id")
    shared = x.join(y, "unit_id").where("left_key < right_key").groupBy("left_key", "right_key").agg(F.count("*").alias("n"))
    flow = shared.select("left_key", "right_key", (F.col("n") / (F.col("n") + 2.0)).alias("flow"))
    resource = A.jaccard_pairs(units.join(t.resources.select("unit_id", "name"), "unit_id"), "key", "name")
    files = units.join(t.units.select(F.col("id").alias("unit_id"), "path", "qualified_name"), "unit_id")
    dirs = files.select("key", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir")).distinct()
    path = A.jaccard_pairs(dirs, "key", "dir").withColumnRenamed("resource", "path")
    words = files.select("key", F.explode(T.tokens(T.short_name(F.col("qualified_name")))).alias("term"))
    lexical = A.cosine_pairs(A.tf_idf(words, "key", "term"), "key", "term")
    out = None
    for df in map(X.cut, (http, call, flow, resource, path, lexical)):
        out = df if out is None else out.join(df, ["left_key", "right_key"], "full")
    return X.cut(out.select("left_key", "right_key", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in SIGNALS]))


def judged_pairs(pairs: DataFrame, roles: DataFrame, mode: str = "structuralCrossKey", threshold: float = 0.08) -> DataFrame:
    """pairs with combined, gate and why they may not merge. roles: key, test (all its files are tests)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    for side in ("left", "right"):
        pairs = pairs.join(roles.select(F.col("key").alias(f"{side}_key"), F.col("test").alias(f"{side}_test")), f"{side}_key")
    c = {s: F.col(s) for s in SIGNALS}
    gate = G.legacy_gate(c["http"], c["call"], c["flow"]) if mode == MODES[0] else G.structural_gate(c["http"], c["call"], c["flow"], c["resource"])
    combined = A.combine(c, WEIGHTS)
    strict = mode == MODES[0]
    why = G.rejection(F.col("left_test"), F.col("right_test"), F.col("left_key") == F.col("right_key"), gate, combined, threshold, strict)
    return pairs.select("left_key", "right_key", *SIGNALS, combined.alias("combined"), gate.alias("gate"), why.alias("rejection"))


def form_domains(t: Tables, mode: str = "structuralCrossKey", threshold: float = 0.08, most: int = 24) -> dict[str, DataFrame]:
    """pairs (judged), clusters (key, cluster), domains with confidence, rejections by reason."""
    units = X.cut(_of_units(t))
    roles = units.join(t.units.select(F.col("id").alias("unit_id"), "file_id"), "unit_id").join(t.files.select("file_id", "role"), "file_id")
    roles = roles.groupBy("key").agg(F.min(F.col("role") == "test").alias("test"))
    pairs = judged_pairs(signal_pairs(t), roles, mode, threshold)
    items = t.capabilities.select(F.lit(0).alias("project"), F.col("key").alias("item"))
    table = pairs.select(F.lit(0).alias("project"), "left_key", "right_key", "combined", F.col("gate").isNotNull().alias("allowed"), (F.col("rejection") == "test-production").eqNullSafe(F.lit(True)).alias("forbidden"))
    clusters = G.cluster_partitions(table, items, "project", threshold, most).select(F.col("item").alias("key"), "cluster")
    quality = A.cluster_quality(pairs.where("combined > 0"), clusters.withColumnRenamed("key", "item"), "item", "cluster", "combined")
    seen = [F.max(F.when(F.col(s) > 0, 1).otherwise(0)) for s in ("http", "call", "flow", "resource", "lexical")]
    member = clusters.select(F.col("key").alias("left_key"), "cluster")
    diversity = pairs.join(member, "left_key").join(clusters.select(F.col("key").alias("right_key"), F.col("cluster").alias("other")), "right_key").where("cluster = other").groupBy("cluster").agg((sum(seen[1:], seen[0]) / 5).alias("diversity"))
    named = quality.join(diversity, "cluster", "left").na.fill(0.0, ["diversity"])
    overall, status, level, score = A.cluster_confidence(F.col("members"), F.col("cohesion"), F.col("separation"), F.col("diversity"))
    domains = named.select(F.col("cluster").alias("key"), T.label(F.col("cluster")).alias("label"), "members", "cohesion", "separation", "diversity", overall.alias("overall"), status.alias("status"), level.alias("level"), score.alias("score"))
    kind = F.when(T.operational_key(F.col("key")), "crossCutting").otherwise("business")
    return {"pairs": pairs, "clusters": clusters, "domains": domains.withColumn("kind", kind), "rejections": pairs.where("rejection is not null").groupBy("rejection").agg(F.count("*").alias("pairs"))}
