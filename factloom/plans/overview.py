"""What an analysis shows: features, cards, boundaries, context flows, snapshots, bundles and maps
(P-08, P-09, P-17 to P-27, C-09, C-12 to C-16, J-17, J-23, J-30, A-22, A-33, T-07 to T-10, S-14, E-01)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import flow as W
from ..operators import graph as X
from ..operators.extract import ENDINGS
from .analyze import Tables

#: Weights of a flow's entrypoint, resource, dynamic boundary and size.
FLOW_WEIGHTS = (100, 60, 40, 1)


def dynamic_boundaries(t: Tables) -> DataFrame:
    """Dynamic references as boundaries: id, unit_id, name, line (P-08)."""
    return t.references.where("status = 'dynamic'").select("id", F.col("source_id").alias("unit_id"), F.col("target_name").alias("name"), F.col("start_line").alias("line"))


def unresolved(references: DataFrame) -> DataFrame:
    """References that hit nothing (P-07)."""
    return references.where(F.col("target_id").isNull())


def confidence_level(resolved: Column, missing: Column, dynamic: Column) -> Column:
    """high without an open edge, medium with a resolved one, else low (A-22)."""
    return F.when((missing == 0) & (dynamic == 0), "high").when(resolved > 0, "medium").otherwise("low")


def features(t: Tables) -> DataFrame:
    """One feature for each contract (C-12): key, label, kind, status, level, roots, entrypoints, domains, resources,
    flows, boundaries and counts over what the roots reach.

    A project without any entrypoint of a contract gets operation features instead: its exported units that nothing
    calls. Lists of what is reached come by strongly connected parts, so cycles don't multiply them.
    """
    served = t.contracts.select(F.coalesce("contract", F.concat_ws(":", "kind", F.coalesce("route", "unit_id"))).alias("feature"), F.coalesce("key", F.lit("operation")).alias("key"), F.lit("endpoint").alias("kind"), F.col("unit_id").alias("root"), F.col("id").alias("entrypoint_id"), "path")
    if t.contracts.isEmpty():
        called = t.calls.where("source_id != target_id").select(F.col("target_id").alias("id")).distinct()
        lone = W.flow_units(t.units).where("exported").join(called, "id", "left_anti")
        served = lone.select(F.col("qualified_name").alias("feature"), T.last_segment(F.col("qualified_name")).alias("key"), F.lit("operation").alias("kind"), F.col("id").alias("root"), F.lit(None).cast("string").alias("entrypoint_id"), "path")
        pairs, own = X.reach_parts(t.calls, "source_id", "target_id", served.select(F.col("root").alias("source_id")))
    else:
        pairs, own = t.reached_parts, t.parts
    part_of = lambda rows, unit: rows.join(own.withColumnRenamed("node", unit), unit, "left").withColumn("part", F.coalesce("part", unit))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    refs = part_of(t.references, "source_id").groupBy("part").agg(n(F.col("target_id").isNotNull()).alias("resolved"), n(F.col("target_id").isNull()).alias("unresolved"), n(F.col("status") == "dynamic").alias("dynamic"))
    held = part_of(t.resources.select("unit_id", F.col("id").alias("resource_id")), "unit_id").groupBy("part").agg(F.collect_set("resource_id").alias("resources"))
    bounds = part_of(dynamic_boundaries(t).select("unit_id", "id"), "unit_id").groupBy("part").agg(F.collect_set("id").alias("boundaries"))
    size = own.groupBy("part").agg(F.count("*").alias("units"))
    roots = served.select("feature", F.col("root").alias("source_id")).distinct().join(pairs, "source_id").select("feature", "part").distinct()
    met = roots.join(refs, "part", "left").join(size, "part", "left").join(held, "part", "left").join(bounds, "part", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    scope = met.withColumn("units", F.coalesce("units", F.lit(1))).groupBy("feature").agg(total("resolved"), total("unresolved"), total("dynamic"), F.sum("units").alias("reachable"), flat("resources"), flat("boundaries"))
    many = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    own_rows = served.groupBy("feature").agg(F.min("key").alias("key"), F.min("kind").alias("kind"), many("root", "unit_ids"), many("entrypoint_id", "entrypoint_ids"), many(P.bucket_key(F.col("path")), "domain_ids"))
    out = own_rows.join(scope, "feature", "left").na.fill(0, ["resolved", "unresolved", "dynamic", "reachable"])
    status = A.feature_status(F.when(F.col("kind") == "endpoint", "confirmed").otherwise("candidate"), F.col("unresolved"), F.col("dynamic"))
    level = confidence_level(F.col("resolved"), F.col("unresolved"), F.col("dynamic"))
    return out.withColumns({"label": T.label(F.col("key")), "status": status, "level": level, "id": T.stable_id("feature_", "feature")})


def feature_priority(reachable: Column, entrypoints: Column, resources: Column) -> Column:
    """100 for an entrypoint, else 60 for a resource, else 40, and up to 100 units that are reached (T-07)."""
    return F.when(entrypoints > 0, 100).when(resources > 0, 60).otherwise(40) + F.least(reachable, F.lit(100))


def required_feature(row: DataFrame) -> Column:
    """A feature with an entrypoint, a resource or a boundary must stay (P-19)."""
    return (F.size(row["entrypoint_ids"]) > 0) | (F.size(row["resources"]) > 0) | (F.size(row["boundaries"]) > 0)


def feature_tags(entrypoints: Column, resources: Column, writes: Column, dynamic: Column) -> Column:
    """endpoint, resourceAccess, sideEffect, dynamicBoundary, or internal if it is none of them (P-20)."""
    marks = F.array_compact(F.array(F.when(entrypoints, "endpoint"), F.when(resources, "resourceAccess"), F.when(writes, "sideEffect"), F.when(dynamic, "dynamicBoundary")))
    return F.when(F.size(marks) == 0, F.array(F.lit("internal"))).otherwise(marks)


def feature_flows(features: DataFrame, pairs: DataFrame, own: DataFrame, flows: DataFrame) -> DataFrame:
    """feature, unit_id of every flow that a feature's units own or reach (J-23)."""
    roots = features.select(F.col("id").alias("feature"), F.explode("unit_ids").alias("source_id"))
    reached = X.members(roots.join(pairs, "source_id").select("feature", "part").distinct(), own, "unit_id").select("feature", "unit_id")
    every = reached.unionByName(roots.select("feature", F.col("source_id").alias("unit_id"))).distinct()
    return every.join(flows.select("unit_id"), "unit_id", "left_semi")


def meaningful_steps(nodes: DataFrame, flow: str, order: str, label: str, most: int) -> DataFrame:
    """The first `most` nodes of each flow that have a label, one for each label, in order (T-09)."""
    first = A.top_per_group(nodes.where(F.coalesce(F.col(label), F.lit("")) != ""), [flow], [F.col(order)], most)
    return first.groupBy(flow, label).agg(F.min(order).alias(order))


def unique_hints(values: Column, most: int) -> Column:
    """Trimmed values without repeats and blanks, the first `most` (T-10)."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.slice(F.array_distinct(clean), 1, most)


def context_flows(t: Tables, chosen: DataFrame, most: int = 24, weights: tuple[int, int, int, int] = FLOW_WEIGHTS) -> DataFrame:
    """Flows of features (as features() gives) for a context: owner, features, reason, score, whether required, steps,
    best first (T-08, P-19, P-26)."""
    owned = feature_flows(chosen, t.reached_parts, t.parts, t.flows).join(chosen.select(F.col("id").alias("feature"), F.size("entrypoint_ids").alias("e"), F.size("resources").alias("r"), F.size("boundaries").alias("b")), "feature")
    any_ = lambda c: F.max(F.when(c, 1).otherwise(0))
    marks = owned.groupBy("unit_id").agg(F.array_sort(F.collect_set("feature")).alias("feature_ids"), any_(F.col("e") > 0).alias("entry"), any_(F.col("r") > 0).alias("held"), any_(F.col("b") > 0).alias("open"))
    touching = t.resources.groupBy("unit_id").agg(F.lit(1).alias("touches"))
    edges = t.flow_edges.groupBy("unit_id").agg(F.count("*").alias("edges"))
    met = t.flows.join(marks, "unit_id").join(touching, "unit_id", "left").join(edges, "unit_id", "left").na.fill(0, ["touches", "edges"])
    has, dynamic = F.greatest("held", "touches"), F.greatest(F.col("open"), (F.size("boundaries") > 0).cast("int"))
    score = F.col("entry") * weights[0] + has * weights[1] + dynamic * weights[2] + (F.col("nodes") + F.col("edges")) * weights[3]
    reason = F.when(F.col("entry") == 1, "entrypoint_flow").when(has == 1, "resource_access_flow").when(dynamic == 1, "dynamic_boundary_flow").otherwise("complex_internal_flow")
    required = (F.size("boundaries") > 0) | (F.greatest("entry", "held", "open") == 1) | (F.col("touches") == 1)
    steps = meaningful_steps(t.flow_nodes.where("kind not in ('entry', 'exit')").select("unit_id", F.struct("line", "id").alias("at"), "label"), "unit_id", "at", "label", most)
    steps = steps.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]).alias("steps"))
    out = met.join(steps, "unit_id", "left").select("unit_id", T.short_name(F.col("qualified_name")).alias("owner"), "feature_ids", reason.alias("reason"), required.alias("required"), score.alias("score"), "steps")
    return out.orderBy(F.desc("score"), "unit_id")


def required_per_domain(t: Tables, visible: DataFrame) -> DataFrame:
    """bucket, kind, id: entrypoints and resources that a domain must keep, those of its visible units (J-30)."""
    owners = t.memberships.select("unit_id", F.explode("domain_ids").alias("bucket")).join(visible.select(F.col("id").alias("unit_id")), "unit_id", "left_semi")
    points = t.entrypoints.select("unit_id", "id", F.lit("entrypoint").alias("kind"))
    return owners.join(points.unionByName(t.resources.select("unit_id", "id", F.lit("resource").alias("kind"))), "unit_id").select("bucket", "kind", "id").distinct()


def package_of(qualified: Column) -> Column:
    """All but the last part of a qualified name (F-08)."""
    return F.regexp_extract(qualified, r"^(.*)(?:::|\.)[^.:]+$", 1)


def module_of(qualified: Column, parts: int = 2) -> Column:
    """The first parts of a qualified name (F-08)."""
    return F.array_join(F.slice(F.split(qualified, r"::|\."), 1, parts), "::")


def capability_cards(t: Tables, most: int = 24) -> DataFrame:
    """Evidence of each capability: contracts, frameworks, packages, names, resources and what is called (C-14)."""
    units = t.units.select(F.col("id").alias("unit_id"), "qualified_name")
    own = t.contracts.where("key is not null").join(units, "unit_id", "left")
    some = lambda c, name: F.slice(F.array_sort(F.collect_set(c)), 1, most).alias(name)
    cards = own.groupBy("key").agg(some("contract", "contracts"), some("framework", "frameworks"), some(package_of(F.col("qualified_name")), "packages"), some(T.short_name(F.col("qualified_name")), "names"), F.countDistinct("unit_id").alias("units"))
    reached = own.select("key", F.col("unit_id").alias("source_id")).distinct().join(t.reached_parts, "source_id").select("key", "part").distinct()
    held = t.resources.join(t.parts.withColumnRenamed("node", "unit_id"), "unit_id", "left").select(F.coalesce("part", "unit_id").alias("part"), "name").distinct()
    touched = reached.join(held, "part").groupBy("key").agg(some("name", "resources"))
    called = own.select("key", F.col("unit_id").alias("source_id")).join(t.calls, "source_id").join(units.select(F.col("unit_id").alias("target_id"), F.col("qualified_name").alias("target")), "target_id").groupBy("key").agg(some(T.last_segment(F.col("target")), "called"))
    return cards.join(touched, "key", "left").join(called, "key", "left")


def handler_key(path_key: Column, kind: Column, handler_class: Column, service: Column, job: Column) -> Column:
    """The capability's key by kind of entrypoint: path, else the handler's class, the service, the job (C-13)."""
    clean = lambda c: F.lower(F.regexp_replace(c, r"(Controller|Handler|Service|Resource|Job)$", ""))
    return F.when(kind == "rpc", F.coalesce(clean(service), path_key)).when(kind == "job", F.coalesce(job, path_key)).otherwise(F.coalesce(path_key, clean(handler_class)))


# domains

def business(domains: DataFrame) -> DataFrame:
    """Groups that the overview shows (P-09)."""
    return domains.where("kind = 'business'")


def absorbed_by_key(domains: DataFrame) -> DataFrame:
    """id, into: business domains without an entrypoint join the first one of the same canonical key that has some (C-09).

    domains: id, key, kind, entrypoints (their number), ord.
    """
    own = business(domains).withColumn("canonical", P.canonical_key(F.col("key")))
    parents = own.where("entrypoints > 0").groupBy("canonical").agg(F.min_by("id", F.struct("ord", "id")).alias("into"))
    return own.where("entrypoints = 0").join(parents, "canonical").select("id", "into")


def merge_reasons(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, reason: the last gate that fires among the pairs of a cluster's members (C-15); `structural` without one.

    pairs: left_key, right_key, gate; clusters: key, cluster.
    """
    side = lambda c, x: clusters.select(F.col("key").alias(c), F.col("cluster").alias(x))
    both = pairs.join(side("left_key", "a"), "left_key").join(side("right_key", "b"), "right_key").where("a = b and gate is not null")
    last = both.groupBy(F.col("a").alias("cluster")).agg(F.max_by("gate", F.struct("left_key", "right_key")).alias("reason"))
    merged = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    return merged.join(last, "cluster", "left").select("cluster", F.coalesce("reason", F.lit("structural")).alias("reason"))


def formation_counters(merges: DataFrame, absorbed: DataFrame) -> DataFrame:
    """step, reason, n: merges by reason and absorptions by strategy (A-33)."""
    a = merges.groupBy(F.lit("merge").alias("step"), F.col("reason").cast("string").alias("reason")).agg(F.count("*").alias("n"))
    return a.unionByName(absorbed.groupBy(F.lit("absorb").alias("step"), F.col("strategy").cast("string").alias("reason")).agg(F.count("*").alias("n")))


def file_overlap(members: DataFrame, group: str, path: str) -> DataFrame:
    """left, right, files that two groups both have units in (C-16)."""
    own = members.select(group, path).distinct()
    a, b = own.select(F.col(group).alias("left_key"), path), own.select(F.col(group).alias("right_key"), path)
    return a.join(b, path).where("left_key < right_key").groupBy("left_key", "right_key").agg(F.count("*").alias("files"))


def project_profile(rows: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """Each part's sum over the total's sum, 0 for an empty total (A-25)."""
    ratio = lambda c: F.when(F.sum(total) == 0, 0.0).otherwise(F.sum(c) / F.sum(total)).alias(c)
    return rows.agg(F.count("*").alias("rows"), F.sum(total).alias(total), *[ratio(c) for c in parts])


def global_summary(members: DataFrame, unit: str, group: str) -> DataFrame:
    """Distinct units, memberships and groups (A-26)."""
    return members.agg(F.countDistinct(unit).alias("units"), F.count("*").alias("memberships"), F.countDistinct(group).alias("groups"))


def adjacent_domains(relations: DataFrame, source: str, target: str, inside: DataFrame, key: str, most: int = 8) -> DataFrame:
    """adjacent, weight: domains outside that share the most relations with those inside (J-24); relations with both
    ends inside or both outside don't count."""
    held = lambda c, x: inside.select(F.col(key).alias(c), F.lit(True).alias(x)).distinct()
    met = relations.join(held(source, "__a"), source, "left").join(held(target, "__b"), target, "left")
    met = met.where(F.col("__a").isNull() != F.col("__b").isNull())
    out = met.groupBy(F.when(F.col("__a").isNull(), F.col(source)).otherwise(F.col(target)).alias("adjacent")).agg(F.count("*").alias("weight"))
    return out.orderBy(F.desc("weight"), "adjacent").limit(most)


#: What a relation's status counts for a connection.
CONNECTION = {"confirmed": 3, "candidate": 2, "unknown": 1, "dynamic": 1}


def connection_weight(relations: DataFrame, group: str, status: str, weight: str) -> DataFrame:
    """Relations of each group, their status times their weight, one at least (A-27)."""
    value = F.coalesce(*[F.when(F.col(status) == s, v) for s, v in CONNECTION.items()], F.lit(0))
    return relations.groupBy(group).agg(F.sum(value * F.greatest(F.col(weight), F.lit(1))).alias("connection"))


def domain_cards(rows: DataFrame, group: str, unit: str, amount: str, signal: str, most: int = 8) -> DataFrame:
    """Units, summed amounts and the first distinct signals of each group (A-35)."""
    return rows.groupBy(group).agg(F.count(unit).alias("units"), F.sum(amount).alias(amount), F.slice(F.array_sort(F.collect_set(signal)), 1, most).alias("signals"))


def shared_threshold(score: Column, numerator: int, denominator: int, least: int, top: int = 2**32 - 1) -> Column:
    """A share of a score, computed without overflow and not under `least` (F-29)."""
    scaled = F.least(score.cast("decimal(20,0)") * numerator, F.lit(top))
    return F.greatest(F.floor(scaled / max(denominator, 1)), F.lit(least)).cast("long")


# bundles

LANGUAGES = [*ENDINGS, "unknown"]


def language_key(value: Column) -> Column:
    """The canonical name of a language, in any case; null for one that is not known (P-27)."""
    return F.when(F.lower(value).isin(LANGUAGES), F.lower(value))


def clean(t: Tables, chosen: DataFrame) -> dict[str, DataFrame]:
    """Datasets of a clean bundle (P-24): what a reader needs, without texts and evidence. chosen: features()."""
    production = t.files.where("role not in ('test', 'archived')").select("file_id")
    units = t.units.join(production, "file_id", "left_semi")
    paths = units.select(F.col("id").alias("unit_id"), "path")
    covered = t.files.groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    domain_paths = t.memberships.join(paths, "unit_id").groupBy(F.col("domain_id").alias("bucket")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return {
        "features": chosen.select("id", "feature", "key", "label", "kind", "status", "level", "unit_ids", "entrypoint_ids", "domain_ids", "resources", "boundaries", "reachable"),
        "domains": t.domains.join(domain_paths, "bucket", "left"),
        "units": units.select("id", "kind", "name", "qualified_name", "path", "language", "start_line", "end_line"),
        "entrypoints": t.entrypoints.select("id", "unit_id", "kind", "method", "path", "framework"),
        "resources": t.resources.select("id", "unit_id", "kind", "name", "mode"),
        "relations": t.relations,
        "flows": t.flows.select("unit_id", "entry_id", "exit_id", "nodes", "boundaries"),
        "coverage": covered,
    }


def from_clean(bundle: dict[str, DataFrame]) -> Tables:
    """An analysis's tables from a clean bundle (S-14, P-25): what a bundle doesn't hold comes back empty, file ids are
    made again from paths, by the same hash as a scan's."""
    file_id = lambda path: F.concat(F.lit("file_"), F.substring(F.sha2(path, 256), 1, 24))
    units = bundle["units"].select(file_id(F.col("path")).alias("file_id"), "path", language_key(F.col("language")).alias("language"), "id", F.lit(None).cast("string").alias("parent_id"), "kind", "qualified_name", "name", "start_line", "end_line", *[F.lit(None).cast("string").alias(c) for c in ("signature", "parameters", "types", "bases", "returns", "modifiers", "visibility")], F.lit(False).alias("exported"))
    files = units.select("file_id", "path", "language").distinct().select("*", F.lit(None).cast("int").alias("size"), P.path_role(F.col("path")).alias("role"), F.lit(None).cast("string").alias("content_hash"))
    return Tables({"files": files, "units": units, "domains": bundle["domains"].drop("paths"), "entrypoints": bundle["entrypoints"], "resources": bundle["resources"], "relations": bundle["relations"], "flows": bundle["flows"], "features": bundle["features"]})


def saved_map(bundle: dict[str, DataFrame]) -> DataFrame:
    """Domains with their features and paths, as a map shows them (S-23); other columns are pruned at the scan."""
    own = bundle["features"].select(F.explode("domain_ids").alias("bucket"), "label", "reachable")
    cards = own.groupBy("bucket").agg(F.count("*").alias("features"), F.sum("reachable").alias("reachable"), F.slice(F.array_sort(F.collect_set("label")), 1, 8).alias("labels"))
    return bundle["domains"].select("bucket", "status", "score", F.size(F.coalesce("paths", F.array())).alias("files")).join(cards, "bucket", "left").na.fill(0, ["features", "reachable"])


def snapshot(t: Tables, chosen: DataFrame) -> dict[str, DataFrame]:
    """What an evaluation compares (E-01): domains (key, domain), contracts (contract, domain), edge kinds by contract."""
    domains = chosen.select("key", F.explode_outer("domain_ids").alias("domain")).distinct()
    contracts = chosen.where("kind = 'endpoint'").select(F.col("feature").alias("contract"), F.explode_outer("domain_ids").alias("domain"))
    owned = feature_flows(chosen.where("kind = 'endpoint'"), t.reached_parts, t.parts, t.flows).join(chosen.select(F.col("id").alias("feature"), F.col("feature").alias("contract")), "feature")
    kinds = owned.join(t.flow_edges.select("unit_id", "kind"), "unit_id").select("contract", "kind").distinct()
    return {"domains": domains, "contracts": contracts, "kinds": kinds}


def overview(t: Tables, chosen: DataFrame) -> dict[str, DataFrame]:
    """The result's sections in their final shape (P-17)."""
    return {
        "summary": A.project_summary(t.files, "language", "size"),
        "features": chosen.select("id", "key", "label", "kind", "status", "level", "domain_ids", "unit_ids", "entrypoint_ids", "resources", "boundaries", "reachable"),
        "domains": t.domains,
        "dynamicBoundaries": dynamic_boundaries(t),
        "frameworks": t.detections.groupBy("framework").agg(F.max("files").alias("files"), F.max("confidence").alias("confidence")),
        "relations": t.relations,
        "edges": t.edges,
        "flows": t.flows,
        "links": t.flow_links,
        "diagnostics": t.diagnostics,
    }
