"""The main query: files to facts, resolved references, edges, capabilities, buckets, memberships and relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import extract as E
from ..operators import flow as W
from ..operators import frameworks as K
from ..operators import graph as X
from ..operators import joins as J
from ..operators import rules as R
from ..operators import validate as V


@dataclass
class Tables:
    """All tables of one analysis, by name."""

    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.frames[name]
        except KeyError:
            raise AttributeError(name) from None


def split_facts(facts: DataFrame) -> dict[str, DataFrame]:
    """One table for each kind of fact, of one pass over the extracted rows."""
    of = lambda kind: facts.where(F.col("fact_kind") == kind)
    span = [F.col("start_line"), F.col("end_line")]
    attr = lambda k: F.col("attrs")[k].alias(k)
    return {
        "units": of("unit").select("file_id", "path", "language", "id", F.col("owner").alias("parent_id"), "kind", F.col("name").alias("qualified_name"), T.last_segment(F.col("name")).alias("name"), *span, attr("signature"), attr("parameters"), attr("types"), attr("bases"), attr("returns"), attr("modifiers"), attr("visibility"), F.coalesce(F.lower(F.col("attrs")["exported"]) == "true", F.lit(False)).alias("exported")),
        "references": of("reference").select("file_id", "language", "id", F.col("owner").alias("source_id"), "kind", F.col("target").alias("target_name"), F.coalesce(F.col("attrs")["status"], F.lit("candidate")).alias("status"), *span),
        "entrypoints": of("entrypoint").select("file_id", "path", "id", F.col("owner").alias("unit_id"), "kind", "name", attr("method"), F.col("attrs")["path"].alias("route"), F.col("attrs")["receiver"].alias("receiver"), *span),
        "resources": of("resource").select("file_id", "id", F.col("owner").alias("unit_id"), "kind", "name", attr("mode"), *span),
        "control_flow": of("control").select("file_id", "id", F.col("owner").alias("unit_id"), "kind", attr("condition"), *span),
        "call_sites": of("call").select("file_id", "id", F.col("owner").alias("unit_id"), F.col("name").alias("callee"), attr("receiver"), attr("arguments"), attr("assigned"), *span),
        "decorators": of("decorator").select("file_id", "id", F.col("owner").alias("unit_id"), "name", attr("receiver"), attr("arguments"), *span),
        "bindings": of("binding").select("file_id", "id", F.col("owner").alias("scope_id"), "kind", F.col("name").alias("local_name"), F.col("target").alias("target_name"), *span),
        "flow_nodes": of("node").select(F.col("owner").alias("unit_id"), "id", "kind", F.col("name").alias("label"), F.col("start_line").alias("line"), F.col("target").alias("reference_id")),
        "flow_edges": of("edge").select(F.col("owner").alias("unit_id"), "id", attr("source").alias("source_id"), F.col("target").alias("target_id"), "kind", F.nullif("name", F.lit("")).alias("label"), attr("status")),
        "diagnostics": of("diagnostic").select(F.col("kind").alias("severity"), F.col("name").alias("code"), F.col("target").alias("message"), "path"),
    }


def resolve(references: DataFrame, units: DataFrame, bindings: DataFrame) -> DataFrame:
    """references with target_id, candidates and status (J-01 to J-04).

    In order: a member of the class around it (`self.`, `this.`), a sibling or child by bare name in the same file, an
    import binding of the file, the exact qualified name, a qualified suffix. One hit confirms, several are candidates;
    imports only hit files (P-06); a dynamic reference stays dynamic, with its target.
    """
    named = units.select("file_id", "language", F.col("id").alias("unit"), "parent_id", "kind", "name", F.col("qualified_name").alias("full"))
    # the head of a dotted target may be bound in its file: app.run with `from x import app` is x.app.run
    bound = J.unique_binding(bindings.where("kind in ('import', 'alias', 'constructor')").select("file_id", F.col("local_name").alias("head"), "target_name"), ["file_id", "head"], "target_name")
    refs = references.withColumn("head", F.regexp_extract("target_name", r"^[^.:]+", 0))
    refs = refs.join(bound.withColumnRenamed("target_name", "bound"), ["file_id", "head"], "left")
    owner = units.select(F.col("id").alias("source_id"), F.col("parent_id").alias("class_id"))
    refs = refs.join(owner, "source_id", "left")
    full = F.when(F.col("bound").isNull(), F.col("target_name")).otherwise(F.concat("bound", F.expr("substring(target_name, length(head) + 1)")))
    dotted = F.regexp_replace(F.regexp_replace(full, r"^[./]+", ""), r"(\.|/|->)+", "::")
    importing = F.col("kind") == "import"
    key = lambda *cols: F.concat_ws("\0", *cols)
    members = named.where("kind != 'file'")
    refs = refs.withColumn("dotted", dotted).withColumn("last", T.last_segment(F.col("target_name")))
    own = F.when(F.col("target_name").rlike(r"^(self|this)(\.|->)[^.]+$"), key(F.col("class_id"), F.col("last")))
    bare = F.when(~importing & ~F.col("target_name").rlike(r"[.:>\[]") & F.col("bound").isNull(), key(F.col("file_id"), F.col("target_name")))
    exact = F.when(F.contains("dotted", F.lit("::")) | importing, key(F.col("language"), importing.cast("string"), F.col("dotted")))
    of = lambda rows, on: rows.select("unit", on.alias("on"))
    files = named.where("kind = 'file'")
    tails = lambda rows, flag: rows.select("unit", "language", F.explode(F.array_union(F.array("full"), F.transform(F.sequence(F.lit(1), F.size(F.split("full", "::"))), lambda i: F.array_join(F.slice(F.split("full", "::"), i, F.size(F.split("full", "::"))), "::")))).alias("tail")).select("unit", key(F.col("language"), F.lit(flag), F.col("tail")).alias("on"))
    rungs = [
        (own, of(members, key(F.col("parent_id"), F.col("name"))), "on"),
        (bare, of(members, key(F.col("file_id"), F.col("name"))), "on"),
        (exact, of(members, key(F.col("language"), F.lit("false"), F.col("full"))).unionByName(of(files, key(F.col("language"), F.lit("true"), F.col("full")))), "on"),
        (exact, tails(members.where("kind in ('class', 'function', 'method', 'interface', 'struct', 'enum', 'trait', 'constructor')"), "false").unionByName(tails(files, "true")), "on"),
    ]
    met = J.priority_join(refs, rungs, "id", "unit").withColumnRenamed("status", "found")
    out = references.join(met, "id")
    status = F.when(F.col("status") == "dynamic", "dynamic").otherwise(F.col("found"))
    return out.select(*[c for c in references.columns if c != "status"], F.when(F.size("targets") == 1, F.get("targets", F.lit(0))).alias("target_id"), F.when(F.size("targets") > 1, F.col("targets")).otherwise(F.slice("targets", 1, 0)).alias("candidates"), status.alias("status"))


LIMITS = {"maxUnits": 2_000_000, "maxReferences": 10_000_000, "maxCallSites": 5_000_000, "maxExecutionFlows": 500_000, "maxFlowNodes": 5_000_000}
_CAPPED = {"units": "maxUnits", "references": "maxReferences", "call_sites": "maxCallSites"}


def capped(t: Tables, limits: dict[str, int]) -> DataFrame:
    """Cut each kind of fact at its limit, in the order of files and lines (T-01), and say so in diagnostics.

    Counts come first, in one pass; a table within its limit is neither sorted nor copied.
    """
    counts = None
    for name in _CAPPED:
        one = t.frames[name].select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    over = [r.name for r in counts.collect() if r.n > limits[_CAPPED[r.name]]]  # a row a kind
    for name in over:
        t.frames[name] = t.frames[name].orderBy("file_id", "start_line", "id").limit(limits[_CAPPED[name]])
    said = [("warning", "ANALYSIS_LIMIT_REACHED", f"{name}: {limits[_CAPPED[name]]}", None) for name in over]
    return t.units.sparkSession.createDataFrame(said, "severity string, code string, message string, path string")


def analyze(files: DataFrame, limits: dict[str, int] | None = None, manifests: DataFrame | None = None) -> Tables:
    """All tables for files (file_id, path, text), and manifests (path, name, text) if given.

    The texts are read by one extraction and one pass for frameworks' marks; all else are joins over facts. Tables are
    lazy but for those that several others read.
    """
    limits = LIMITS | (limits or {})
    facts = X.cut(E.extract(files))  # every table below reads its result
    t = Tables(split_facts(facts))
    t.frames["files"] = files.select("file_id", "path", language_column(), F.octet_length("text").alias("size"), P.path_role(F.col("path")).alias("role"), F.sha2("text", 256).alias("content_hash"))
    truncated = capped(t, limits)
    t.frames["diagnostics"] = t.diagnostics.unionByName(truncated)
    refs = X.cut(resolve(t.references, t.units, t.bindings))
    t.frames["references"] = refs
    t.frames["edges"] = A.aggregate_edges(refs.withColumn("target", F.coalesce("target_id", F.concat(F.lit("name:"), "target_name"))), "source_id", "target", "kind", "status", "id")
    calls = W.call_edges(refs).where("target_id is not null").select("source_id", "target_id").distinct()
    t.frames["calls"] = calls
    t.frames["resources"] = t.resources.unionByName(R.call_resources(t.call_sites, t.bindings))
    add_frameworks(t, files, manifests)
    _flows(t, limits)
    _domains(t, refs, calls)
    return t


def add_frameworks(t: Tables, files: DataFrame, manifests: DataFrame | None) -> None:
    """Detections, what applies to each file, and entrypoints and resources with what frameworks declare (X-01 to X-19)."""
    typed = files.select("file_id", "path", language_column(), "text")
    found = K.detect(K.code_lines(typed))
    if manifests is not None:
        named = K.manifest_matches(K.manifest_dependencies(manifests)).select("framework", F.col("path").alias("file_id"), "language", "line")
        found = found.select("framework", "file_id", "language", "line").unionByName(named)
    found = X.cut(found.select("framework", "file_id", "language", "line"))
    t.frames["detections"] = found.join(K.confidence(found), "framework")
    applied = X.cut(K.applies(typed.select("file_id", "language"), found))
    t.frames["applied"] = applied
    t.frames["entrypoints"] = X.cut(K.enrich(typed.select("file_id", "language", "path"), t.frames, applied, found).join(typed.select("file_id", F.col("path").alias("file_path")), "file_id"))
    if found.isEmpty():
        t.frames["components"] = t.units.select(F.col("id").alias("unit_id"), F.lit("").alias("framework")).limit(0)
        return
    models = K.orm_tables(t.units, applied)
    touched = K.orm_access(t.call_sites, models).join(t.units.select(F.col("id").alias("unit_id"), "file_id", "start_line", "end_line"), "unit_id")
    orm = touched.select("file_id", T.stable_id("orm_", "unit_id", "table", "mode").alias("id"), "unit_id", F.lit("table").alias("kind"), F.col("table").alias("name"), "mode", "start_line", "end_line")
    t.frames["resources"] = t.resources.unionByName(orm)
    t.frames["components"] = K.components(t.units, t.decorators, t.call_sites, applied)


def _flows(t: Tables, limits: dict[str, int]) -> None:
    """Flows within the limits, their nodes with targets, whole edges, and links between flows (G-09)."""
    nodes = W.resolved_nodes(t.flow_nodes, t.references)
    kept = X.cut(W.flows(t.units, t.flow_nodes, limits["maxExecutionFlows"]))
    nodes = X.cut(W.capped_nodes(nodes, kept, limits["maxFlowNodes"]))
    t.frames["flows"] = kept.join(nodes.select("unit_id").distinct(), "unit_id", "left_semi")
    t.frames["flow_nodes"] = nodes
    t.frames["flow_edges"] = W.whole_edges(t.flow_edges, nodes)
    t.frames["flow_links"] = W.call_links(nodes, t.flow_edges, t.flows)


def _domains(t: Tables, refs: DataFrame, calls: DataFrame) -> None:
    """Contracts, capabilities, what they reach, domains, memberships, relations and features."""
    served = capability_entrypoints(t.entrypoints)
    routed = X.cut(served.select("id", "unit_id", F.col("file_path").alias("path"), "method", F.col("path").alias("route"), "framework", "kind", P.contract_identity(F.col("method"), F.col("path")).alias("contract"), P.capability_key(F.col("path")).alias("key")))
    t.frames["contracts"] = routed
    t.frames["capabilities"] = A.capabilities(routed, "key", {"entrypoints": "id", "contracts": "contract", "units": "unit_id"})
    # what is reached is kept by strongly connected parts: a cycle that n entrypoints reach gives n rows, not n times its size
    pairs, own = X.reach_parts(calls, "source_id", "target_id", t.entrypoints.select(F.col("unit_id").alias("source_id")))
    t.frames["parts"], t.frames["reached_parts"] = own, pairs
    t.frames["reachable"] = X.members(pairs, own, "target_id").select("source_id", "target_id")
    owners = routed.select("unit_id", P.bucket_key(F.col("path")).alias("bucket"))
    packets = owners.join(pairs.withColumnRenamed("source_id", "unit_id"), "unit_id").select("bucket", "part").distinct()
    sizes = owners.groupBy("bucket").agg(F.count("*").alias("packets"))
    status, level, score = A.bucket_confidence(F.col("packets"))
    t.frames["domains"] = sizes.select("bucket", "packets", status.alias("status"), level.alias("level"), score.alias("score"))
    scored = X.members(packets, own, "unit_id").select("bucket", "unit_id").join(t.domains.select("bucket", "score"), "bucket")
    t.frames["memberships"] = A.memberships(scored, "unit_id", "bucket", F.struct(-F.col("score"), F.col("bucket")), "score")
    t.frames["unassigned"] = J.unassigned(t.units.where("kind != 'file'").select(F.col("id").alias("unit_id"), "qualified_name"), t.memberships, "unit_id")
    spread = J.relation_edges(refs.where("target_id is not null").select("source_id", "target_id", "kind", "status", "id"), scored.select("unit_id", "bucket"), "source_id", "target_id", "unit_id", "bucket")
    t.frames["relations"] = A.aggregate_relations(spread, "status", F.col("id"), "kind")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    by_part = refs.join(own.withColumnRenamed("node", "source_id"), "source_id", "left").groupBy(F.coalesce("part", "source_id").alias("part")).agg(n(F.col("target_id").isNotNull()).alias("resolved"), n(F.col("target_id").isNull()).alias("unresolved"), n(F.col("status") == "dynamic").alias("dynamic"))
    size = own.groupBy("part").agg(F.count("*").alias("units"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    scope = pairs.join(by_part, "part", "left").join(size, "part", "left").withColumn("units", F.coalesce("units", F.lit(1)))
    t.frames["features"] = scope.groupBy(F.col("source_id").alias("root")).agg(total("resolved"), total("unresolved"), total("dynamic"), total("units"))


def capability_entrypoints(entrypoints: DataFrame) -> DataFrame:
    """Entrypoints that make capabilities and features (P-05)."""
    return entrypoints.where(F.col("kind").isin("http", "webSocket", "rpc", "job"))


def validated(t: Tables) -> DataFrame:
    """reference, missing: broken keys of an analysis; all zero (V-01, V-02)."""
    keys = V.primary_keys([(n, t.frames[n], k) for n, k in (("files", "file_id"), ("units", "id"), ("references", "id"), ("entrypoints", "id"), ("flows", "unit_id"))])
    ids = t.units
    checks = [("references.source_id", t.references, "source_id", ids, "id"), ("references.target_id", t.references, "target_id", ids, "id"), ("entrypoints.unit_id", t.entrypoints, "unit_id", ids, "id"), ("flow_edges.source_id", t.flow_edges, "source_id", t.flow_nodes, "id"), ("flow_edges.target_id", t.flow_edges, "target_id", t.flow_nodes, "id"), ("flow_links.target_unit_id", t.flow_links, "target_unit_id", t.flows, "unit_id")]
    return keys.select(F.col("name").alias("reference"), F.col("repeated").alias("missing")).unionByName(V.foreign_keys(checks))


def language_column() -> F.Column:
    """Language of a path by its ending."""
    end = F.lower(F.substring_index("path", ".", -1))
    known = F.create_map(*[F.lit(x) for lang, ends in E.ENDINGS.items() for e in ends for x in (e, lang)])
    return F.coalesce(F.try_element_at(known, end), F.lit("unknown")).alias("language")
