"""Queries for ordered and ranked operators: representatives, successors, budgets, parts, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import aggregates as A
from ..operators import budget as B
from ..operators import flow as W
from ..operators import gates as G
from ..plans import overview
from ..plans.lens import Lens, with_views
from .aggregation import _LEX, _lexical
from .registry import query
from .scalar import bucket_sql, contract_ctes


@query(with_views("l_pages", "," + contract_ctes("l_pages", "page_id, method", "url") + " SELECT path, page_id FROM (SELECT path, page_id, row_number() OVER (PARTITION BY path ORDER BY page_id % 3 = 0 DESC, method IS NOT NULL DESC, page_id) AS rn FROM contract WHERE path IS NOT NULL) WHERE rn = 1"))
def representative(lens: Lens) -> DataFrame:
    """W-01: production first, then with a method, then the smallest id."""
    rows = lens.pages().select(P.contract_path(F.col("url")).alias("path"), "page_id", "method").where("path is not null")
    order = [F.when(F.col("page_id") % 3 == 0, 0).otherwise(1), F.when(F.col("method").isNotNull(), 0).otherwise(1), F.col("page_id")]
    return A.first_of_group(rows, ["path"], order).select("path", "page_id")


@query(with_views("members", "SELECT unit, domain FROM (SELECT unit, domain, row_number() OVER (PARTITION BY unit ORDER BY amount DESC, domain) AS rn FROM members) WHERE rn = 1"))
def primary_domain(lens: Lens) -> DataFrame:
    """W-11: the domain of the highest score, the smallest of equals."""
    return A.first_of_group(lens.members(), ["unit"], [-F.col("amount"), F.col("domain")]).select("unit", "domain")


@query(_LEX.split(", nz AS")[0] + " SELECT doc, term, rank FROM (SELECT doc, term, row_number() OVER (PARTITION BY doc ORDER BY round(weight, 9) DESC, term) AS rank FROM w) WHERE rank <= 3")
def top_terms(lens: Lens) -> DataFrame:
    """W-09, W-10: the heaviest terms of each document (a top-k)."""
    rows = lens.table("part").select(F.concat_ws("/", "p_brand", (F.col("p_size") % 4).cast("string")).alias("doc"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("term"))
    return A.top_per_group(A.tf_idf(rows, "doc", "term"), ["doc"], [F.round("weight", 9).desc(), F.col("term")], 3).select("doc", "term", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next FROM events")
def next_in_region(lens: Lens) -> DataFrame:
    """W-03."""
    return W.next_in_region(lens.table("events"), "event_id", ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "next")


@query("SELECT a.event_id, min(b.event_id) AS follower FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.event_id > a.event_id WHERE a.event_type = 'click' GROUP BY a.event_id")
def first_after(lens: Lens) -> DataFrame:
    """W-04: the first event of one kind after an event of another, by one window over both."""
    return W.first_after(lens.table("events"), "user_id", "event_id", F.col("event_type") == "click", F.col("event_type") == "purchase")


@query(with_views("turns", "SELECT flow, node, lead(node) OVER (PARTITION BY flow ORDER BY node) AS successor FROM turns"))
def successor(lens: Lens) -> DataFrame:
    """W-12, J-09: the node after each node of a flow."""
    return W.next_in_region(lens.turns().select("flow", "node"), "node", ["flow"], ["node"]).withColumnRenamed("next", "successor")


@query(with_views("turns", """, f AS (SELECT flow, count(*) AS n FROM turns GROUP BY flow), b AS (SELECT flow, n, coalesce(sum(n) OVER (ORDER BY flow ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
    r AS (SELECT flow, node, row_number() OVER (PARTITION BY flow ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, node) AS rn FROM turns)
    SELECT flow, node FROM r JOIN b USING (flow) WHERE rn <= 300 - before"""))
def node_budget(lens: Lens) -> DataFrame:
    """W-06: a running budget over flows in order; in the flow that crosses it nodes stay by priority."""
    priority = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return B.running_budget(lens.turns(), "flow", [priority, F.col("node")], 300).select("flow", "node")


@query(with_views("refs", "SELECT supplier, list_sort(list(DISTINCT target))[1:24] AS evidence FROM refs GROUP BY supplier"))
def capped_evidence(lens: Lens) -> DataFrame:
    """T-03: the first pieces of evidence, sorted, without repeats."""
    return lens.refs().groupBy("supplier").agg(F.slice(F.array_sort(F.collect_set("target")), 1, 24).alias("evidence"))


@query(f"WITH b AS (SELECT {bucket_sql("regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')")} AS bucket, page_id FROM pages) SELECT bucket, page_id FROM (SELECT bucket, page_id, row_number() OVER (PARTITION BY bucket ORDER BY page_id) AS rn FROM b) WHERE rn <= 12")
def packet_cap(lens: Lens) -> DataFrame:
    """T-04: at most twelve packets a bucket (a top-k)."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return A.top_per_group(lens.pages().select(P.bucket_key(path).alias("bucket"), "page_id"), ["bucket"], [F.col("page_id")], 12).select("bucket", "page_id")


@query(_LEX + " SELECT left_key, right_key, round(lexical, 6) AS lexical FROM cosine ORDER BY round(lexical, 6) DESC, left_key, right_key LIMIT 20")
def topk_pairs(lens: Lens) -> DataFrame:
    """T-06: the most similar pairs (a top-k)."""
    return _lexical(lens).select("left_key", "right_key", F.round("lexical", 6).alias("lexical")).orderBy(F.desc("lexical"), "left_key", "right_key").limit(20)


@query(with_views("files", """, o AS (SELECT path, size, row_number() OVER (PARTITION BY source ORDER BY path) AS rn, source FROM files),
    w AS (SELECT source, path, rn, size, 1 AS part, size AS used FROM o WHERE rn = 1
        UNION ALL SELECT o.source, o.path, o.rn, o.size, CASE WHEN w.used + o.size > 20000 THEN w.part + 1 ELSE w.part END, CASE WHEN w.used + o.size > 20000 THEN o.size ELSE w.used + o.size END FROM w JOIN o ON o.source = w.source AND o.rn = w.rn + 1)
    SELECT path, part FROM w""", recursive=True))
def part_split(lens: Lens) -> DataFrame:
    """W-05, S-12: rows of each source into parts of a byte target; a row that is larger has a part of its own."""
    return B.split_parts(lens.files().select("source", "path", "size"), "source", "path", "size", 20000).select("path", "part")


@query(with_views("turns", "SELECT flow, string_agg(role, '>' ORDER BY node) AS steps FROM (SELECT flow, node, role, row_number() OVER (PARTITION BY flow, role ORDER BY node) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY node) AS place FROM turns WHERE role <> '') WHERE place <= 6) WHERE rn = 1 GROUP BY flow"))
def meaningful_steps(lens: Lens) -> DataFrame:
    """T-09: the first steps of a flow, each label once, in order."""
    rows = overview.meaningful_steps(lens.turns(), "flow", "node", "role", 6)
    return rows.groupBy("flow").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "role"))), lambda s: s["role"]), ">").alias("steps"))


@query(with_views("members", "SELECT unit, domain, CASE WHEN amount > 5000000 THEN 100 WHEN amount > 1000000 THEN 60 ELSE 40 END + least(amount // 100000, 100) AS priority FROM members"))
def feature_priority(lens: Lens) -> DataFrame:
    """T-07."""
    a = F.col("amount")
    return lens.members().select("unit", "domain", overview.feature_priority(F.floor(a / 100000), (a > 5000000).cast("int"), (a > 1000000).cast("int")).alias("priority"))


@query()
def bucket_cap(lens: Lens) -> DataFrame:
    """C-02: buckets of the files, at most eight left. The fold is sequential, so there is no SQL."""
    rows = lens.files().groupBy(P.bucket_key(F.col("path")).alias("bucket")).agg(F.count("*").alias("n"))
    few = rows.limit(100_001).collect()  # directories, at most two deep
    if len(few) > 100_000:
        raise ValueError("more directories than the fold on the driver is meant for")
    goes = G.cap_buckets(dict(few), 8)
    return lens.spark.createDataFrame(sorted(goes.items()), "bucket string, goes string").join(rows, "bucket").groupBy("goes").agg(F.sum("n").alias("files"))


@query()
def clustering(lens: Lens) -> DataFrame:
    """C-03, C-06: suppliers of each nation clustered by shared parts, one matrix a nation."""
    s = lens.table("supplier").select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("nation"))
    pairs = A.jaccard_pairs(lens.table("lineitem"), "l_suppkey", "l_partkey")
    pairs = pairs.join(s.select(F.col("item").alias("left_key"), "nation"), "left_key").join(s.select(F.col("item").alias("right_key"), F.col("nation").alias("other")), "right_key").where("nation = other")
    pairs = pairs.select("nation", "left_key", "right_key", F.col("resource").alias("combined"), (F.col("resource") > 0).alias("allowed"), F.lit(False).alias("forbidden"))
    return G.cluster_partitions(pairs, s, "nation", 0.05, 8)


@query(with_views("files", """, c AS (SELECT source, doc_id AS id, size, size > 20000 AS required, doc_id % 100 AS priority FROM files),
    o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY required DESC, floor(priority * 1000000 / greatest(size, 1)) DESC, priority DESC, id) AS rn FROM c WHERE required OR size <= 60000),
    w AS (SELECT source, id, size, required, priority, rn, true AS taken, size AS used FROM o WHERE rn = 1
        UNION ALL SELECT o.source, o.id, o.size, o.required, o.priority, o.rn, o.required OR w.used + o.size <= 60000, w.used + CASE WHEN o.required OR w.used + o.size <= 60000 THEN o.size ELSE 0 END FROM w JOIN o ON o.source = w.source AND o.rn = w.rn + 1)
    SELECT source, id, size, required, priority FROM w WHERE taken""", recursive=True))
def budget_fill(lens: Lens) -> DataFrame:
    """B-03: the files of each source that fit a budget, best value first; large texts are required."""
    rows = lens.files().select("source", F.col("doc_id").alias("id"), "size", (F.col("size") > 20000).alias("required"), (F.col("doc_id") % 100).alias("priority"))
    return B.fill(rows, "source", 60_000)


@query()
def chunk_plan(lens: Lens) -> DataFrame:
    """B-01: nations into chunks by signal and trade."""
    domains = [(r[0], int(r[1]), int(r[2])) for r in lens.members().groupBy("domain").agg(F.count("*"), F.sum("amount")).orderBy("domain").collect()]  # nations
    links = {(r[0], r[1]): int(r[2]) for r in lens.trade_edges().collect()}
    plan = B.plan_chunks([(str(d), n, s) for d, n, s in domains], {(str(a), str(b)): w for (a, b), w in links.items()}, 4 * max([1, *(n for _, n, _ in domains)]))
    return lens.spark.createDataFrame([(i, d) for i, chunk in enumerate(plan) for d in chunk], "chunk int, domain string")
