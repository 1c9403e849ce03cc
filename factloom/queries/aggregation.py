"""Queries for aggregates, similarities, gates and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import aggregates as A
from ..operators import gates as G
from ..operators import joins as J
from ..operators import similar
from ..plans import overview
from ..plans.lens import Lens, with_views
from .registry import query
from .scalar import _KEY, bucket_sql, contract_ctes

_RANK = "CASE status WHEN 'confirmed' THEN 1 WHEN 'candidate' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END"


@query(
    with_views(
        "refs",
        f"""SELECT supplier, target, kind, count(*) AS weight, ['confirmed', 'candidate', 'unknown', 'dynamic'][max({_RANK})] AS status, list_sort(list(DISTINCT source))[1:24] AS evidence FROM refs GROUP BY supplier, target, kind""",
    )
)
def edge_aggregate(lens: Lens) -> DataFrame:
    """A-01, T-03."""
    return A.aggregate_edges(lens.refs(), "supplier", "target", "kind", "status", "source")


@query(with_views("refs", "SELECT kind, " + ", ".join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s}" for s in A.STATUSES) + " FROM refs GROUP BY kind"))
def status_counts(lens: Lens) -> DataFrame:
    """A-04, P-07, P-08."""
    return A.status_counts(lens.refs(), "kind", "status")


@query(with_views("refs", "SELECT s.s_nationkey AS source_group, p.p_size AS target_group, kind, count(*) AS weight, arg_min(status, source * 10 + line) AS status FROM refs r JOIN supplier s ON r.supplier = s.s_suppkey JOIN part p ON r.target = p.p_partkey WHERE s.s_nationkey <> p.p_size GROUP BY 1, 2, 3"))
def relation_aggregate(lens: Lens) -> DataFrame:
    """A-03: weight and the status that comes first."""
    rows = lens.refs().join(lens.table("supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("source_group")), "supplier")
    rows = rows.join(lens.table("part").select(F.col("p_partkey").alias("target"), F.col("p_size").alias("target_group")), "target").where("source_group != target_group")
    return A.aggregate_relations(rows, "status", F.col("source") * 10 + F.col("line"), "kind")


@query(with_views("files", "SELECT language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ROLLUP (language)"))
def project_summary(lens: Lens) -> DataFrame:
    """A-02."""
    return A.project_summary(lens.files(), "language", "size")


@query(with_views("files", """, l AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q FROM labels GROUP BY doc_id)
    SELECT language, count(*) AS detected, count(l.n) AS covered, CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS facts, CAST(sum(coalesce(l.q, 0)) AS BIGINT) AS flagged FROM files LEFT JOIN l USING (doc_id) GROUP BY language"""))
def coverage(lens: Lens) -> DataFrame:
    """A-05."""
    return A.coverage(lens.files(), lens.table("labels"), "doc_id", "language", "quality")


@query("WITH " + contract_ctes("pages", "page_id", "url") + f", k AS (SELECT page_id, path, {_KEY} AS key FROM contract) SELECT key, list_sort(list(DISTINCT page_id)) AS entrypoints, list_sort(list(DISTINCT path)) AS paths FROM k WHERE key IS NOT NULL GROUP BY key")
def capability_build(lens: Lens) -> DataFrame:
    """A-06, C-13."""
    rows = lens.table("pages").select("page_id", P.contract_path(F.col("url")).alias("path"), P.capability_key(F.col("url")).alias("key"))
    return A.capabilities(rows, "key", {"entrypoints": "page_id", "paths": "path"})


@query("SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def home_vote(lens: Lens) -> DataFrame:
    """A-07."""
    return A.most_frequent(lens.table("events"), "user_id", "event_type")


@query("SELECT o_custkey, o_orderpriority, votes FROM (SELECT o_custkey, o_orderpriority, count(*) AS votes, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority DESC) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1")
def key_vote(lens: Lens) -> DataFrame:
    """A-20."""
    return A.most_frequent(lens.table("orders"), "o_custkey", "o_orderpriority", smallest=False)


@query("""WITH k AS (SELECT o_custkey AS unit, CASE o_orderkey % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'orders/' || o_orderstatus ELSE o_orderpriority END AS key FROM orders)
    SELECT unit, key FROM (SELECT unit, key, row_number() OVER (PARTITION BY unit ORDER BY len(string_split(key, '/')) DESC, key = 'list', key) AS rn FROM k) WHERE rn = 1""")
def best_key(lens: Lens) -> DataFrame:
    """A-08, P-10."""
    k = F.col("o_orderkey") % 3
    rows = lens.table("orders").select(F.col("o_custkey").alias("unit"), F.when(k == 0, "list").when(k == 1, F.concat(F.lit("orders/"), "o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("key"))
    return A.best_key(rows, "unit", "key", F.col("key") == "list")


_TFIDF = """, tf AS (SELECT doc, term, count(*) AS n FROM terms GROUP BY doc, term), top AS (SELECT doc, max(n) AS top FROM tf GROUP BY doc),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT tf.doc, tf.term, n / CAST(top AS DOUBLE) * ln(((SELECT count(*) FROM top) + 1) / CAST(df + 1 AS DOUBLE)) AS weight FROM tf JOIN top USING (doc) JOIN df USING (term))"""


@query(with_views("terms", _TFIDF + " SELECT doc, term, round(weight, 6) AS weight FROM w"))
def tfidf(lens: Lens) -> DataFrame:
    """A-09."""
    return A.tf_idf(lens.terms(), "doc", "term").select("doc", "term", F.round("weight", 6).alias("weight"))


_COSINE = """, nz AS (SELECT * FROM w WHERE weight <> 0), norm AS (SELECT doc, sqrt(sum(weight * weight)) AS n FROM nz GROUP BY doc),
    lex AS (SELECT a.doc AS left_key, b.doc AS right_key, sum(a.weight * b.weight) AS dot FROM nz a JOIN nz b ON a.term = b.term AND a.doc < b.doc GROUP BY 1, 2),
    cosine AS (SELECT left_key, right_key, least(greatest(dot / (x.n * y.n), 0), 1) AS lexical FROM lex JOIN norm x ON x.doc = left_key JOIN norm y ON y.doc = right_key)"""


def _lexical(lens: Lens) -> DataFrame:
    # a part name is one of few words, so a brand's vocabulary is small; names tell documents apart by size class
    rows = lens.table("part").select(F.concat_ws("/", "p_brand", (F.col("p_size") % 4).cast("string")).alias("doc"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("term"))
    return A.cosine_pairs(A.tf_idf(rows, "doc", "term"), "doc", "term")


_LEX = "WITH terms AS (SELECT p_brand || '/' || (p_size % 4) AS doc, unnest(string_split(p_name || ' ' || p_type, ' ')) AS term FROM part)" + _TFIDF + _COSINE


@query(_LEX + " SELECT left_key, right_key, round(lexical, 6) AS lexical FROM cosine")
def tfidf_cosine(lens: Lens) -> DataFrame:
    """A-10, J-18: all pairs of brand classes that share a term."""
    return _lexical(lens).select("left_key", "right_key", F.round("lexical", 6).alias("lexical"))


_JACCARD = """, own AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS item FROM lineitem), size AS (SELECT k, count(*) AS n FROM own GROUP BY k),
    resource AS (SELECT left_key, right_key, c / CAST(x.n + y.n - c AS DOUBLE) AS resource FROM (SELECT a.k AS left_key, b.k AS right_key, count(*) AS c FROM own a JOIN own b ON a.item = b.item AND a.k < b.k GROUP BY 1, 2)
        JOIN size x ON x.k = left_key JOIN size y ON y.k = right_key)"""


@query("WITH" + _JACCARD[1:] + " SELECT left_key, right_key, round(resource, 6) AS resource FROM resource")
def jaccard_pairs(lens: Lens) -> DataFrame:
    """A-13, J-18: suppliers that share parts."""
    return A.jaccard_pairs(lens.table("lineitem"), "l_suppkey", "l_partkey").select("left_key", "right_key", F.round("resource", 6).alias("resource"))


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_PATHS = "WITH " + contract_ctes("pages", "page_id, url", "url") + f", h AS (SELECT DISTINCT right({_HOST}, 12) AS host, path FROM contract WHERE path IS NOT NULL)"
_PATH_PAIRS = """, pp AS (SELECT a.host AS left_key, b.host AS right_key, a.path AS l, b.path AS r FROM h a JOIN h b ON a.host < b.host),
    sim AS (SELECT left_key, right_key, avg((CASE WHEN l = r THEN len(string_split(l, '/')) WHEN string_split(l, '/')[2] = string_split(r, '/')[2] THEN 2 + CASE WHEN string_split(l, '/')[3] = string_split(r, '/')[3] THEN 1 ELSE 0 END ELSE 1 END)
        / CAST(greatest(len(string_split(l, '/')), len(string_split(r, '/'))) AS DOUBLE)) AS path,
        avg(CASE WHEN l = r OR starts_with(l, r || '/') OR starts_with(r, l || '/') THEN 1.0 ELSE 0.0 END) AS http FROM pp GROUP BY 1, 2)"""


def _path_pairs(lens: Lens) -> DataFrame:
    """Similarities of the paths of host classes."""
    host = F.right(F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.lit(12))
    h = lens.table("pages").select(host.alias("host"), P.contract_path(F.col("url")).alias("path")).where("path is not null").distinct()
    return A.path_pairs(h, "host", "path")


@query("""WITH s AS (SELECT DISTINCT o_custkey AS key, strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS item FROM orders), n AS (SELECT key, count(*) AS n FROM s GROUP BY 1),
    b AS (SELECT x.key AS left_key, y.key AS right_key, count(*) AS shared FROM s x JOIN s y ON x.item = y.item AND x.key < y.key GROUP BY 1, 2)
    SELECT left_key, right_key, round(shared / CAST(l.n + r.n - shared AS DOUBLE), 6) AS resource FROM b JOIN n l ON l.key = left_key JOIN n r ON r.key = right_key WHERE shared * 5 >= (l.n + r.n - shared) * 2""")
def similar_pairs(lens: Lens) -> DataFrame:
    """A-13, J-18: customers whose months of orders have a Jaccard similarity of 0.4 or more."""
    sets = lens.table("orders").select(F.col("o_custkey").alias("key"), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM").alias("item"))
    return similar.similar_pairs(sets, "key", "item", 0.4).select("left_key", "right_key", F.round("resource", 6).alias("resource"))


@query(_PATHS + _PATH_PAIRS + " SELECT left_key, right_key, round(path, 6) AS path FROM sim")
def path_similarity(lens: Lens) -> DataFrame:
    """A-14, F-09: mean common prefix of the paths of two host classes."""
    return _path_pairs(lens).select("left_key", "right_key", F.round("path", 6).alias("path"))


@query(_PATHS + _PATH_PAIRS + " SELECT left_key, right_key, round(http, 6) AS http FROM sim")
def http_similarity(lens: Lens) -> DataFrame:
    """A-15, J-14: share of path pairs that match."""
    return _path_pairs(lens).select("left_key", "right_key", F.round("http", 6).alias("http"))


_SIGNALS = """, pairs AS (SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key, coalesce(r.resource, 0) AS resource, ((a.s_suppkey * 7 + b.s_suppkey * 3) % 10) / 10.0 AS http, ((a.s_suppkey + b.s_suppkey) % 5) / 20.0 AS call, ((a.s_suppkey * b.s_suppkey) % 7) / 30.0 AS flow
    FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey LEFT JOIN resource r ON r.left_key = a.s_suppkey AND r.right_key = b.s_suppkey)"""


def _signal_pairs(lens: Lens) -> DataFrame:
    s = lens.table("supplier")
    a, b = s.select(F.col("s_suppkey").alias("left_key"), "s_nationkey"), s.select(F.col("s_suppkey").alias("right_key"), "s_nationkey")
    both = a.join(b, "s_nationkey").where("left_key < right_key").join(A.jaccard_pairs(lens.table("lineitem"), "l_suppkey", "l_partkey"), ["left_key", "right_key"], "left")
    x, y = F.col("left_key"), F.col("right_key")
    return both.select("left_key", "right_key", F.coalesce("resource", F.lit(0.0)).alias("resource"), (((x * 7 + y * 3) % 10) / 10.0).alias("http"), (((x + y) % 5) / 20.0).alias("call"), (((x * y) % 7) / 30.0).alias("flow"))


_WEIGHTS = {"http": 0.40, "call": 0.15, "flow": 0.15, "resource": 0.10}


@query("WITH" + _JACCARD[1:] + _SIGNALS + " SELECT left_key, right_key, round((0.4 * http + 0.15 * call + 0.15 * flow + 0.1 * resource) / 0.8, 6) AS combined FROM pairs")
def pair_combined(lens: Lens) -> DataFrame:
    """A-16."""
    return _signal_pairs(lens).select("left_key", "right_key", F.round(A.combine({k: F.col(k) for k in _WEIGHTS}, _WEIGHTS), 6).alias("combined"))


_GATE = """CASE WHEN n = 0 OR (n = 1 AND s[1] = 'call') THEN NULL WHEN http >= 0.6 AND resource >= 0.2 THEN 'http+resource' WHEN resource >= 0.45 THEN 'resource-strong'
    WHEN http >= 0.6 THEN 'http-strong' WHEN n >= 2 THEN s[1] || '+' || s[2] END"""
_GATED = f""", sig AS (SELECT *, list_filter([CASE WHEN http >= 0.2 THEN 'http' END, CASE WHEN call >= 0.12 THEN 'call' END, CASE WHEN flow >= 0.12 THEN 'flow' END, CASE WHEN resource >= 0.2 THEN 'resource' END], lambda v: v IS NOT NULL) AS s FROM pairs),
    gated AS (SELECT *, {_GATE} AS gate FROM (SELECT *, len(s) AS n FROM sig))"""


@query("WITH" + _JACCARD[1:] + _SIGNALS + _GATED + " SELECT left_key, right_key, CASE WHEN http > 0 THEN 'http' WHEN call > 0 THEN 'call' WHEN flow > 0 THEN 'flow' END AS legacy, gate AS structural FROM gated")
def merge_gates(lens: Lens) -> DataFrame:
    """C-04."""
    h, c, f, r = (F.col(x) for x in ("http", "call", "flow", "resource"))
    return _signal_pairs(lens).select("left_key", "right_key", G.legacy_gate(h, c, f).alias("legacy"), G.structural_gate(h, c, f, r).alias("structural"))


@query(
    "WITH" + _JACCARD[1:] + _SIGNALS + _GATED
    + """ SELECT reason, count(*) AS pairs FROM (SELECT CASE WHEN left_key % 4 = 0 AND right_key % 4 <> 0 OR left_key % 4 <> 0 AND right_key % 4 = 0 THEN 'test-production' WHEN gate IS NULL THEN 'no-signal'
    WHEN round((0.4 * http + 0.15 * call + 0.15 * flow + 0.1 * resource) / 0.8, 9) < 0.3 THEN 'below-threshold' END AS reason FROM gated) WHERE reason IS NOT NULL GROUP BY reason"""
)
def pair_rejections(lens: Lens) -> DataFrame:
    """C-05, A-28."""
    h, c, f, r = (F.col(x) for x in ("http", "call", "flow", "resource"))
    combined = F.round(A.combine({k: F.col(k) for k in _WEIGHTS}, _WEIGHTS), 9)
    why = G.rejection(F.col("left_key") % 4 == 0, F.col("right_key") % 4 == 0, F.lit(True), G.structural_gate(h, c, f, r), combined, 0.3, False)
    return _signal_pairs(lens).select(why.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("pairs"))


@query(with_views("sold trade", "SELECT least(nation, partner) AS left_key, greatest(nation, partner) AS right_key, count(*) AS n FROM trade GROUP BY 1, 2"))
def call_counts(lens: Lens) -> DataFrame:
    """A-11."""
    return A.pair_counts(lens.trade(), "nation", "partner")


@query(with_views("turns", "SELECT role, next, n, round(n / (n + 2.0), 6) AS similarity FROM (SELECT role, next, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY flow ORDER BY node) AS next FROM turns) WHERE next IS NOT NULL GROUP BY 1, 2)"))
def flow_counts(lens: Lens) -> DataFrame:
    """A-12: links between successive nodes, with their similarity."""
    rows = lens.turns().withColumn("next", F.lead("role").over(Window.partitionBy("flow").orderBy("node"))).where("next is not null")
    out = rows.groupBy("role", "next").agg(F.count("*").alias("n"))
    return out.withColumn("similarity", F.round(F.col("n") / (F.col("n") + 2.0), 6))


_SIM = "WITH" + _JACCARD[1:] + ", m AS (SELECT s_suppkey AS item, s_nationkey AS cluster FROM supplier)"


@query(
    _SIM
    + """, b AS (SELECT x.cluster AS cx, y.cluster AS cy, resource FROM resource JOIN m x ON x.item = left_key JOIN m y ON y.item = right_key),
    q AS (SELECT cluster, count(*) AS members, coalesce((SELECT avg(resource) FROM b WHERE cx = cluster AND cy = cluster), 0) AS cohesion,
        coalesce((SELECT 1 - max(resource) FROM b WHERE cx <> cy AND (cx = cluster OR cy = cluster)), 1) AS separation FROM m GROUP BY cluster),
    o AS (SELECT *, 0.4 * cohesion + 0.3 * separation + 0.3 * 0.6 AS overall FROM q)
    SELECT cluster, members, round(cohesion, 6) AS cohesion, round(separation, 6) AS separation, CASE WHEN members >= 2 AND overall >= 0.6 AND separation >= 0.3 THEN 'confirmed' WHEN overall >= 0.3 THEN 'candidate' WHEN overall > 0 THEN 'ambiguous' ELSE 'unknown' END AS status,
        CAST(round(overall * 100) AS INTEGER) AS score FROM o"""
)
def cluster_quality(lens: Lens) -> DataFrame:
    """A-17, A-18."""
    pairs = A.jaccard_pairs(lens.table("lineitem"), "l_suppkey", "l_partkey")
    q = A.cluster_quality(pairs, lens.table("supplier").select(F.col("s_suppkey").alias("item"), F.col("s_nationkey").alias("cluster")), "item", "cluster", "resource")
    _, status, _, score = A.cluster_confidence(F.col("members"), F.col("cohesion"), F.col("separation"), F.lit(0.6))
    return q.select("cluster", "members", F.round("cohesion", 6).alias("cohesion"), F.round("separation", 6).alias("separation"), status.alias("status"), score.alias("score"))


_BUCKET_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query(
    "WITH " + contract_ctes("pages", "page_id, url", "url")
    + f""", b AS (SELECT {bucket_sql(_BUCKET_PATH)} AS bucket, path FROM contract)
    SELECT bucket, count(*) AS packets, list_sort(list(DISTINCT path)) AS contracts, CASE WHEN count(*) >= 3 THEN 'confirmed' ELSE 'candidate' END AS status,
        CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS level, CASE WHEN count(*) >= 3 THEN 80 WHEN count(*) = 2 THEN 55 ELSE 35 END AS score FROM b GROUP BY bucket"""
)
def bucket_confidence(lens: Lens) -> DataFrame:
    """C-01, A-19, F-07, P-17: path buckets with their contracts, status and score."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    rows = lens.table("pages").select(P.bucket_key(path).alias("bucket"), P.contract_path(F.col("url")).alias("path"))
    sets = rows.groupBy("bucket").agg(F.count("*").alias("packets"), F.array_sort(F.collect_set("path")).alias("contracts"))
    status, level, score = A.bucket_confidence(F.col("packets"))
    return sets.select("bucket", "packets", "contracts", status.alias("status"), level.alias("level"), score.alias("score"))


@query(with_views("members", """SELECT unit, arg_min(domain, domain) AS domain_id, list_sort(list(DISTINCT domain)) AS domain_ids, CAST(max(amount) AS BIGINT) AS score, CASE WHEN count(DISTINCT domain) > 1 THEN 'shared' ELSE 'primary' END AS kind FROM members GROUP BY unit"""))
def memberships(lens: Lens) -> DataFrame:
    """A-21."""
    return A.memberships(lens.members(), "unit", "domain", F.col("domain"), "amount")


@query(
    with_views(
        "refs",
        """, e AS (SELECT s_nationkey AS domain, sum(CASE WHEN status = 'confirmed' THEN 1 ELSE 0 END) AS confirmed, count(*) AS touching FROM refs JOIN supplier ON supplier = s_suppkey GROUP BY 1)
    SELECT domain, CAST(round(400 * CASE domain % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.6 ELSE 1.0 END + 300 * (confirmed / CAST(touching AS DOUBLE)) + 200 * 0.5 + 100 * 0.8) AS BIGINT) AS signal FROM e""",
    )
)
def domain_signal(lens: Lens) -> DataFrame:
    """A-23."""
    rows = lens.refs().join(lens.table("supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("domain")), "supplier")
    e = rows.groupBy("domain").agg(F.sum(F.when(F.col("status") == "confirmed", 1).otherwise(0)).alias("confirmed"), F.count("*").alias("touching"))
    k = F.col("domain") % 3
    return e.select("domain", A.domain_signal(F.when(k == 0, 0.0).when(k == 1, 0.6).otherwise(1.0), F.col("confirmed"), F.col("touching"), F.lit(0.5), F.lit(0.8)).alias("signal"))


@query(with_views("members", """, s AS (SELECT domain, list(DISTINCT unit) AS u FROM members GROUP BY domain)
    SELECT a.domain AS left_key, b.domain AS right_key, CAST(floor(100 * len(list_intersect(a.u, b.u)) / least(len(a.u), len(b.u))) AS INTEGER) AS percent FROM s a JOIN s b ON a.domain < b.domain WHERE len(list_intersect(a.u, b.u)) > 0"""))
def overlap(lens: Lens) -> DataFrame:
    """A-24 of nations that share units: each unit's pairs are counted, no two sets are compared."""
    m = lens.members().select("unit", "domain")
    size = m.groupBy("domain").agg(F.count("*").alias("n"))
    met = m.select("unit", F.col("domain").alias("left_key")).join(m.select("unit", F.col("domain").alias("right_key")), "unit").where("left_key < right_key").groupBy("left_key", "right_key").agg(F.count("*").alias("both"))
    for s in ("left", "right"):
        met = met.join(size.select(F.col("domain").alias(f"{s}_key"), F.col("n").alias(f"n_{s}")), f"{s}_key")
    return met.select("left_key", "right_key", F.floor(100 * F.col("both") / F.least("n_left", "n_right")).cast("int").alias("percent"))


@query("SELECT round(count(*) FILTER (quality = 1) / CAST(count(*) AS DOUBLE), 6) AS good, round(count(*) FILTER (toxic = 1) / CAST(count(*) AS DOUBLE), 6) AS toxic, count(DISTINCT doc_id) AS documents, count(*) AS labels FROM labels")
def project_profile(lens: Lens) -> DataFrame:
    """A-25, A-26."""
    labels = lens.table("labels").select("doc_id", F.lit(1).alias("all"), F.when(F.col("quality") == 1, 1).otherwise(0).alias("good"), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"))
    ratios = overview.project_profile(labels, "all", ["good", "toxic"]).select(F.round("good", 6).alias("good"), F.round("toxic", 6).alias("toxic"))
    return ratios.crossJoin(overview.global_summary(labels, "doc_id", "all").select(F.col("units").alias("documents"), F.col("memberships").alias("labels")))  # one row each


@query(with_views("refs", """SELECT s_nationkey AS candidate, CAST(sum(CASE status WHEN 'confirmed' THEN 3 WHEN 'candidate' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM refs JOIN supplier ON supplier = s_suppkey WHERE target IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY 1"""))
def connection_weight(lens: Lens) -> DataFrame:
    """A-27: status weights of the edges into a partition, by candidate."""
    inside = lens.table("part").where("p_size < 5").select(F.col("p_partkey").alias("target"))
    supplier = lens.table("supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("candidate"))
    rows = lens.refs().join(inside, "target", "left_semi").groupBy("supplier", "status").agg(F.count("*").alias("n"))
    return overview.connection_weight(rows.join(supplier, "supplier"), "candidate", "status", "n").withColumnRenamed("connection", "weight")
