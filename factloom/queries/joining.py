"""Queries for joins: resolution, contracts, spans, nearest, pruning, integrity, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import joins as J
from ..operators import rules, validate
from ..plans.lens import Lens, with_views
from .registry import query
from .scalar import contract_ctes

_EVENT_DAY = "date_diff('day', DATE '1990-01-01', CAST(ts AS DATE)) - 8000"


def _event_day() -> F.Column:
    return (F.datediff(F.col("ts").cast("date"), F.lit("1990-01-01").cast("date")) - 8000).cast("int")


@query(
    with_views(
        "units",
        """, r AS (SELECT DISTINCT o_orderkey AS ref, CASE o_orderkey % 4 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') WHEN 2 THEN 'n' || (o_custkey % 30) ELSE '#' || (o_custkey % 10) END AS name FROM orders),
    t AS (SELECT ref, 0 AS priority, unit AS target FROM r JOIN units ON r.name = units.unit
        UNION ALL SELECT ref, 1, unit FROM r JOIN units ON r.name = units.name
        UNION ALL SELECT ref, 2, unit FROM r JOIN units ON level = 2 AND r.name = '#' || right(units.name, 1)),
    s AS (SELECT ref, priority, list_sort(list(DISTINCT target)) AS targets FROM t GROUP BY ref, priority),
    b AS (SELECT ref, min(priority) AS priority FROM s GROUP BY ref)
    SELECT r.ref, b.priority, len(coalesce(s.targets, [])) AS n, s.targets[1] AS first, CASE WHEN b.ref IS NULL THEN 'unknown' WHEN len(s.targets) = 1 THEN 'confirmed' ELSE 'candidate' END AS status
    FROM r LEFT JOIN b ON r.ref = b.ref LEFT JOIN s ON s.ref = b.ref AND s.priority = b.priority""",
    )
)
def resolve_refs(lens: Lens) -> DataFrame:
    """J-01: names resolve by id, else by full name, else by their last character; the first rung that has any wins."""
    k = F.col("o_orderkey") % 4
    cust = F.col("o_custkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("c"), cust)).when(k == 1, F.concat(F.lit("Customer#"), F.lpad(cust, 9, "0"))).when(k == 2, F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string"))).otherwise(F.concat(F.lit("#"), (F.col("o_custkey") % 10).cast("string")))
    refs = lens.table("orders").select(F.col("o_orderkey").alias("ref"), name.alias("name"))
    units = lens.units()
    last = units.where("level = 2").select("unit", F.concat(F.lit("#"), F.substring("name", -1, 1)).alias("tail"))
    # names, not references, meet the units: equal names share one resolution
    names = refs.select("name").distinct()
    met = J.priority_join(names, [(F.col("name"), units, "unit"), (F.col("name"), units.withColumnRenamed("name", "full"), "full"), (F.col("name"), last, "tail")], "name", "unit")
    met = met.select("name", "priority", F.size("targets").cast("long").alias("n"), F.get("targets", F.lit(0)).alias("first"), "status")
    return refs.join(met, "name").drop("name")


@query("""WITH f AS (SELECT o_custkey || '::' || o_orderpriority || '::' || o_orderstatus || '::' || o_orderkey AS name FROM orders)
    SELECT suffix, count(*) AS n FROM (SELECT unnest([array_to_string(string_split(name, '::')[2:], '::'), array_to_string(string_split(name, '::')[3:], '::')]) AS suffix FROM f) GROUP BY suffix""")
def suffix_index(lens: Lens) -> DataFrame:
    """J-02: proper suffixes of qualified names."""
    name = F.concat_ws("::", F.col("o_custkey").cast("string"), "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string"))
    return lens.table("orders").select(F.explode(J.suffixes(name)).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderstatus, min(o_orderpriority) AS target FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) = 1")
def binding_join(lens: Lens) -> DataFrame:
    """J-03, J-27: bindings whose rows all agree."""
    return J.unique_binding(lens.table("orders").select("o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("target")), ["o_custkey", "o_orderstatus"], "target")


@query(
    with_views(
        "links",
        "," + contract_ctes("pages", "page_id", "url")
        + f""", s AS (SELECT DISTINCT path AS server FROM contract WHERE path IS NOT NULL),
    c AS (SELECT DISTINCT path || '/' || (page_id % 3) AS client FROM contract WHERE path IS NOT NULL UNION SELECT DISTINCT translate(href, '{P.UPPER}', '{P.LOWER}') FROM links WHERE regexp_full_match(href, '/[a-zA-Z]{{5,}}'))
    SELECT client, server FROM c JOIN s ON client = server OR starts_with(client, server || '/') OR starts_with(server, client || '/')""",
    )
)
def http_relations(lens: Lens) -> DataFrame:
    """J-14: client paths with server paths that are equal or one the other's prefix."""
    own = lens.table("pages").select("page_id", P.contract_path(F.col("url")).alias("path")).where("path is not null")
    server = own.select(F.col("path").alias("server")).distinct()
    made = own.select(F.concat("path", F.lit("/"), (F.col("page_id") % 3).cast("string")).alias("client"))
    linked = lens.links().where(F.col("href").rlike("^/[a-zA-Z]{5,}$")).select(P.fold(F.col("href")).alias("client"))
    return J.prefix_join(made.union(linked).distinct(), server, "client", "server")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_prune(lens: Lens) -> DataFrame:
    """J-10, P-11."""
    return J.keep_visible(lens.table("orders").select("o_orderkey", "o_custkey"), lens.table("customer").where("c_acctbal > 5000"), "o_custkey", "c_custkey")


@query(
    with_views(
        "refs",
        """SELECT source, CASE WHEN t.p_partkey IS NULL THEN NULL ELSE target END AS target, line, CASE WHEN t.p_partkey IS NULL AND status <> 'dynamic' THEN 'unknown' ELSE status END AS status
    FROM refs LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) t ON target = t.p_partkey WHERE source IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
    )
)
def anti_repair(lens: Lens) -> DataFrame:
    """J-11: edges of vanished owners go, edges to vanished targets are repaired."""
    owners = lens.table("orders").where("o_orderstatus != 'P'")
    edges = J.keep_visible(lens.refs().select("source", "target", "line", "status"), owners, "source", "o_orderkey")
    parts = lens.table("part").where("p_size > 10").select(F.col("p_partkey").alias("id"))
    return J.repair(edges, parts, "target", "id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unassigned_units(lens: Lens) -> DataFrame:
    """J-12."""
    members = lens.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.unassigned(lens.table("customer").select("c_custkey", "c_name"), members, "c_custkey")


@query(
    with_views(
        "spans",
        """, e AS (SELECT o_orderkey AS point, o_custkey AS owner, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 40 AS pos FROM orders)
    SELECT point, id FROM (SELECT point, id, row_number() OVER (PARTITION BY point ORDER BY start DESC, "end", id) AS rn
        FROM e JOIN spans USING (owner) WHERE pos BETWEEN start AND "end") WHERE rn = 1""",
    )
)
def stab_line(lens: Lens) -> DataFrame:
    """J-06: the latest-starting span that covers a point, up to forty days after each order; most points lie in one."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    points = lens.table("orders").select(F.col("o_orderkey").alias("point"), F.col("o_custkey").alias("owner"), (day + F.col("o_orderkey") % 40).alias("at"))
    return J.latest_stab(points, lens.spans(), ["owner"], "point", "at", "id", "start", "end", 64).select("point", "id")


@query(
    """WITH e AS (SELECT event_id, user_id, date_diff('day', DATE '1990-01-01', CAST(ts AS DATE)) - 8000 AS pos FROM events),
    o AS (SELECT o_custkey AS user_id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) - 2920 AS day, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
    SELECT event_id, day, o_orderkey FROM (SELECT e.event_id, o.day, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY o.day) AS rn FROM e LEFT JOIN o ON e.user_id = o.user_id AND o.day > e.pos) WHERE rn = 1"""
)
def asof_next(lens: Lens) -> DataFrame:
    """J-07: the next order of the same customer strictly after an event's day."""
    points = lens.table("events").select("event_id", "user_id", _event_day().alias("at"))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")) - 2920
    marks = lens.table("orders").select(F.col("o_custkey").alias("user_id"), day.alias("day"), "o_orderkey")
    return J.next_asof(points, marks, ["user_id"], "at", "day", "o_orderkey", width=64).select("event_id", F.col("day").cast("long").alias("day"), "o_orderkey")


@query(
    """WITH e AS (SELECT event_id, user_id, date_diff('day', DATE '1990-01-01', CAST(ts AS DATE)) - 8000 AS pos FROM events),
    o AS (SELECT o_custkey AS user_id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) - 2920 AS day, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
    SELECT event_id, o_orderkey FROM (SELECT e.event_id, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(o.day - e.pos), o.o_orderkey) AS rn FROM e LEFT JOIN o ON e.user_id = o.user_id) WHERE rn = 1"""
)
def nearest_evidence(lens: Lens) -> DataFrame:
    """J-22: the order of the same customer at the least distance in days."""
    points = lens.table("events").select("event_id", "user_id", _event_day().alias("at"))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")) - 2920
    marks = lens.table("orders").select(F.col("o_custkey").alias("user_id"), day.alias("day"), "o_orderkey")
    return J.nearest(points, marks, ["user_id"], "event_id", "at", "day", "o_orderkey", width=64).select("event_id", "o_orderkey")


@query(
    with_views(
        "spans",
        """SELECT inner_id, id AS outer_id FROM (SELECT a.id AS inner_id, b.id, row_number() OVER (PARTITION BY a.owner, a.id ORDER BY b."end" - b.start, b.id) AS rn
    FROM spans a JOIN spans b ON a.owner = b.owner AND b.start <= a.start AND a."end" <= b."end" AND NOT (a.start = b.start AND a."end" = b."end")) WHERE rn = 1""",
    )
)
def innermost_span(lens: Lens) -> DataFrame:
    """J-05, J-08: the smallest span of the same owner that holds another."""
    spans = lens.spans()
    return J.innermost(spans, spans, ["owner"], "inner_id", "outer_id").select("inner_id", "outer_id")


@query(with_views("refs members", "SELECT a.domain AS source_group, b.domain AS target_group, kind, count(*) AS weight FROM (SELECT supplier AS source, target, kind FROM refs WHERE status = 'confirmed') r JOIN (SELECT s_suppkey AS unit, s_nationkey AS domain FROM supplier) a ON r.source = a.unit JOIN members b ON r.target = b.unit WHERE a.domain <> b.domain GROUP BY 1, 2, 3"))
def relation_edges(lens: Lens) -> DataFrame:
    """J-13, A-03: edges between groups through the memberships of both ends."""
    edges = lens.refs().where("status = 'confirmed'").groupBy(F.col("supplier").alias("source"), "target", "kind").agg(F.count("*").alias("n"))
    sellers = lens.table("supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("source_group"))
    buyers = lens.members().select(F.col("unit").alias("target"), F.col("domain").alias("target_group"))
    # equal edges are summed first, and sources replaced by their one group, before targets multiply
    by_group = edges.join(sellers, "source").groupBy("source_group", "target", "kind").agg(F.sum("n").alias("n"))
    return by_group.join(buyers, "target").where("source_group != target_group").groupBy("source_group", "target_group", "kind").agg(F.sum("n").alias("weight"))


@query("""WITH i AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'n' ELSE 'm' END || (page_id % 40) AS target FROM pages),
    f AS (SELECT 'n' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.ts' END AS path FROM nation)
    SELECT page_id, target, path AS resolved FROM i JOIN f ON path IN (target || '.ts', target || '.js', target || '/index.ts')""")
def relative_module(lens: Lens) -> DataFrame:
    """J-20: the first existing candidate file of a relative import."""
    k = F.col("page_id")
    imports = lens.table("pages").select("page_id", F.concat(F.when(k % 2 == 0, "n").otherwise("m"), (k % 40).cast("string")).alias("target"))
    n = F.col("n_nationkey")
    files = lens.table("nation").select(F.concat(F.lit("n"), n.cast("string"), F.when(n % 3 == 0, ".ts").when(n % 3 == 1, ".js").otherwise("/index.ts")).alias("path"))
    return J.relative_module(imports, files, "target", "path", ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts"])


@query("""WITH d AS (SELECT o_orderkey AS file, o_orderstatus AS language, CASE WHEN o_orderstatus = 'P' THEN 'only' ELSE o_orderpriority END AS framework FROM orders WHERE o_orderpriority <> '5-LOW'),
    l AS (SELECT file, min(framework) AS f FROM d GROUP BY file), a AS (SELECT language, min(framework) AS f FROM d GROUP BY language HAVING count(DISTINCT framework) = 1)
    SELECT o_orderkey AS file, o_orderstatus AS language, coalesce(l.f, a.f) AS framework FROM orders LEFT JOIN l ON l.file = o_orderkey LEFT JOIN a ON a.language = o_orderstatus""")
def applicable_framework(lens: Lens) -> DataFrame:
    """J-21: evidence in the file decides, else the language's only detection."""
    orders = lens.table("orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderstatus").alias("language"), "o_orderpriority")
    found = orders.where("o_orderpriority != '5-LOW'").select("file", "language", F.when(F.col("language") == "P", "only").otherwise(F.col("o_orderpriority")).alias("framework"))
    return J.applicable(orders.select("file", "language"), found, "file", "language", "framework")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1 UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY 1")
def union_all(lens: Lens) -> DataFrame:
    """O-03, P-04: facts of one kind from several sources."""
    a = lens.table("orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return a.unionByName(lens.table("lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(lens: Lens) -> DataFrame:
    """O-01."""
    return lens.table("customer").select(F.col("c_nationkey").alias("k")).union(lens.table("supplier").select("s_nationkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_difference(lens: Lens) -> DataFrame:
    """O-05: missing ids."""
    return validate.missing_ids(lens.table("customer").select(F.col("c_custkey").alias("k")), lens.table("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT supplier, len(list_intersect(a, b)) > 0 AS meets FROM (SELECT l_suppkey AS supplier, list(DISTINCT l_returnflag) FILTER (l_linestatus = 'F') AS a, list(DISTINCT l_returnflag) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)")
def set_intersects(lens: Lens) -> DataFrame:
    """O-02."""
    line = lens.table("lineitem")
    own = lambda s: F.collect_set(F.when(F.col("l_linestatus") == s, F.col("l_returnflag")))
    return line.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.arrays_overlap(own("F"), own("O")).alias("meets"))


@query("""SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY recency DESC) AS rn FROM (SELECT c_custkey AS k, c_mktsegment AS v, 0 AS recency FROM customer UNION ALL SELECT c_custkey, 'RETRY', 1 FROM customer WHERE c_custkey % 3 = 0)) WHERE rn = 1""")
def upsert_by_id(lens: Lens) -> DataFrame:
    """O-04: later rows replace earlier ones of the same id."""
    old = lens.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return validate.upsert(old, old.where("k % 3 = 0").withColumn("v", F.lit("RETRY")), "k")


@query("""WITH g AS (SELECT o_custkey AS unit, o_orderpriority AS path, 'generic' AS origin FROM orders), s AS (SELECT o_custkey AS unit, o_orderpriority AS path, 'specific' AS origin FROM orders WHERE o_orderstatus = 'P')
    SELECT origin, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM g WHERE (unit, path) NOT IN (SELECT unit, path FROM s)) GROUP BY origin""")
def replace_generic(lens: Lens) -> DataFrame:
    """O-06."""
    orders = lens.table("orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("path"), "o_orderstatus")
    specific = orders.where("o_orderstatus = 'P'").select("unit", "path", F.lit("specific").alias("origin"))
    out = rules.replace_generic(orders.select("unit", "path", F.lit("generic").alias("origin")), specific, ["unit", "path"])
    return out.groupBy("origin").agg(F.count("*").alias("n"))


@query(
    """SELECT 'lineitem.l_orderkey' AS reference, count(*) AS missing FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'labels.doc_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'nation.n_regionkey', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)"""
)
def fk_check(lens: Lens) -> DataFrame:
    """V-02."""
    checks = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("nation", "n_regionkey", "region", "r_regionkey")]
    return validate.foreign_keys([(f"{t}.{c}", lens.table(t), c, lens.table(p), k) for t, c, p, k in checks])


@query(
    """SELECT name, CAST(sum(n - 1) AS BIGINT) AS repeated FROM (SELECT 'orders' AS name, o_orderkey AS k, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'labels', doc_id, count(*) FROM labels GROUP BY 2 UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM lineitem GROUP BY 2) GROUP BY name"""
)
def pk_check(lens: Lens) -> DataFrame:
    """V-01: rows beyond the first of each key."""
    return validate.primary_keys([("orders", lens.table("orders"), "o_orderkey"), ("labels", lens.table("labels"), "doc_id"), ("lineitem", lens.table("lineitem"), "l_orderkey")])


@query(
    """WITH s AS (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_custkey AS domain, o_orderpriority AS name FROM orders)
    SELECT domain, name, CASE WHEN domain NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'unknown id' END AS warning FROM s WHERE rn = 1"""
)
def review_merge(lens: Lens) -> DataFrame:
    """V-03: the first suggestion of each id; those of unknown ids carry a warning."""
    rows = lens.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("domain"), F.col("o_orderpriority").alias("name"))
    known = lens.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("domain"))
    return validate.first_suggestions(rows, known, "domain", "name", F.col("id"))

