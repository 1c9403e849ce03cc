"""Queries for the smaller operators: names, literals, assignments, candidates, caps, rewrites, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import budget as B
from ..operators import evaluate, frameworks, gates, graph, joins, rules, validate
from ..plans import overview
from ..plans.lens import Lens, with_views
from .registry import query

_NAME = "CASE o_orderkey % 3 WHEN 0 THEN 'a::b::' || o_orderstatus WHEN 1 THEN 'x.y.' || o_orderstatus ELSE 'p->' || o_orderstatus END"


def _names(lens: Lens) -> DataFrame:
    k, s = F.col("o_orderkey") % 3, F.col("o_orderstatus")
    return lens.table("orders").select("o_orderkey", F.when(k == 0, F.concat(F.lit("a::b::"), s)).when(k == 1, F.concat(F.lit("x.y."), s)).otherwise(F.concat(F.lit("p->"), s)).alias("name"))


@query(f"""WITH n AS (SELECT o_orderkey, {_NAME} AS name FROM orders)
    SELECT o_orderkey, CASE WHEN contains(name, '.') THEN split_part(name, '.', -1) WHEN contains(name, '::') THEN split_part(name, '::', -1) ELSE split_part(name, '->', -1) END AS last,
        array_to_string(string_split(name, '::')[-2:], '::') AS short FROM n""")
def name_parts(lens: Lens) -> DataFrame:
    """F-18, F-32."""
    return _names(lens).select("o_orderkey", T.last_segment(F.col("name")).alias("last"), T.short_name(F.col("name")).alias("short"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'a::b::c::x' WHEN 1 THEN 'a::b::x' WHEN 2 THEN 'a::x' ELSE 'x' END AS target
    FROM (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 0) WHERE n_nationkey % 4 <> 0
    UNION ALL SELECT n_nationkey, 'x' FROM nation WHERE n_nationkey % 4 = 0""")
def relative_targets(lens: Lens) -> DataFrame:
    """F-19: one part of the module goes for each leading dot."""
    k = F.col("n_nationkey") % 4
    target = F.concat(F.when(k == 0, "").when(k == 1, ".").when(k == 2, "..").otherwise("..."), F.lit("x"))
    return lens.table("nation").select("n_nationkey", T.relative_target(target, F.lit("a::b::c")).alias("target"))


@query("SELECT p_partkey, contains(' ' || regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || ' ', ' ring ') OR contains(' ' || regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || ' ', ' red widget ') AS hit FROM part")
def token_windows(lens: Lens) -> DataFrame:
    """F-12."""
    return lens.table("part").select("p_partkey", (T.token_window(F.col("p_name"), F.lit("ring")) | T.token_window(F.col("p_name"), F.lit("red widget"))).alias("hit"))


@query("SELECT o_orderkey, o_orderstatus = 'P' OR o_orderkey % 2 = 0 AS shares FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'P' UNION ALL SELECT o_orderkey, false FROM orders WHERE o_orderkey % 2 <> 0 AND o_orderstatus <> 'P'")
def entity_matches(lens: Lens) -> DataFrame:
    """F-11, F-13: keys whose entities are equal, or one holds the other."""
    key = F.when(F.col("o_orderkey") % 2 == 0, F.lit("create-order")).otherwise(F.when(F.col("o_orderstatus") == "P", "list_order_items").otherwise("getUsers"))
    return lens.table("orders").select("o_orderkey", T.share_entity(key, F.lit("order")).alias("shares"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '/') WHEN 1 THEN p_brand || '/:param' ELSE NULL END AS literal FROM part""")
def string_literals(lens: Lens) -> DataFrame:
    """F-21."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("'"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("'"))).when(k == 1, F.concat(F.lit("`"), "p_brand", F.lit("/${id}`"))).otherwise(F.col("p_name"))
    return lens.table("part").select("p_partkey", T.string_literal(text).alias("literal"))


@query("""SELECT n_nationkey, '/r' || n_regionkey || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/x' ELSE '/x/' END AS path, CASE n_nationkey % 3 WHEN 0 THEN '/a/:id' WHEN 1 THEN '/a/*rest' ELSE '/a' END AS route FROM nation""")
def joined_paths(lens: Lens) -> DataFrame:
    """F-22, F-23."""
    k = F.col("n_nationkey") % 3
    path = P.join_paths(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/")), F.when(k == 0, "").when(k == 1, "/x").otherwise("x/"))
    file = F.when(k == 0, "a/[id].tsx").when(k == 1, "a/[...rest].ts").otherwise("a/index.ts")
    return lens.table("nation").select("n_nationkey", path.alias("path"), P.file_route(file).alias("route"))


@query("SELECT c_custkey, CAST(octet_length(encode('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_mktsegment\":\"' || c_mktsegment || '\"}')) AS INTEGER) AS bytes FROM customer")
def json_sizes(lens: Lens) -> DataFrame:
    """F-27."""
    from ..sources.bundle import size_of

    rows = lens.table("customer").select("c_custkey", "c_name", "c_mktsegment")
    return rows.select("c_custkey", size_of(rows).alias("bytes"))


@query("SELECT s_nationkey, CAST(least(greatest(round(sqrt(count(*))), 2), 24, count(*)) AS INTEGER) AS clusters FROM supplier GROUP BY 1")
def cluster_targets(lens: Lens) -> DataFrame:
    """F-28."""
    n = F.count("*")
    return lens.table("supplier").groupBy("s_nationkey").agg(F.least(F.greatest(F.round(F.sqrt(n)), F.lit(2.0)), F.lit(24.0), n.cast("double")).cast("int").alias("clusters"))


@query(with_views("units", """, d AS (SELECT unit, 'd' || unit AS domain FROM units WHERE unit IN ('r0', 'r1', 'n3', 'n7'))
    SELECT u.unit, coalesce(s.domain, p.domain, g.domain) AS domain FROM units u LEFT JOIN d s ON s.unit = u.unit LEFT JOIN d p ON p.unit = u.parent LEFT JOIN units pu ON pu.unit = u.parent LEFT JOIN d g ON g.unit = pu.parent"""))
def ancestor_domains(lens: Lens) -> DataFrame:
    """J-15: the nearest ancestor that has a domain."""
    units = lens.units()
    named = units.where(F.col("unit").isin("r0", "r1", "n3", "n7")).select(F.col("unit").alias("ancestor"), F.concat(F.lit("d"), "unit").alias("domain"))
    met = graph.ancestors(units, "unit", "parent").join(named, "ancestor", "left")
    return met.groupBy("unit").agg(F.min_by("domain", F.when(F.col("domain").isNotNull(), F.col("depth"))).alias("domain"))


@query(with_views("members", "SELECT o_orderkey AS feature, list_sort(list(DISTINCT domain)) AS domains FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey FROM lineitem) JOIN members ON l_partkey = unit GROUP BY 1"))
def feature_domains(lens: Lens) -> DataFrame:
    """J-16: domains of features through the ids they hold; every order is a feature of this lens."""
    ids = lens.table("lineitem").select(F.col("l_orderkey").alias("feature"), F.col("l_partkey").alias("unit")).distinct()
    return ids.join(lens.members(), "unit").groupBy("feature").agg(F.array_sort(F.collect_set("domain")).alias("domains"))


@query("SELECT o_orderkey, h.target FROM orders JOIN (SELECT o_custkey AS file, o_orderpriority AS name, min(o_orderkey) AS target FROM orders GROUP BY 1, 2 HAVING count(*) = 1) h ON h.file = o_custkey AND h.name = o_orderpriority")
def unique_handlers(lens: Lens) -> DataFrame:
    """J-19: the only unit of the file with the name."""
    rows = lens.table("orders").select("o_orderkey", F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("name"))
    one = rows.groupBy("file", "name").agg(F.min("o_orderkey").alias("target"), F.count("*").alias("n")).where("n = 1")
    return rows.join(one, ["file", "name"]).select("o_orderkey", "target")


@query(with_views("trade", "SELECT CASE WHEN nation < 5 THEN partner ELSE nation END AS adjacent, count(*) AS weight FROM trade WHERE (nation < 5) <> (partner < 5) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8").replace("WITH trade", "WITH sold AS (SELECT s_nationkey, c_nationkey, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), trade"))
def adjacent_domains(lens: Lens) -> DataFrame:
    """J-24: relations with just one end inside, the eight strongest (a top-k)."""
    return overview.adjacent_domains(lens.trade(), "nation", "partner", lens.table("nation").where("n_nationkey < 5"), "n_nationkey")


@query("SELECT c_custkey, coalesce(m.canonical, c_nationkey) AS domain FROM customer LEFT JOIN (SELECT n_nationkey AS id, n_regionkey AS canonical FROM nation WHERE n_nationkey % 2 = 0) m ON m.id = c_nationkey")
def canonical_ids(lens: Lens) -> DataFrame:
    """J-26, C-08: ids replaced by what they merged into."""
    mapping = lens.table("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("domain"), F.col("n_regionkey").alias("into"))
    return gates.merge_groups(lens.table("customer").select("c_custkey", F.col("c_nationkey").alias("domain")), mapping, "domain").select("c_custkey", "domain")


@query("SELECT o_custkey || '/' || o_orderpriority AS framework, count(DISTINCT o_orderkey) AS files, CAST(round(least(0.99, 0.65 + 0.05 * count(DISTINCT o_orderkey)), 2) AS DOUBLE) AS confidence FROM orders GROUP BY 1")
def detection_confidence(lens: Lens) -> DataFrame:
    """A-34, with a customer's priorities as frameworks, which have few files each."""
    name = F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority")
    return frameworks.confidence(lens.table("orders").select(name.alias("framework"), F.col("o_orderkey").alias("file_id")))


@query("SELECT c_nationkey AS domain, count(*) AS units, round(sum(c_acctbal), 2) AS balance, list_sort(list(DISTINCT c_mktsegment))[1:8] AS signals FROM customer GROUP BY 1")
def domain_cards(lens: Lens) -> DataFrame:
    """A-35."""
    rows = lens.table("customer").select(F.col("c_nationkey").alias("domain"), "c_custkey", F.col("c_acctbal").alias("balance"), "c_mktsegment")
    return overview.domain_cards(rows, "domain", "c_custkey", "balance", "c_mktsegment").withColumn("balance", F.round("balance", 2))


@query("""WITH p AS (SELECT a.n_nationkey AS l, b.n_nationkey AS r, true AS positive FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)
    SELECT positive, count(*) AS pairs, CAST(sum(CASE WHEN (l + r) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS found, round(avg(CASE WHEN (l + r) % 3 = 0 THEN (l + r) / 10.0 END), 6) AS signal FROM p GROUP BY 1""")
def pair_signal_averages(lens: Lens) -> DataFrame:
    """A-29, E-07."""
    nation = lens.table("nation").select("n_regionkey", "n_nationkey")
    pairs = evaluate.gold_pairs(nation, "n_regionkey", "n_nationkey", lens.spark.createDataFrame([], "left_group int, right_group int"))
    known = pairs.where((F.col("left_key") + F.col("right_key")) % 3 == 0).select("left_key", "right_key", ((F.col("left_key") + F.col("right_key")) / 10.0).alias("signal"))
    return evaluate.pair_signals(pairs, known, ["signal"]).select("positive", "pairs", "found", F.round("signal", 6).alias("signal"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_totalprice > 400000 AS required, row_number() OVER (PARTITION BY o_custkey, o_totalprice > 400000 ORDER BY o_orderkey) AS rn FROM orders) WHERE required OR rn <= 3")
def capped_with_required(lens: Lens) -> DataFrame:
    """T-05: required rows always, of the others the first three (a top-k)."""
    rows = lens.table("orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 400000).alias("required"))
    free = A.top_per_group(rows.where("not required"), ["o_custkey"], [F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")
    return rows.where("required").select("o_custkey", "o_orderkey").unionByName(free)


@query("SELECT c_custkey AS unit_id FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 50")
def flow_cap(lens: Lens) -> DataFrame:
    """T-02: flows of the first units in id order (a top-k)."""
    return lens.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("unit_id")).orderBy("unit_id").limit(50)


@query("SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def first_by_id(lens: Lens) -> DataFrame:
    """T-11: one row an id, the smallest."""
    return A.first_of_group(lens.table("lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey"], [F.col("l_partkey")])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) THEN 'review' WHEN o_orderstatus = 'F' THEN 'reject' ELSE 'keep' END AS decision FROM orders")
def demote_rejections(lens: Lens) -> DataFrame:
    """V-04."""
    rows = lens.table("orders").select("o_orderkey", F.col("o_custkey").alias("domain"), F.when(F.col("o_orderstatus") == "F", "reject").otherwise("keep").alias("decision"))
    return validate.demote_rejected(rows, lens.table("customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("domain")), "domain").select("o_orderkey", "decision")


@query("SELECT user_id, list_sort(list(DISTINCT CASE event_type WHEN 'refund' THEN 'purchase' ELSE event_type END)) AS kinds FROM events GROUP BY 1")
def canonical_lists(lens: Lens) -> DataFrame:
    """V-05."""
    rows = lens.table("events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return validate.to_canonical(rows, "user_id", "kinds", lens.spark.createDataFrame([("refund", "purchase")], "id string, canonical string"))


@query(with_views("files", "SELECT 'warning' AS severity, 'BUDGET_EXCEEDED' AS code, size || ' bytes' AS message FROM files WHERE size > 20000"))
def budget_warnings(lens: Lens) -> DataFrame:
    """V-08."""
    return validate.over_budget(lens.files(), "size", 20000)


@query("""WITH d AS (SELECT c_nationkey AS domain, count(*) AS need, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS signal FROM customer GROUP BY 1), t AS (SELECT sum(need) AS need, sum(signal) AS signal FROM d)
    SELECT domain, CAST(d.need + floor(greatest(1000000 - t.need, 0) * d.signal / CAST(t.signal AS DOUBLE)) AS BIGINT) AS bytes FROM d, t""")
def budget_shares(lens: Lens) -> DataFrame:
    """B-02."""
    rows = lens.table("customer").groupBy(F.col("c_nationkey").alias("domain")).agg(F.count("*").alias("need"), F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).alias("signal"))
    return B.share_budget(rows, "need", "signal", 1_000_000).select("domain", F.col("bytes").cast("long").alias("bytes"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'full' WHEN n_nationkey % 5 = 1 THEN 'partial' WHEN n_nationkey % 5 = 2 THEN 'suppressed' WHEN n_nationkey % 5 = 3 THEN 'alias' ELSE 'missing' END AS coverage FROM nation")
def coverage_ledger(lens: Lens) -> DataFrame:
    """B-08."""
    n = lens.table("nation").select("n_nationkey")
    part = lambda k: n.where(F.col("n_nationkey") % 5 == k)
    planned = part(0).withColumn("complete", F.lit(True)).unionByName(part(1).withColumn("complete", F.lit(False)))
    return B.ledger(n, planned, part(2), part(3), "n_nationkey")


_SQL = ["SELECT a FROM t", "  insert into t values (1)", "UPDATE t SET a = 1", "with x as (select 1) select * from x", "nothing"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(["read", "write", "write", "read", "unknown"])) + ") t(id, mode)")
def access_modes(lens: Lens) -> DataFrame:
    """U-13, U-14: reads and writes of statements."""
    return lens.spark.createDataFrame(list(enumerate(_SQL)), "id int, stmt string").select("id", rules.access_mode(F.col("stmt")).alias("mode"))


@query("""SELECT d.doc_id, count(*) AS routes FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) d WHERE regexp_matches(line, '(token|key) = "') GROUP BY 1""")
def line_rules(lens: Lens) -> DataFrame:
    """U-11: a rule over every line of every document."""
    lines = rules.lines_of(lens.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    return lines.where(F.col("content").rlike('(token|key) = "')).groupBy("doc_id").agg(F.count("*").alias("routes"))


@query("""SELECT c_custkey, parent, strategy FROM (SELECT c_custkey, parent, strategy, row_number() OVER (PARTITION BY c_custkey ORDER BY strategy, score DESC, parent) AS rn FROM
    (SELECT c_custkey, c_nationkey AS parent, 2 AS strategy, 1 AS score FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, o_orderkey, 1, CAST(o_orderkey % 7 AS INTEGER) FROM orders WHERE o_orderstatus = 'P') WHERE c_custkey IN (SELECT c_custkey FROM customer)) WHERE rn = 1""")
def absorbed_singletons(lens: Lens) -> DataFrame:
    """C-07, W-07: the first strategy that has a parent, then the best score."""
    customers = lens.table("customer")
    a = customers.where("c_acctbal > 0").select("c_custkey", F.col("c_nationkey").cast("long").alias("parent"), F.lit(2).alias("strategy"), F.lit(1).alias("score"))
    b = lens.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("parent"), F.lit(1).alias("strategy"), (F.col("o_orderkey") % 7).cast("int").alias("score"))
    return gates.absorb_singletons(customers.select("c_custkey"), a.unionByName(b), "c_custkey", "parent")


@query("SELECT a.o_custkey, count(*) AS n FROM orders a JOIN customer ON c_custkey = a.o_custkey WHERE split_part(o_orderpriority, '-', 2) <> '' GROUP BY 1")
def dimension_join(lens: Lens) -> DataFrame:
    """J-28: an equi join on a part of a name, counted."""
    rows = lens.table("orders").where(F.substring_index("o_orderpriority", "-", -1) != "").select("o_custkey")
    return joins.keep_visible(rows, lens.table("customer"), "o_custkey", "c_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))
