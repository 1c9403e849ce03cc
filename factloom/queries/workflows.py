"""Queries for extraction, the main analysis, control flow, evaluation and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, extract
from ..plans.lens import Lens, with_views
from ..session import ship
from ..streaming import incremental
from .registry import query

@query()
def extract_documents(lens: Lens) -> DataFrame:
    """U-01, U-11, U-13 over all documents as plain text files: line facts and statements, counted by kind."""
    ship(lens.spark)
    files = lens.table("documents").select(F.col("doc_id").cast("string").alias("file_id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return extract.extract(files).groupBy("fact_kind", "kind").agg(F.count("*").alias("n"))


_GOLD = """, a AS (SELECT DISTINCT bucket AS domain, key FROM (SELECT page_id % 4 AS bucket, split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 2) AS key FROM pages)),
    m AS (SELECT * FROM (VALUES ('en'), ('fr'), ('xx')) t(key)), n AS (SELECT 'en' AS left_key, 'de' AS right_key), f AS (SELECT 'es' AS key)"""


@query("WITH" + _GOLD[1:] + """ SELECT 'missing' AS finding, key AS subject FROM m WHERE key NOT IN (SELECT key FROM a)
    UNION ALL SELECT DISTINCT 'overMerge', left_key || '/' || right_key FROM n JOIN a x ON x.key = left_key JOIN a y ON y.key = right_key AND x.domain = y.domain
    UNION ALL SELECT DISTINCT 'forbidden', a.key FROM a JOIN f USING (key)
    UNION ALL SELECT 'overSplit', key FROM a WHERE key IN (SELECT key FROM m) GROUP BY key HAVING count(DISTINCT domain) > 1""")
def scoring(lens: Lens) -> DataFrame:
    """E-02: findings of made-up domains of the pages against labels."""
    key = F.get(F.split(F.regexp_replace("url", "^https?://", ""), "/"), F.lit(1))
    actual = lens.table("pages").select((F.col("page_id") % 4).alias("domain"), key.alias("key")).distinct()
    rows = lambda xs, schema: lens.spark.createDataFrame(xs, schema)
    must = rows([("en",), ("fr",), ("xx",)], "key string")
    found = evaluate.domain_findings(actual, must, rows([("en", "de")], "left_key string, right_key string"), rows([("es",)], "key string"))
    return found.union(evaluate.split_findings(actual, must))


@query("SELECT o_orderstatus AS contract, CASE WHEN count(*) > 4000 THEN 'duplicate' ELSE 'found' END AS finding FROM orders GROUP BY 1 HAVING false UNION ALL SELECT c, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN NOT ok THEN 'wrongDomain' ELSE 'found' END FROM (VALUES ('1', 0), ('2', 9), ('99', NULL), ('r0', NULL)) e(c, d) LEFT JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS k, count(*) AS n, bool_or(n_regionkey = CASE CAST(n_nationkey AS VARCHAR) WHEN '1' THEN 0 ELSE 9 END) AS ok FROM nation GROUP BY 1 UNION ALL SELECT 'r0', count(*), true FROM nation WHERE n_regionkey = 0) ON k = c")
def feature_scoring(lens: Lens) -> DataFrame:
    """E-03."""
    nation = lens.table("nation")
    own = nation.select(F.col("n_nationkey").cast("string").alias("contract"), F.col("n_regionkey").alias("domain"))
    own = own.union(nation.where("n_regionkey = 0").select(F.lit("r0"), "n_regionkey"))
    expected = lens.spark.createDataFrame([("1", 0), ("2", 9), ("99", None), ("r0", None)], "contract string, domain int")
    return evaluate.feature_findings(own, expected)


@query("SELECT user_id AS contract, list_sort(list_filter(['click', 'purchase', 'refund'], lambda k: NOT list_contains(own, k))) AS lacking FROM (SELECT user_id, list(DISTINCT event_type) AS own FROM events GROUP BY 1)")
def flow_scoring(lens: Lens) -> DataFrame:
    """E-04."""
    edges = lens.table("events").select(F.col("user_id").alias("contract"), F.col("event_type").alias("kind"))
    expected = edges.select("contract").distinct().withColumn("kinds", F.array(F.lit("click"), F.lit("purchase"), F.lit("refund")))
    return evaluate.flow_findings(edges, expected)


@query("""WITH m AS (SELECT n_regionkey AS g, n_nationkey AS i FROM nation)
    SELECT a.i AS left_key, b.i AS right_key, true AS positive FROM m a JOIN m b ON a.g = b.g AND a.i < b.i
    UNION SELECT least(a.i, b.i), greatest(a.i, b.i), false FROM m a JOIN m b ON a.g = 0 AND b.g = 1""")
def pair_labels(lens: Lens) -> DataFrame:
    """E-06."""
    nation = lens.table("nation").select("n_regionkey", "n_nationkey")
    return evaluate.gold_pairs(nation, "n_regionkey", "n_nationkey", lens.spark.createDataFrame([(0, 1)], "left_group int, right_group int"))


@query("SELECT o_orderstatus AS mode, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def ab_summary(lens: Lens) -> DataFrame:
    """E-08, A-31."""
    rows = lens.table("orders").where("o_orderpriority in ('1-URGENT', '5-LOW')").select(F.col("o_orderstatus").alias("mode"), F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("urgent").alias("finding"))
    return evaluate.mode_summary(rows, "mode", "finding", ["urgent", "low"])


@query("SELECT round(avg(m), 6) AS o_totalprice, count(*) AS projects FROM (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1)")
def two_level_average(lens: Lens) -> DataFrame:
    """A-30."""
    return evaluate.two_level_average(lens.table("orders"), "o_custkey", "o_totalprice").select(F.round("o_totalprice", 6).alias("o_totalprice"), "projects")


@query("SELECT c_custkey, CASE WHEN coalesce(p, 0) = 0 AND coalesce(q, 0) = 0 THEN 'passPositive' WHEN coalesce(q, 0) = 0 THEN 'passNegativeOnly' ELSE 'fail' END AS outcome FROM (SELECT o_custkey AS c_custkey, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS q FROM orders GROUP BY 1)")
def outcomes(lens: Lens) -> DataFrame:
    """E-05."""
    one = lambda c: lens.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.when(c, 1).otherwise(0).alias("n"))
    return evaluate.outcome(one(F.col("o_orderstatus") == "P"), one(F.col("o_orderpriority") == "1-URGENT"), "c_custkey")


@query(with_views("files", "SELECT doc_id AS file_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS content_hash FROM files WHERE doc_id % 10 = 0 OR doc_id % 17 = 0"))
def incremental_misses(lens: Lens) -> DataFrame:
    """ST-01: a cache from before every tenth file was edited, and without every seventeenth."""
    files = lens.files()
    config = F.lit("c1").alias("config")
    now = files.select(F.col("doc_id").alias("file_id"), F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"), config)
    cache = files.where("doc_id % 17 != 0").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("content_hash"), config)
    return incremental.misses(now, cache).select("file_id", "content_hash")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'added' WHEN c_custkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE (c_custkey % 5 = 0) <> (c_custkey % 7 = 0) OR (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0)")
def change_detection(lens: Lens) -> DataFrame:
    """ST-02: old lacks every fifth row, new every seventh, every third changed."""
    rows = lens.table("customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    new = rows.where("c_custkey % 7 != 0").withColumn("v", F.when(F.col("c_custkey") % 3 == 0, "other").otherwise(F.col("v")))
    return incremental.changes(rows.where("c_custkey % 5 != 0"), new, "c_custkey", "v")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(lens: Lens) -> DataFrame:
    """An extension: sessions of users with a gap of half an hour."""
    events = lens.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return incremental.session_windows(events, "ts", "user_id", "30 minutes", "1 hour").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
