"""Views of the driver's tables as fact tables: entrypoints, references, units, spans, events, memberships, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Lens:
    """The tables of one folder; every view is a projection that prunes columns at the scan."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def files(self) -> DataFrame:
        """file_id, path, language, source, size, lines of each document."""
        text = F.coalesce("text", F.lit(""))
        newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
        open_end = F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
        return self.table("documents").select(
            "doc_id",
            F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
            F.col("lang").alias("language"),
            "source",
            F.octet_length(text).cast("long").alias("size"),
            (newlines + open_end).cast("long").alias("lines"),
            text.alias("text"),
        )

    def pages(self) -> DataFrame:
        """page_id, url, method (GET for even ids, else null)."""
        return self.table("pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, "GET").alias("method"))

    def links(self) -> DataFrame:
        """page_id, href of every link."""
        return self.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))

    def refs(self) -> DataFrame:
        """source (order), target (part), kind, status, line of each line item; supplier for memberships."""
        f, d = F.col("l_linestatus") == "F", F.col("l_discount")
        status = F.when(f & (d < 0.03), "confirmed").when(f, "candidate").when(d < 0.05, "unknown").otherwise("dynamic")
        return self.table("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("kind"), status.alias("status"), F.col("l_linenumber").alias("line"))

    def units(self) -> DataFrame:
        """unit, parent, name, level: regions, nations, customers."""
        region = self.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("unit"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.lit(0).alias("level"))
        nation = self.table("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", F.lit(1))
        customer = self.table("customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name", F.lit(2))
        return region.union(nation).union(customer)

    def spans(self) -> DataFrame:
        """owner (customer), id (order), start, end (days) of each order: order date to last shipping."""
        day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date"))
        line = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
        rows = self.table("orders").join(line, "o_orderkey")
        return rows.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.least(day("o_orderdate"), day("last")).alias("start"), F.greatest(day("o_orderdate"), day("last")).alias("end"))

    def trade(self) -> DataFrame:
        """nation, partner: for each supplier nation the customer nation of most revenue, ties to the smaller key."""
        line = self.table("lineitem").select("l_orderkey", "l_suppkey", (F.round(F.col("l_extendedprice") * 100)).cast("long").alias("cents"))
        sold = line.join(self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        sold = sold.join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        sold = sold.join(self.table("customer").select("c_custkey", "c_nationkey"), "c_custkey").where("s_nationkey != c_nationkey")
        sums = sold.groupBy("s_nationkey", "c_nationkey").agg(F.sum("cents").alias("cents"))
        best = F.min_by("c_nationkey", F.struct(-F.col("cents"), F.col("c_nationkey")))
        return sums.groupBy(F.col("s_nationkey").alias("nation")).agg(best.alias("partner"))

    def trade_edges(self) -> DataFrame:
        """nation, partner: the three best partners of each nation, a cyclic graph."""
        line = self.table("lineitem").select("l_orderkey", "l_suppkey", (F.round(F.col("l_extendedprice") * 100)).cast("long").alias("cents"))
        sold = line.join(self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")
        sold = sold.join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        sold = sold.join(self.table("customer").select("c_custkey", F.col("c_nationkey").alias("partner")), "c_custkey").where("nation != partner")
        return sold.groupBy("nation", "partner").agg(F.sum("cents").alias("cents"))

    def members(self) -> DataFrame:
        """unit (part), domain (customer nation), amount: parts bought, by nation."""
        line = self.table("lineitem").select("l_orderkey", "l_partkey", (F.round(F.col("l_extendedprice") * 100)).cast("long").alias("cents"))
        sold = line.join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        sold = sold.join(self.table("customer").select("c_custkey", F.col("c_nationkey").alias("domain")), "c_custkey")
        return sold.groupBy(F.col("l_partkey").alias("unit"), "domain").agg(F.sum("cents").alias("amount"))

    def turns(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("flow"), F.col("turn").alias("node"), "role", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))

    def terms(self) -> DataFrame:
        """doc, term: the words of part names, with the brand as document."""
        return self.table("part").select(F.col("p_brand").alias("doc"), F.explode(F.split("p_name", " ")).alias("term"))


#: The same views for the oracle.
SQL = {
    "files": """SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS language, source,
        CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size,
        CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + CASE WHEN coalesce(text, '') <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS lines,
        coalesce(text, '') AS text FROM documents""",
    "l_pages": "SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'GET' END AS method FROM pages",
    "links": """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages""",
    "refs": """SELECT l_orderkey AS source, l_partkey AS target, l_suppkey AS supplier, l_returnflag AS kind,
        CASE WHEN l_linestatus = 'F' AND l_discount < 0.03 THEN 'confirmed' WHEN l_linestatus = 'F' THEN 'candidate' WHEN l_discount < 0.05 THEN 'unknown' ELSE 'dynamic' END AS status, l_linenumber AS line FROM lineitem""",
    "units": """SELECT 'r' || r_regionkey AS unit, NULL AS parent, r_name AS name, 0 AS level FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 1 FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 2 FROM customer""",
    "spans": """SELECT owner, id, least(a, b) AS start, greatest(a, b) AS "end" FROM (
        SELECT o_custkey AS owner, o_orderkey AS id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a, date_diff('day', DATE '1990-01-01', CAST(last AS DATE)) AS b
        FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)""",
    "sold": """SELECT s_nationkey, c_nationkey, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "trade": """SELECT s_nationkey AS nation, c_nationkey AS partner FROM (
        SELECT s_nationkey, c_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY sum(cents) DESC, c_nationkey) AS rn
        FROM sold WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey) WHERE rn = 1""",
    "members": """SELECT l_partkey AS unit, c_nationkey AS domain, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "turns": "SELECT conv_id AS flow, turn AS node, role, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM conversations",
    "terms": "SELECT p_brand AS doc, unnest(string_split(p_name, ' ')) AS term FROM part",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """body with the named views in front of it."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split()) + "\n" + body
