"""Queries for closures, searches, trees, components and pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import graph as X
from ..operators.aggregates import top_per_group
from ..plans.lens import Lens, with_views
from .registry import query
from .scalar import contract_ctes

#: Nations and the three partners they sell most to: a graph with cycles.
_EDGES = """sold AS (SELECT s_nationkey AS nation, c_nationkey AS partner, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey),
    ranked AS (SELECT nation, partner, row_number() OVER (PARTITION BY nation ORDER BY sum(cents) DESC, partner) AS rn FROM sold GROUP BY nation, partner)"""


def _edges(lens: Lens, most: int) -> DataFrame:
    return top_per_group(lens.trade_edges(), ["nation"], [F.col("cents").desc(), F.col("partner")], most).select("nation", "partner")


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT nation, partner FROM ranked WHERE rn = 1),
    n AS (SELECT nation FROM e UNION SELECT partner FROM e), r AS (SELECT nation, nation AS partner FROM n UNION SELECT r.nation, e.partner FROM r JOIN e ON r.partner = e.nation) SELECT nation, partner FROM r""")
def reachability(lens: Lens) -> DataFrame:
    """G-01, G-07."""
    return X.reach(_edges(lens, 1), "nation", "partner")


@query(f"""WITH {_EDGES}, e AS (SELECT nation, partner FROM ranked WHERE rn <= 2),
    w AS (SELECT nation, partner, 1 AS depth FROM e UNION ALL SELECT a.nation, b.partner, 2 FROM e a JOIN e b ON a.partner = b.nation)
    SELECT nation, partner, min(depth) AS depth FROM w WHERE nation <> partner GROUP BY 1, 2""")
def bounded_bfs(lens: Lens) -> DataFrame:
    """G-02."""
    e = _edges(lens, 2)
    return X.within(e, "nation", "partner", e.select("nation"), 2)


@query(with_views("units", ", a AS (SELECT unit, unit AS ancestor, 0 AS depth FROM units UNION ALL SELECT a.unit, u.parent, depth + 1 FROM a JOIN units u ON a.ancestor = u.unit WHERE u.parent IS NOT NULL) SELECT unit, ancestor, depth FROM a", recursive=True))
def ancestors(lens: Lens) -> DataFrame:
    """G-03, G-04."""
    return X.ancestors(lens.units(), "unit", "parent")


@query(with_views("units", "SELECT parent, list_sort(list(unit)) AS children FROM units WHERE parent IS NOT NULL GROUP BY parent"))
def children(lens: Lens) -> DataFrame:
    """G-05."""
    return X.children(lens.units(), "unit", "parent")


@query(with_views("units", "SELECT u.unit, CASE WHEN u.level = 0 THEN u.unit WHEN u.level = 1 THEN u.unit ELSE u.parent END AS root FROM units u"))
def operation_root(lens: Lens) -> DataFrame:
    """G-03: the nearest ancestor of level one, else the topmost."""
    return X.root_of(lens.units(), "unit", "parent", F.col("level") == 1)


@query("WITH RECURSIVE" + contract_ctes("pages", "page_id, url", "url") + """, h AS (SELECT page_id, path, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM contract WHERE path IS NOT NULL),
    l AS (SELECT DISTINCT page_id AS a, min(page_id) OVER (PARTITION BY path) AS b FROM h UNION SELECT DISTINCT page_id, min(page_id) OVER (PARTITION BY host) FROM h),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
    SELECT node, min(root) AS root FROM r GROUP BY node""")
def contract_components(lens: Lens) -> DataFrame:
    """G-06: pages that share a path or a host, transitively; each meets its group's smallest page, not all others."""
    rows = lens.table("pages").select("page_id", P.contract_path(F.col("url")).alias("path"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).where("path is not null")
    star = lambda k: rows.join(rows.groupBy(k).agg(F.min("page_id").alias("b")), k).select(F.col("page_id").alias("a"), "b")
    return X.components(star("path").union(star("host")), "a", "b")


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT nation, partner FROM ranked WHERE rn = 1), n AS (SELECT nation FROM e UNION SELECT partner FROM e),
    r AS (SELECT nation, nation AS pos, 0 AS step FROM n UNION ALL SELECT r.nation, e.partner, step + 1 FROM r JOIN e ON r.pos = e.nation WHERE step < 60)
    SELECT nation, min(pos) AS canonical FROM r WHERE step >= 30 OR pos NOT IN (SELECT nation FROM e) GROUP BY nation""")
def canonical_chase(lens: Lens) -> DataFrame:
    """G-10."""
    return X.canonical(_edges(lens, 1), "nation", "partner")


@query("""WITH m AS (SELECT 'n' || n_nationkey AS c, 'r' || n_regionkey AS p, '/' || lower(replace(n_name, ' ', '')) AS x FROM nation), r AS (SELECT 'r' || r_regionkey AS c, '/' || lower(replace(r_name, ' ', '')) AS x FROM region)
    SELECT c AS router, x AS prefix FROM r UNION ALL SELECT m.c, r.x || m.x FROM m JOIN r ON m.p = r.c""")
def route_prefixes(lens: Lens) -> DataFrame:
    """G-11, X-17: full prefixes of nested routers."""
    path = lambda c: F.concat(F.lit("/"), F.lower(F.replace(c, F.lit(" "), F.lit(""))))
    region = lens.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("router"), F.lit(None).cast("string").alias("parent"), path("r_name").alias("prefix"))
    nation = lens.table("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), path("n_name"))
    return X.fixpoint_prefixes(region.union(nation), "router", "parent", "prefix", P.join_paths)
