"""Queries for scans, paths, keys, tokens and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import rules
from ..operators import budget as B
from ..plans.lens import Lens, with_views
from .registry import query

_AZ = f"'{P.UPPER}', '{P.LOWER}'"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def contract_ctes(source: str, columns: str, raw: str) -> str:
    """CTEs that end in `contract`: the columns, kept (segments or null) and path of the raw path in each row."""
    hexes = "[0-9a-fA-F-]{32,}"
    return f"""
    c1 AS (SELECT {columns}, trim({raw}) AS given, regexp_replace(trim({raw}), '(?i)^({'|'.join(P.METHODS)}) [ ]*', '') AS bare FROM {source}),
    c2 AS (SELECT *, CASE WHEN regexp_matches(bare, '^https?://') THEN coalesce(nullif(regexp_extract(bare, '^https?://[^/?#]*(/[^?#]*)', 1), ''), '/')
        WHEN contains(bare, '://') THEN '' WHEN starts_with(regexp_extract(bare, '^([^?#]*)', 1), '/') THEN regexp_extract(bare, '^([^?#]*)', 1) ELSE '/' || regexp_extract(bare, '^([^?#]*)', 1) END AS p FROM c1),
    c3 AS (SELECT *, list_transform(list_filter(string_split(regexp_replace(replace(p, chr(92), '/'), '/+', '/', 'g'), '/'), lambda s: s <> ''),
        lambda s: CASE WHEN regexp_full_match(s, '(:.*|[{{].*[}}]|<.*>|[0-9]+|{hexes})') THEN ':param' ELSE translate(s, {_AZ}) END) AS a FROM c2),
    c4 AS (SELECT *, list_transform(a, lambda s, i: CASE WHEN i > 1 AND i < len(a) AND a[i + 1] <> ':param' AND s <> ':param' AND s NOT IN {_in(P.NO_INSTANCES)}
        AND regexp_full_match(s, '([0-9]*|{hexes}|[a-z0-9]{{1,4}})') THEN ':param' ELSE s END) AS b FROM c3),
    c5 AS (SELECT *, coalesce(list_position(list_transform(b, lambda s: s IN {_in([*P.PREFIXES, P.PARAM])}), false), 0) AS f FROM c4),
    contract AS (SELECT {columns}, CASE WHEN given <> '' AND lower(given) <> '<dynamic>' AND f > 0 THEN b[f:] END AS kept,
        CASE WHEN given <> '' AND lower(given) <> '<dynamic>' AND f > 0 THEN '/' || array_to_string(b[f:], '/') END AS path FROM c5)"""


#: Path to capability key over `kept`.
_KEY = f"list_filter(list_filter(kept, lambda s: s <> ':param'), lambda s: s NOT IN {_in([*P.PREFIXES, *P.TRANSPORT])})[1]"


def bucket_sql(path: str) -> str:
    """bucket_key() over a path expression."""
    parts = f"list_filter(string_split(replace({path}, chr(92), '/'), '/'), lambda s: s <> '')"
    first = f"greatest(coalesce(list_position(list_transform({parts}, lambda s: s IN {_in(P.BUCKET_SKIP)}), false), 0), 1)"
    return f"""CASE WHEN len({parts}) = 0 THEN '_unscoped' WHEN len({parts}) - {first} > 0
        THEN array_to_string(({parts})[{first}:{first} + least(len({parts}) - {first}, 2) - 1], '/')
        WHEN contains(({parts})[{first}], '.') THEN '_unscoped' ELSE ({parts})[{first}] END"""


@query(with_views("files", "SELECT doc_id, path, language, size, lines, sha256(text) AS content_hash FROM files WHERE size <= 10485760"))
def scan_inventory(lens: Lens) -> DataFrame:
    """S-01, S-03: inventory of the files that are small enough."""
    return lens.files().where(F.col("size") <= 10485760).select("doc_id", "path", "language", "size", "lines", F.sha2("text", 256).alias("content_hash"))


@query(with_views("files", """, o AS (SELECT path, size, row_number() OVER (ORDER BY path) AS rn FROM files),
    w AS (SELECT path, size, rn, size <= 100000 AS taken, CASE WHEN size <= 100000 THEN size ELSE 0 END AS used FROM o WHERE rn = 1
        UNION ALL SELECT o.path, o.size, o.rn, w.used + o.size <= 100000, w.used + CASE WHEN w.used + o.size <= 100000 THEN o.size ELSE 0 END FROM w JOIN o ON o.rn = w.rn + 1 WHERE o.rn <= 100)
    SELECT path, size FROM w WHERE taken""", recursive=True))
def scan_limit_prefix(lens: Lens) -> DataFrame:
    """S-02: the first files by path, up to the limits on their number and their bytes; what would go beyond is skipped."""
    return B.scan_prefix(lens.files().select("path", "size"), "path", "size", 100, 100_000)


@query(with_views("files", "SELECT path, CASE WHEN language = 'en' THEN 'English' WHEN language = 'fr' THEN 'French' WHEN language = 'de' THEN 'German' ELSE 'unknown' END AS name FROM files"))
def lang_lookup(lens: Lens) -> DataFrame:
    """S-05: lookup in a literal map, a default for what is missing."""
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "fr", "French", "de", "German")])
    return lens.files().select("path", F.coalesce(F.try_element_at(names, P.fold(F.ltrim("language", F.lit(".")))), F.lit("unknown")).alias("name"))


@query(with_views("files", "SELECT source, sha256(string_agg(path || chr(1) || sha256(text) || chr(1), '' ORDER BY path)) AS snapshot, count(*) AS files FROM files GROUP BY source"))
def snapshot_hash(lens: Lens) -> DataFrame:
    """S-06: one hash over the ordered (path, content hash) of each source."""
    rows = lens.files().select("source", "path", F.sha2("text", 256).alias("h"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda r: F.concat(r["path"], F.lit("\1"), r["h"], F.lit("\1"))), "")
    return rows.groupBy("source").agg(F.sha2(one, 256).alias("snapshot"), F.count("*").alias("files"))


@query("WITH " + contract_ctes("pages", "page_id, url", "url") + " SELECT page_id, url, path FROM contract")
def contract_path(lens: Lens) -> DataFrame:
    """F-01 to F-03 over page addresses."""
    return lens.pages().select("page_id", "url", P.contract_path(F.col("url")).alias("path"))


@query(with_views("links", "," + contract_ctes("links", "page_id, href", "href") + " SELECT href, path, count(*) AS n FROM contract GROUP BY href, path"))
def contract_path_links(lens: Lens) -> DataFrame:
    """F-01 over link targets."""
    return lens.links().groupBy("href", P.contract_path(F.col("href")).alias("path")).agg(F.count("*").alias("n"))


@query(with_views("l_pages", "," + contract_ctes("l_pages", "page_id, method", "url") + " SELECT page_id, coalesce(method, '*') || ':' || path AS identity FROM contract"))
def contract_identity(lens: Lens) -> DataFrame:
    """F-04, F-24."""
    return lens.pages().select("page_id", P.contract_identity(F.col("method"), F.col("url")).alias("identity"))


@query("WITH " + contract_ctes("pages", "page_id", "url") + f" SELECT page_id, {_KEY} AS key FROM contract")
def capability_key(lens: Lens) -> DataFrame:
    """F-05."""
    return lens.pages().select("page_id", P.capability_key(F.col("url")).alias("key"))


@query(with_views("files", f"SELECT bucket, count(*) AS files FROM (SELECT {bucket_sql('path')} AS bucket FROM files) GROUP BY bucket"))
def bucket_key(lens: Lens) -> DataFrame:
    """F-07."""
    return lens.files().groupBy(P.bucket_key(F.col("path")).alias("bucket")).agg(F.count("*").alias("files"))


_ROLE_PATHS = "CASE page_id % 6 WHEN 0 THEN 'src/Tests/' WHEN 1 THEN 'tools/' WHEN 2 THEN 'legacy/' WHEN 3 THEN 'gen/' WHEN 4 THEN 'poc/' ELSE 'src/' END || page_id || CASE WHEN page_id % 7 = 0 THEN '_test.py' ELSE '.py' END"


@query(f"""WITH p AS (SELECT page_id, translate({_ROLE_PATHS}, {_AZ}) AS path FROM pages),
    d AS (SELECT page_id, path, list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) AS dirs FROM p)
    SELECT page_id, CASE WHEN list_has_any(dirs, ['test', 'tests', '__tests__']) OR path LIKE '%\\_test.py' ESCAPE '\\' THEN 'test'
        WHEN list_has_any(dirs, ['experiments', 'experiment', 'sandbox', 'poc']) THEN 'experiment' WHEN list_has_any(dirs, ['scripts', 'tools']) THEN 'script'
        WHEN list_has_any(dirs, ['generated', 'gen']) THEN 'generated' WHEN list_has_any(dirs, ['legacy', 'deprecated', 'archive', 'archives']) THEN 'archived'
        ELSE 'production' END AS role FROM d""")
def path_role(lens: Lens) -> DataFrame:
    """P-01, P-02 over made-up paths of the pages."""
    first = F.element_at(F.array(*[F.lit(x) for x in ("src/Tests/", "tools/", "legacy/", "gen/", "poc/", "src/")]), (F.col("page_id") % 6 + 1).cast("int"))
    path = F.concat(first, F.col("page_id").cast("string"), F.when(F.col("page_id") % 7 == 0, "_test.py").otherwise(".py"))
    return lens.table("pages").select("page_id", P.path_role(path).alias("role"))


@query("""SELECT c_custkey, list_filter(string_split(lower(regexp_replace(regexp_replace(c_name || 'HttpServer' || c_mktsegment, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '),
    lambda t: length(t) >= 3 AND t <> 'http') AS tokens FROM customer""")
def tokens(lens: Lens) -> DataFrame:
    """F-10 with a generic word left out."""
    return lens.table("customer").select("c_custkey", T.tokens(F.concat("c_name", F.lit("HttpServer"), "c_mktsegment"), 3, ["http"]).alias("tokens"))


_KEYS = "CASE page_id % 5 WHEN 0 THEN 'create-' WHEN 1 THEN 'getAll_' WHEN 2 THEN 'list/' WHEN 3 THEN 'authenticate' ELSE '' END || 'order' || CASE WHEN page_id % 2 = 0 THEN '-items' ELSE '' END"


@query(f"""WITH k AS (SELECT page_id, {_KEYS} AS key FROM pages), c AS (SELECT *, lower(regexp_replace(key, '[-_/]', '', 'g')) AS compact FROM k),
    a AS (SELECT *, CASE {' '.join(f"WHEN starts_with(compact, '{w}') AND length(compact) > {len(w)} THEN '{w}'" for w in T.ACTIONS)} END AS action FROM c)
    SELECT page_id, key, action, CASE WHEN action IS NULL THEN compact ELSE substr(compact, length(action) + 1) END AS entity FROM a""")
def key_decomposition(lens: Lens) -> DataFrame:
    """F-11."""
    first = F.element_at(F.array(*[F.lit(x) for x in ("create-", "getAll_", "list/", "authenticate", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    key = F.concat(first, F.lit("order"), F.when(F.col("page_id") % 2 == 0, "-items").otherwise(""))
    rows = lens.table("pages").select("page_id", key.alias("key"))
    return rows.select("page_id", "key", T.key_action(F.col("key")).alias("action"), T.key_entity(F.col("key")).alias("entity"))


@query("SELECT n_nationkey, 'unit_' || left(sha256(n_name || chr(0) || n_regionkey), 24) AS id FROM nation".replace("chr(0)", "chr(1)"))
def stable_ids(lens: Lens) -> DataFrame:
    """F-25, with a visible separator that both engines can hold in a string."""
    return lens.table("nation").select("n_nationkey", T.stable_id("unit_", F.concat_ws("\1", "n_name", F.col("n_regionkey").cast("string"))).alias("id"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(p_type, ' ', '') || 'HTTPServer', '([a-z])([A-Z])', '\\1_\\2', 'g'), '([^_])([A-Z][a-z])', '\\1_\\2', 'g')) AS name FROM part")
def snake_names(lens: Lens) -> DataFrame:
    """F-14."""
    return lens.table("part").select("p_partkey", T.snake_case(F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit("HTTPServer"))).alias("name"))


@query("""WITH t AS (SELECT DISTINCT w || x.s AS token FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) CROSS JOIN (VALUES (''), ('s'), ('ies'), ('es'), ('us')) x(s))
    SELECT token, list_filter([token, CASE WHEN length(token) > 4 AND token LIKE '%ies' THEN left(token, length(token) - 3) || 'y' END,
        CASE WHEN length(token) > 3 AND token LIKE '%s' AND NOT regexp_matches(token, '(ss|us|is|as|os)$') THEN left(token, length(token) - 1) END,
        CASE WHEN length(token) > 4 AND token LIKE '%es' THEN left(token, length(token) - 2) END], lambda v: v IS NOT NULL) AS variants FROM t""")
def singular_variants(lens: Lens) -> DataFrame:
    """F-16."""
    words = lens.table("part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    rows = words.select(F.explode(F.array(*[F.concat("w", F.lit(s)) for s in ("", "s", "ies", "es", "us")])).alias("token")).distinct()
    return rows.select("token", T.singular_variants(F.col("token")).alias("variants"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), s AS (SELECT w AS token, w AS v FROM w UNION SELECT w || 's', w FROM w UNION SELECT w || 's', w || 's' FROM w)
    SELECT DISTINCT a.w AS left_key, b.w || 's' AS right_key FROM w a JOIN w b ON a.w = b.w OR a.w = b.w || 's'
    WHERE regexp_matches(a.w, '[a-z]{3,}') AND NOT regexp_matches(b.w || 's', '(ss|us|is|as|os|es)$') AND NOT regexp_matches(a.w, 's$')""")
def key_equivalence(lens: Lens) -> DataFrame:
    """F-16: words and the plurals that are equivalent to them, met through shared variants."""
    w = lens.table("part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    a = w.where(~F.endswith("w", F.lit("s"))).select(F.col("w").alias("left_key"), F.explode(T.key_variants(F.col("w"))).alias("v"))
    b = w.where(~F.concat("w", F.lit("s")).rlike("(ss|us|is|as|os|es)$")).select(F.concat("w", F.lit("s")).alias("right_key"), F.explode(T.key_variants(F.concat("w", F.lit("s")))).alias("v"))
    return a.join(b, "v").select("left_key", "right_key").distinct()


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label FROM nation")
def labels_of_keys(lens: Lens) -> DataFrame:
    """F-17."""
    return lens.table("nation").select("n_nationkey", T.label(P.fold(F.col("n_name"))).alias("label"))


@query(with_views("links", "SELECT page_id, href, count(*) AS n FROM links GROUP BY page_id, href"))
def href_extract(lens: Lens) -> DataFrame:
    """U-11's shape: one pattern over every page, all matches."""
    return lens.links().groupBy("page_id", "href").agg(F.count("*").alias("n"))


_STATEMENTS = ["SELECT a FROM orders o JOIN lineitem l ON 1=1", "insert into part values (1)", "UPDATE customer SET x = 1 WHERE y IN (SELECT z from nation)", "DELETE FROM `events`", "no statement here", "create table region (a int)"]


@query(f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(_STATEMENTS))}) t(id, stmt))
    SELECT id, lower(unnest(regexp_extract_all(stmt, '(?i)\\b(?:from|into|update|join|table)\\s+[`"'']?([a-zA-Z_][a-zA-Z0-9_]*)', 1))) AS "table" FROM s""")
def sql_tables(lens: Lens) -> DataFrame:
    """U-13: tables that SQL statements name."""
    rows = lens.spark.createDataFrame(list(enumerate(_STATEMENTS)), "id int, stmt string")
    return rows.select("id", F.explode(rules.sql_tables(F.col("stmt"))).alias("table"))


_RULES = [("red", "red|pink"), ("ring", "ring$"), ("small", "^small"), ("any", ".*")]


@query(f"SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(p_name, '{r}') THEN '{n}'" for n, r in _RULES)} END AS rule FROM part")
def rule_first_match(lens: Lens) -> DataFrame:
    """W-07, U-14: the first rule, in rule order, whose pattern fits."""
    return rules.first_match(lens.table("part"), _RULES, F.col("p_name")).select("p_partkey", "rule")


@query("""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/orders/:param/start' WHEN 1 THEN '/admin/start' ELSE '/start' END AS path FROM pages)
    SELECT page_id, path = '/start' OR (path LIKE '%/start' AND path LIKE '%:param%') AS mounted, CASE WHEN path = '/orders/:param/start' THEN 2.0 / 4 WHEN path = '/admin/start' THEN 1.0 / 4 ELSE 1.0 / 4 END AS ratio FROM p""")
def mounted_match(lens: Lens) -> DataFrame:
    """F-06, F-09."""
    path = F.element_at(F.array(F.lit("/orders/:param/start"), F.lit("/admin/start"), F.lit("/start")), (F.col("page_id") % 3 + 1).cast("int"))
    return lens.table("pages").select("page_id", P.mounted_match(path, F.lit("/start")).alias("mounted"), P.common_prefix_ratio(path, F.lit("/orders/list/all")).cast("double").alias("ratio"))


@query(with_views("files", "SELECT path, size, length(trim(regexp_extract(text, '^[^\\n]*'))) BETWEEN 1 AND 80 AS valid_head FROM files"))
def text_validity(lens: Lens) -> DataFrame:
    """P-15 over the first line of each text."""
    head = F.regexp_extract("text", r"^[^\n]*", 0)
    return lens.files().select("path", "size", F.length(F.trim(head)).between(1, 80).alias("valid_head"))
