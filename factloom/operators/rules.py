"""Rule tables: first match, SQL tables, routes and component markers (U-11 to U-14, X-01 to X-10, W-07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import last_segment, stable_id, string_literal

# Keyword before a table name; words that are no tables.
SQL_TABLE = r"""(?i)\b(?:from|into|update|join|table)\s+[`"']?([a-zA-Z_][a-zA-Z0-9_]*)"""
NO_TABLES = ["select", "where", "set", "values", "on", "and", "or", "as", "if", "exists"]


def first_match(rows: DataFrame, rules: Sequence[tuple[str, str]], text: Column) -> DataFrame:
    """rows with `rule`: the first rule, in order, whose pattern is found in text; null for none.

    Rules are literals of the plan, so the choice is one projection, without a join.
    """
    chosen = F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules])
    return rows.withColumn("rule", chosen)


def first_match_table(rows: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """The same for a table of rules (ord, rule, language, pattern) joined on `language` (U-14)."""
    met = rows.join(F.broadcast(rules), "language").where(F.expr(f"`{text}` rlike pattern"))  # rule tables are bounded by the configuration
    best = Window.partitionBy(key).orderBy("ord")
    return met.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def sql_tables(statement: Column) -> Column:
    """Lower-case names of the tables that a statement reads or writes, in order, repeats kept."""
    found = F.transform(F.regexp_extract_all(statement, F.lit(SQL_TABLE), F.lit(1)), lambda t: F.lower(t))
    return F.filter(found, lambda t: ~t.isin(NO_TABLES))


def access_mode(statement: Column) -> Column:
    """write for inserts, updates, deletes and definitions, read for queries, else unknown."""
    verb = F.lower(F.regexp_extract(statement, r"(?i)^\s*(select|insert|update|delete|create|drop|alter|merge|with)\b", 1))
    return F.when(verb.isin("select", "with"), "read").when(verb == "", "unknown").otherwise("write")


def lines_of(files: DataFrame, text: str) -> DataFrame:
    """files with line (from 1) and content of each line."""
    cols = [c for c in files.columns if c != text]
    return files.select(*cols, F.posexplode(F.split(text, "\n")).alias("__n", "content")).select(*cols, (F.col("__n") + 1).alias("line"), "content")


def routes(lines: DataFrame, rules: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """method and path by the first route rule that fits a line (U-11).

    A rule is (name, pattern, group of the method or 0, group of the path or 0); without a method group it is HTTP.
    """
    content = F.col("content")
    out = lines.withColumn("rule", F.coalesce(*[F.when(content.rlike(p), F.lit(n)) for n, p, _, _ in rules])).where("rule is not null")
    method = F.coalesce(*[F.when(F.col("rule") == n, F.upper(F.regexp_extract(content, p, m))) for n, p, m, _ in rules if m], F.lit("HTTP"))
    path = F.coalesce(*[F.when(F.col("rule") == n, F.regexp_extract(content, p, g)) for n, p, _, g in rules if g], F.lit("/"))
    return out.withColumn("method", F.when(method == "", "HTTP").otherwise(method)).withColumn("path", path)


def detect_markers(lines: DataFrame, markers: Sequence[tuple[str, str, str]], file: str) -> DataFrame:
    """framework, file, first line of its marker, number of files with evidence and confidence (X-01, A-34).

    A marker is (framework, language, pattern); lines must be free of comments and strings already.
    """
    found = F.array_compact(F.array(*[F.when((F.col("language") == lang) & F.col("content").rlike(p), F.lit(f)) for f, lang, p in markers]))
    hits = lines.select(file, "line", F.explode(F.array_distinct(found)).alias("framework"))
    first = hits.groupBy("framework", file).agg(F.min("line").alias("line"))
    files = first.groupBy("framework").agg(F.count("*").alias("files"))
    return first.join(files, "framework").withColumn("confidence", F.least(F.lit(0.99), 0.65 + 0.05 * F.col("files")))


def replace_generic(generic: DataFrame, specific: DataFrame, keys: list[str]) -> DataFrame:
    """Specific rows, and generic rows whose key no specific row has (O-06)."""
    return specific.unionByName(generic.join(specific.select(*keys).distinct(), keys, "left_anti"))


# Resources by the callee with its imports resolved: kind, pattern, whether the receiver is the name, and
# the way of access where the method doesn't say.
RESOURCES: list[tuple[str, str, bool, str]] = [
    ("environment", r"^(os\.getenv|os\.environ\.get|process\.env\.\w+|System\.getenv|(std::)?env::var|Environment\.GetEnvironmentVariable|os\.Getenv)$", False, "read"),
    ("webSocket", r"^WebSocket$", False, "readWrite"),
    ("externalApi", r"^(axios|requests|httpx|superagent|reqwest|http)(\.|::)(get|post|put|patch|delete|head|request|Get|Post)$|^fetch$", False, "read"),
    ("file", r"^(fs|fs/promises|fsPromises)\.\w*([rR]ead|[wW]rite|append|unlink)\w*$|^open$|^os\.(Open|ReadFile|WriteFile|Create)$|^(std::)?fs::(read|write|read_to_string)$", False, "read"),
    ("file", r"(^|\.)(path|file|Path)\.(read_text|write_text|read_bytes|write_bytes)$", True, "read"),
    ("cache", r"^(redis|cache|memcache|memcached)\.(get|set|del|delete|hget|hset|expire|incr)$", False, "read"),
    ("eventTopic", r"(^|\.)(bus|eventBus|event_bus|broker|producer|publisher)\.(publish|emit|send|dispatch)$", False, "write"),
    ("network", r"^(socket|net)\.(connect|createConnection|Dial|bind|listen)$", False, "readWrite"),
    ("process", r"^(subprocess\.(run|call|Popen|check_output)|os\.system|child_process\.(exec|spawn|execFile)|exec\.Command)$", False, "execute"),
]


def call_resources(calls: DataFrame, bindings: DataFrame, rules: Sequence[tuple[str, str, bool, str]] = RESOURCES) -> DataFrame:
    """file_id, id, unit_id, kind, name, mode, start_line, end_line of resources that calls touch, by the first rule that
    fits (U-14, W-07). The head of a callee is what its file has imported under that name, if all imports agree (J-27);
    the name is the first argument's literal, or the receiver's; a method that reads or writes says the mode.

    Rules are literals of the plan: one projection, and one join with the bindings by file and name.
    """
    bound = bindings.where("kind = 'import'").groupBy("file_id", F.col("local_name").alias("head")).agg(F.min("target_name").alias("to"), F.max("target_name").alias("other")).where("to = other")
    own = calls.withColumn("head", F.regexp_extract("callee", r"^[A-Za-z_$][\w$]*", 0)).join(bound.select("file_id", "head", "to"), ["file_id", "head"], "left")
    source = F.regexp_replace(F.regexp_replace("to", r"\.default$", ""), r"^node:", "")
    full = F.when(F.col("to").isNull(), F.col("callee")).otherwise(F.concat(source, F.expr("substring(callee, length(head) + 1)")))
    own = own.withColumn("full", full)
    hit = lambda p: F.col("full").rlike(p) | F.col("callee").rlike(p)
    pick = lambda i: F.coalesce(*[F.when(hit(r[1]), F.lit(r[i])) for r in rules])
    literal = string_literal(F.get(F.split(F.coalesce("arguments", F.lit("")), "\x1f"), F.lit(0)))
    met = own.withColumns({"kind": pick(0), "by_receiver": pick(2), "usual": pick(3)}).where("kind is not null")
    verb = F.lower(last_segment(F.col("full")))
    mode = F.when(F.col("usual").isin("readWrite", "execute"), F.col("usual")).when(verb.rlike("write|set|put|post|patch|delete|append|unlink|publish|emit|send|dispatch|create|incr|expire|^del$"), "write").when(verb.rlike("read|get|load|open|fetch|head"), "read").otherwise(F.col("usual"))
    name = F.when(F.col("by_receiver"), F.coalesce(last_segment(F.col("receiver")), literal)).otherwise(literal)
    out = met.withColumns({"name": name, "mode": mode}).where("name is not null")
    return out.select("file_id", stable_id("call_", "id", "kind").alias("id"), "unit_id", "kind", "name", "mode", "start_line", "end_line")
