"""Contract paths, keys and buckets as column expressions (F-01 to F-09, F-15, F-22 to F-24, P-01, P-14)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARAM = ":param"

# What a path may start with, short words that are no instances, transport words, HTTP methods,
# directories that packages don't count, directory and file names by role.
PREFIXES = ["api", "v1", "v2", "v3", "public", "internal", "backend"]
NO_INSTANCES = ["auth", "data", "file", "http", "jobs", "role", "tags", "task", "user", "ws"]
TRANSPORT = ["shop-api", "admin-api", "gateway", "graphql", "connect", "rpc"]
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "CONNECT", "TRACE"]
BUCKET_SKIP = ["src", "lib", "pkg", "internal"]
ROLES = {
    "test": ["test", "tests", "__tests__"],
    "experiment": ["experiments", "experiment", "sandbox", "poc"],
    "script": ["scripts", "tools"],
    "generated": ["generated", "gen"],
    "archived": ["legacy", "deprecated", "archive", "archives"],
}
TEST_PREFIXES = ["test_", "test-"]
TEST_SUFFIXES = ["_test.go", "_test.rs", ".test.js", ".spec.js", ".test.jsx", ".spec.jsx", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", "_test.py", "test.java", "tests.java"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value in the plan once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """A-Z to lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _segment(raw: Column) -> Column:
    s = strip(raw)
    return F.when(s.rlike(r"^(:.*|\{.*\}|<.*>|[0-9]+|[0-9a-fA-F-]{32,})$"), F.lit(PARAM)).otherwise(fold(s))


def _instance(s: Column) -> Column:
    return (s != PARAM) & ~s.isin(NO_INSTANCES) & s.rlike(r"^([0-9]*|[0-9a-fA-F-]{32,}|[a-z0-9]{1,4})$")


def drop_while(items: Column, leading: list[str]) -> Column:
    """The array from its first element that isn't in `leading`; empty if there is none."""

    def cut(own: Column) -> Column:
        first = F.array_position(F.transform(own, lambda s: s.isin(leading)), F.lit(False)).cast("int")
        return F.when(first > 0, F.slice(own, first, F.size(own))).otherwise(F.slice(own, 1, 0))

    return let(items, cut)


def _path_of(bare: Column) -> Column:
    of_url = F.regexp_extract(bare, r"^https?://[^/?#]*(/[^?#]*)", 1)
    local = F.regexp_extract(bare, r"^([^?#]*)", 1)
    return (
        F.when(bare.rlike("^https?://"), F.when(of_url == "", F.lit("/")).otherwise(of_url))
        .when(F.contains(bare, F.lit("://")), F.lit(""))
        .otherwise(F.when(F.startswith(local, F.lit("/")), local).otherwise(F.concat(F.lit("/"), local)))
    )


def url_path(raw: Column) -> Column:
    """The path of a URL or route, without method, host, query and fragment; empty for other schemes."""
    return let(strip(F.regexp_replace(strip(raw), rf"(?i)^({'|'.join(METHODS)}) \s*", "")), _path_of)


def _marked(parts: Column) -> Column:
    last = F.size(parts) - 1
    return F.transform(parts, lambda s, i: F.when((i > 0) & (i < last) & (F.get(parts, i + 1) != PARAM) & _instance(s), F.lit(PARAM)).otherwise(s))


def contract_segments(raw: Column) -> Column:
    """Segments of the normalised contract path; null if there are none (F-01 to F-03)."""
    path = F.regexp_replace(url_path(raw), r"[/\\]+", "/")
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _segment)
    kept = let(drop_while(let(parts, _marked), [*PREFIXES, PARAM]), lambda k: F.when(F.size(k) > 0, k))
    given = strip(raw)
    return F.when((given != "") & (fold(given) != "<dynamic>"), kept)


def contract_path(raw: Column) -> Column:
    """Normalised contract path, null if nothing is left."""
    return F.concat(F.lit("/"), F.array_join(contract_segments(raw), "/"))


def http_method(raw: Column) -> Column:
    """Upper-case method, `*` for none (F-24)."""
    return F.coalesce(F.nullif(F.upper(strip(raw)), F.lit("")), F.lit("*"))


def contract_identity(method: Column, raw: Column) -> Column:
    """METHOD:/path (F-04)."""
    return F.concat(http_method(method), F.lit(":"), contract_path(raw))


def capability_key(raw: Column) -> Column:
    """First segment that is neither prefix, parameter nor transport word (F-05)."""
    parts = F.filter(contract_segments(raw), lambda s: (s != PARAM) & (s != ""))
    return F.get(drop_while(parts, [*PREFIXES, *TRANSPORT, PARAM]), F.lit(0))


def bucket_key(path: Column) -> Column:
    """At most two directories after those that packages skip, or `_unscoped` (F-07)."""

    def of(parts: Column) -> Column:
        first = F.greatest(F.array_position(F.transform(parts, lambda s: s.isin(BUCKET_SKIP)), F.lit(False)).cast("int"), F.lit(1))
        dirs = F.size(parts) - first
        alone = F.get(parts, first - 1)
        deep = F.array_join(F.slice(parts, first, F.least(F.greatest(dirs, F.lit(0)), F.lit(2))), "/")
        return F.when(F.size(parts) == 0, F.lit("_unscoped")).when(dirs > 0, deep).when(F.contains(alone, F.lit(".")), F.lit("_unscoped")).otherwise(alone)

    return let(F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: s != ""), of)


def path_role(path: Column) -> Column:
    """test, experiment, script, generated, archived or production (P-01)."""
    folded = fold(F.regexp_replace(path, r"\\", "/"))
    parts = F.split(folded, "/")
    name, dirs = F.element_at(parts, -1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    inside = lambda names: F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))
    test = inside(ROLES["test"])
    for p in TEST_PREFIXES:
        test = test | F.startswith(name, F.lit(p))
    for s in TEST_SUFFIXES:
        test = test | F.endswith(name, F.lit(s))
    role = F.when(test, F.lit("test"))
    for kind in ("experiment", "script", "generated", "archived"):
        role = role.when(inside(ROLES[kind]), F.lit(kind))
    return role.otherwise(F.lit("production"))


def prefix_match(a: Column, b: Column) -> Column:
    """Equal, or one is the other's leading segments."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def mounted_match(a: Column, b: Column) -> Column:
    """One path is the tail of the other, and what stands before it has a parameter (F-06)."""
    x, y = (F.filter(F.split(p, "/"), lambda s: s != "") for p in (a, b))
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    more = F.size(long) - F.size(short)
    tail = F.slice(long, more + 1, F.greatest(F.size(short), F.lit(0))) == short
    return (a == b) | ((F.size(short) > 0) & (more > 0) & tail & F.array_contains(F.slice(long, 1, F.greatest(more, F.lit(0))), PARAM))


def common_prefix_ratio(a: Column, b: Column) -> Column:
    """Common leading segments over the longer path's segments (F-09)."""
    x, y = F.split(a, "/"), F.split(b, "/")
    differs = F.array_position(F.transform(F.arrays_zip(x.alias("l"), y.alias("r")), lambda p: ~p["l"].eqNullSafe(p["r"])), F.lit(True))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(differs == 0, most).otherwise(differs - 1) / most


def canonical_key(key: Column) -> Column:
    """The key without one `:param` at its end, unless that is all (F-15)."""
    return F.regexp_replace(strip(key), r"(?<=.):param$", "")


def join_paths(prefix: Column, path: Column) -> Column:
    """prefix/path with one slash between and one before; a path's trailing slash stays (F-22)."""
    tail = F.ltrim(path, F.lit("/"))
    head = F.trim(prefix, F.lit("/"))
    return F.concat(F.lit("/"), F.when(head == "", tail).when(tail == "", head).otherwise(F.concat(head, F.lit("/"), tail)))


def file_route(path: Column) -> Column:
    """Route of a page file: `[id]` to `:id`, `[...x]` to `*x`, `index` and the extension dropped (F-23)."""
    bare = F.regexp_replace(path, r"\.[A-Za-z]+$", "")
    named = F.regexp_replace(F.regexp_replace(bare, r"\[\.\.\.([^\]]+)\]", "*$1"), r"\[([^\]]+)\]", ":$1")
    parts = F.filter(F.split(named, "/"), lambda s: (s != "") & (s != "index") & ~s.rlike(r"^\(.*\)$"))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def plausible_path(text: Column) -> Column:
    """No scheme and no dotted configuration key (P-14)."""
    return ~F.contains(text, F.lit("://")) & ~(~F.contains(text, F.lit("/")) & text.rlike(r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)+$"))
