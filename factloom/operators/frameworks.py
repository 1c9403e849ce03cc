"""Frameworks: detection by markers and manifests, and data-driven rules over facts (X-01 to X-19, J-19 to J-22, J-29, J-31, F-33, S-08).

Rules are small tables from this module or from the caller; they are literals or broadcast, as their size is that of
the configuration. Facts are joined with them by call name, decorator name or file, never pair by pair.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from .extract import ARGUMENT, HTTP_VERBS, mask
from .graph import ancestors, fixpoint_prefixes

# Frameworks with their languages, parent and markers.
REGISTRY: list[tuple[str, str, str | None, list[str]]] = [
    ("c.gtk_glib", "c", None, ["gtk/gtk.h", "glib.h"]),
    ("c.qt", "c", None, ["qt", "qobject"]),
    ("c.libuv", "c", None, ["uv.h", "uv_loop"]),
    ("c.libevent", "c", None, ["event2/", "event_base"]),
    ("cpp.qt", "cpp", None, ["qt", "qobject"]),
    ("cpp.mfc", "cpp", None, ["afxwin.h", "CWinApp"]),
    ("cpp.boost_asio", "cpp", None, ["boost/asio", "io_context"]),
    ("cpp.poco", "cpp", None, ["Poco/", "Poco::"]),
    ("cpp.unreal_engine", "cpp", None, ["CoreMinimal.h", "UCLASS", "UFUNCTION"]),
    ("cpp.drogon", "cpp", None, ["drogon/", "ADD_METHOD_TO"]),
    ("cpp.crow", "cpp", None, ["crow.h", "CROW_ROUTE"]),
    ("cpp.grpc", "cpp", None, ["grpcpp/", "grpc::"]),
    ("csharp.aspnet_core", "csharp", None, ["Microsoft.AspNetCore", "ControllerBase"]),
    ("csharp.aspnet_mvc", "csharp", "csharp.aspnet_core", ["System.Web.Mvc", "RouteAttribute"]),
    ("csharp.aspnet_web_api", "csharp", "csharp.aspnet_core", ["System.Web.Http", "ApiController", "IHttpActionResult"]),
    ("csharp.minimal_api", "csharp", "csharp.aspnet_core", ["MapGet", "MapPost", "WebApplication"]),
    ("csharp.blazor", "csharp", "csharp.aspnet_core", [".razor", "ComponentBase"]),
    ("csharp.dotnet_maui", "csharp", None, ["Microsoft.Maui", "ContentPage"]),
    ("dart.flutter", "dart", None, ["package:flutter", "StatelessWidget", "StatefulWidget"]),
    ("dart.shelf", "dart", None, ["package:shelf", "shelf.Handler"]),
    ("dart.serverpod", "dart", None, ["package:serverpod", "Endpoint"]),
    ("dart.dart_frog", "dart", None, ["package:dart_frog", "Response"]),
    ("go.net_http", "go", None, ["net/http", "http.HandleFunc"]),
    ("go.gin", "go", None, ["gin-gonic/gin", "gin.Default"]),
    ("go.echo", "go", None, ["labstack/echo", "echo.New"]),
    ("go.fiber", "go", None, ["gofiber/fiber", "fiber.New"]),
    ("go.chi", "go", None, ["go-chi/chi", "chi.NewRouter"]),
    ("go.beego", "go", None, ["beego", "beego.Controller"]),
    ("go.grpc", "go", None, ["google.golang.org/grpc", "grpc.NewServer"]),
    ("java.spring", "java", None, ["org.springframework", "@Component"]),
    ("java.spring_boot", "java", "java.spring", ["spring-boot", "SpringBootApplication"]),
    ("java.spring_mvc", "java", "java.spring", ["spring-webmvc", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "PatchMapping", "DeleteMapping", "RestController"]),
    ("java.spring_webflux", "java", "java.spring", ["spring-webflux", "org.springframework.web.reactive", "RouterFunction", "RequestPredicates", "Mono<", "Flux<"]),
    ("java.jakarta_ee", "java", None, ["jakarta.ws.rs", "javax.ws.rs", "jakarta.servlet", "jakarta.enterprise"]),
    ("java.quarkus", "java", None, ["io.quarkus", "@QuarkusMain"]),
    ("java.micronaut", "java", None, ["io.micronaut", "io.micronaut.http.annotation"]),
    ("java.play", "java", None, ["play.mvc", "routes"]),
    ("javascript.react", "javascript typescript", None, ["react", "useState"]),
    ("javascript.nextjs", "javascript typescript", None, ["next/", "next.config"]),
    ("javascript.angular", "javascript typescript", None, ["@angular/core", "@Component"]),
    ("javascript.vue", "javascript typescript", None, ["vue", "defineComponent"]),
    ("javascript.nuxt", "javascript typescript", "javascript.vue", ["nuxt", "defineNuxtConfig"]),
    ("javascript.sveltekit", "javascript typescript", None, ["@sveltejs/kit", "+page"]),
    ("javascript.express", "javascript typescript", None, ["express", "express()"]),
    ("javascript.fastify", "javascript typescript", None, ["fastify", "fastify()"]),
    ("javascript.nestjs", "javascript typescript", None, ["@nestjs/common", "@Controller"]),
    ("javascript.nestjs_graphql", "javascript typescript", "javascript.nestjs", ["@nestjs/graphql", "@Query", "@Mutation", "@Resolver"]),
    ("javascript.koa", "javascript typescript", None, ["koa", "new Koa"]),
    ("javascript.tauri", "javascript typescript rust", None, ["@tauri-apps/api", "tauri::"]),
    ("python.django", "python", None, ["django", "urlpatterns", "models.Model", "django.db"]),
    ("python.django_rest_framework", "python", "python.django", ["rest_framework", "APIView"]),
    ("python.flask", "python", None, ["flask", "Flask("]),
    ("python.fastapi", "python", None, ["fastapi", "FastAPI("]),
    ("python.starlette", "python", None, ["starlette", "Starlette("]),
    ("python.sanic", "python", None, ["sanic", "Sanic("]),
    ("python.sqlalchemy", "python", None, ["sqlalchemy", "declarative_base", "DeclarativeBase"]),
    ("python.sqlmodel", "python", "python.sqlalchemy", ["sqlmodel", "SQLModel"]),
    ("rust.axum", "rust", None, ["axum", "Router::new"]),
    ("rust.actix_web", "rust", None, ["actix_web", "HttpServer"]),
    ("rust.rocket", "rust", None, ["rocket", "rocket::get"]),
    ("rust.warp", "rust", None, ["warp", "warp::path"]),
    ("rust.poem", "rust", None, ["poem", "#[handler]"]),
    ("rust.tokio", "rust", None, ["tokio", "#[tokio::main]"]),
    ("rust.tonic", "rust", None, ["tonic", "tonic::transport"]),
    ("rust.tauri", "rust", None, ["tauri", "tauri::Builder"]),
]

# Call routes as framework, methods of the receiver (empty: HTTP verbs), constructors, receiver names,
# place of path, place of handler (-1: last), fixed method, prefix calls, kind.
_VERBS = [v.upper() for v in HTTP_VERBS] + [v.capitalize() for v in HTTP_VERBS] + list(HTTP_VERBS)
CALL_ROUTES: list[tuple[str, list[str], list[str], list[str], int, int, str | None, list[str], str]] = [
    ("go.net_http", ["Handle", "HandleFunc"], ["NewServeMux"], ["http", "mux"], 0, 1, "HTTP", [], "http"),
    ("go.gin", _VERBS, ["Default", "New"], ["router", "r", "group", "api", "v1"], 0, -1, None, ["Group"], "http"),
    ("go.echo", _VERBS, ["New"], ["e", "g"], 0, 1, None, ["Group"], "http"),
    ("go.fiber", _VERBS, ["New"], ["app"], 0, -1, None, ["Group"], "http"),
    ("go.chi", _VERBS, ["NewRouter"], ["r"], 0, 1, None, ["Route"], "http"),
    ("go.beego", ["Router", *_VERBS], [], ["beego", "web"], 0, 1, None, ["Namespace"], "http"),
    ("csharp.minimal_api", [f"Map{v.capitalize()}" for v in HTTP_VERBS], [], ["app", "group"], 0, 1, None, ["MapGroup"], "http"),
    ("dart.shelf", list(HTTP_VERBS), ["Router"], ["router", "app"], 0, 1, None, ["mount"], "http"),
    ("javascript.express", [*HTTP_VERBS, "all"], ["express", "Router"], ["app", "router"], 0, -1, None, [], "http"),
    ("javascript.express", ["ws"], ["express", "Router"], ["app", "router"], 0, -1, "WS", [], "webSocket"),
    ("javascript.fastify", list(HTTP_VERBS), ["fastify"], ["fastify", "app"], 0, -1, None, [], "http"),
    ("javascript.koa", [*HTTP_VERBS, "all"], ["Router"], ["router"], 0, -1, None, [], "http"),
    ("rust.axum", ["route"], ["new"], ["Router", "app", ""], 0, 1, "HTTP", ["nest"], "http"),
    ("rust.warp", ["path"], [], ["warp"], 0, -1, "HTTP_FILTER", [], "http"),
    ("rust.poem", ["at"], ["new"], ["Route", "app", ""], 0, 1, "HTTP", ["nest"], "http"),
    ("python.django", ["path", "re_path"], [], [""], 0, 1, "HTTP", [], "http"),
    ("python.django_rest_framework", ["register"], ["DefaultRouter", "SimpleRouter"], ["router"], 0, 1, "HTTP", [], "http"),
    ("python.starlette", ["Route", "add_route"], ["Starlette"], ["", "app"], 0, 1, "HTTP", [], "http"),
]

# Callbacks as framework, call, places of the callbacks.
CALLBACKS: list[tuple[str, str, list[int]]] = [
    ("c.gtk_glib", "g_signal_connect", [2]), ("c.gtk_glib", "g_signal_connect_swapped", [2]), ("c.gtk_glib", "g_timeout_add", [1]), ("c.gtk_glib", "g_idle_add", [0]), ("c.gtk_glib", "g_source_set_callback", [1]),
    ("c.libuv", "uv_read_start", [1, 2]), ("c.libuv", "uv_write", [4]), ("c.libuv", "uv_connect", [3]), ("c.libuv", "uv_fs_open", [5]), ("c.libuv", "uv_timer_start", [1]), ("c.libuv", "uv_async_init", [2]),
    ("c.libevent", "event_new", [3]), ("c.libevent", "event_assign", [4]), ("c.libevent", "evhttp_set_cb", [2]), ("c.libevent", "evconnlistener_new_bind", [1]),
    ("cpp.qt", "connect", [3]),
    ("cpp.boost_asio", "async_accept", [1]), ("cpp.boost_asio", "async_connect", [2]), ("cpp.boost_asio", "async_read", [2]), ("cpp.boost_asio", "async_write", [2]), ("cpp.boost_asio", "post", [1]), ("cpp.boost_asio", "dispatch", [1]), ("cpp.boost_asio", "defer", [1]),
]

# Decorators as framework, name, what it makes (an HTTP verb, or a kind of entrypoint).
DECORATORS: list[tuple[str, str, str]] = [
    *[(f, f"{v.capitalize()}Mapping", v.upper()) for f in ("java.spring_mvc", "java.spring") for v in HTTP_VERBS],
    ("java.spring_mvc", "RequestMapping", "HTTP"),
    *[(f, v.upper(), v.upper()) for f in ("java.jakarta_ee", "java.quarkus") for v in HTTP_VERBS],
    *[("java.micronaut", v.capitalize(), v.upper()) for v in HTTP_VERBS],
    *[(f, f"Http{v.capitalize()}", v.upper()) for f in ("csharp.aspnet_core", "csharp.aspnet_mvc", "csharp.aspnet_web_api") for v in HTTP_VERBS],
    *[("javascript.nestjs", v.capitalize(), v.upper()) for v in HTTP_VERBS],
    ("javascript.nestjs", "SubscribeMessage", "webSocket"),
    ("javascript.nestjs_graphql", "Query", "graphql"), ("javascript.nestjs_graphql", "Mutation", "graphql"), ("javascript.nestjs_graphql", "Subscription", "graphql"),
    *[(f, v, v.upper()) for f in ("rust.actix_web", "rust.rocket") for v in HTTP_VERBS],
    ("rust.actix_web", "actix_web::main", "main"), ("rust.tokio", "tokio::main", "main"), ("rust.poem", "handler", "handler"), ("rust.tauri", "tauri::command", "rpc"), ("rust.tauri", "command", "rpc"), ("rust.rocket", "launch", "main"),
]
CONTROLLERS = ["RequestMapping", "Path", "Controller", "Route", "RoutePrefix"]

# Marks of components in decorators, signatures or bases.
COMPONENTS: list[tuple[str, str]] = [
    ("c.qt", "QObject"), ("c.qt", "QWidget"), ("cpp.qt", "QObject"), ("cpp.qt", "QWidget"), ("cpp.mfc", "CWinApp"), ("cpp.mfc", "CDialog"), ("cpp.unreal_engine", "AActor"), ("cpp.unreal_engine", "UObject"), ("cpp.poco", "HTTPRequestHandler"),
    ("csharp.blazor", "ComponentBase"), ("csharp.dotnet_maui", "ContentPage"), ("dart.flutter", "StatelessWidget"), ("dart.flutter", "StatefulWidget"), ("java.spring_boot", "SpringBootApplication"), ("java.spring_mvc", "RestController"),
    ("javascript.react", "Component"), ("javascript.angular", "Component"), ("javascript.vue", "defineComponent"),
]

# RPC registrations as framework, call pattern, place of the service (-1: named by the call).
RPC: list[tuple[str, str, int]] = [("cpp.grpc", r"^RegisterService$", 0), ("go.grpc", r"^Register(\w+)Server$", -1), ("rust.tonic", r"^add_service$", 0)]

# Base classes whose children are tables.
MODELS = {"python.django": ["models.Model", "Model"], "python.sqlalchemy": ["Base", "DeclarativeBase"], "python.sqlmodel": ["SQLModel"]}


def registry(spark: SparkSession) -> DataFrame:
    """framework, language, parent, marker: a row for each marker and language (S-08)."""
    rows = [(f, lang, parent, m) for f, langs, parent, marks in REGISTRY for lang in langs.split() for m in marks]
    return spark.createDataFrame(rows, "framework string, language string, parent string, marker string")


def marker_pattern(marker: str) -> str:
    """A pattern for a marker in a line of code: whole words, import paths from their first part on."""
    quoted = re.escape(marker)
    left = r"(?<![\w.])" if re.match(r"\w", marker) else ""
    right = r"(?![\w])" if re.search(r"\w$", marker) else ""
    return left + quoted + right


def code_lines(files: DataFrame) -> DataFrame:
    """file_id, language, line, content (comments blanked), code (strings blanked too) of files (file_id, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, language, text in zip(pdf["file_id"], pdf["language"], pdf["text"]):
                marks = ("#", ("\"\"\"", "\"\"\"")) if language == "python" else ("//", ("/*", "*/"))
                kept, code = mask(text or "", *marks, quotes=""), mask(text or "", *marks)
                rows += [(file_id, language, n, a, b) for n, (a, b) in enumerate(zip(kept.split("\n"), code.split("\n")), 1)]
            yield pd.DataFrame(rows, columns=["file_id", "language", "line", "content", "code"])

    return files.select("file_id", "language", "text").mapInPandas(run, "file_id string, language string, line int, content string, code string")


def detect(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """framework, file, line: the first line of each file that shows a marker of its language (X-01).

    lines: what code_lines() gives. Names of code count in code alone, paths and packages on import lines.
    """
    content, blank = F.col("content"), F.col("code")
    imports = content.rlike(r"""^\s*(#\s*include|import\b|from\b|using\b|use\b|export\b|package\b|"|'|[A-Za-z_.]\w*\s+"|const\b.*require|var\b.*require)""")
    found = []
    for framework, langs, _, marks in REGISTRY:
        hit = None
        for m in marks:
            code = bool(re.search(r"[A-Z(@#:<]", m))  # names of code, against paths and package names
            one = content.rlike(marker_pattern(m) if code else "(?i)" + marker_pattern(m)) & imports  # paths in any case
            one = one | blank.rlike(marker_pattern(m)) if code else one
            hit = one if hit is None else hit | one
        found.append(F.when(F.col("language").isin(langs.split()) & hit, F.lit(framework)))
    hits = lines.select(file, "language", "line", F.explode(F.array_compact(F.array(*found))).alias("framework"))
    return hits.groupBy("framework", file, "language").agg(F.min("line").alias("line"))


def confidence(detections: DataFrame, file: str = "file_id") -> DataFrame:
    """framework, files, confidence: .65 and .05 for each file with evidence, .99 at most (A-34)."""
    n = detections.groupBy("framework").agg(F.countDistinct(file).alias("files"))
    return n.withColumn("confidence", F.round(F.least(F.lit(0.99), 0.65 + 0.05 * F.col("files")), 2))


def applies(files: DataFrame, detections: DataFrame) -> DataFrame:
    """file_id, framework: frameworks with evidence in the file; without any, the only one of its language (J-21)."""
    local = detections.select("file_id", "framework").distinct()
    alone = detections.groupBy("language").agg(F.countDistinct("framework").alias("n"), F.min("framework").alias("framework")).where("n = 1").select("language", "framework")
    rest = files.select("file_id", "language").join(local.select("file_id").distinct(), "file_id", "left_anti")
    return local.unionByName(rest.join(alone, "language").select("file_id", "framework"))


def dependencies_of(name: str, text: str) -> list[tuple[str, int]]:
    """Dependencies that a manifest names, with their line (X-02)."""
    found: list[str] = []
    low = name.lower()
    try:
        if low == "package.json":
            data = json.loads(text)
            found = [d for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for d in data.get(k) or {}]
        elif low in ("pyproject.toml", "cargo.toml"):
            data = tomllib.loads(text)
            project = data.get("project", {})
            plain = [*project.get("dependencies", []), *(d for g in project.get("optional-dependencies", {}).values() for d in g)]
            tables = [data.get(k, {}) for k in ("dependencies", "dev-dependencies", "build-dependencies")] + [data.get("tool", {}).get("poetry", {}).get("dependencies", {})]
            found = [re.split(r"[\s<>=!~;\[(]", d, maxsplit=1)[0] for d in plain] + [d for t in tables for d in t]
        elif low == "requirements.txt":
            found = [m[1] for m in re.finditer(r"(?m)^\s*([A-Za-z0-9][\w.-]*)", text)]
        elif low == "go.mod":
            blocks = re.findall(r"require\s*\(([^)]*)\)", text) + re.findall(r"(?m)^require\s+([^\s(].*)$", text)
            found = [m for b in blocks for m in re.findall(r"(?m)^\s*([\w.-]+(?:/[\w.-]+)+)", b)]
        elif low == "pom.xml":
            found = [":".join(x) for x in re.findall(r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>", text)]
        elif low.startswith("build.gradle"):
            found = re.findall(r"""(?m)^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(?\s*["']([^"':]+:[^"':]+)""", text)
        elif low == "pubspec.yaml":
            block = re.search(r"(?ms)^(?:dev_)?dependencies:\s*\n(.*?)(?=^\S|\Z)", text)
            found = re.findall(r"(?m)^  ([a-z_][\w]*):", block[1]) if block else []
    except (ValueError, AttributeError, TypeError):
        return []
    lines = text.split("\n")
    where = lambda d: next((i for i, x in enumerate(lines, 1) if d.split(":")[-1] in x), 1)
    return [(d, where(d)) for d in dict.fromkeys(found)]


def manifest_dependencies(manifests: DataFrame) -> DataFrame:
    """path, dependency, line of manifests (path, name, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, d, n) for p, name, t in zip(pdf["path"], pdf["name"], pdf["text"]) for d, n in dependencies_of(name, t or "")], columns=["path", "dependency", "line"])

    return manifests.select("path", "name", "text").mapInPandas(run, "path string, dependency string, line int")


def _arg(args: Column, place: Column) -> Column:
    return F.try_element_at(args, F.when(place < 0, F.size(args)).otherwise(place + 1).cast("int"))


def _split(column: str) -> Column:
    return F.filter(F.split(F.coalesce(column, F.lit("")), ARGUMENT), lambda a: a != "")


def _handlers(rows: DataFrame, units: DataFrame, name: str) -> DataFrame:
    """rows with `handler`: the only unit of the file with that name (J-19)."""
    one = units.where("kind != 'file'").groupBy("file_id", "name").agg(F.min("id").alias("handler"), F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return rows.join(one.withColumnRenamed("name", name), ["file_id", name], "left")


def call_routes(calls: DataFrame, bindings: DataFrame, units: DataFrame, applied: DataFrame, rules: Sequence[tuple] = CALL_ROUTES) -> DataFrame:
    """file_id, framework, unit_id, kind, method, path, line of routes that calls register (X-04, X-18).

    The receiver must come from one of the framework's constructors, or bear one of its usual names. Prefix calls that are
    assigned to a receiver, nested ones too, go before its paths. The handler that is named in the call owns the route.
    """
    spark = calls.sparkSession
    flat = [(f, m, cs, rs, p, h, fixed, kind) for f, ms, cs, rs, p, h, fixed, _, kind in rules for m in ms]
    table = spark.createDataFrame(flat, "framework string, verb string, constructors array<string>, receivers array<string>, path_at int, handler_at int, fixed string, route_kind string")
    own = calls.select("file_id", "unit_id", "callee", F.coalesce("receiver", F.lit("")).alias("receiver"), _split("arguments").alias("args"), "assigned", "start_line", T.last_segment(F.col("callee")).alias("verb"))
    made = bindings.where("kind = 'constructor'").select("file_id", F.col("local_name").alias("receiver"), T.last_segment(F.col("target_name")).alias("made"), F.regexp_extract("target_name", r"^(\w+)\.", 1).alias("of"))
    made = made.unionByName(own.where("assigned is not null").select("file_id", F.col("assigned").alias("receiver"), F.col("verb").alias("made"), F.col("receiver").alias("of")))
    met = own.join(F.broadcast(table), "verb").join(applied, ["file_id", "framework"]).join(made.distinct(), ["file_id", "receiver"], "left")
    # what a framework's package has made is no other framework's
    packages = sorted({f.rpartition(".")[2] for f, *_ in rules})
    source = F.coalesce(F.nullif("of", F.lit("")), "receiver")
    met = met.where(~source.isin(packages) | (source == F.substring_index("framework", ".", -1)))
    met = met.where(F.array_contains("constructors", F.col("made")) | F.array_contains("receivers", F.col("receiver")) | F.col("made").isin([p for r in rules for p in r[7]]))
    raw = T.string_literal(_arg(F.col("args"), F.col("path_at")))
    met = met.withColumn("raw", raw).where("raw is not null")
    grouped = [p for r in rules for p in r[7]]
    mounts = own.where(F.col("verb").isin(grouped) & F.col("assigned").isNotNull())
    mounts = mounts.select(F.concat_ws("\0", "file_id", "assigned").alias("router"), F.concat_ws("\0", "file_id", "receiver").alias("over"), T.string_literal(F.get("args", F.lit(0))).alias("prefix")).where("prefix is not null")
    tops = mounts.select("over").subtract(mounts.select("router")).select(F.col("over").alias("router"), F.lit(None).cast("string").alias("over"), F.lit("").alias("prefix"))
    full = fixpoint_prefixes(mounts.unionByName(tops), "router", "over", "prefix", P.join_paths)
    met = met.withColumn("router", F.concat_ws("\0", "file_id", "receiver")).join(full, "router", "left")
    handler = F.coalesce(_arg(F.col("args"), F.col("handler_at")), F.lit(""))
    wrapped = F.regexp_extract(handler, rf"^({'|'.join(HTTP_VERBS)})\(", 1)  # `get(handler)`
    met = met.withColumn("name", T.last_segment(F.regexp_extract(handler, r"^(?:&|\w+\()?([\w.:]+)\)?$", 1))).withColumn("wrapped", F.nullif(F.upper(wrapped), F.lit("")))
    met = _handlers(met, units, "name")
    verb = F.upper(F.regexp_replace("verb", "^Map", ""))
    return met.select("file_id", "framework", F.coalesce("handler", "unit_id").alias("unit_id"), F.col("route_kind").alias("kind"), F.coalesce("wrapped", "fixed", verb).alias("method"), P.join_paths(F.coalesce("prefix", F.lit("")), F.col("raw")).alias("path"), F.col("start_line").alias("line")).distinct()


def decorator_routes(decorators: DataFrame, units: DataFrame, applied: DataFrame, rules: Sequence[tuple] = DECORATORS, controllers: Sequence[str] = CONTROLLERS) -> DataFrame:
    """file_id, framework, unit_id, kind, method, path, line of entrypoints that decorators declare (X-05 to X-07, X-14).

    The path of the class around a method, from its controller decorator, goes first; a bare `/` that the same unit also
    declares with a longer path is left out.
    """
    table = decorators.sparkSession.createDataFrame(list(rules), "framework string, name string, makes string")
    text = F.regexp_replace(F.coalesce(F.get(_split("arguments"), F.lit(0)), F.lit("")), r"^(value|path|url|route)\s*=\s*", "")
    literal = F.coalesce(T.string_literal(text), F.lit(""))
    own = decorators.select("file_id", "unit_id", "name", literal.alias("raw"), F.col("start_line").alias("line"))
    parent = units.select(F.col("id").alias("unit_id"), "parent_id", F.col("kind").alias("unit_kind"))
    heads = own.where(F.col("name").isin(list(controllers))).groupBy(F.col("unit_id").alias("parent_id")).agg(F.max("raw").alias("prefix"))
    paths = own.where("name in ('Path', 'Route')").groupBy("unit_id").agg(F.max("raw").alias("own_path"))
    met = own.join(F.broadcast(table), "name").join(applied, ["file_id", "framework"]).join(parent, "unit_id").where("unit_kind not in ('class', 'interface', 'struct')")
    met = met.join(heads, "parent_id", "left").join(paths, "unit_id", "left")
    http = F.col("makes").isin([v.upper() for v in HTTP_VERBS] + ["HTTP"])
    path = P.join_paths(F.coalesce("prefix", F.lit("")), F.when(F.col("raw") == "", F.coalesce("own_path", F.lit(""))).otherwise(F.col("raw")))
    out = met.select("file_id", "framework", "unit_id", F.when(http, "http").otherwise(F.col("makes")).alias("kind"), F.when(http, F.col("makes")).alias("method"), F.when(http, path).otherwise(F.nullif("raw", F.lit(""))).alias("path"), "line").distinct()
    longer = out.where("path != '/'").select("unit_id", "method").distinct()
    return out.where("path is null or path != '/'").unionByName(out.where("path = '/'").join(longer, ["unit_id", "method"], "left_anti").select(out.columns))


def callbacks(calls: DataFrame, units: DataFrame, applied: DataFrame, rules: Sequence[tuple] = CALLBACKS) -> DataFrame:
    """file_id, framework, unit_id, name, line of functions that calls register as callbacks (X-08)."""
    table = calls.sparkSession.createDataFrame(list(rules), "framework string, verb string, places array<int>")
    own = calls.select("file_id", T.last_segment(F.col("callee")).alias("verb"), _split("arguments").alias("args"), F.col("start_line").alias("line"))
    met = own.join(F.broadcast(table), "verb").join(applied, ["file_id", "framework"]).withColumn("place", F.explode("places"))
    met = met.withColumn("name", T.last_segment(F.regexp_extract(F.coalesce(_arg(F.col("args"), F.col("place")), F.lit("")), r"^(?:&|G_CALLBACK\()?([\w.:]+)\)?$", 1)))
    return _handlers(met.where("name != ''"), units, "name").where("handler is not null").select("file_id", "framework", F.col("handler").alias("unit_id"), "name", "line")


def components(units: DataFrame, decorators: DataFrame, calls: DataFrame, applied: DataFrame, marks: Sequence[tuple] = COMPONENTS) -> DataFrame:
    """unit_id, framework of units with a mark in a decorator, a call, their bases or signature (X-09, X-12)."""
    table = F.broadcast(units.sparkSession.createDataFrame(list(marks), "framework string, mark string"))
    words = units.select("file_id", F.col("id").alias("unit_id"), F.explode(F.array_distinct(F.split(F.concat_ws(" ", "signature", "bases"), r"[^\w]+"))).alias("mark"))
    words = words.unionByName(decorators.select("file_id", "unit_id", F.col("name").alias("mark"))).unionByName(calls.select("file_id", "unit_id", T.last_segment(F.col("callee")).alias("mark")))
    return words.join(table, "mark").join(applied, ["file_id", "framework"]).select("unit_id", "framework").distinct()


# Frameworks whose files are routes.
PAGES = ["javascript.nextjs", "javascript.nuxt", "javascript.sveltekit", "dart.dart_frog"]


def file_routes(files: DataFrame, applied: DataFrame) -> DataFrame:
    """file_id, framework, path of page files (X-11)."""
    web = files.join(applied, "file_id").where(F.col("framework").isin(PAGES))
    inside = F.regexp_extract("path", r"(?:^|/)(?:pages|app|routes|server/routes|server/api)/(.*)$", 1)
    bare = F.regexp_replace(inside, r"(^|/)(page|route|\+page|\+server|\+page\.server)\.[a-z]+$", "$1index.x")
    return web.where(inside != "").select("file_id", "framework", P.file_route(bare).alias("path"))


def rpc_services(calls: DataFrame, applied: DataFrame, rules: Sequence[tuple] = RPC) -> DataFrame:
    """file_id, framework, unit_id, service, line of RPC registrations (X-13)."""
    out = None
    own = calls.join(applied, "file_id").withColumn("verb", T.last_segment(F.col("callee"))).withColumn("args", _split("arguments"))
    for framework, pattern, place in rules:
        name = F.regexp_extract("verb", pattern, 1) if place < 0 else F.regexp_extract(F.coalesce(F.get("args", F.lit(place)), F.lit("")), r"([A-Za-z_]\w*)", 1)
        one = own.where((F.col("framework") == framework) & F.col("verb").rlike(pattern)).select("file_id", "framework", "unit_id", name.alias("service"), F.col("start_line").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def orm_tables(units: DataFrame, applied: DataFrame) -> DataFrame:
    """unit_id, framework, model, table: model classes by their bases; the table is the class name in snake case (X-19)."""
    out = None
    for framework, bases in MODELS.items():
        hit = F.exists(F.split(F.coalesce("bases", F.lit("")), r",\s*"), lambda b: b.isin(bases))
        one = units.where((F.col("kind") == "class") & hit).join(applied.where(F.col("framework") == framework), "file_id").select(F.col("id").alias("unit_id"), "framework", F.col("name").alias("model"), T.snake_case(F.col("name")).alias("table"))
        out = one if out is None else out.unionByName(one)
    return out


def orm_access(calls: DataFrame, models: DataFrame) -> DataFrame:
    """unit_id, table, mode: calls whose callee or arguments name a model, write by the call's name (X-19, J-28)."""
    words = F.array_distinct(F.split(F.concat_ws(" ", "callee", F.regexp_replace(F.coalesce("arguments", F.lit("")), ARGUMENT, " ")), r"[^\w]+"))
    verb = F.lower(T.last_segment(F.col("callee")))
    mode = F.when(verb.rlike("^(add|create|insert|save|update|delete|merge|bulk_|remove|execute$)"), "write").otherwise("read")
    rows = calls.select("unit_id", mode.alias("mode"), F.explode(words).alias("model"))
    return rows.join(models.select("model", "table").distinct(), "model").groupBy("unit_id", "table").agg(F.max("mode").alias("mode"))


def manifest_matches(dependencies: DataFrame) -> DataFrame:
    """framework, path, language, line of the manifests that name a framework's package (X-02).

    A dependency matches a marker that equals it or one of its leading parts (`github.com/gin-gonic/gin/v2` names
    `github.com/gin-gonic/gin`); the markers are literals of the plan.
    """
    rows = [(f, lang.split()[0], m.lower().rstrip("/")) for f, lang, _, marks in REGISTRY for m in marks if re.fullmatch(r"[@A-Za-z0-9_./-]+", m)]
    table = dependencies.sparkSession.createDataFrame(rows, "framework string, language string, marker string")
    low = F.lower("dependency")
    parts = F.split(low, "[/:]")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    names = F.array_distinct(F.concat(heads, F.array(low, F.element_at(parts, -1))))
    met = dependencies.select("path", "line", F.explode(names).alias("marker")).join(F.broadcast(table), "marker")  # the registry is bounded
    return met.groupBy("framework", "path", "language").agg(F.min("line").alias("line"))


def framework_ids(detections: DataFrame, file: str = "file_id") -> DataFrame:
    """Sorted frameworks of each file (J-31)."""
    return detections.groupBy(file).agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))


def module_aliases(units: DataFrame) -> DataFrame:
    """file_id, module: every suffix of a file's module path by which it may be imported (J-31)."""
    parts = F.split("qualified_name", "::")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return units.where("kind = 'file'").select("file_id", F.explode(tails).alias("module"))


def attach(entrypoints: DataFrame, detections: DataFrame) -> DataFrame:
    """entrypoints (file_id, id, start_line) with the framework whose marker is nearest in their file (X-03, J-22)."""
    from .joins import nearest

    best = nearest(entrypoints.select("file_id", "id", "start_line"), detections.select("file_id", "line", "framework"), ["file_id"], "id", "start_line", "line", "framework")
    return entrypoints.join(best.select("id", "framework"), "id", "left")


# Calls that register a handler for a named event.
EVENTS = ["on", "once", "addEventListener", "addListener", "subscribe", "addHandler"]


def call_events(calls: DataFrame, units: DataFrame, names: Sequence[str] = EVENTS) -> DataFrame:
    """file_id, unit_id, name, line of events that calls register (X-10): the handler that is named owns the event, else
    the unit around the call. Only a literal is an event's name."""
    args = _split("arguments")
    own = calls.where(T.last_segment(F.col("callee")).isin(list(names)) & F.contains("callee", F.lit(".")))
    own = own.select("file_id", "unit_id", F.col("start_line").alias("line"), T.string_literal(F.get(args, F.lit(0))).alias("event"), F.regexp_extract(F.coalesce(F.get(args, F.lit(1)), F.lit("")), r"^(?:this\.)?([A-Za-z_$][\w$]*)$", 1).alias("name"))
    met = _handlers(own.where("event is not null"), units, "name")
    return met.select("file_id", F.coalesce("handler", "unit_id").alias("unit_id"), F.col("event").alias("name"), "line")


def qualified_handlers(rows: DataFrame, units: DataFrame, name: str) -> DataFrame:
    """rows with `handler`: the only unit that `Class::method` in `name` can mean, where some ancestor of the method
    bears the class's name (J-29)."""
    tail = F.substring_index(name, "::", -1)
    head = F.substring_index(F.expr(f"substring({name}, 1, length({name}) - length(substring_index({name}, '::', -1)) - 2)"), "::", -1)
    named = units.select(F.col("id").alias("unit"), F.col("name").alias("__tail"))
    chain = ancestors(units.select("id", "parent_id"), "id", "parent_id").where("depth > 0").select(F.col("id").alias("unit"), F.col("ancestor").alias("id"))
    above = chain.join(units.select("id", F.col("name").alias("__head")), "id").select("unit", "__head").distinct()
    own = rows.withColumn("__tail", tail).withColumn("__head", F.when(F.contains(F.col(name), F.lit("::")), head))
    full = units.select(F.col("id").alias("unit"), F.explode(F.array(F.substring_index("qualified_name", "::", -2))).alias("__full"))
    by_chain = own.where("__head is not null").join(named.select("unit", "__tail"), "__tail").join(above, ["unit", "__head"], "left_semi")
    by_name = own.where("__head is not null").withColumn("__full", F.concat_ws("::", "__head", "__tail")).join(full, "__full").drop("__full")
    hits = by_chain.select(*rows.columns, "unit").unionByName(by_name.select(*rows.columns, "unit")).distinct()
    # a prototype and its definition bear one name: the longer one stands for both
    hits = hits.join(units.select(F.col("id").alias("unit"), "qualified_name", (F.col("end_line") - F.col("start_line")).alias("__lines")), "unit")
    one = hits.groupBy(*rows.columns).agg(F.max_by("unit", F.struct("__lines", "unit")).alias("handler"), F.countDistinct("qualified_name").alias("__n")).where("__n = 1").drop("__n")
    return rows.join(one, rows.columns, "left")


# Macros as framework, name, places of handler, path and first method.
MACROS: list[tuple[str, str, int, int, int]] = [("cpp.drogon", "ADD_METHOD_TO", 0, 1, 2), ("cpp.drogon", "METHOD_ADD", 0, 1, 2), ("cpp.drogon", "PATH_ADD", -1, 0, 1), ("cpp.crow", "CROW_ROUTE", -1, 1, 9), ("cpp.crow", "CROW_BP_ROUTE", -1, 1, 9)]


def macro_routes(calls: DataFrame, units: DataFrame, applied: DataFrame, rules: Sequence[tuple] = MACROS) -> DataFrame:
    """file_id, framework, unit_id, kind, method, path, line of routes that macros declare, a row for each method (X-15).

    Methods stand among the macro's arguments, or in a `.methods(...)` call on the same line; without any it is HTTP.
    """
    table = F.broadcast(calls.sparkSession.createDataFrame(list(rules), "framework string, verb string, handler_at int, path_at int, method_at int"))
    own = calls.select("file_id", "unit_id", "callee", _split("arguments").alias("args"), F.col("start_line").alias("line"), T.last_segment(F.col("callee")).alias("verb"))
    clean = lambda a: F.upper(F.regexp_replace(F.regexp_replace(a, r"_method$", ""), r"[\"']|.*::", ""))
    said = own.where("verb = 'methods'").select("file_id", "line", F.transform("args", clean).alias("said"))
    met = own.join(table, "verb").join(applied, ["file_id", "framework"]).join(said, ["file_id", "line"], "left")
    verbs = [v.upper() for v in HTTP_VERBS]
    inside = F.filter(F.transform(F.slice("args", F.col("method_at") + 1, F.lit(100)), clean), lambda m: m.isin(verbs))
    every = F.when(F.size(inside) > 0, inside).when(F.size(F.coalesce("said", F.array())) > 0, F.col("said")).otherwise(F.array(F.lit("HTTP")))
    met = met.withColumn("raw", T.string_literal(F.get("args", F.col("path_at")))).where("raw is not null")
    met = met.withColumn("name", F.when(F.col("handler_at") >= 0, F.regexp_extract(F.coalesce(F.get("args", F.greatest("handler_at", F.lit(0))), F.lit("")), r"^&?([\w:]+)$", 1)).otherwise(F.lit("")))
    met = met.select("file_id", "framework", "unit_id", "line", "raw", "name", F.explode(every).alias("method"))
    named = qualified_handlers(met.select("name").where("name != ''").distinct(), units, "name").where("handler is not null")
    return met.join(named, "name", "left").select("file_id", "framework", F.coalesce("handler", "unit_id").alias("unit_id"), F.lit("http").alias("kind"), "method", P.join_paths(F.lit(""), F.col("raw")).alias("path"), "line")


def conventional_routes(units: DataFrame, decorators: DataFrame, applied: DataFrame, framework: str = "csharp.aspnet_mvc") -> DataFrame:
    """file_id, framework, unit_id, kind, method, path, line of public actions of controllers that declare no route:
    `/{area}/{controller}/{action}` (X-16). Actions with a verb or route of their own are not conventional."""
    routed = decorators.where(F.col("name").isin("Route", *[f"Http{v.capitalize()}" for v in HTTP_VERBS]))
    literal = T.string_literal(F.coalesce(F.get(_split("arguments"), F.lit(0)), F.lit("")))
    area = decorators.where("name = 'Area'").groupBy(F.col("unit_id").alias("parent_id")).agg(F.max(literal).alias("area"))
    owner = units.where("kind = 'class'").where(F.endswith("name", F.lit("Controller")) & (F.col("name") != "Controller"))
    owner = owner.join(routed.select(F.col("unit_id").alias("id")), "id", "left_anti").select(F.col("id").alias("parent_id"), F.regexp_replace("name", "Controller$", "").alias("controller"))
    actions = units.where("kind = 'method' and visibility = 'public'").join(routed.select(F.col("unit_id").alias("id")), "id", "left_anti")
    met = actions.select("file_id", "id", "name", "start_line", "parent_id").join(owner, "parent_id").join(area, "parent_id", "left").join(applied.where(F.col("framework") == framework), "file_id")
    parts = F.array_compact(F.array("area", "controller", "name"))
    return met.select("file_id", "framework", F.col("id").alias("unit_id"), F.lit("http").alias("kind"), F.lit("HTTP").alias("method"), F.concat(F.lit("/"), F.array_join(parts, "/")).alias("path"), F.col("start_line").alias("line"))


def combine_prefix(above: Column, own: Column) -> Column:
    """A prefix below another; null, which stands for one that is not known before the program runs, stays null (F-33)."""
    joined = P.join_paths(above, own)
    return F.when(above.isNull() | own.isNull(), F.lit(None)).when(F.length(own) == 0, above).when(F.length(above) == 0, own).otherwise(joined)


# Constructors of routers and applications, calls that mount one on another, their prefix keywords.
ROUTERS, APPS = ["APIRouter", "Blueprint", "Router"], ["FastAPI", "Flask", "Starlette", "Sanic", "Quart"]
MOUNTS = ["include_router", "register_blueprint", "blueprint", "mount"]


def router_routes(calls: DataFrame, bindings: DataFrame, units: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """id, path: a row for each mount of the router that an entrypoint's decorator names (X-17).

    Routers are mounted on applications and on each other, in other files too, to any depth; a prefix that is no
    literal makes the path null. A router that nothing mounts has its own prefix alone.
    """
    def keyword(args: Column, *names: str) -> Column:
        """The value of one of these arguments: the literal, null if it is not known, empty if it is not given."""
        given = F.get(F.filter(args, lambda a: a.rlike(rf"^\s*({'|'.join(names)})\s*=")), F.lit(0))
        return F.when(given.isNull(), F.lit("")).otherwise(T.string_literal(F.regexp_replace(given, r"^[^=]*=\s*", "")))

    own = calls.select("file_id", "callee", "receiver", "assigned", _split("arguments").alias("args"), T.last_segment(F.col("callee")).alias("verb"))
    made = own.where(F.col("assigned").isNotNull() & F.col("verb").isin(ROUTERS + APPS))
    symbol = lambda f, n: F.concat_ws("\0", f, n)
    routers = made.select(symbol("file_id", "assigned").alias("router"), keyword(F.col("args"), "prefix", "url_prefix").alias("own"), F.col("verb").isin(APPS).alias("app"))
    routers = routers.groupBy("router").agg(F.min_by("own", "app").alias("own"), F.max("app").alias("app"))
    # a mounted name is one of the file, an imported one, or a member of an imported module
    mounts = own.where(F.col("verb").isin(MOUNTS)).select("file_id", symbol("file_id", F.coalesce("receiver", F.lit(""))).alias("over"), F.get("args", F.lit(0)).alias("name"), keyword(F.col("args"), "prefix", "url_prefix").alias("mounted"))
    modules = module_aliases(units).withColumnRenamed("file_id", "target_file")
    bound = bindings.where("kind in ('import', 'alias')").select("file_id", F.col("local_name").alias("head"), F.regexp_replace("target_name", r"^\.+", "").alias("target"))
    dotted = mounts.withColumn("head", F.regexp_extract("name", r"^\w+", 0)).withColumn("rest", F.regexp_extract("name", r"\.(\w+)$", 1))
    met = dotted.join(bound, ["file_id", "head"], "left")
    module = F.when(F.col("rest") != "", F.col("target")).otherwise(F.regexp_replace("target", r"\.[^.]+$", ""))
    leaf = F.when(F.col("rest") != "", F.col("rest")).otherwise(F.substring_index("target", ".", -1))
    met = met.withColumn("module", module).join(modules, "module", "left")
    child = F.when(F.col("target").isNull(), symbol("file_id", "name")).otherwise(symbol("target_file", leaf))
    links = met.select(child.alias("router"), "over", "mounted").where(F.contains("router", F.lit("\0"))).distinct()
    links = links.join(routers.select("router", "own"), "router").select("router", "over", combine_prefix(F.col("mounted"), F.col("own")).alias("prefix"))
    lone = routers.join(links.select("router").distinct(), "router", "left_anti").select("router", F.lit(None).cast("string").alias("over"), F.col("own").alias("prefix"))
    # a null prefix must not vanish in a join on strings: it is carried as a mark and taken off at the end
    mark = "\1"
    lifted = links.unionByName(lone).withColumn("prefix", F.coalesce("prefix", F.lit(mark)))
    known = lambda c: F.when(~F.contains(c, F.lit(mark)), c)
    full = fixpoint_prefixes(lifted, "router", "over", "prefix", lambda a, b: F.coalesce(combine_prefix(known(a), known(b)), F.lit(mark)))
    points = entrypoints.where("receiver is not null and route is not null").select("id", symbol("file_id", "receiver").alias("router"), "route")
    return points.join(full, "router").select("id", F.when(known(F.col("prefix")).isNull(), F.lit(None)).otherwise(P.join_paths(F.col("prefix"), F.col("route"))).alias("path")).distinct()


ROUTE_COLUMNS = ["file_id", "framework", "unit_id", "kind", "method", "path", "line"]


def enrich(files: DataFrame, t: dict[str, DataFrame], applied: DataFrame, found: DataFrame) -> DataFrame:
    """Entrypoints of an analysis with those that frameworks declare, in a fixed order (X-03): what lines show gets the
    nearest framework; routes of calls, decorators, macros, conventions and files, callbacks, events, services and
    Python routers follow. A specific row takes the place of the generic one of its file and line (O-06).

    Columns: id, file_id, unit_id, kind, method, path, line, framework.
    """
    kind = lambda name: F.lit(name).alias("kind")
    none = F.lit(None).cast("string")
    units, calls, marks = t["units"], t["call_sites"], t["decorators"]
    # a rule of a framework that is nowhere is no part of the plan; the registry bounds the names
    here = {r.framework for r in found.select("framework").distinct().collect()}
    rules = [
        ({r[0] for r in CALL_ROUTES}, lambda: call_routes(calls, t["bindings"], units, applied)),
        ({r[0] for r in DECORATORS}, lambda: decorator_routes(marks, units, applied)),
        ({r[0] for r in MACROS}, lambda: macro_routes(calls, units, applied)),
        ({"csharp.aspnet_mvc"}, lambda: conventional_routes(units, marks, applied)),
        ({r[0] for r in CALLBACKS}, lambda: callbacks(calls, units, applied).select("file_id", "framework", "unit_id", kind("callback"), none.alias("method"), F.col("name").alias("path"), "line")),
        ({r[0] for r in RPC}, lambda: rpc_services(calls, applied).select("file_id", "framework", "unit_id", kind("rpc"), none.alias("method"), F.col("service").alias("path"), "line")),
        (set(PAGES), lambda: file_routes(files, applied).join(units.where("kind = 'file'").select("file_id", F.col("id").alias("unit_id")), "file_id").select("file_id", "framework", "unit_id", kind("http"), F.lit("HTTP").alias("method"), "path", F.lit(1).alias("line"))),
    ]
    specific = call_events(calls, units).select("file_id", none.alias("framework"), "unit_id", kind("event"), none.alias("method"), F.col("name").alias("path"), "line")
    for names, rule in rules:
        if names & here:
            specific = specific.unionByName(rule().select(*ROUTE_COLUMNS))
    generic = attach(t["entrypoints"], found) if here else t["entrypoints"].withColumn("framework", none)
    path = F.col("route")
    if any(name.startswith("python.") for name in here):
        mounted = router_routes(calls, t["bindings"], units, t["entrypoints"]).withColumnRenamed("path", "mounted")
        generic = generic.join(mounted.withColumn("__hit", F.lit(True)), "id", "left")
        path = F.when(F.col("__hit"), F.col("mounted")).otherwise(F.col("route"))
    generic = generic.select("file_id", "framework", "unit_id", "kind", "method", path.alias("path"), F.col("start_line").alias("line"))
    if here:  # the path of a controller is a prefix, no route (X-07); a line that a rule reads is no generic route
        heads = marks.where(F.col("name").isin(CONTROLLERS)).join(units.where("kind in ('class', 'interface')").select(F.col("id").alias("unit_id")), "unit_id", "left_semi")
        taken = specific.where("kind = 'http'").select("file_id", "line").unionByName(heads.select("file_id", F.col("start_line").alias("line"))).distinct()
        generic = generic.where("kind != 'http'").unionByName(generic.where("kind = 'http'").join(taken, ["file_id", "line"], "left_anti"))
    out = specific.unionByName(generic).groupBy("file_id", "unit_id", "kind", "method", "path", "line").agg(F.max("framework").alias("framework"))
    return out.withColumn("id", T.stable_id("entry_", "file_id", "unit_id", "kind", F.coalesce("method", F.lit("")), F.coalesce("path", F.lit("")), F.col("line").cast("string")))
