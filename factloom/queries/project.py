"""Queries over small source projects: no table holds code, so each has its files here and literal rows as its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evaluate, extract, gates, graph, rules
from ..operators import frameworks as K
from ..plans import formation, overview
from ..plans.analyze import Tables, add_frameworks, analyze, split_facts, validated
from ..plans.lens import Lens
from ..plans.profile import progress_events, progress_line, stage_percent
from ..session import ship
from .expected import ROWS, rows
from .registry import query

Project = list[tuple[str, str, str]]

#: A service in three languages, with a branch, loops, a try, a cycle of calls, tables and a dynamic call.
SHOP: Project = [
    ("f1", "src/orders/api.py", 'from fastapi import FastAPI\nfrom src.orders.store import Store\n\napp = FastAPI()\n\n\n@app.get("/api/v1/orders/{id}")\ndef read(id: int):\n    store = Store()\n    return store.load(id)\n\n\n@app.post("/orders")\ndef create(body):\n    if not body:\n        raise ValueError("empty")\n    return save_order(body)\n\n\ndef save_order(body):\n    return Store().save(body)\n'),
    ("f2", "src/orders/store.py", 'class Store:\n    def load(self, id):\n        return self.run("SELECT * FROM orders WHERE id = 1")\n\n    def save(self, body):\n        for line in body:\n            self.run("INSERT INTO order_lines VALUES (1)")\n        return self.check(body)\n\n    def check(self, body):\n        return body and self.save(body[1:])\n\n    def run(self, sql):\n        try:\n            return eval(sql)\n        finally:\n            print(sql)\n'),
    ("f3", "web/client.ts", "import { get } from './http';\nexport async function loadOrder(id) {\n  return await get('/api/v1/orders/' + id);\n}\nrouter.get('/health', loadOrder);\nbus.on('order.created', loadOrder);\n"),
    ("f4", "web/http.ts", "export function get(path) { return fetch(path); }\n"),
    ("f5", "cmd/main.go", "package main\n\nfunc helper(a int) int { return a }\n\nfunc main() { helper(1) }\n"),
    ("f6", "src/broken.py", "def broken(:\n"),
]

#: Components and a route of native and .NET frameworks.
NATIVE: Project = [
    ("n1", "widget.c", "#include <QtCore/QObject>\nstruct Panel { QObject* object; };\n"),
    ("n2", "native.cpp", '#include <afxwin.h>\n#include "CoreMinimal.h"\nclass MainWindow : public CWinApp {};\nclass Monster : public AActor {};\n'),
    ("n3", "program.cs", 'using Microsoft.AspNetCore;\nusing Microsoft.AspNetCore.Components;\nusing Microsoft.Maui.Controls;\n\nclass Program {\n  void Setup(WebApplication app) { app.MapGet("/status-page", Show); }\n  void Show() {}\n}\nclass Panel : ComponentBase {}\nclass Start : ContentPage {}\n'),
]

#: Routers of Go.
GO: Project = [
    ("g1", "routes.go", 'package main\n\nimport (\n\t"net/http"\n\t"github.com/gin-gonic/gin"\n\t"github.com/labstack/echo/v4"\n\t"github.com/gofiber/fiber/v2"\n\t"github.com/go-chi/chi/v5"\n\tbeego "github.com/beego/beego/v2/server/web"\n)\n\nfunc serve() {}\nfunc wire() {\n\tg := gin.Default()\n\tg.GET("/from-gin", serve)\n\te := echo.New()\n\te.GET("/from-echo", serve)\n\tapp := fiber.New()\n\tapp.Get("/from-fiber", serve)\n\tr := chi.NewRouter()\n\tr.Get("/from-chi", serve)\n\tbeego.Get("/from-beego", serve)\n\thttp.HandleFunc("/from-http", serve)\n}\n'),
]

#: Servers and page files of ECMAScript.
ECMA: Project = [
    ("e1", "router.ts", 'import fastify from "fastify";\nimport Koa from "koa";\nimport Router from "@koa/router";\n\nfunction serve() {}\nconst server = fastify();\nserver.get("/from-fastify", serve);\nconst app = new Koa();\nconst router = new Router();\nrouter.get("/from-koa", serve);\n'),
    ("e2", "server/api/users.ts", 'import { defineEventHandler } from "nuxt";\nexport function GET() { return defineEventHandler(() => "ok"); }\n'),
    ("e3", "routes/items/+server.ts", 'import type { RequestHandler } from "@sveltejs/kit";\nexport const GET: RequestHandler = async () => new Response("ok");\n'),
]

#: Routes of Java, Python, Dart and Rust.
POLYGLOT: Project = [
    ("p1", "Stock.java", 'import io.quarkus.runtime.Quarkus;\n@Path("/stock")\nclass Stock {\n  @GET\n  @Path("/parts")\n  void parts() {}\n}\n'),
    ("p2", "Cart.java", 'import io.micronaut.http.annotation.Controller;\nimport io.micronaut.http.annotation.Get;\n@Controller("/cart")\nclass Cart {\n  @Get("/lines")\n  void lines() {}\n}\n'),
    ("p3", "site.py", 'from sanic import Sanic\napp = Sanic("site")\n@app.get("/from-sanic")\nasync def front(request):\n    return request\n'),
    ("p4", "shelf.dart", 'import "package:shelf/shelf.dart";\nvoid serve() {}\nvoid setup(Router router) { router.get("/from-shelf", serve); }\n'),
    ("p5", "axum.rs", 'use axum::{routing::get, Router};\nfn serve() {}\nfn build() { let app = Router::new().route("/from-axum", get(serve)); }\n'),
]

#: Routers across files, with a prefix that only the running program knows; macros, conventions and events.
ROUTERS: Project = [
    ("r1", "shop/main.py", 'from fastapi import FastAPI\nfrom shop import users\nfrom shop.carts import router as carts\n\nBASE = load()\napp = FastAPI()\napp.include_router(users.router, prefix="/v1")\napp.include_router(carts, prefix=BASE)\n'),
    ("r2", "shop/users.py", 'from fastapi import APIRouter\nfrom shop.roles import inner\n\nrouter = APIRouter(prefix="/users")\nrouter.include_router(inner, prefix="/admin")\n\n\n@router.get("/{id}")\ndef read(id):\n    return id\n'),
    ("r3", "shop/roles.py", 'from fastapi import APIRouter\n\ninner = APIRouter()\n\n\n@inner.post("/roles")\ndef add(body):\n    return body\n'),
    ("r4", "shop/carts.py", 'from fastapi import APIRouter\n\nrouter = APIRouter(prefix="/carts")\n\n\n@router.get("/open")\ndef open_carts():\n    return []\n'),
    ("r5", "todo.cpp", '#include <drogon/HttpController.h>\nusing namespace drogon;\nclass Todos {\n public:\n  METHOD_LIST_BEGIN\n  ADD_METHOD_TO(Todos::list, "/todos", Get, Post);\n  METHOD_LIST_END\n  void list(int q);\n};\nvoid Todos::list(int q) { q; }\n'),
    ("r6", "Pages.cs", 'using System.Web.Mvc;\n[Area("Admin")]\npublic class ReportController : Controller {\n  public string Index() { return "x"; }\n  [HttpGet("/own")]\n  public string Own() { return "x"; }\n  private void Hidden() {}\n}\n'),
]
PROJECTS = {"shop": SHOP, "native": NATIVE, "go": GO, "ecma": ECMA, "polyglot": POLYGLOT, "routers": ROUTERS}

#: Analyses of a session's projects, so that the queries share them.
_done: dict[tuple[str, str], Tables] = {}


def files_of(lens: Lens, name: str) -> DataFrame:
    ship(lens.spark)
    return lens.spark.createDataFrame(PROJECTS[name], "file_id string, path string, text string")


def analysis(lens: Lens, name: str) -> Tables:
    key = lens.spark.sparkContext.applicationId, name
    if key not in _done:
        _done[key] = analyze(files_of(lens, name))
    return _done[key]


def frameworks_of(lens: Lens, name: str) -> Tables:
    """Facts and frameworks alone, without resolution, flows and domains."""
    key = lens.spark.sparkContext.applicationId, "frameworks " + name
    if key not in _done:
        files = files_of(lens, name)
        t = Tables(split_facts(graph.cut(extract.extract(files))))
        add_frameworks(t, files, None)
        _done[key] = t
    return _done[key]


def features_of(lens: Lens) -> DataFrame:
    return overview.features(analysis(lens, "shop"))


def _named(t: Tables, rows: DataFrame, unit: str, name: str) -> DataFrame:
    """rows with the qualified name of the unit in `unit`."""
    return rows.join(t.units.select(F.col("id").alias(unit), F.col("qualified_name").alias(name)), unit, "left")


@query(ROWS["extract_facts"])
def extract_facts(lens: Lens) -> DataFrame:
    """U-01 to U-21: fact rows of a small project."""
    rows = extract.extract(files_of(lens, "shop")).where("fact_kind not in ('node', 'edge', 'control')")
    return rows.select("path", "fact_kind", "kind", "name", "target", "start_line", "end_line")


@query(ROWS["control_facts"])
def control_facts(lens: Lens) -> DataFrame:
    """U-09: control statements with their conditions."""
    t = analysis(lens, "shop")
    return _named(t, t.control_flow, "unit_id", "owner").select("owner", "kind", "condition", "start_line", "end_line")


@query(ROWS["unit_details"])
def unit_details(lens: Lens) -> DataFrame:
    """U-04 to U-06, U-18: kinds, parameters, visibility and parents of units in six projects."""
    out = None
    for name in PROJECTS:
        t = split_facts(extract.extract(files_of(lens, name)))
        one = t["units"].where("kind != 'file'").select(F.lit(name).alias("project"), "qualified_name", "kind", "parameters", "bases", "returns", "visibility")
        out = one if out is None else out.unionByName(one)
    return out


@query(ROWS["analyze_domains"])
def analyze_domains(lens: Lens) -> DataFrame:
    """The main query over a small project: domains with their score (C-01)."""
    return analysis(lens, "shop").domains


@query(ROWS["analyze_references"])
def analyze_references(lens: Lens) -> DataFrame:
    """J-01 to J-04, J-27, P-06: references of a small project, resolved."""
    t = analysis(lens, "shop")
    return _named(t, t.references, "target_id", "qualified_name").select("file_id", "kind", "target_name", "qualified_name", "status", "start_line")


@query(ROWS["analyze_features"])
def analyze_features(lens: Lens) -> DataFrame:
    """A-22, C-12, J-17: features with the edges, resources and boundaries of all that they reach."""
    return features_of(lens).select("feature", "key", "label", "kind", "status", "level", "domain_ids", "resolved", "unresolved", "dynamic", "reachable", F.size("resources").alias("resources"), F.size("boundaries").alias("boundaries"))


@query(ROWS["operation_features"])
def operation_features(lens: Lens) -> DataFrame:
    """C-12: a project without entrypoints has its exported units that nothing calls as features."""
    t = analyze(files_of(lens, "ecma").where("file_id = 'e3'").unionByName(lens.spark.createDataFrame([("x", "lib/sum.ts", "export function sum(a, b) { return add(a, b); }\nfunction add(a, b) { return a + b; }\n")], "file_id string, path string, text string")).where("file_id = 'x'"))
    return overview.features(t).select("feature", "key", "kind", "status", "level", "reachable")


@query(ROWS["cfg_edges"])
def cfg_edges(lens: Lens) -> DataFrame:
    """G-08, P-22: control-flow edges of the project's functions, by what they join."""
    t = analysis(lens, "shop")
    nodes = lambda side: t.flow_nodes.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"), F.col("label").alias(f"{side}_label"))
    both = t.flow_edges.join(nodes("source"), "source_id").join(nodes("target").withColumnRenamed("target_id", "target_id"), "target_id")
    return _named(t, both, "unit_id", "owner").select("owner", "source_kind", "source_label", "target_kind", "target_label", "kind", F.coalesce("label", F.lit("")).alias("label"))


@query(ROWS["flow_nodes"])
def flow_nodes(lens: Lens) -> DataFrame:
    """P-21, P-03: nodes of flows with the unit that a call goes to."""
    t = analysis(lens, "shop")
    return _named(t, _named(t, t.flow_nodes, "unit_id", "owner"), "target_id", "target").select("owner", "kind", "label", "line", "target")


@query(ROWS["flow_links"])
def flow_links(lens: Lens) -> DataFrame:
    """J-09, W-12, G-09: calls between flows, and the node that they come back to."""
    t = analysis(lens, "shop")
    back = t.flow_nodes.select(F.col("id").alias("return_node_id"), F.col("kind").alias("back"))
    rows = _named(t, _named(t, t.flow_links, "source_unit_id", "source"), "target_unit_id", "target").join(back, "return_node_id", "left")
    return rows.select("source", "target", "back", "status")


@query(ROWS["flow_maps"])
def flow_maps(lens: Lens) -> DataFrame:
    """P-18: what a map shows of a flow."""
    t = analysis(lens, "shop")
    nodes, _ = overview.W.map_flow(t.flow_nodes.select("unit_id", "id", "kind", "label"), t.flow_edges.drop("unit_id"))
    return _named(t, nodes, "unit_id", "owner").select("owner", "kind", "label", "status")


@query(ROWS["context_flows"])
def context_flows(lens: Lens) -> DataFrame:
    """J-23, P-19, P-26, T-08, T-09: flows of features for a context, by score."""
    out = overview.context_flows(analysis(lens, "shop"), features_of(lens))
    return out.select("owner", F.size("feature_ids").alias("features"), "reason", "required", F.col("score").cast("long").alias("score"), "steps")


@query(ROWS["capability_cards"])
def capability_cards(lens: Lens) -> DataFrame:
    """C-14, F-08: the evidence of capabilities."""
    return overview.capability_cards(analysis(lens, "shop"))


@query(ROWS["required_ids"])
def required_ids(lens: Lens) -> DataFrame:
    """J-30: entrypoints and resources that each domain must keep, counted."""
    t = analysis(lens, "shop")
    return overview.required_per_domain(t, t.units).groupBy("bucket", "kind").agg(F.count("*").alias("n"))


@query(ROWS["dynamic_boundaries"])
def dynamic_boundaries(lens: Lens) -> DataFrame:
    """P-07, P-08, U-08, U-19: dynamic references as boundaries."""
    t = analysis(lens, "shop")
    return _named(t, overview.dynamic_boundaries(t), "unit_id", "owner").select("owner", "name", "line")


@query(ROWS["analysis_integrity"])
def analysis_integrity(lens: Lens) -> DataFrame:
    """V-01, V-02: broken keys of an analysis."""
    return validated(analysis(lens, "shop"))


@query(ROWS["fact_limits"])
def fact_limits(lens: Lens) -> DataFrame:
    """T-01: facts cut at their limits, and what the diagnostics say."""
    t = analyze(files_of(lens, "shop"), {"maxUnits": 4, "maxFlowNodes": 0})
    counts = t.units.agg(F.lit("units").alias("name"), F.count("*").alias("n")).unionByName(t.flows.agg(F.lit("flows").alias("name"), F.count("*").alias("n")))
    return counts.unionByName(t.diagnostics.where("code = 'ANALYSIS_LIMIT_REACHED'").select(F.col("message").alias("name"), F.lit(1).cast("long").alias("n")))


@query(ROWS["clean_bundle"])
def clean_bundle(lens: Lens) -> DataFrame:
    """P-24, P-25, S-14, P-27: rows of a clean bundle, and of the analysis made from it again."""
    bundle = overview.clean(analysis(lens, "shop"), features_of(lens))
    back = overview.from_clean(bundle)
    count = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    out = None
    for name, df in [*bundle.items(), *((f"from {k}", v) for k, v in back.frames.items())]:
        out = count(name, df) if out is None else out.unionByName(count(name, df))
    return out


@query(ROWS["saved_map"])
def saved_map(lens: Lens) -> DataFrame:
    """S-23: domains as a map shows them."""
    return overview.saved_map(overview.clean(analysis(lens, "shop"), features_of(lens)))


@query(ROWS["snapshots"])
def snapshots(lens: Lens) -> DataFrame:
    """E-01: what an evaluation compares."""
    s = overview.snapshot(analysis(lens, "shop"), features_of(lens))
    rows = s["domains"].select(F.lit("domain").alias("what"), F.col("key").alias("a"), F.col("domain").alias("b"))
    return rows.unionByName(s["contracts"].select(F.lit("contract").alias("what"), F.col("contract").alias("a"), F.col("domain").alias("b"))).unionByName(s["kinds"].select(F.lit("kind").alias("what"), F.col("contract").alias("a"), F.col("kind").alias("b")))


@query(ROWS["overview_sections"])
def overview_sections(lens: Lens) -> DataFrame:
    """P-17, S-10: rows of each section of the result."""
    t = analysis(lens, "shop")
    out = None
    for name, df in overview.overview(t, features_of(lens)).items():
        one = df.agg(F.lit(name).alias("section"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(ROWS["formed_domains"])
def formed_domains(lens: Lens) -> DataFrame:
    """C-06, C-11, C-15, A-17, A-18: domains by clustering, with the reason of a merge."""
    t = analysis(lens, "shop")
    out = formation.form_domains(t)
    reasons = overview.merge_reasons(out["pairs"].select("left_key", "right_key", "gate"), out["clusters"])
    return out["domains"].join(reasons.withColumnRenamed("cluster", "key"), "key", "left").select("key", "label", F.col("members").cast("long").alias("members"), "status", "kind", "reason")


_TOUCHING: Project = [
    ("t1", "src/load.ts", 'import fs from "fs";\nimport axios from "axios";\nimport redis from "redis";\nimport { readFile as slurp } from "fs";\nasync function load(path, customer) {\n  await axios.get("https://example.test/users");\n  await fs.writeFile("./data.json", "x");\n  slurp("./in.json");\n  await redis.set("session:1", 2);\n  await eventBus.publish("user.created");\n  new WebSocket("wss://example.test");\n  path.read_text();\n  customer.read_text();\n  publish("no-topic");\n}\n'),
    ("t2", "conf.py", 'import os\nimport socket\nimport subprocess as sp\n\n\ndef load():\n    os.getenv("API_KEY")\n    socket.connect("localhost")\n    sp.run("ls")\n'),
]


@query(rows("file_id VARCHAR, kind VARCHAR, name VARCHAR, mode VARCHAR, start_line INTEGER", *[f"'{f}', '{k}', '{n}', '{m}', {i}" for f, k, n, m, i in [("t1", "externalApi", "https://example.test/users", "read", 6), ("t1", "file", "./data.json", "write", 7), ("t1", "file", "./in.json", "read", 8), ("t1", "cache", "session:1", "write", 9), ("t1", "eventTopic", "user.created", "write", 10), ("t1", "webSocket", "wss://example.test", "readWrite", 11), ("t1", "file", "path", "read", 12), ("t2", "environment", "API_KEY", "read", 7), ("t2", "network", "localhost", "readWrite", 8), ("t2", "process", "ls", "execute", 9)]]))
def call_resources(lens: Lens) -> DataFrame:
    """U-14, W-07: resources that calls touch, through import aliases; plain methods of the same names are none."""
    ship(lens.spark)
    t = split_facts(extract.extract(lens.spark.createDataFrame(_TOUCHING, "file_id string, path string, text string")))
    return rules.call_resources(t["call_sites"], t["bindings"]).select("file_id", "kind", "name", "mode", "start_line")


def _matrix(lens: Lens, name: str) -> DataFrame:
    t = frameworks_of(lens, name)
    routes = _named(t, t.entrypoints.where("kind in ('http', 'webSocket', 'event')"), "unit_id", "unit").select("framework", "kind", "method", F.col("path").alias("path"), "unit", "line")
    return routes


@query(ROWS["framework_detection"])
def framework_detection(lens: Lens) -> DataFrame:
    """X-01, A-34, S-08: frameworks by markers in code, in five projects."""
    out = None
    for name in ("native", "go", "ecma", "polyglot", "routers"):
        one = frameworks_of(lens, name).detections.select(F.lit(name).alias("project"), "framework", "file_id", "line", "confidence")
        out = one if out is None else out.unionByName(one)
    return out


@query(ROWS["matrix_native"])
def matrix_native(lens: Lens) -> DataFrame:
    """X-03, X-04, X-09, X-12: components and a route of C, C++ and C#."""
    t = frameworks_of(lens, "native")
    marks = _named(t, t.components, "unit_id", "unit").select("framework", F.lit("component").alias("kind"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("path"), "unit", F.lit(None).cast("int").alias("line"))
    return _matrix(lens, "native").unionByName(marks)


@query(ROWS["matrix_go"])
def matrix_go(lens: Lens) -> DataFrame:
    """X-03, X-04, J-19, J-21: routes of six Go routers in one file."""
    return _matrix(lens, "go")


@query(ROWS["matrix_ecma"])
def matrix_ecma(lens: Lens) -> DataFrame:
    """X-03, X-04, X-11, F-23: routes of servers and page files."""
    return _matrix(lens, "ecma")


@query(ROWS["matrix_polyglot"])
def matrix_polyglot(lens: Lens) -> DataFrame:
    """X-03 to X-07: routes of Java, Python, Dart and Rust."""
    return _matrix(lens, "polyglot")


@query(ROWS["matrix_routers"])
def matrix_routers(lens: Lens) -> DataFrame:
    """X-15 to X-17, F-33, J-29, J-31, G-11: routers across files, macros, conventions."""
    return _matrix(lens, "routers")


@query(ROWS["call_events"])
def call_events(lens: Lens) -> DataFrame:
    """X-10: events that calls register."""
    t = analysis(lens, "shop")
    return _named(t, t.entrypoints.where("kind = 'event'"), "unit_id", "unit").select("path", "unit", "line")


@query(ROWS["manifest_frameworks"])
def manifest_frameworks(lens: Lens) -> DataFrame:
    """X-02: frameworks that manifests name."""
    rows = [
        ("package.json", "package.json", '{\n "dependencies": {"express": "1", "left-pad": "1"},\n "devDependencies": {"@nestjs/common": "2"}\n}'),
        ("go.mod", "go.mod", "module x\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n\tgithub.com/other/thing v1.0.0\n)\n"),
        ("requirements.txt", "requirements.txt", "flask==2.0\nnumpy\n"),
        ("pyproject.toml", "pyproject.toml", '[project]\ndependencies = ["django>=4"]\n'),
        ("broken.json", "package.json", "{"),
    ]
    df = lens.spark.createDataFrame(rows, "path string, name string, text string")
    return K.manifest_matches(K.manifest_dependencies(df)).select("framework", "path", "line")


@query(ROWS["bucket_cap_rows"])
def bucket_cap_rows(lens: Lens) -> DataFrame:
    """C-02 on a small table: where buckets go so that four are left."""
    goes = gates.cap_buckets({"a": 9, "a/x": 1, "a/y": 7, "b": 3, "b/z": 2, "c": 1, "d": 8}, 4)
    return lens.spark.createDataFrame(sorted(goes.items()), "bucket string, goes string")


@query(ROWS["cluster_rows"])
def cluster_rows(lens: Lens) -> DataFrame:
    """C-03, C-06 on a small table: five items, one pair forbidden."""
    items = lens.spark.createDataFrame([(0, k) for k in "abcde"], "project int, item string")
    pairs = lens.spark.createDataFrame([(0, "a", "b", 0.9, True, False), (0, "b", "c", 0.8, True, False), (0, "a", "c", 0.2, True, False), (0, "c", "d", 0.9, True, True), (0, "d", "e", 0.4, True, False)], "project int, left_key string, right_key string, combined double, allowed boolean, forbidden boolean")
    return gates.cluster_partitions(pairs, items, "project", 0.3, 24).select("item", "cluster")


@query(ROWS["chunk_rows"])
def chunk_rows(lens: Lens) -> DataFrame:
    """B-01 on a small table."""
    from ..operators.budget import plan_chunks

    plan = plan_chunks([("a", 40, 9), ("b", 30, 5), ("c", 50, 7), ("d", 120, 1), ("e", 20, 2)], {("a", "b"): 3, ("a", "c"): 5, ("c", "e"): 4, ("b", "e"): 1}, 100)
    return lens.spark.createDataFrame([(i, n, d) for i, chunk in enumerate(plan) for n, d in enumerate(chunk)], "chunk int, ord int, domain string")


@query(ROWS["context_fits"])
def context_fits(lens: Lens) -> DataFrame:
    """B-04 to B-07 on a small table: what is dropped until it fits, and parts by halving."""
    from ..operators.budget import fit, halve

    feats, flows, ok = fit([("f1", 40, 9, True), ("f2", 30, 5, False), ("f3", 20, 1, False)], [("w1", 30, 8), ("w2", 25, 2)], 10, 120)
    parts = halve([("a", 50), ("b", 40), ("c", 30), ("d", 90)], 100, lambda x: 10)
    rows = [("feature", 0, x) for x in feats] + [("flow", int(ok), x) for x in flows] + [("part", i, x) for i, p in enumerate(parts) for x in p]
    return lens.spark.createDataFrame(rows, "what string, n int, id string")


@query(ROWS["catalog_reports"])
def catalog_reports(lens: Lens) -> DataFrame:
    """E-09, E-12, E-13, A-32: a catalog's reports and what a console shows of them."""
    rows = lambda xs, s: lens.spark.createDataFrame(xs, s)
    reports = evaluate.evaluate_catalog(rows([("a",), ("b",), ("c",)], "project string"), rows([("a",), ("b",)], "project string"), rows([("b", "missing"), ("b", "overMerge")], "project string, finding string"))
    return evaluate.summary_lines(reports)


@query(ROWS["diagnosis_runs"])
def diagnosis_runs(lens: Lens) -> DataFrame:
    """E-10: what a diagnosis runs and why projects are left out."""
    golds = lens.spark.createDataFrame([("a", "/a", True), ("b", None, None), ("c", "/c", False), ("d", "/d", True)], "project string, path string, exists boolean")
    return evaluate.diagnose(golds, ["a", "b", "c"], formation.MODES).select("project", "mode", "skipped")


@query(ROWS["gold_matches"])
def gold_matches(lens: Lens) -> DataFrame:
    """J-25, E-11, F-31, P-16: labels against a snapshot, by aliases and contracts with any method."""
    rows = lambda xs, s: lens.spark.createDataFrame(xs, s)
    domains = evaluate.matched_domains(rows([("d1", "Orders"), ("d2", "billing:param"), ("d3", "src")], "domain string, key string"), rows([("orders",), ("payment",)], "key string"), rows([("Payment", ["Billing", "invoices"])], "key string, names array<string>"))
    raw = rows([("GET /api/v1/orders/{id}",), ("POST:/orders",), ("/health",)], "raw string")
    expected = raw.select(evaluate.gold_contract(F.col("raw")).alias("contract"))
    actual = rows([("GET:/orders/:param",), ("PUT:/orders",), ("GET:/health",)], "contract string")
    contracts = evaluate.matched_contracts(actual, expected)
    bad = rows([("src", ["x"]), ("X", ["x"]), ("orders", ["x"]), ("api", None)], "key string, forbidden array<string>")
    out = domains.select(F.lit("domain").alias("what"), F.col("key").alias("a"), F.col("domain").alias("b"))
    out = out.unionByName(contracts.select(F.lit("contract").alias("what"), F.col("expected").alias("a"), F.col("contract").alias("b")))
    return out.unionByName(bad.where(evaluate.forbidden_key(F.col("key"), F.col("forbidden"))).select(F.lit("forbidden").alias("what"), F.col("key").alias("a"), F.lit("").alias("b")))


@query(ROWS["absorbed_domains"])
def absorbed_domains(lens: Lens) -> DataFrame:
    """C-09, P-09, F-15: domains without entrypoints join those of their canonical key; A-33: the counters."""
    rows = [("d1", "orders", "business", 2, 0), ("d2", "orders:param", "business", 0, 1), ("d3", "logs", "business", 0, 2), ("d4", "orders", "crossCutting", 0, 3), ("d5", "orders", "business", 1, 4)]
    absorbed = overview.absorbed_by_key(lens.spark.createDataFrame(rows, "id string, key string, kind string, entrypoints int, ord int"))
    merges = lens.spark.createDataFrame([("a", "http+call"), ("b", "http+call"), ("c", "structural")], "cluster string, reason string")
    counters = overview.formation_counters(merges, absorbed.select(F.lit("canonical-key").alias("strategy")))
    return absorbed.select(F.lit("absorbed").alias("what"), F.col("id").alias("a"), F.col("into").alias("b")).unionByName(counters.select("step", "reason", F.col("n").cast("string")).toDF("what", "a", "b"))


@query(ROWS["feature_marks"])
def feature_marks(lens: Lens) -> DataFrame:
    """P-20, T-07, T-10, C-13, F-29: tags, priorities, hints, keys by kind of entrypoint, thresholds."""
    rows = lens.spark.createDataFrame([(1, True, False, False, False, 7, "http", "orders", "OrderController", None), (2, False, True, True, False, 300, "rpc", "x", None, "BillingService"), (3, False, False, False, True, 0, "job", None, None, None), (4, False, False, False, False, 5, "http", None, "UserHandler", None)], "id int, e boolean, r boolean, w boolean, d boolean, n int, kind string, path_key string, cls string, service string")
    c = F.col
    return rows.select("id", overview.feature_tags(c("e"), c("r"), c("w"), c("d")).alias("tags"), overview.feature_priority(c("n"), c("e").cast("int"), c("r").cast("int")).alias("priority"), overview.unique_hints(F.array(c("kind"), F.lit(" a "), F.lit("a"), F.lit(""), F.lit("b")), 3).alias("hints"), overview.handler_key(c("path_key"), c("kind"), c("cls"), c("service"), F.lit("nightly")).alias("key"), overview.shared_threshold(c("n") * 100, 3, 4, 200).alias("threshold"))


@query(rows("stage VARCHAR, percent INTEGER, status VARCHAR", "'scan', 100, 'done'", "'extract', 40, 'running'"))
def progress_fold(lens: Lens) -> DataFrame:
    """ST-03: log lines to percentages."""
    log = ["starting", progress_line("scan", 1, 2), progress_line("scan", 2, 2, "done"), progress_line("extract", 1, 5), "progress of another kind", progress_line("extract", 2, 5)]
    return stage_percent(progress_events(lens.spark.createDataFrame(list(enumerate(log)), "ord int, line string")))


@query(ROWS["aggregate_statuses"])
def aggregate_statuses(lens: Lens) -> DataFrame:
    """A-01, A-04: edges of the project by kind and worst status."""
    t = analysis(lens, "shop")
    return A.status_counts(t.references, "kind", "status")
