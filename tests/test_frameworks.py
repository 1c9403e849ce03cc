"""Framework detection and rules on small sources."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import extract
from factloom.operators import frameworks as X
from factloom.plans.analyze import split_facts

SOURCES = [
    ("go", "cmd/main.go", 'package main\nimport (\n\t"github.com/gin-gonic/gin"\n)\nfunc list(c int) { x() }\nfunc main() {\n\tr := gin.Default()\n\tv1 := r.Group("/v1")\n\tusers := v1.Group("/users")\n\tusers.GET("/:id", list)\n\tr.POST("/ping", list)\n}\n'),
    ("js", "web/app.js", "import express from 'express';\nfunction home(req, res) { res.send(1); }\nconst site = express();\nsite.get('/home', home);\nother.get('/no', home);\n"),
    ("py", "api/app.py", "from django.urls import path\nfrom django.db import models\n\nclass OrderLine(models.Model):\n    pass\n\ndef show(request):\n    return OrderLine.objects.filter(id=1)\n\ndef store(request):\n    OrderLine.objects.create(id=1)\n\nurlpatterns = [path('orders/', show)]\n"),
    ("java", "src/Users.java", 'import org.springframework.web.bind.annotation.GetMapping;\n@RestController\n@RequestMapping("/users")\nclass Users {\n  @GetMapping("/{id}")\n  String read(String id) { return find(id); }\n  @PostMapping\n  void add() { save(); }\n}\n'),
    ("cs", "src/Orders.cs", 'using Microsoft.AspNetCore.Mvc;\n[Route("/orders")]\nclass Orders : ControllerBase {\n  [HttpGet("/open")]\n  public int Open() { return 1; }\n}\n'),
    ("c", "src/ui.c", '#include <gtk/gtk.h>\nvoid on_click(void) { go(); }\nint main(void) { g_signal_connect(button, "clicked", G_CALLBACK(on_click), 0); return 0; }\n'),
    ("rs", "src/main.rs", "use tokio::net;\n#[tokio::main]\nasync fn main() { run(); }\n"),
    ("grpc", "src/server.go", 'package main\nimport "google.golang.org/grpc"\nfunc serve() { pb.RegisterGreeterServer(s, x) }\n'),
    ("next", "web/pages/blog/[slug].tsx", "import x from 'next/router';\nexport default function Page() { return y(); }\n"),
    ("decoy", "web/none.js", "// import express from 'express'\nconst s = 'express()';\n"),
]


@pytest.fixture(scope="module")
def world(spark):
    files = spark.createDataFrame(SOURCES, "file_id string, path string, text string")
    facts = extract.extract(files).cache()
    t = split_facts(facts)
    typed = spark.createDataFrame([(f, extract.language_of(p), x) for f, p, x in SOURCES], "file_id string, language string, text string")
    lines = X.code_lines(typed)
    found = X.detect(lines).cache()
    langs = spark.createDataFrame([(f, extract.language_of(p), p) for f, p, _ in SOURCES], "file_id string, language string, path string")
    return t, found, X.applies(langs, found).cache(), langs


def test_detection(world):
    t, found, applied, _ = world
    got = {(r.file_id, r.framework) for r in found.collect()}
    assert {("go", "go.gin"), ("js", "javascript.express"), ("py", "python.django"), ("java", "java.spring"), ("java", "java.spring_mvc"), ("cs", "csharp.aspnet_core"), ("c", "c.gtk_glib"), ("rs", "rust.tokio"), ("grpc", "go.grpc"), ("next", "javascript.nextjs")} <= got
    assert not any(f == "decoy" for f, _ in got)
    assert {r.framework: r.confidence for r in X.confidence(found).collect()}["go.gin"] == 0.7
    assert ("rs", "rust.tokio") in {tuple(r) for r in applied.collect()}


def names(t):
    return {r.id: r.qualified_name for r in t["units"].collect()}


def test_call_routes(world):
    t, _, applied, _ = world
    own = names(t)
    got = {(r.framework, r.method, r.path, own[r.unit_id].rpartition("::")[2]) for r in X.call_routes(t["call_sites"], t["bindings"], t["units"], applied).collect()}
    assert got == {("go.gin", "GET", "/v1/users/:id", "list"), ("go.gin", "POST", "/ping", "list"), ("javascript.express", "GET", "/home", "home"), ("python.django", "HTTP", "/orders/", "show")}


def test_decorator_routes(world):
    t, _, applied, _ = world
    own = names(t)
    got = {(r.framework, r.kind, r.method, r.path, own[r.unit_id].rpartition("::")[2]) for r in X.decorator_routes(t["decorators"], t["units"], applied).collect()}
    assert ("java.spring_mvc", "http", "GET", "/users/{id}", "read") in got
    assert ("java.spring_mvc", "http", "POST", "/users", "add") in got or ("java.spring_mvc", "http", "POST", "/users/", "add") in got
    assert ("csharp.aspnet_core", "http", "GET", "/orders/open", "Open") in got
    assert ("rust.tokio", "main", None, None, "main") in got


def test_callbacks_components_rpc_files(world):
    t, _, applied, langs = world
    own = names(t)
    assert [r.name for r in X.callbacks(t["call_sites"], t["units"], applied).collect()] == ["on_click"]
    comp = {(own[r.unit_id].rpartition("::")[2], r.framework) for r in X.components(t["units"], t["decorators"], t["call_sites"], applied).collect()}
    assert ("Users", "java.spring_mvc") in comp
    assert [r.service for r in X.rpc_services(t["call_sites"], applied).collect()] == ["Greeter"]
    assert [(r.file_id, r.path) for r in X.file_routes(langs, applied).collect()] == [("next", "/blog/:slug")]


def test_orm(world):
    t, _, applied, _ = world
    models = X.orm_tables(t["units"], applied)
    assert [(r.model, r.table) for r in models.collect()] == [("OrderLine", "order_line")]
    own = names(t)
    got = {(own[r.unit_id].rpartition("::")[2], r.mode) for r in X.orm_access(t["call_sites"], models).collect()}
    assert got == {("show", "read"), ("store", "write")}


@pytest.mark.parametrize(
    "name,text,found",
    [
        ("package.json", '{"dependencies": {"express": "1"}, "devDependencies": {"jest": "2"}}', ["express", "jest"]),
        ("pyproject.toml", '[project]\ndependencies = ["fastapi>=1", "x[y]"]\n', ["fastapi", "x"]),
        ("requirements.txt", "# c\nflask==1\nDjango\n", ["flask", "Django"]),
        ("go.mod", "module a\nrequire (\n\tgithub.com/gin-gonic/gin v1\n)\nrequire github.com/x/y v2\n", ["github.com/gin-gonic/gin", "github.com/x/y"]),
        ("pom.xml", "<dependency><groupId>a.b</groupId><artifactId>c</artifactId></dependency>", ["a.b:c"]),
        ("build.gradle", "implementation 'a.b:c:1'\n", ["a.b:c"]),
        ("pubspec.yaml", "name: x\ndependencies:\n  shelf: ^1\n  path: any\ndev_dependencies:\n  test: any\n", ["shelf", "path"]),
        ("package.json", "not json", []),
    ],
)
def test_manifests(name, text, found):
    assert [d for d, _ in X.dependencies_of(name, text)] == found


def test_registry(spark):
    rows = X.registry(spark)
    assert rows.select("framework").distinct().count() == 65
    assert rows.where(F.col("marker").isNull()).count() == 0
