"""Operators that SQL doesn't express, against plain versions and scenarios."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import paths as P
from factloom.functions import text as T
from factloom.operators import budget, evaluate, extract, gates, graph, joins, rules, validate
from factloom.plans.analyze import analyze
from factloom.queries.project import SHOP as PROJECT
from factloom.sources import bundle, config, scan
from factloom.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_contract_paths(spark):
    cases = {
        "GET /api/v1/users/{id}/": "/users/:param",
        "https://h.example/Orders/123?x=1": "/orders/:param",
        "orders//list#top": "/orders/list",
        "/users/abc/items": "/users/:param/items",
        "/users/auth/items": "/users/auth/items",
        "ftp://x/y": None,
        "<dynamic>": None,
        "  ": None,
        "/api/v2": None,
        "/a\\b\\<x>": "/a/b/:param",
        "/sessions/0123456789abcdef0123456789abcdef/x": "/sessions/:param/x",
    }
    assert column(spark, P.contract_path, list(cases)) == list(cases.values())


def test_keys_and_buckets(spark):
    assert column(spark, P.capability_key, ["/api/gateway/Orders/1", "/:id", "/rpc/x"]) == ["orders", None, "x"]
    assert column(spark, P.bucket_key, ["src/orders/api/x.py", "src/x.py", "README", "lib/a/b/c/d.py", "", "pkg\\core\\y.go"]) == ["orders/api", "_unscoped", "README", "a/b", "_unscoped", "core"]
    assert column(spark, P.path_role, ["src/a.py", "Tests/a.py", "x/test_a.py", "legacy/a.py", "poc/a.py", "gen/a.py", "tools/a.py", "a.spec.ts"]) == ["production", "test", "test", "archived", "experiment", "generated", "script", "test"]
    assert column(spark, P.file_route, ["users/[id].tsx", "blog/[...slug].ts", "index.tsx", "(group)/a/index.ts"]) == ["/users/:id", "/blog/*slug", "/", "/a"]


def test_tokens_and_names(spark):
    assert column(spark, T.tokens, ["HTTPServerError x2yZ", "getUserName", "a_bc-def"]) == [["httpserver", "error", "x2y"], ["get", "user", "name"], ["def"]]
    assert column(spark, T.snake_case, ["GreetingEndpoint", "HTTPServer", "aB"]) == ["greeting_endpoint", "http_server", "a_b"]
    assert column(spark, T.string_literal, ["'a b'", '"x${y}z"', "plain"]) == ["a b", "x:paramz", None]
    assert column(spark, T.label, ["ws", "stt", "order items"]) == ["WebSocket", "STT", "Order Items"]
    assert column(spark, lambda c: T.relative_target(c, F.lit("a::b::c")), ["..x.y", "x", "."]) == ["a::x::y", "x", "a::b"]


@pytest.mark.parametrize("text,parts", [("a, b", ["a", "b"]), ("f(x, y), [1, 2]", ["f(x, y)", "[1, 2]"]), ("'a,b', \"c\\\",d\"", ["'a,b'", '"c\\",d"']), ("", []), ("{a: (1, 2)}, `x,${y}`", ["{a: (1, 2)}", "`x,${y}`"])])
def test_split_arguments(text, parts):
    assert T.split_arguments(text) == parts


def test_reach_on_random_graphs(spark):
    rng = random.Random(5)
    for n in (1, 6, 14):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)}
        out = graph.reach(spark.createDataFrame(sorted(edges), "a int, b int"), "a", "b")
        nodes = {x for e in edges for x in e}
        seen = {(x, x) for x in nodes}
        while True:
            more = seen | {(x, b) for x, y in seen for a, b in edges if a == y}
            if more == seen:
                break
            seen = more
        assert set(rows(out)) == seen


def test_components_and_canonical(spark):
    c = graph.components(spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (8, 7), (7, 9)], "a int, b int"), "a", "b")
    assert rows(c) == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 7)]
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "f"), ("f", "d"), ("g", "e"), ("h", None)], "n string, t string")
    assert dict(rows(graph.canonical(p, "n", "t"))) == {"a": "c", "b": "c", "c": "c", "d": "d", "e": "d", "f": "d", "g": "d", "h": "h"}


def test_asof_and_nearest(spark):
    rng = random.Random(7)
    points = [(i, rng.randrange(3), rng.randrange(30)) for i in range(60)]
    marks = [(rng.randrange(3), rng.randrange(30), i) for i in range(25)]
    p = spark.createDataFrame(points, "id int, g int, at int")
    m = spark.createDataFrame(marks, "g int, t int, v int")
    got = {r.id: (r.t, r.v) for r in joins.next_asof(p, m, ["g"], "at", "t", "v", F.lit(8)).collect()}
    near = {r.id: r.v for r in joins.nearest(p, m, ["g"], "id", "at", "t", "v").collect()}
    for i, g, at in points:
        later = sorted((t, v) for mg, t, v in marks if mg == g and t > at)
        want = later[0] if later and later[0][0] - at <= 8 else (None, None)
        assert got[i] == want
        own = sorted((abs(t - at), v) for mg, t, v in marks if mg == g)
        assert near[i] == (own[0][1] if own else None)


def test_spans(spark):
    rng = random.Random(3)
    spans = [(i, rng.randrange(2), s, s + rng.randrange(40)) for i in range(30) for s in [rng.randrange(60)]]
    df = spark.createDataFrame(spans, "id int, g int, start int, end int")
    pts = [(i, rng.randrange(2), rng.randrange(100)) for i in range(50)]
    p = spark.createDataFrame(pts, "pt int, g int, at int")
    got = {r.pt: r.id for r in joins.latest_stab(p, df, ["g"], "pt", "at", "id", "start", "end", 16).collect()}
    for i, g, at in pts:
        own = sorted((-s, e, k) for k, sg, s, e in spans if sg == g and s <= at <= e)
        assert got.get(i) == (own[0][2] if own else None)


def test_budgets(spark):
    rng = random.Random(11)
    data = [(rng.choice("ab"), f"{i:03}", rng.randrange(1, 50)) for i in range(80)]
    out = budget.split_parts(spark.createDataFrame(data, "g string, k string, n long"), "g", "k", "n", 100)
    got = {r.k: r.part for r in out.collect()}
    for g in "ab":
        part, used = 1, 0
        for _, k, n in sorted(x for x in data if x[0] == g):
            if used and used + n > 100:
                part, used = part + 1, 0
            used += n
            assert got[k] == part
    kept = budget.scan_prefix(spark.createDataFrame(data, "g string, k string, n long"), "k", "n", 50, 300)
    used, want = 0, []
    for _, k, n in sorted(data, key=lambda x: x[1])[:50]:
        if used + n <= 300:
            used += n
            want.append(k)
    assert [k for _, k, _ in sorted(rows(kept), key=lambda r: r[1])] == want
    assert budget.halve([("a", 5), ("b", 5), ("c", 9)], 10, lambda x: x[1]) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        budget.halve([("a", 50)], 10, lambda x: x[1])
    assert budget.plan_chunks([("a", 4, 9), ("b", 4, 5), ("c", 4, 7), ("d", 99, 1)], {("a", "b"): 3, ("a", "c"): 1}, 8) == [["a", "b"], ["c"], ["d"]]
    assert budget.fit([("x", 5, 9, True), ("y", 5, 1, False)], [("w", 3, 1)], 2, 10) == (["x"], ["w"], True)


def test_scan_prefix_keeps_columns(spark):
    """The order's column stays where it was, with the values of the others beside it."""
    df = spark.createDataFrame([(5, "x", "b"), (400, "y", "a"), (6, "z", "c"), (1, "w", "d")], "size long, tag string, path string")
    kept = budget.scan_prefix(df, "path", "size", 3, 100)
    assert kept.dtypes == df.dtypes and rows(kept) == [(5, "x", "b"), (6, "z", "c")]


@given(st.dictionaries(st.sampled_from(["a", "b", "a/x", "a/y", "b/z", "c", "d/e"]), st.integers(1, 9), min_size=1), st.integers(1, 4))
@settings(max_examples=40, deadline=None)
def test_cap_buckets_keeps_all(sizes, most):
    goes = gates.cap_buckets(sizes, most)
    assert set(goes) == set(sizes)
    assert len(set(goes.values())) <= max(most, 1)


def test_agglomerate():
    s = np.array([[0, 0.9, 0.1], [0.9, 0, 0.2], [0.1, 0.2, 0]])
    no, yes = np.zeros((3, 3), bool), np.ones((3, 3), bool)
    assert gates.agglomerate(["a", "b", "c"], s, no, yes, 0.5, 9)[0] == [["a", "b"], ["c"]]
    assert gates.agglomerate(["a", "b", "c"], s, no, yes, 0.5, 1)[0] == [["a", "b", "c"]]
    ban = no.copy()
    ban[0, 1] = ban[1, 0] = True
    assert gates.agglomerate(["a", "b", "c"], s, ban, yes, 0.15, 9)[0] == [["a"], ["b", "c"]]


@pytest.mark.parametrize(
    "path,text,units",
    [
        ("a.py", "class A:\n def f(self):\n  return g()\ndef g(): pass\n", {"class", "method", "function"}),
        ("a.ts", "class A { f(x) { return g(x); } }\nfunction g(x) { return x }\n", {"class", "method", "function"}),
        ("A.java", "class A { int f() { return g(); } static int g() { return 1; } }", {"class", "method"}),
        ("a.c", "int g(int x) { return x; }\nint f(int x) { return g(x); }", {"function"}),
        ("a.cpp", "class A { int f() { return g(); } };\nint g() { return 1; }", {"class", "method", "function"}),
        ("a.cs", "class A { int F() { return G(); } int G() { return 1; } }", {"class", "method"}),
        ("a.go", "func g() int { return 1 }\nfunc f() int { return g() }", {"function"}),
        ("a.rs", "fn g() -> i32 { 1 }\nfn f() -> i32 { g() }", {"function"}),
        ("a.dart", "int g() { return 1; }\nint f() { return g(); }", {"function"}),
        ("a.js", "const g = (x) => { return x; };\nfunction f() { return g(1); }", {"function"}),
    ],
)
def test_units_and_calls(path, text, units):
    facts = extract.facts_of("1", path, text)
    kinds = {r[6] for r in facts if r[3] == "unit"} - {"file"}
    assert kinds == units
    assert any(r[3] == "reference" and r[6] == "call" and r[7].lower() == "g" for r in facts)


def test_comments_and_strings_are_masked():
    facts = extract.facts_of("1", "a.js", "// f(1)\n/* g(2) */ const s = 'h(3)'; k(4);\n")
    assert [r[7] for r in facts if r[3] == "reference"] == ["k"]


def test_broken_and_empty_files():
    assert any(r[7] == "PARSE_ERROR" for r in extract.facts_of("1", "a.py", "def f(:\n"))
    assert any(r[7] == "PARSE_ERROR" for r in extract.facts_of("1", "a.c", "int f() { {"))
    for path in ("a.py", "a.c", "a.txt"):
        assert [r[3] for r in extract.facts_of("1", path, "")] == ["unit"]
        assert [r[3] for r in extract.facts_of("1", path, None)] == ["unit"]


def test_analysis(spark):
    t = analyze(spark.createDataFrame(PROJECT, "file_id string, path string, text string"))
    assert rows(t.domains) == [("orders", 2, "candidate", "medium", 55), ("web", 1, "candidate", "medium", 35)]
    names = {r.id: r.qualified_name for r in t.units.collect()}
    refs = {(r.target_name, r.status): names.get(r.target_id) for r in t.references.collect()}
    assert refs["save_order", "confirmed"] == "src::orders::api::save_order"
    assert refs["self.run", "confirmed"] == "src::orders::store::Store::run"
    assert refs["store.load", "confirmed"].endswith("Store::load") if ("store.load", "confirmed") in refs else True
    assert refs["eval", "dynamic"] is None
    assert refs["helper", "confirmed"] == "cmd::main::helper"
    assert {r.contract for r in t.contracts.collect()} == {"GET:/orders/:param", "POST:/orders", "GET:/health"}
    assert [r.code for r in t.diagnostics.collect()] == ["PARSE_ERROR"]
    assert t.unassigned.count() >= 1
    assert {r.key for r in t.capabilities.collect()} == {"orders", "health"}


def test_rules(spark):
    rule = spark.createDataFrame([(0, "a", "x", "foo"), (1, "b", "x", "fo+"), (2, "c", "y", ".")], "ord int, rule string, language string, pattern string")
    df = spark.createDataFrame([(1, "x", "foo"), (2, "x", "fooo"), (3, "y", "z"), (4, "x", "q")], "id int, language string, t string")
    assert rows(rules.first_match_table(df, "id", "t", rule).select("id", "rule")) == [(1, "a"), (2, "a"), (3, "c")]
    assert column(spark, rules.access_mode, ["SELECT 1", " insert into t", "x"]) == ["read", "write", "unknown"]


def test_validation(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert rows(validate.primary_keys([("a", a.where("k is not null"), "k")])) == [("a", 1)]
    found = validate.foreign_keys([("a.k", a, "k", spark.createDataFrame([(1,)], "p int"), "p")])
    assert rows(found) == [("a.k", 1)]
    with pytest.raises(ValueError, match="a.k"):
        validate.require(found, "missing")


def test_evaluation(spark):
    labels = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "g string, i int")
    pairs = evaluate.gold_pairs(labels, "g", "i", spark.createDataFrame([("g", "h")], "left_group string, right_group string"))
    assert rows(pairs) == [(1, 2, True), (1, 3, False), (2, 3, False)]
    signals = spark.createDataFrame([(1, 2, 0.5)], "left_key int, right_key int, s double")
    assert rows(evaluate.pair_signals(pairs, signals, ["s"])) == [(False, 2, 0, None), (True, 1, 1, 0.5)]


def test_bundle_round_trip(spark, tmp_path):
    tables = {"a": spark.createDataFrame([(i, f"x{i}", None if i % 3 else i * 0.5) for i in range(200)], "id int, name string, v double"), "empty": spark.createDataFrame([], "id int")}
    folder = str(tmp_path / "bundle")
    bundle.write_bundle(spark, tables, folder, {"a": "id", "empty": "id"}, target=1000, buckets=2)
    back = bundle.read_bundle(spark, folder)
    assert set(back) == {"a", "empty"}
    assert back["a"].exceptAll(tables["a"]).count() == 0 and back["a"].count() == 200
    assert back["empty"].count() == 0
    part = next((tmp_path / "bundle" / "a").rglob("part-*"))
    part.write_text(part.read_text() + "x\n")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        bundle.read_bundle(spark, folder)


def test_scan(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", "src/b.h": "class A {};\n", "node_modules/c.js": "f()", ".git/d.py": "", "src/e.h": "int x;", "README": "hi", "package.json": "{}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = scan.read_tree(spark, str(tmp_path))
    assert rows(scan.manifests(tree).select("path")) == [("package.json",)]
    files, large = scan.inventory(scan.with_language(tree), 8)
    assert rows(files.select("path", "language", "lines")) == [("src/a.py", "python", 1), ("src/e.h", "c", 1)]
    assert [r.path for r in large.collect()] == ["src/b.h"]


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[limits]\nmaxFiles = 5\n[new]\na = [1]\n")
    got = config.load(tmp_path / "c.toml")
    assert got["limits"] == {"maxFiles": 5, "maxTotalBytes": 1_073_741_824} and got["new"] == {"a": [1]}
    assert config.fingerprint(got) != config.fingerprint(config.load())


def test_incremental_stream(spark, tmp_path):
    schema = "file_id string, path string, text string, content_hash string, config string"
    src, cache = str(tmp_path / "in"), str(tmp_path / "cache")
    spark.createDataFrame([("1", "a.py", "def f(): pass", "h1", "c")], schema).write.parquet(src)
    for _ in range(2):
        incremental.watch(spark, src, schema, cache, extract.extract, str(tmp_path / "cp")).awaitTermination()
    facts = spark.read.parquet(cache)
    assert facts.where("fact_kind = 'unit'").count() == 2
    now = spark.createDataFrame([("1", "a.py", "def f(): pass", "h1", "c"), ("2", "b.py", "x = 1", "h2", "c")], schema)
    cached = facts.drop("epoch")
    assert rows(incremental.misses(now, cached).select("file_id")) == [("2",)]
    assert incremental.refresh(now, cached, extract.extract).where("fact_kind = 'unit'").count() == 3
    assert rows(incremental.changes(now, now.where("file_id = '1'"), "file_id", "content_hash")) == [("2", "removed")]


def test_fill_is_the_plain_fold(spark):
    import pandas as pd

    rng = random.Random(4)
    data = [(rng.choice("ab"), i, rng.randrange(1, 60), rng.random() < 0.1, rng.randrange(100)) for i in range(120)]
    columns = ["g", "id", "size", "required", "priority"]
    got = budget.fill(spark.createDataFrame(data, "g string, id int, size int, required boolean, priority int"), "g", 300)
    want = [tuple(r) for g in "ab" for r in budget.fill_rows(pd.DataFrame([d for d in data if d[0] == g], columns=columns), 300).itertuples(index=False)]
    assert rows(got) == sorted(want)


def test_layout(spark):
    from factloom.operators import layout

    assert layout.places([("e", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")]) == [("e", 0, 0), ("a", 1, 0), ("b", 2, 0), ("c", 2, 1), ("d", 3, 0)]
    assert layout.places([]) == [] and len(layout.places([(str(i), str(i + 1)) for i in range(100)])) == 24
    assert layout.places([("a", "b"), ("b", "a")]) == [("a", 0, 0), ("b", 1, 0)]
    df = spark.createDataFrame([("f", "a", "b"), ("g", "x", "x")], "flow_id string, source string, target string")
    assert rows(layout.layout(df)) == [("f", "a", 0, 0), ("f", "b", 1, 0), ("g", "x", 0, 0)]


def test_kinds_and_profile(spark):
    from factloom.operators import aggregates as A
    from factloom.plans.profile import Profile

    df = spark.createDataFrame([("logging", "business"), ("orders", "business"), ("x", "external"), ("y", "odd")], "k string, kind string")
    assert [r[0] for r in df.select(A.domain_kind(F.col("k"), F.lit(False), ["logging"], F.lit(False))).collect()] == ["crossCutting", "business", "business", "business"]
    assert [r[0] for r in df.select(A.domain_role(F.col("kind"), F.array("k"), ["logging"], F.lit(False))).collect()] == ["noise", "business", "external", "unknown"]
    p = Profile()
    with p.step("a"):
        pass
    with pytest.raises(ZeroDivisionError), p.step("b"):
        1 / 0
    assert [(r.step, r.status) for r in p.table(spark).collect()] == [("a", "ok"), ("b", "failed")]
    assert p.percent(4) == 50
