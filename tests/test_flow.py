"""Statements and flows of all languages: units, calls in the order in which they run, and the edges between them."""

import random

import pytest

from factloom.operators import extract, graph


def facts(path, text):
    return extract.facts_of("f", path, text)


def units(path, text):
    return {r[7].partition("::")[2] or r[7]: (r[6], r[11]) for r in facts(path, text) if r[3] == "unit" and r[6] != "file"}


def flow(path, text, name):
    """Edges (source, target, kind, label) of a function's flow by node labels, and its nodes (kind, label)."""
    rows = facts(path, text)
    unit = next(r[4] for r in rows if r[3] == "unit" and r[7].rpartition("::")[2] == name)
    nodes = [r for r in rows if r[3] == "node" and r[5] == unit]
    label = {r[4]: r[7] if r[6] in ("call", "dynamicBoundary") else r[6] for r in nodes}
    edges = {(label[r[11]["source"]], label[r[8]], r[6], r[7] or None) for r in rows if r[3] == "edge" and r[5] == unit}
    ids = [r[4] for r in rows if r[3] == "edge"]
    assert len(ids) == len(set(ids))
    return edges, [(r[6], r[7]) for r in nodes]


PROGRAMS = {
    "a.js": "function top() { low(); }\nfunction low() {}\n",
    "a.ts": "export function top(): void { low(); }\nfunction low(): void {}\n",
    "a.py": "def top():\n    low()\n\ndef low():\n    return 1\n",
    "A.java": "class A { void top() { low(); } void low() {} }\n",
    "a.c": "static void low(void) {}\nint top(void) { low(); return 1; }\n",
    "a.cpp": "void low() {}\nint top() { low(); return 1; }\n",
    "A.cs": "class A { void top() { low(); } void low() {} }\n",
    "a.go": "package a\n\nfunc top() int {\n\tlow()\n\treturn 1\n}\n\nfunc low() {}\n",
    "a.rs": "fn top() -> i32 { low(); 1 }\nfn low() {}\n",
    "a.dart": "void top() { low(); }\nvoid low() {}\n",
}


@pytest.mark.parametrize("path", sorted(PROGRAMS))
def test_every_language_has_units_calls_and_flows(path):
    found = units(path, PROGRAMS[path])
    assert {k.rpartition("::")[2] for k in found} >= {"top", "low"}
    edges, nodes = flow(path, PROGRAMS[path], "top")
    assert ("entry", "low", "sequential", None) in edges and ("call", "low") in nodes
    assert not any(r[3] == "diagnostic" for r in facts(path, PROGRAMS[path]))


BRANCHES = {
    "a.ts": "function f(v: boolean) { if (v) { yes(); } else { no(); } after(); }",
    "A.java": "class A { void f(boolean v) { if (v) { yes(); } else { no(); } after(); } }",
    "a.c": "void f(int v) { if (v) yes(); else no(); after(); }",
    "a.go": "package a\nfunc f(v bool) {\n\tif v {\n\t\tyes()\n\t} else {\n\t\tno()\n\t}\n\tafter()\n}\n",
    "a.rs": "fn f(v: bool) { if v { yes(); } else { no(); } after(); }",
    "a.dart": "void f(bool v) { if (v) { yes(); } else { no(); } after(); }",
    "A.cs": "class A { void f(bool v) { if (v) { yes(); } else { no(); } after(); } }",
    "a.py": "def f(v):\n    if v:\n        yes()\n    else:\n        no()\n    after()\n",
}


@pytest.mark.parametrize("path", sorted(BRANCHES))
def test_branches_join(path):
    edges, _ = flow(path, BRANCHES[path], "f")
    assert edges == {
        ("entry", "condition", "sequential", None), ("condition", "yes", "trueBranch", None), ("condition", "no", "falseBranch", None),
        ("yes", "after", "sequential", None), ("no", "after", "sequential", None), ("after", "exit", "sequential", None),
    }


LOOPS = {
    "a.ts": "function f(xs: X[]) { for (const x of xs) { if (skip(x)) continue; if (stop(x)) break; work(x); } after(); }",
    "A.java": "class A { void f(List<X> xs) { for (X x : xs) { if (skip(x)) continue; if (stop(x)) break; work(x); } after(); } }",
    "a.go": "package a\nfunc f(xs []X) {\n\tfor _, x := range xs {\n\t\tif skip(x) {\n\t\t\tcontinue\n\t\t}\n\t\tif stop(x) {\n\t\t\tbreak\n\t\t}\n\t\twork(x)\n\t}\n\tafter()\n}\n",
    "a.rs": "fn f(xs: Vec<X>) { for x in xs { if skip(x) { continue; } if stop(x) { break; } work(x); } after(); }",
    "a.py": "def f(xs):\n    for x in xs:\n        if skip(x):\n            continue\n        if stop(x):\n            break\n        work(x)\n    after()\n",
}


@pytest.mark.parametrize("path", sorted(LOOPS))
def test_loops_break_and_continue(path):
    edges, _ = flow(path, LOOPS[path], "f")
    assert ("continue", "loop", "loopBack", "continue") in edges and ("break", "after", "falseBranch", "break") in edges
    assert ("work", "loop", "loopBack", None) in edges and ("loop", "after", "falseBranch", None) in edges
    assert ("loop", "skip", "loopBody", None) in edges and not any(a == "break" and b == "loop" for a, b, _, _ in edges)


def test_break_leaves_the_inner_loop():
    edges, _ = flow("a.ts", "function f(xs) { for (const a of xs) { for (const b of xs) { if (stop(b)) break; work(b); } inner(); } outer(); }", "f")
    assert ("break", "inner", "falseBranch", "break") in edges
    edges, _ = flow("A.java", "class A { void f() { out: for (;;) { for (;;) { if (s()) break out; w(); } } after(); } }", "f")
    assert ("break", "after", "falseBranch", "break") in edges


@pytest.mark.parametrize("path,text", [("a.ts", "function f() { do { tick(); } while (check()); after(); }"), ("A.java", "class A { void f() { do { tick(); } while (check()); after(); } }"), ("a.c", "void f(void) { do { tick(); } while (check()); after(); }")])
def test_post_test_loop(path, text):
    edges, _ = flow(path, text, "f")
    assert edges == {
        ("entry", "tick", "sequential", None), ("tick", "loop", "loopBack", None), ("loop", "check", "sequential", "condition"),
        ("check", "tick", "loopBody", None), ("check", "after", "falseBranch", None), ("after", "exit", "sequential", None),
    }


def test_return_goes_through_its_value():
    edges, nodes = flow("a.ts", "export function f() { return combine(first(), second()); }", "f")
    assert [l for k, l in nodes if k == "call"] == ["first", "second", "combine"]
    assert ("return", "first", "sequential", "return-value") in edges and ("combine", "exit", "return", None) in edges


def test_dynamic_calls_are_boundaries():
    edges, nodes = flow("a.ts", "export function f(q) { if (q.on) { return load(q); } return eval(q.code); }\nfunction load(q) { return q; }", "f")
    assert {k for k, _ in nodes} >= {"condition", "call", "dynamicBoundary", "return"}
    assert {k for _, _, k, _ in edges} >= {"trueBranch", "falseBranch"}
    _, nodes = flow("a.ts", "function f() { evaluate(1); eval(2); }\nfunction eval(x) { return x; }", "f")
    assert [k for k, _ in nodes if k == "dynamicBoundary"] == []  # the file's own function


def test_construction_is_a_call():
    rows = facts("a.ts", "class Service {}\nexport function f() { const s = new Service(); return s; }")
    assert [(r[6], r[7]) for r in rows if r[3] == "reference" and r[6] == "constructs"] == [("constructs", "Service")]


TRIES = {
    "a.ts": "function f() { try { risky(); } catch (e) { fallback(e); } finally { cleanup(); } }",
    "A.java": "class A { void f() { try { risky(); } catch (E e) { fallback(e); } finally { cleanup(); } } }",
    "A.cs": "class A { void f() { try { risky(); } catch (E e) when (e.X) { fallback(e); } finally { cleanup(); } } }",
    "a.dart": "void f() { try { risky(); } on E catch (e) { fallback(e); } finally { cleanup(); } }",
    "a.py": "def f():\n    try:\n        risky()\n    except E as e:\n        fallback(e)\n    finally:\n        cleanup()\n",
}


@pytest.mark.parametrize("path", sorted(TRIES))
def test_try(path):
    edges, nodes = flow(path, TRIES[path], "f")
    assert ("condition", "risky", "sequential", "try") in edges and ("condition", "catch", "exception", "catch") in edges
    assert ("catch", "fallback", "sequential", "catch") in edges and ("risky", "cleanup", "sequential", "finally") in edges
    assert ("fallback", "cleanup", "sequential", "finally") in edges and ("cleanup", "exit", "sequential", None) in edges


def test_throw_goes_to_its_handler():
    edges, _ = flow("a.ts", "function f() { try { throw new Error('x'); } catch (e) { fallback(e); } after(); }", "f")
    assert ("throw", "catch", "exception", "catch") in edges and ("fallback", "after", "sequential", None) in edges
    edges, _ = flow("a.py", "def f():\n    try:\n        return g()\n    finally:\n        h()\n", "f")
    assert ("g", "h", "sequential", "finally") in edges and ("h", "exit", "return", None) in edges


def test_short_circuits_and_ternaries():
    edges, nodes = flow("a.ts", "export function f(l: boolean, r: boolean) { return l && load() || fallback(); }", "f")
    assert sum(k == "condition" for k, _ in nodes) == 2
    assert ("condition", "load", "trueBranch", None) in edges and ("condition", "fallback", "falseBranch", None) in edges
    edges, _ = flow("a.c", "int f(int v) { return v ? yes() : no(); }", "f")
    assert ("condition", "yes", "trueBranch", None) in edges and ("condition", "no", "falseBranch", None) in edges


def test_switches():
    edges, _ = flow("A.java", "class A { void f(int v) { switch (v) { case 1: one(); case 2: two(); break; default: three(); } after(); } }", "f")
    assert ("one", "two", "sequential", None) in edges and ("three", "after", "sequential", None) in edges and ("break", "after", "falseBranch", "break") in edges
    edges, _ = flow("a.go", "package a\nfunc f(v int) {\n\tswitch v {\n\tcase 1:\n\t\tone()\n\tcase 2:\n\t\ttwo()\n\t}\n\tafter()\n}\n", "f")
    assert ("one", "after", "sequential", None) in edges and ("one", "two", "sequential", None) not in edges
    edges, _ = flow("a.rs", "fn f(v: i32) { match v { 1 => one(), _ => { two(); } } after(); }", "f")
    assert ("one", "after", "sequential", None) in edges and ("two", "after", "sequential", None) in edges and ("condition", "after", "falseBranch", None) not in edges


def test_signatures():
    found = units("s.ts", "export class Auth {\n  public async login(request: LoginRequest): Promise<Session> {\n    return open(request);\n  }\n}\ntype Props = { name: string };\n")
    kind, attrs = found["Auth::login"]
    assert (kind, attrs["parameters"], attrs["types"], attrs["returns"], attrs["visibility"]) == ("method", "request", "request:LoginRequest", "Promise<Session>", "public") and "async" in attrs["modifiers"]
    assert found["Auth"][0] == "class" and found["Props"][0] == "typeAlias"
    found = units("A.java", "class A extends B implements C, D { private final int x = 1; public A(Repo r) { go(); } <T> List<T> all(@Ok String a, int... b) throws E { return null; } interface I { void m(); } record P(int a) {} }")
    assert found["A"][1]["bases"] == "B, C, D" and found["A::A"][0] == "constructor" and found["A::all"][1]["parameters"] == "a, b" and found["A::I::m"][0] == "method" and found["A::P"][0] == "record"
    found = units("a.go", "package a\ntype S struct {\n\tBase\n\tv int\n}\nfunc (s *S) Run(a, b int, c string) (int, error) { return 1, nil }\n")
    assert found["S"] [1]["bases"] == "Base" and found["S::Run"][0] == "method" and found["S::Run"][1]["types"] == "a:int, b:int, c:string"
    found = units("a.cpp", "namespace n { class S : public B { public: S(int a) : a_(a), b_{1} {} ~S() {} int run(int v) const { return v; } virtual void v() = 0; }; }\nvoid n::get(const Q& q) { }\ntemplate <typename T> T top(T a) { return a; }\n")
    assert found["n::S"][1]["bases"] == "B" and found["n::S::S"][0] == "constructor" and {"n::S::~S", "n::S::run", "n::S::v", "n::get", "top"} <= set(found)
    found = units("a.rs", "pub struct S;\nimpl Run<T> for S { pub async fn run(&self, v: i32) -> Result<i32, E> { Ok(v) } }\ntrait T { fn m(&self); }\nmod inner { fn deep() {} }\n")
    assert found["S::run"][1]["returns"] == "Result<i32, E>" and found["T::m"][0] == "method" and "inner::deep" in found
    found = units("A.cs", "namespace App.Web;\npublic class A : B { public string Name { get; set; } public int N => calc(); public A(R r) : base(r) { } public async Task<string> Get(int id) => await x.Load(id); }\npublic record P(string Name);")
    assert found["App::Web::A"][1]["bases"] == "B" and found["App::Web::A::Name"][0] == "property" and found["App::Web::A::Get"][1]["returns"] == "Task<string>" and "App::Web::P::Name" in found
    found = units("a.dart", "class S extends B { final int a; S(this.a); S.named(int b) : a = b; String run(String v, {int? x}) { return v; } int get v => calc(); }\n")
    assert found["S::S"][0] == "constructor" and found["S::S::named"][0] == "constructor" and found["S::run"][1]["parameters"] == "v, x" and found["S::v"][0] == "property"


def test_lambdas_and_names():
    found = units("a.ts", "const f = async (a, b) => { await g(a); };\nexport const o = { go(x) { hop(x); }, k: function (y) { z(y); } };\nlist.map((x) => x.run());\n")
    assert found["f"][0] == "function" and found["go"][0] == "function" and found["k"][0] == "function"
    assert any(k.startswith("<lambda@3:") for k in found)
    assert len([r for r in facts("a.ts", "function p(v: string) { return v; } function p(v: number) { return v; }") if r[3] == "unit"]) == len({r[4] for r in facts("a.ts", "function p(v: string) { return v; } function p(v: number) { return v; }") if r[3] == "unit"}) == 3


def test_call_names():
    calls = lambda p, t: [r[7] for r in facts(p, t) if r[3] == "reference" and r[6] == "call"]
    assert calls("a.ts", "service.save(); client.builder().setup(1).run(); handlers[name](x); a[0].go(); 'x'.join(y); (function () {})();") == ["service.save", "client.builder", "setup", "run", "[dynamic]", "[go]", "join", "[anonymous]"]
    assert calls("A.java", "class A { void f() { target.getClass().getMethod(n).invoke(t); } }") == ["target.getClass", "getClass.getMethod", "getMethod.invoke"]
    assert calls("a.ts", "// no(1)\nconst s = 'no(2)'; /* no(3) */ const r = /no(4)/g; yes(`a ${inner(1)}`);") == ["inner", "yes"]


def test_odd_texts_never_crash():
    rng = random.Random(5)
    pieces = ["{", "}", "(", ")", "[", "]", "if", "else", "for", "function f", "class A", "=>", "->", "'", '"', "`", "/*", "*/", "//", "\n", "x", "=", ":", ";", ",", "<", ">", "return", "switch", "case", "try", "catch", "fn g", "func h", "#", "@", "'a", "|", "||", "&&", "?", ".", "::", "!", "new", "match", "impl", "struct S", "template", "operator", "get", "\\", "日"]
    for path in PROGRAMS:
        for _ in range(150):
            facts(path, " ".join(rng.choice(pieces) for _ in range(rng.randrange(40))))
        facts(path, "(" * 3000)
        facts(path, "{" * 3000)
        facts(path, "a(" * 1500 + ")" * 1500)


def brute_parts(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, todo = {n}, [n]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[n] = seen
    out = {}
    for n in reach:
        part = {m for m in reach[n] if n in reach[m]}
        if len(part) > 1:
            out[n] = min(part)
    return out, reach


def test_strong_parts_in_one_task():
    rng = random.Random(3)
    for n, m in ((5, 8), (30, 40), (30, 80)):
        edges = [e for e in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if e[0] != e[1]]
        assert dict(graph._strong(edges)) == brute_parts(edges)[0]
    ring = [(i, (i + 1) % 5000) for i in range(5000)]
    assert set(dict(graph._strong(ring)).values()) == {0}


@pytest.mark.parametrize("small", [0, 1000])
def test_reached_parts(spark, small, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(50 + i, 50 + (i + 1) % 20) for i in range(20)]
    if not small:  # labels take many rounds
        edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0), (6, 7)]
    parts, reach = brute_parts([e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r.node: r.part for r in graph.strong_parts(df, "a", "b", small).collect()}
    assert got == parts
    if small:
        pairs, own = graph.reach_parts(df, "a", "b", spark.createDataFrame([(n,) for n in (0, 7, 55, 99)], "a int"))
        met = {(r.a, r.n) for r in graph.members(pairs, own, "n").collect()}
        assert met == {(s, t) for s in (0, 7, 55, 99) for t in reach.get(s, {s})}


def test_deep_chains(spark):
    """Ancestors beyond any fixed depth, in rings too; nested mounts beyond eight, and in a ring."""
    rows = [(i, i - 1 if i else None) for i in range(150)] + [(1000 + i, 1000 + (i + 1) % 3) for i in range(3)]
    got = {(r.n, r.ancestor): r.depth for r in graph.ancestors(spark.createDataFrame(rows, "n int, p int"), "n", "p").collect()}
    want = {(i, j): i - j for i in range(150) for j in range(i + 1)} | {(1000 + i, 1000 + (i + d) % 3): d for i in range(3) for d in range(3)}
    assert got == want
    mounts = [(f"r{i}", f"r{i - 1}" if i else None, f"/p{i}") for i in range(14)] + [("x", "y", "/x"), ("y", "x", "/y")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(mounts, "c string, p string, x string")
    full = {r.c: r.x for r in graph.fixpoint_prefixes(df, "c", "p", "x", lambda a, b: F.concat(a, b)).collect()}
    assert full == {f"r{i}": "".join(f"/p{k}" for k in range(i + 1)) for i in range(14)}
