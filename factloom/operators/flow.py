"""Execution flows: the graph of a function from its statements, and flows, links and budgets as tables
(G-08, G-09, G-13, J-09, P-03, P-21, P-22, T-02, W-02 to W-06, W-12).

A node is an entry, an exit, a control statement or a call; calls stand in the order in which they run, inner ones first.
Edges: sequential, trueBranch, falseBranch, loopBody, loopBack, exception, return. Graphs are built in the pass over the
texts, function by function; what joins flows with each other are equi joins over the fact tables.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .budget import running_sum
from .syntax import Items

#: Kinds of units that have a flow (P-03), and of references that are calls (P-04).
FLOW_UNITS = ("function", "method", "constructor", "lambda")
CALLS = ("call", "constructs")

End = tuple[int, str, str | None]


class Graph:
    """Nodes (kind, label, line, reference) and edges (source, target, kind, label) of one function."""

    def __init__(self, items: Items, label: str = "") -> None:
        self.nodes: list[tuple[str, str, int, str | None]] = [("entry", label, 0, None), ("exit", label, 0, None)]
        self.edges: dict[tuple[int, int, str, str | None], None] = {}
        self.loops: list[tuple[int, str | None, list[End]]] = []  # head (-1: a switch), label, ways out
        self.tries: list[tuple[list[int], Items | None]] = []  # handlers, what runs at the end
        for end in self.run(items, [(0, "sequential", None)]):
            self.link([end], 1)

    def node(self, kind: str, label: str, line: int, ends: list[End], reference: str | None = None) -> int:
        self.nodes.append((kind, label, line, reference))
        self.link(ends, len(self.nodes) - 1)
        return len(self.nodes) - 1

    def link(self, ends: list[End], to: int, kind: str | None = None, label: str | None = None) -> None:
        for source, own, mark in ends:
            self.edges[source, to, kind or own, label or mark] = None

    def run(self, items: Items, ends: list[End]) -> list[End]:
        """Ways out of statements, given the ways in; what nothing leads to is left out."""
        for x in items:
            if not ends:
                break
            ends = getattr(self, "on_" + x[0])(x, ends)
        return ends

    def branch(self, items: Items, source: int, kind: str, label: str | None = None) -> list[End]:
        return self.run(items, [(source, kind, label)])

    def on_call(self, x: tuple, ends: list[End]) -> list[End]:
        _, reference, label, line, dynamic = x
        return [(self.node("dynamicBoundary" if dynamic else "call", label, line, ends, reference), "sequential", None)]

    def on_block(self, x: tuple, ends: list[End]) -> list[End]:
        return self.run(x[1], ends)

    def on_cond(self, x: tuple, ends: list[End]) -> list[End]:
        _, op, first, second, third, line = x
        n = self.node("condition", op, line, self.run(first, ends))
        if op == "?":
            return self.branch(second, n, "trueBranch") + self.branch(third, n, "falseBranch")
        if op == "&&":
            return [*self.branch(second, n, "trueBranch"), (n, "falseBranch", None)]
        return [*self.branch(second, n, "falseBranch"), (n, "trueBranch", None)]

    def on_if(self, x: tuple, ends: list[End]) -> list[End]:
        _, line, text, test, then, other = x
        n = self.node("condition", text[:120], line, self.run(test, ends))
        return self.branch(then, n, "trueBranch") + self.branch(other, n, "falseBranch")

    def on_loop(self, x: tuple, ends: list[End]) -> list[End]:
        _, line, text, head, test, step, body, post, endless, label = x[:10]
        outs: list[End] = []
        after = x[10] if len(x) > 10 else []
        ends = self.run(head, ends)
        if post:
            n = self.node("loop", text[:120], line, [])
            first = len(self.nodes)
            self.loops.append((n, label, outs))
            back = self.run(body, ends)
            self.loops.pop()
            self.link(back, n, "loopBack" if first < len(self.nodes) else None)
            tested = self.run(test, [(n, "sequential", "condition")])
            if first < len(self.nodes):
                self.link(tested, first, "loopBody", "condition" if not test else None)
            return [*([] if endless else [(s, "falseBranch", None) for s, _, _ in tested]), *outs]
        n = self.node("loop", text[:120], line, ends)
        tested = self.run(test, [(n, "sequential", "condition")]) if test else [(n, "loopBody", None)]
        self.loops.append((n, label, outs))
        back = self.run(step, self.run(body, [(s, "loopBody", None) for s, _, _ in tested]))
        self.loops.pop()
        self.link(back, n, "loopBack")
        over = [] if endless else self.run(after, [(s, "falseBranch", None) for s, _, _ in tested])
        return [*over, *outs]

    def on_switch(self, x: tuple, ends: list[End]) -> list[End]:
        _, line, text, subject, cases, total = x
        n = self.node("condition", text[:120], line, self.run(subject, ends))
        outs: list[End] = []
        self.loops.append((-1, None, outs))
        through: list[End] = []
        done: list[End] = []
        for items, falls in cases:
            got = self.run(items, [(n, "trueBranch", "case"), *through])
            through = got if falls else []
            done += [] if falls else got
        self.loops.pop()
        return [*done, *through, *outs, *([] if total else [(n, "falseBranch", None)])]

    def on_try(self, x: tuple, ends: list[End]) -> list[End]:
        _, line, body, handlers, final = x
        n = self.node("condition", "try", line, ends)
        heads = [self.node("catch", "catch", at, [(n, "exception", "catch")]) for at, _ in handlers]
        self.tries.append((heads, final))
        out = self.branch(body, n, "sequential", "try")
        self.tries[-1] = ([], final)  # a handler's own throws go further out
        for head, (_, part) in zip(heads, handlers):
            out = out + self.branch(part, head, "sequential", "catch")
        self.tries.pop()
        if final is None:
            return out
        return self.run(final, [(s, k if k != "sequential" else "sequential", "finally") for s, k, _ in out]) if out else []

    def leave(self, at: int, depth: int, kind: str, label: str | None) -> list[End]:
        """Ways out of the tries beyond `depth`, through what each runs at the end."""
        ends: list[End] = [(at, kind, label)]
        saved = self.tries
        for i in range(len(saved) - 1, depth - 1, -1):
            final = saved[i][1]
            if final:
                self.tries = saved[:i]
                ends = [(s, "sequential", None) for s, _, _ in self.run(final, [(s, "sequential", "finally") for s, _, _ in ends])]
        self.tries = saved
        return [(s, kind, label) for s, _, _ in ends]

    def on_return(self, x: tuple, ends: list[End]) -> list[End]:
        n = self.node("return", "return", x[1], ends)
        for s, _, _ in self.branch(x[2], n, "sequential", "return-value") if x[2] else [(n, "return", None)]:
            self.link(self.leave(s, 0, "return", None), 1)
        return []

    def on_throw(self, x: tuple, ends: list[End]) -> list[End]:
        n = self.node("throw", "throw", x[1], self.run(x[2], ends))
        depth = next((i for i in range(len(self.tries) - 1, -1, -1) if self.tries[i][0]), None)
        if depth is None:
            self.link(self.leave(n, 0, "exception", "catch"), 1)
        else:
            self.link(self.leave(n, depth + 1, "exception", "catch"), self.tries[depth][0][0])
        return []

    def on_break(self, x: tuple, ends: list[End]) -> list[End]:
        n = self.node("break", "break", x[1], ends)
        found = [l for l in self.loops if x[2] is None or l[1] == x[2]]
        if found:
            found[-1][2].append((n, "falseBranch", "break"))
        else:
            self.link([(n, "falseBranch", "break")], 1)
        return []

    def on_continue(self, x: tuple, ends: list[End]) -> list[End]:
        n = self.node("continue", "continue", x[1], ends)
        found = [l for l in self.loops if l[0] >= 0 and (x[2] is None or l[1] == x[2])]
        self.link([(n, "loopBack", "continue")], found[-1][0] if found else 1)
        return []


def digest(*parts: object) -> str:
    """A content hash over the parts (P-22)."""
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()[:24]


def rows(unit: str, items: Items, label: str = "") -> tuple[list[tuple], list[tuple]]:
    """Nodes (id, kind, label, line, reference) and edges (id, source, target, kind, label, status) of a unit's flow."""
    try:
        g = Graph(items, label)
    except RecursionError:
        g = Graph([], label)
    name = [f"n_{digest(unit, i, kind)}" for i, (kind, *_) in enumerate(g.nodes)]
    nodes = [(name[i], kind, text, line, ref) for i, (kind, text, line, ref) in enumerate(g.nodes)]
    status = lambda b: "dynamic" if g.nodes[b][0] == "dynamicBoundary" else "confirmed"
    edges = [(f"e_{digest(name[a], name[b], kind, mark, g.nodes[b][3])}", name[a], name[b], kind, mark, status(b)) for a, b, kind, mark in g.edges]
    return nodes, edges


class PythonStatements:
    """Statements of a Python function as the items that Graph reads; calls by what the extractor has named them."""

    def __init__(self, calls: Mapping[int, tuple]) -> None:
        self.calls = calls

    def body(self, statements: list[ast.stmt]) -> Items:
        return [x for s in statements for x in self.statement(s)]

    def values(self, *nodes: ast.AST | None) -> Items:
        return [x for n in nodes if n is not None for x in self.value(n)]

    def value(self, n: ast.AST) -> Items:
        if isinstance(n, ast.Call):
            inner = self.values(n.func if not isinstance(n.func, ast.Name) else None, *n.args, *(k.value for k in n.keywords))
            return [*inner, self.calls[id(n)]] if id(n) in self.calls else inner
        if isinstance(n, ast.BoolOp):
            op = "&&" if isinstance(n.op, ast.And) else "||"
            out = self.value(n.values[-1])
            for v in reversed(n.values[:-1]):
                out = [("cond", op, self.value(v), out, [], n.lineno)]
            return out
        if isinstance(n, ast.IfExp):
            return [("cond", "?", self.value(n.test), self.value(n.body), self.value(n.orelse), n.lineno)]
        if isinstance(n, (ast.Lambda, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return []
        return self.values(*ast.iter_child_nodes(n))

    def statement(self, s: ast.stmt) -> Items:
        if isinstance(s, ast.If):
            return [("if", s.lineno, ast.unparse(s.test), self.value(s.test), self.body(s.body), self.body(s.orelse))]
        if isinstance(s, (ast.For, ast.AsyncFor)):
            return [("loop", s.lineno, ast.unparse(s.iter), self.value(s.iter), [], [], self.body(s.body), False, False, None, self.body(s.orelse))]
        if isinstance(s, ast.While):
            endless = isinstance(s.test, ast.Constant) and bool(s.test.value)
            return [("loop", s.lineno, ast.unparse(s.test), [], self.value(s.test), [], self.body(s.body), False, endless, None, self.body(s.orelse))]
        if isinstance(s, (ast.Try, ast.TryStar)):
            handlers = [(h.lineno, self.body(h.body)) for h in s.handlers]
            return [("try", s.lineno, self.body(s.body) + self.body(s.orelse), handlers, self.body(s.finalbody) if s.finalbody else None)]
        if isinstance(s, ast.Match):
            total = any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.guard is None for c in s.cases)
            return [("switch", s.lineno, ast.unparse(s.subject), self.value(s.subject), [(self.values(c.guard) + self.body(c.body), False) for c in s.cases], total)]
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return [*self.values(*(i.context_expr for i in s.items)), *self.body(s.body)]
        if isinstance(s, ast.Return):
            return [("return", s.lineno, self.values(s.value))]
        if isinstance(s, ast.Raise):
            return [("throw", s.lineno, self.values(s.exc, s.cause))]
        if isinstance(s, ast.Break):
            return [("break", s.lineno, None)]
        if isinstance(s, ast.Continue):
            return [("continue", s.lineno, None)]
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom)):
            return []
        return self.value(s)


# tables

def flow_units(units: DataFrame) -> DataFrame:
    """Units that have a flow (P-03)."""
    return units.where(F.col("kind").isin(*FLOW_UNITS))


def call_edges(references: DataFrame) -> DataFrame:
    """References that are calls or constructions (P-04)."""
    return references.where(F.col("kind").isin(*CALLS))


def flows(units: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """unit_id, entry_id, exit_id, nodes, boundaries (dynamic references) of each unit's flow, of the first `most` units
    by id (T-02). nodes: unit_id, id, kind, reference_id."""
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("id")))
    bounds = F.array_sort(F.collect_set(F.when(F.col("kind") == "dynamicBoundary", F.col("reference_id"))))
    own = nodes.groupBy("unit_id").agg(of("entry").alias("entry_id"), of("exit").alias("exit_id"), F.count("*").alias("nodes"), bounds.alias("boundaries"))
    out = own.join(flow_units(units).select(F.col("id").alias("unit_id"), "qualified_name", "path"), "unit_id")
    return out.orderBy("unit_id").limit(most)


def capped_nodes(nodes: DataFrame, kept: DataFrame, budget: int) -> DataFrame:
    """Nodes of the flows that fit a common budget whole, flows in id order (W-06); a flow is never cut, so none is left
    without its entry or exit."""
    used = running_sum(kept.select("unit_id", "nodes"), "unit_id", "nodes", "__before")
    fits = used.where(F.col("__before") + F.col("nodes") <= budget).select("unit_id")
    return nodes.join(fits, "unit_id", "left_semi")


def resolved_nodes(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """nodes with the target unit and status of their reference (P-21)."""
    refs = references.select(F.col("id").alias("reference_id"), "target_id", F.col("status").alias("reference_status"))
    return nodes.join(refs, "reference_id", "left")


def successors(edges: DataFrame) -> DataFrame:
    """source, successor: the sequential successor of a node, the largest target if there are several (W-12)."""
    return edges.where("kind = 'sequential'").groupBy(F.col("source_id").alias("node_id")).agg(F.max("target_id").alias("successor_id"))


def call_links(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Calls that reach a unit with a flow: where they leave, enter and come back (J-09).

    nodes: unit_id, id, reference_id, target_id, reference_status.
    """
    target = kept.select(F.col("unit_id").alias("target_id"), F.col("entry_id").alias("target_entry_id"), F.col("exit_id").alias("target_exit_id"))
    met = nodes.where("target_id is not null").join(target, "target_id")
    met = met.join(successors(edges), F.col("id") == F.col("node_id"), "left")
    return met.select("reference_id", F.col("unit_id").alias("source_unit_id"), F.col("id").alias("source_node_id"), F.col("target_id").alias("target_unit_id"), "target_entry_id", "target_exit_id", F.col("successor_id").alias("return_node_id"), F.col("reference_status").alias("status"))


def whole_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose nodes are there (O-05)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def next_in_region(events: DataFrame, event: str, region: list[str], order: list[str]) -> DataFrame:
    """events with the next one of the same region (W-03)."""
    return events.withColumn("next", F.lead(event).over(Window.partitionBy(*region).orderBy(*order)))


def first_after(events: DataFrame, owner: str, event: str, before: Column, after: Column) -> DataFrame:
    """For each event that is `before` the first later one of its owner that is `after`, by one window over both (W-04)."""
    rows = events.where(before | after)
    later = Window.partitionBy(owner).orderBy(event).rowsBetween(1, Window.unboundedFollowing)
    found = rows.withColumn("follower", F.first(F.when(after, F.col(event)), True).over(later))
    return found.where(before).select(event, "follower")


def map_flow(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A flow for drawing: nodes but entries and exits, with the worst status of what leads to them (P-18).

    nodes: unit_id, id, kind, label; edges: source_id, target_id, kind, status. Statuses fold to verified, shared and
    candidate; an edge from the entry stays, to mark the first node.
    """
    rank = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "shared", 1).otherwise(2)
    name: Callable[[Column], Column] = lambda r: F.when(r == 0, "verified").when(r == 1, "shared").otherwise("candidate")
    shown = nodes.where("kind not in ('entry', 'exit')")
    worst = edges.groupBy(F.col("target_id").alias("id")).agg(F.max(rank).alias("__rank"))
    out = shown.join(worst, "id", "left").withColumn("status", name(F.coalesce("__rank", F.lit(0)))).drop("__rank")
    kinds = nodes.select("id", "kind")
    a, b = kinds.select(F.col("id").alias("source_id"), F.col("kind").alias("__a")), kinds.select(F.col("id").alias("target_id"), F.col("kind").alias("__b"))
    kept = edges.join(a, "source_id").join(b, "target_id").where("__a != 'exit' and __b not in ('entry', 'exit')").drop("__a", "__b")
    return out, kept.withColumn("status", name(rank))
