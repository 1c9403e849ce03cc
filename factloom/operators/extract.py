"""Facts from source texts (U-01 to U-21): one file row gives many fact rows, row-local, so the plan has no shuffle.

A fact row: file_id, path, language, fact_kind (unit, reference, call, control, decorator, binding, entrypoint,
resource, node, edge, diagnostic), id, owner (the unit it belongs to), kind, name, target, start_line, end_line, attrs.
Nodes and edges are those of the functions' flows. Python is parsed by the standard library, brace languages by the
statement parser of syntax.py; other texts give line facts only.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import split_arguments
from .flow import PythonStatements, rows
from .rules import NO_TABLES, SQL_TABLE
from .syntax import Parser

FACTS = "file_id string, path string, language string, fact_kind string, id string, owner string, kind string, name string, target string, start_line int, end_line int, attrs map<string,string>"

# Languages by file ending.
ENDINGS = {
    "javascript": ["js", "mjs", "cjs", "jsx"], "typescript": ["ts", "mts", "cts", "tsx"], "python": ["py", "pyw"], "java": ["java"], "c": ["c", "h"],
    "cpp": ["cc", "cp", "cpp", "cxx", "hh", "hpp", "hxx"], "csharp": ["cs"], "go": ["go"], "rust": ["rs"], "dart": ["dart"],
}
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
DYNAMIC = {"getattr", "__import__", "eval", "exec", "import_module", "require"}


def language_of(path: str) -> str:
    """Language by the file's ending, in any case; `unknown` otherwise (S-05)."""
    end = path.rpartition(".")[2].lower()
    return next((lang for lang, ends in ENDINGS.items() if end in ends), "unknown")


def fact_id(*parts: object) -> str:
    return "f_" + hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()[:24]


#: Stands between the arguments of a call in its `arguments`.
ARGUMENT = "\x1f"


class Facts:
    """The fact rows of one file."""

    def __init__(self, file_id: str, path: str, language: str) -> None:
        self.file = (file_id, path, language)
        self.rows: list[tuple] = []
        self.module = re.sub(r"\.[^./]+$", "", path).strip("/").replace("/", "::")
        self.root = self.add("unit", "", "file", self.module, start=1, end=1)

    def put(self, fact: str, id_: str, owner: str, kind: str, name: str, target: str | None, line: int, **attrs: object) -> None:
        """A row whose id is known."""
        self.rows.append((*self.file, fact, id_, owner, kind, name, target, line, line, {k: str(v) for k, v in attrs.items() if v is not None}))

    def add(self, fact: str, owner: str, kind: str, name: str, target: str | None = None, start: int = 0, end: int = 0, **attrs: object) -> str:
        id_ = fact_id(self.file[0], fact, owner, kind, name, target, start, end, len(self.rows) if fact != "unit" else attrs.get("at", ""))
        self.rows.append((*self.file, fact, id_, owner or None, kind, name, target, start, end, {k: str(v) for k, v in attrs.items() if v is not None}))
        return id_


@lru_cache
def _masked(line_comment: str, block: tuple[str, str], quotes: str) -> re.Pattern:
    """Comments and strings: one pattern, so that the search runs in C."""
    parts = [f"{re.escape(line_comment)}[^\\n]*", f"{re.escape(block[0])}.*?(?:{re.escape(block[1])}|\\Z)"]
    parts += [rf"{q}(?:\\.|[^{q}\\])*(?:{q}|\Z)" if q == "`" else rf"{q}(?:\\.|[^{q}\\\n])*(?:{q}|(?=\n)|\Z)" for q in quotes]
    return re.compile("|".join(parts), re.S)


def mask(text: str, line_comment: str = "//", block: tuple[str, str] = ("/*", "*/"), quotes: str = "\"'`") -> str:
    """Comments and what strings hold become spaces, of the same length; lines stay (F-30)."""

    def blank(m: re.Match) -> str:
        found = m[0]
        if found[0] in quotes and not found.startswith(block[0]):
            closed = len(found) > 1 and found[-1] == found[0]
            return found[0] + _INK.sub(" ", found[1 : len(found) - closed]) + (found[0] if closed else "")
        return _INK.sub(" ", found)

    return _masked(line_comment, tuple(block), quotes).sub(blank, text)


_INK = re.compile(r"[^\n]")


def sql_facts(facts: Facts, owner: str, literal: str, line: int) -> None:
    """Tables that a string literal names, if it looks like a statement (U-13)."""
    verb = re.match(r"(?i)\s*(select|insert|update|delete|create|alter|drop|with)\b", literal)
    if verb:
        mode = "read" if verb[1].lower() in ("select", "with") else "write"
        for table in dict.fromkeys(t.lower() for t in re.findall(SQL_TABLE, literal)):
            if table not in NO_TABLES:
                facts.add("resource", owner, "table", table, start=line, end=line, mode=mode)


class _Python(ast.NodeVisitor):
    """One walk over a module: units, references, calls, control flow, decorators, bindings (U-03 to U-10, U-15)."""

    def __init__(self, facts: Facts) -> None:
        self.facts, self.owner, self.names, self.classes = facts, facts.root, [facts.module], [False]
        self.assigned: dict[int, str] = {}  # names that calls are assigned to, by node
        self.calls: dict[int, tuple] = {}  # what a flow shows of a call, by node
        self.functions: list[tuple[str, list[ast.stmt]]] = []
        self.defined: set[str] = set()

    def _unit(self, node: ast.AST, kind: str, name: str, **attrs: object) -> None:
        full = "::".join([*self.names, name])
        id_ = self.facts.add("unit", self.owner, kind, full, None, node.lineno, node.end_lineno or node.lineno, exported=not name.startswith("_"), **attrs)
        for d in getattr(node, "decorator_list", []):
            call = d if isinstance(d, ast.Call) else None
            label = ast.unparse(call.func if call else d)
            args = [ast.unparse(a) for a in call.args] if call else []
            self.facts.add("decorator", id_, "decorator", label, None, d.lineno, d.end_lineno or d.lineno, arguments=ARGUMENT.join(args), receiver=label.rpartition(".")[0] or None)
            verb = label.rpartition(".")[2].lower()
            if call and (verb in HTTP_VERBS or verb in ("route", "websocket")) and call.args and isinstance(call.args[0], ast.Constant):
                methods = next((ast.literal_eval(k.value) for k in call.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))), [verb.upper() if verb in HTTP_VERBS else None])
                for m in methods:
                    self.facts.add("entrypoint", id_, "webSocket" if verb == "websocket" else "http", name, None, d.lineno, d.lineno, method=m, path=call.args[0].value, receiver=label.rpartition(".")[0])
        if kind in ("function", "method", "constructor"):
            self.functions.append((id_, node.body))
            self.defined.add(name)
        outer = self.owner, self.names, self.classes
        self.owner, self.names, self.classes = id_, [*self.names, name], [*self.classes, kind in ("class", "enum", "interface")]
        for child in ast.iter_child_nodes(node):
            if child not in getattr(node, "decorator_list", []):
                self.visit(child)
        self.owner, self.names, self.classes = outer

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [ast.unparse(b) for b in node.bases]
        kind = "enum" if any(b.rpartition(".")[2] in ("Enum", "IntEnum", "StrEnum", "Flag") for b in bases) else "interface" if any(b.rpartition(".")[2].startswith("Protocol") for b in bases) else "class"
        for b in bases:
            self.facts.add("reference", self.owner, "inherits", node.name, b, node.lineno, node.lineno)
        self._unit(node, kind, node.name, bases=", ".join(bases) or None)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        kind = ("constructor" if node.name == "__init__" else "method") if self.classes[-1] else "function"
        every = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        types = [f"{a.arg}:{ast.unparse(a.annotation)}" for a in every if a.annotation]
        self._unit(node, kind, node.name, parameters=", ".join(a.arg for a in every), types=", ".join(types), returns=ast.unparse(node.returns) if node.returns else None, modifiers="async" if isinstance(node, ast.AsyncFunctionDef) else None)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.facts.add("reference", self.owner, "import", a.name, a.name, node.lineno, node.lineno, status="candidate")
            self.facts.add("binding", self.owner, "import", a.asname or a.name.partition(".")[0], a.name if a.asname else a.name.partition(".")[0], node.lineno, node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        if module != "__future__":
            self.facts.add("reference", self.owner, "import", module, module, node.lineno, node.lineno, status="candidate")
            for a in node.names:
                self.facts.add("binding", self.owner, "wildcard" if a.name == "*" else "import", a.asname or a.name, f"{module}.{a.name}", node.lineno, node.lineno)

    def visit_Call(self, node: ast.Call) -> None:
        try:
            callee = ast.unparse(node.func)
        except RecursionError:
            callee = "[dynamic]"
        callee = callee if re.fullmatch(r"[\w.]+", callee) else "[dynamic]" + ("." + node.func.attr if isinstance(node.func, ast.Attribute) else "")
        status = "dynamic" if "[" in callee or callee.rpartition(".")[2] in DYNAMIC else "candidate" if "." in callee else "confirmed"
        args = ARGUMENT.join([*(ast.unparse(a) for a in node.args), *(f"{k.arg}={ast.unparse(k.value)}" for k in node.keywords if k.arg)])[:512]
        id_ = self.facts.add("reference", self.owner, "call", callee, callee, node.lineno, node.end_lineno or node.lineno, status=status)
        self.calls[id(node)] = ("call", id_, callee, node.lineno, "[" in callee)
        self.facts.add("call", self.owner, "call", callee, None, node.lineno, node.end_lineno or node.lineno, arguments=args, receiver=callee.rpartition(".")[0] or None, assigned=self.assigned.pop(id(node), None))
        self.generic_visit(node)

    def visit_Lambda(self, node: ast.Lambda) -> None:
        name = f"<lambda@{node.lineno}:{node.col_offset + 1}>"
        id_ = self.facts.add("unit", self.owner, "lambda", "::".join([*self.names, name]), None, node.lineno, node.end_lineno or node.lineno, parameters=", ".join(a.arg for a in node.args.args) or None)
        self.functions.append((id_, [ast.copy_location(ast.Return(node.body), node)]))
        outer = self.owner, self.names, self.classes
        self.owner, self.names, self.classes = id_, [*self.names, name], [*self.classes, False]
        self.visit(node.body)
        self.owner, self.names, self.classes = outer

    def visit_Assign(self, node: ast.Assign) -> None:
        if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, (ast.Call, ast.Name, ast.Attribute)):
            value = node.value.func if isinstance(node.value, ast.Call) else node.value
            text = ast.unparse(value)
            if isinstance(node.value, ast.Call):
                self.assigned[id(node.value)] = node.targets[0].id
            if re.fullmatch(r"[\w.]+", text):
                self.facts.add("binding", self.owner, "constructor" if isinstance(node.value, ast.Call) else "alias", node.targets[0].id, text, node.lineno, node.lineno)
        self.generic_visit(node)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str):
            sql_facts(self.facts, self.owner, node.value, node.lineno)

    def _control(self, node: ast.AST, kind: str, condition: ast.AST | None = None) -> None:
        self.facts.add("control", self.owner, kind, kind, None, node.lineno, node.end_lineno or node.lineno, condition=ast.unparse(condition)[:256] if condition is not None else None)
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        guard = isinstance(node.test, ast.Compare) and ast.unparse(node.test) in ("__name__ == '__main__'", "'__main__' == __name__")
        if guard:
            self.facts.add("entrypoint", self.owner, "cli", "__main__", None, node.lineno, node.end_lineno or node.lineno)
        self._control(node, "branch", node.test)

    def visit_For(self, node: ast.For) -> None:
        self._control(node, "loop", node.iter)

    visit_AsyncFor = visit_For

    def visit_While(self, node: ast.While) -> None:
        self._control(node, "loop", node.test)

    def visit_Try(self, node: ast.Try) -> None:
        self._control(node, "try")

    visit_TryStar = visit_Try

    def visit_Match(self, node: ast.Match) -> None:
        self._control(node, "switch", node.subject)

    def visit_Return(self, node: ast.Return) -> None:
        self._control(node, "return", node.value)

    def visit_Raise(self, node: ast.Raise) -> None:
        self._control(node, "throw", node.exc)

    def visit_Break(self, node: ast.Break) -> None:
        self._control(node, "break")

    def visit_Continue(self, node: ast.Continue) -> None:
        self._control(node, "continue")


def python_facts(facts: Facts, text: str) -> None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)  # odd escapes are the text's affair
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        facts.add("diagnostic", facts.root, "warning", "PARSE_ERROR", str(e)[:200], getattr(e, "lineno", 1) or 1, getattr(e, "lineno", 1) or 1)
        line_facts(facts, text)
        return
    visitor = _Python(facts)
    for node in tree.body:
        visitor.visit(node)
    unshadowed(facts, visitor.defined)
    items = PythonStatements(visitor.calls)
    flow_facts(facts, [(unit, items.body(body)) for unit, body in visitor.functions])


_FAMILY = {"javascript": "ecma", "typescript": "ecma", "java": "c", "csharp": "c", "c": "c", "cpp": "c", "dart": "c", "go": "go", "rust": "rust"}
_IMPORT = {
    "ecma": re.compile(r"""^\s*(?:import|export)\b[^'"\n]*?(?:from\s*)?['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]""", re.M),
    "c": re.compile(r"""^\s*#\s*include\s*[<"]([^>"]+)[>"]|^\s*(?:import|using)\s+(?:static\s+)?([\w.*]+)\s*;|^\s*import\s+'([^']+)'""", re.M),
    "go": re.compile(r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$""", re.M),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)", re.M),
}


_ANNOTATION = {
    "csharp": re.compile(r"^\s*\[([A-Za-z_][\w.]*)\s*(?:\((.*?)\))?\]", re.M),
    "rust": re.compile(r"#\[([A-Za-z_][\w:]*)\s*(?:\((.*?)\))?\]"),
    "other": re.compile(r"(?<![\w.])@([A-Za-z_][\w.]*)\s*(?:\(((?:[^()]|\([^()]*\))*)\))?"),
}


def annotation_facts(facts: Facts, text: str, code: str, spans: list[tuple], line: Callable[[int], int]) -> None:
    """Annotations, attributes and decorators with their arguments; each belongs to the next unit, else to the one
    around it (U-12, J-07)."""
    language = facts.file[2]
    starts = sorted(spans)
    firsts = [s[0] for s in starts]
    for m in _ANNOTATION.get(language, _ANNOTATION["other"]).finditer(text):
        if not code[m.start(1) : m.end(1)].strip():
            continue  # in a comment or string
        at = bisect_left(firsts, m.end())
        after = starts[at] if at < len(starts) else None
        around = [s for s in starts[max(0, at - 200) : at] if s[0] <= m.start() <= s[1]]
        own = after if after and not any(s[1] < after[0] for s in around[-1:]) else around[-1] if around else after
        name = m[1][: -len("Attribute")] if language == "csharp" and m[1].endswith("Attribute") else m[1]
        facts.add("decorator", own[4] if own else facts.root, "decorator", name, None, line(m.start()), line(m.end()), arguments=ARGUMENT.join(split_arguments(m[2] or "")), receiver=name.rpartition(".")[0] or None)


class _Sink:
    """Fact rows of what the statement parser finds."""

    def __init__(self, facts: Facts) -> None:
        self.facts, self.spans, self.places = facts, [], []  # units by lines and by places in the text
        self.names: set[str] = set()

    def unit(self, owner: str, kind: str, full: str, start: int, end: int, place: tuple[int, int], **attrs: object) -> str:
        id_ = self.facts.add("unit", owner, kind, full, None, start, end, at=place[0], **attrs)
        self.spans.append((start, end, kind, full, id_))
        self.places.append((*place, kind, full, id_))
        if kind in ("function", "method", "constructor"):
            self.names.add(full.rpartition("::")[2])
        return id_

    def call(self, owner: str, name: str, kind: str, start: int, end: int, arguments: list[str], assigned: str | None) -> str:
        tail = _TAIL.split(name)[-1].rstrip("!")
        status = "dynamic" if "[" in name or tail in DYNAMIC else "candidate" if name != tail and not name.endswith("!") else "confirmed"
        id_ = self.facts.add("reference", owner, kind, name, name, start, end, status=status)
        self.facts.add("call", owner, kind, name, None, start, end, arguments=ARGUMENT.join(arguments), receiver=name[: -len(tail)].rstrip(".:->") or None if name.endswith(tail) else None, assigned=assigned)
        return id_

    def control(self, owner: str, kind: str, start: int, end: int, condition: str | None, post: bool) -> None:
        self.facts.add("control", owner, kind, kind, None, start, end, condition=condition, post_test=post or None)


_TAIL = re.compile(r"\.|::|->")


def flow_facts(facts: Facts, functions: list[tuple[str, list]]) -> None:
    """Nodes and edges of the functions' flows (G-08); a call is a boundary where its reference is dynamic."""
    dynamic = {r[4] for r in facts.rows if r[3] == "reference" and r[11].get("status") == "dynamic"}
    for unit, items in functions:
        nodes, edges = rows(unit, items)
        bounds = {n[0] for n in nodes if n[4] in dynamic}
        for id_, kind, label, line, reference in nodes:
            facts.put("node", id_, unit, "dynamicBoundary" if id_ in bounds else kind, label, reference, line)
        for id_, source, target, kind, label, status in edges:
            facts.put("edge", id_, unit, kind, label or "", target, 0, source=source, status="dynamic" if target in bounds else status)


def unshadowed(facts: Facts, names: set[str]) -> None:
    """A call of a dynamic name that the file defines itself is a plain one (U-19)."""
    for i, r in enumerate(facts.rows):
        if r[3] == "reference" and r[11].get("status") == "dynamic" and "[" not in r[7] and r[7] in names:
            facts.rows[i] = (*r[:11], r[11] | {"status": "confirmed"})


def brace_facts(facts: Facts, text: str) -> None:
    """Units, calls, control flow, imports and SQL of a brace language (U-03 to U-12, U-16 to U-20)."""
    language = facts.file[2]
    family = _FAMILY[language]
    sink = _Sink(facts)
    parser = Parser(text, language, sink, facts.root, facts.module)
    parser.run()
    line = lambda p: bisect_left(parser.breaks, p) + 1
    if not parser.balanced:
        facts.add("diagnostic", facts.root, "warning", "PARSE_ERROR", "unbalanced brackets", 1, 1)
    for start, _, kind, full, id_ in list(sink.spans):
        name = full.rpartition("::")[2]
        if name == "main" and kind == "function" and language in ("c", "cpp", "go", "rust", "dart") or name in ("main", "Main") and kind == "method" and language in ("java", "csharp"):
            facts.add("entrypoint", id_, "main", name, None, start, start)
    # owner by line: units nest, so the latest to start among those that cover a line is the innermost
    owners: dict[int, str] = {}
    for start, end, _, _, id_ in sorted(sink.spans, key=lambda s: (s[0], -s[1])):
        for n in range(start, min(end, start + 20_000) + 1):
            owners[n] = id_
    owner = lambda n: owners.get(n, facts.root)
    code = mask(text)
    for m in _IMPORT[family].finditer(text):
        target = next((g for g in m.groups() if g), None)
        if target and (code[m.start() : m.end()].strip() or family == "go"):
            facts.add("reference", facts.root, "import", target, target, line(m.start()), line(m.start()), status="candidate")
    if family == "ecma":
        ecma_bindings(facts, text, line)
    annotation_facts(facts, text, code, sink.places, line)
    for m in _LITERAL.finditer(text):
        sql_facts(facts, owner(line(m.start())), next(g for g in m.groups() if g is not None), line(m.start()))
    named: dict[str, list[str]] = {}
    for s in sink.spans:
        named.setdefault(s[3].rpartition("::")[2], []).append(s[4])
    unshadowed(facts, sink.names)
    flow_facts(facts, parser.functions)
    line_facts(facts, text, owner, named)


_LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`]*)`')
_BOUND = re.compile(r"""^\s*import\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\*\s*as\s+([A-Za-z_$][\w$]*)\s*|\{([^}]*)\}\s*)?from\s*['"]([^'"]+)['"]""", re.M)


def ecma_bindings(facts: Facts, text: str, line: Callable[[int], int]) -> None:
    """Local names of default, namespace and named imports (U-16)."""
    for m in _BOUND.finditer(text):
        default, space, names, module = m.groups()
        at = line(m.start())
        if default:
            facts.add("binding", facts.root, "import", default, f"{module}.default", at, at)
        if space:
            facts.add("binding", facts.root, "import", space, module, at, at)
        for part in filter(None, (n.strip() for n in (names or "").split(","))):
            name, _, local = part.partition(" as ")
            facts.add("binding", facts.root, "import", (local or name).strip(), f"{module}.{name.strip()}", at, at)


_ROUTE = re.compile(r"""(?i)\b(?:app|router|server|r|e|api)\s*\.\s*(?:map)?(get|post|put|patch|delete|options|head)\s*\(\s*["']([^"']+)""")
_HANDLE = re.compile(r"""(?i)(?:handlefunc|handle|route)\s*\(\s*["']([^"']+)""")
_MAPPING = re.compile(r"""(?i)@(?:(get|post|put|patch|delete|head)mapping|requestmapping)\s*\(\s*(?:(?:value|path|url|route)\s*=\s*)?["']([^"']+)""")


_HANDLER = re.compile(r",\s*([A-Za-z_$][\w$]*)\s*\)\s*;?\s*$")


def line_facts(facts: Facts, text: str, owner_of: Callable[[int], str] | None = None, units: dict[str, list[str]] | None = None) -> None:
    """Routes that single lines declare, by the first rule that fits (U-11, U-12).

    A route belongs to the handler that its line names, if just one unit of the file has that name (J-19), else to the
    unit around the line.
    """
    for n, content in enumerate(text.split("\n"), 1):
        if content.lstrip().startswith(("//", "#", "*", "/*")):
            continue
        if m := _ROUTE.search(content) or _MAPPING.search(content):
            method, path = (m[1] or "HTTP").upper(), m[2]
        elif m := _HANDLE.search(content):
            method, path = "HTTP", m[1]
        else:
            continue
        handler = _HANDLER.search(content)
        own = (units or {}).get(handler[1], []) if handler else []
        owner = own[0] if len(own) == 1 else owner_of(n) if owner_of else facts.root
        facts.add("entrypoint", owner, "http", path, None, n, n, method=method, path=path)


#: Analyzers by language; more can be registered before extract() is called.
ANALYZERS: dict[str, Callable[[Facts, str], None]] = {"python": python_facts, **dict.fromkeys(_FAMILY, brace_facts)}


def facts_of(file_id: str, path: str, text: str | None, language: str | None = None) -> list[tuple]:
    """All fact rows of one file."""
    facts = Facts(file_id, path, language or language_of(path))
    if text is not None:
        try:
            ANALYZERS.get(facts.file[2], line_facts)(facts, text)
        except RecursionError:
            facts.add("diagnostic", facts.root, "warning", "PARSE_FAILED", "nesting is too deep", 1, 1)
    return facts.rows


def extract(files: DataFrame) -> DataFrame:
    """Fact rows of files (file_id, path, text), file by file in the Python workers."""
    names = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                rows = [r for f, p, t in zip(part["file_id"], part["path"], part["text"]) for r in facts_of(f, p, t)]
                yield pd.DataFrame(rows, columns=names)

    return files.select("file_id", "path", "text").mapInPandas(run, FACTS)
