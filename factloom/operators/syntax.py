"""Statements of brace languages (U-02 to U-10, G-08): tokens, declarations, expressions and control structure of one file.

One tokenizer and one recursive parser serve nine languages; what differs is a table (`Dialect`). The parser is
tolerant: what it doesn't know is an expression, and brackets are matched once, so nesting never runs away. It gives
the caller units, calls and control facts as it meets them, and for each function a tree of statements:

    ("call", reference, label, line, dynamic)       ("cond", operator, first, second, third, line)
    ("if", line, text, condition, then, other)      ("loop", line, text, head, condition, step, body, post, endless, label)
    ("switch", line, text, subject, cases, total)   cases: (items, falls through)
    ("try", line, body, handlers, final)            handlers: (line, items)
    ("return", line, items) ("throw", line, items) ("break", line, label) ("continue", line, label) ("block", items)
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

Items = list[tuple]

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
  | (?P<str>(?:[rRuUL]|u8)?"{3}.*?"{3}|'{3}.*?'{3}|[@$]{0,2}r?(?P<hash>\#*)"(?:\\.|[^"\\])*"(?P=hash)|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*')
  | (?P<num>\d[\w.]*)
  | (?P<id>[A-Za-z_$\x80-\U0010ffff][\w$]*|\#[A-Za-z_]\w*)
  | (?P<op>===|!==|\.\.\.|=>|->|::|&&|\|\||\?\?|\?\.|:=|==|!=|<=|\+\+|--|.)
    """,
    re.X | re.S,
)
#: Lifetimes and labels of Rust, so that they don't open a string.
_LIFETIME = re.compile(r"'[A-Za-z_]\w*(?!')")
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_PREPROCESSOR = re.compile(r"(?m)^[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|region|endregion|nullable)\b(?:\\\r?\n|[^\n])*")


@dataclass(frozen=True)
class Dialect:
    """What a language family does in its own way."""

    name: str
    types: dict[str, str]
    modifiers: frozenset[str]
    parens: bool = True  # conditions stand in parentheses
    newlines: bool = False  # a line's end may end a statement
    ternary: bool = True
    falls: bool = True  # a case runs into the next one
    arrows: bool = False  # => makes functions
    typed: bool = False  # functions are declared as `type name(...)`


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_ECMA = Dialect("ecma", {"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace", "module": "module"}, _words("export default declare abstract async static public private protected readonly override get set accessor const"), newlines=True, arrows=True)
_JAVA = Dialect("java", {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}, _words("public private protected static final abstract native synchronized transient volatile strictfp default sealed non"), typed=True)
_CSHARP = Dialect("csharp", {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "record": "record", "namespace": "namespace"}, _words("public private protected internal static sealed abstract virtual override async readonly extern unsafe partial new required file const volatile ref"), falls=False, arrows=True, typed=True)
_CPP = Dialect("cpp", {"class": "class", "struct": "struct", "enum": "enum", "namespace": "namespace", "union": "struct"}, _words("static inline extern virtual explicit friend constexpr consteval typedef register volatile mutable thread_local"), typed=True)
_DART = Dialect("dart", {"class": "class", "mixin": "mixin", "enum": "enum", "extension": "extension"}, _words("abstract static final const late external factory covariant sealed base interface get set required operator"), falls=False, arrows=True, typed=True)
_GO = Dialect("go", {}, frozenset(), parens=False, newlines=True, ternary=False, falls=False)
_RUST = Dialect("rust", {"struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "module", "union": "struct"}, _words("pub async unsafe const extern default"), parens=False, ternary=False, falls=False)
DIALECTS = {"javascript": _ECMA, "typescript": _ECMA, "java": _JAVA, "csharp": _CSHARP, "c": _CPP, "cpp": _CPP, "dart": _DART, "go": _GO, "rust": _RUST}

#: Units whose bodies hold members.
CONTAINERS = _words("class interface struct enum trait impl record mixin extension")
_CONTROL = _words("if for foreach while do loop switch match select try return throw break continue goto")
_PLAIN = _words("await async typeof delete void in of instanceof as is not and or new move mut ref unsafe sizeof alignof yield else case default catch finally this super self true false null nil None undefined let var const val final static where when out inout defer go range chan import export from package using use namespace throw return")
_NEVER_CALLED = _words("if for foreach while switch match catch return sizeof typeof function func fn do else case await new delete throw lock using synchronized select loop in of unsafe defer go alignof when where")
#: No declaration of a typed language starts with these.
_NO_TYPES = _words("return new throw delete await yield case else goto in is as not and or sizeof typeof import export package using use co_await co_return co_yield this super base")
_CONTINUES = _words("= + - * / % & | ^ ! ~ < > ? : , . ( [ { && || ?? => ?. == != === !== <= := -> :: new typeof in of instanceof await extends implements")
_CONTINUED = _words(". ?. , ) ] = + - * / % & | ^ < > ? : && || ?? => == != === !== <= in instanceof as")


class Sink(Protocol):
    """Takes what the parser finds; unit() and call() give ids."""

    def unit(self, owner: str, kind: str, full: str, start: int, end: int, place: tuple[int, int], **attrs: object) -> str: ...
    def call(self, owner: str, name: str, kind: str, start: int, end: int, arguments: list[str], assigned: str | None) -> str: ...
    def control(self, owner: str, kind: str, start: int, end: int, condition: str | None, post: bool) -> None: ...


@dataclass
class Scope:
    """Where the parser stands: the unit around, its kind and qualified name."""

    owner: str
    kind: str
    full: str
    flows: bool = False


@dataclass
class Parser:
    """Parses one text; `functions` gets (unit, statements) of every function, method, constructor and lambda."""

    text: str
    language: str
    sink: Sink
    root: str
    module: str
    functions: list[tuple[str, Items]] = field(default_factory=list)
    balanced: bool = True

    def __post_init__(self) -> None:
        self.d = DIALECTS[self.language]
        self.t: list[str] = []
        self.k: list[str] = []
        self.at: list[int] = []
        self.end: list[int] = []
        self.breaks = [m.start() for m in re.finditer("\n", self.text)]
        self._tokens()
        self._match()
        self.scope = Scope(self.root, "file", self.module)

    # tokens

    def _tokens(self) -> None:
        text, n, i = self.text, len(self.text), 0
        skip = {m.start(): m.end() for m in _PREPROCESSOR.finditer(text)} if self.d.name in ("cpp", "csharp") else {}
        scan = _TOKEN.match
        while i < n:
            if i in skip:
                i = skip[i]
                continue
            c = text[i]
            m = None
            if c == "/" and self.d.name == "ecma" and (not self.t or self.t[-1] in _CONTINUES or self.t[-1] in (";", "}", "return", "case")):
                m = _REGEX.match(text, i)
                if m:
                    self._add("str", m[0], i, m.end())
            elif c == "'" and self.d.name == "rust" and (m := _LIFETIME.match(text, i)):
                self._add("life", m[0], i, m.end())
            if m is None:
                m = scan(text, i)
                if m is None:  # nothing but an open string or comment is left
                    i += 1
                    continue
                kind = m.lastgroup if m.lastgroup != "hash" else "str"
                if kind == "skip" and skip and m[0].isspace() and (hit := next((p for p in range(i + 1, m.end()) if p in skip), None)) is not None:
                    i = hit
                    continue
                if kind != "skip":
                    self._add(kind, m[0], i, m.end())
            i = m.end()
        self.n = len(self.t)
        line = [bisect_right(self.breaks, p - 1) for p in self.at]
        self.new = [i == 0 or line[i] != bisect_right(self.breaks, self.end[i - 1] - 1) for i in range(self.n)]

    def _add(self, kind: str, text: str, start: int, end: int) -> None:
        self.k.append(kind)
        self.t.append(text)
        self.at.append(start)
        self.end.append(end)

    def _match(self) -> None:
        """The partner of each bracket; one without a partner closes at the end."""
        pairs, stack = {")": "(", "]": "[", "}": "{"}, []
        self.match = [self.n] * self.n
        for i in range(self.n):
            if self.k[i] != "op":
                continue
            c = self.t[i]
            if c in "([{":
                stack.append(i)
            elif c in pairs:
                if any(self.t[s] == pairs[c] for s in stack[-8:]):
                    while self.t[stack[-1]] != pairs[c]:
                        stack.pop()
                        self.balanced = False
                    self.match[stack.pop()] = i
                else:
                    self.balanced = False
        self.balanced &= not stack

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, (self.at[i] if i < self.n else len(self.text)) - 1) + 1

    def last_line(self, i: int) -> int:
        return self.line(min(i, self.n - 1)) if self.n else 1

    def source(self, i: int, j: int) -> str:
        return self.text[self.at[i] : self.end[j - 1]] if i < j <= self.n else ""

    def word(self, i: int) -> str:
        return self.t[i] if i < self.n else ""

    def past(self, i: int) -> int:
        """The place after a token, or after the bracket that it opens."""
        return min(self.match[i], self.n - 1) + 1 if self.k[i] == "op" and self.t[i] in "([{" else i + 1

    def find(self, i: int, j: int, *wanted: str) -> int:
        """The first of these tokens outside of brackets, or j."""
        while i < j:
            if self.t[i] in wanted and self.k[i] != "str":
                return i
            i = self.past(i)
        return j

    def angles(self, i: int, j: int) -> int:
        """The place after `<...>` that opens at i, or i if it is no list of types."""
        depth, k = 0, i
        while k < min(j, i + 80):
            c = self.t[k]
            if c == "<":
                depth += 1
            elif c == ">":
                depth -= 1
                if depth == 0:
                    return k + 1
            elif c in ("(", "["):
                k = self.past(k)
                continue
            elif self.k[k] not in ("id", "life") and c not in (",", ".", "::", "?", "&", "*", "|", ":", "=", "->", "=>", "+"):
                return i
            k += 1
        return i

    # statements

    def run(self) -> Items:
        return self.block(0, self.n)

    def block(self, i: int, j: int) -> Items:
        out: Items = []
        while i < j:
            items, after = self.statement(i, j)
            out += items
            i = max(after, i + 1)
        return out

    def braces(self, i: int, j: int) -> tuple[Items, int]:
        """The block that opens at i."""
        return self.block(i + 1, min(self.match[i], j)), min(self.past(i), j)

    def body(self, i: int, j: int) -> tuple[Items, int]:
        """A block or a single statement."""
        if self.word(i) == "{":
            return self.braces(i, j)
        return self.statement(i, j) if i < j else ([], j)

    def statement(self, i: int, j: int) -> tuple[Items, int]:
        t, kind = self.t[i], self.k[i]
        if t in (";", ",", "}", ")", "]") and kind == "op":
            return [], i + 1
        if t == "{" and kind == "op":
            return self.braces(i, j)
        if t == "@" and self.d.name != "csharp":  # an annotation
            k = i + 1
            while k < j and (self.k[k] == "id" or self.t[k] == "."):
                k += 1
                if self.word(k) != "." and self.t[k - 1] != ".":
                    break
            if self.word(i + 1) != "interface":
                return [], self.past(k) if self.word(k) == "(" and not self.new[k] else k
        if t == "#" and self.d.name == "rust":
            k = i + 2 if self.word(i + 1) == "!" else i + 1
            return [], self.past(k) if self.word(k) == "[" else i + 1
        if t == "[" and self.d.name == "csharp" and (i == 0 or self.t[i - 1] in (";", "{", "}", "]", ")", ",")) and self.match[i] + 1 < j and (self.k[self.match[i] + 1] == "id" or self.t[self.match[i] + 1] == "["):
            return [], self.past(i)
        if kind in ("id", "life") and self.word(i + 1) == ":" and t not in ("case", "default") and self.scope.kind != "interface":
            if self.word(i + 2) in _CONTROL or kind == "life":
                items, after = self.statement(i + 2, j) if i + 2 < j else ([], j)
                return [(*x[:-1], t) if x[0] == "loop" else x for x in items], after
            if t in ("public", "private", "protected", "signals", "slots") and self.d.name == "cpp":
                return [], i + 2
        if kind == "id":
            if t in _CONTROL and not (self.word(i + 1) == "(" and t in ("match", "select", "loop") and self.d.parens):
                found = self.control(i, j)
                if found is not None:
                    return found
            if t in ("import", "package", "use") or t == "using" and self.word(i + 1) != "(" and self.word(i + 1) not in ("var", "let"):
                stop = self.finish(i, j)
                return [], stop + (self.word(stop) == ";")
            if t in ("synchronized", "using", "lock", "fixed", "with") and self.word(i + 1) == "(":
                close = self.match[i + 1]
                items, after = self.body(close + 1, j)
                return [*self.expr(i + 2, min(close, j)), ("block", items)], after
            if t in ("unsafe", "checked", "unchecked", "defer", "async", "static", "else") and self.word(i + 1) == "{":
                items, after = self.braces(i + 1, j)
                return [("block", items)], after
            found = self.declaration(i, j)
            if found is not None:
                return [], found
        elif t in ("~", "[", "*", "<") or kind == "str":
            if self.scope.kind in CONTAINERS and (found := self.declaration(i, j)) is not None:
                return [], found
        stop = self.finish(i, j)
        return self.expr(i, stop), stop + (self.word(stop) == ";" and stop < j)

    def finish(self, i: int, j: int) -> int:
        """Where the expression statement that starts at i ends."""
        k = i
        while k < j:
            c = self.t[k]
            if c in (";", "}") and self.k[k] == "op":
                return k
            if k > i and self.d.newlines and self.new[k] and self.t[k - 1] not in _CONTINUES:
                if c not in _CONTINUED or self.d.name == "go":
                    return k
            if c == "{" and not self.d.newlines and k > i and self.t[k - 1] not in _CONTINUES and self.t[k - 1] not in ("]", "return"):
                close = self.past(k)
                if self.word(close) not in (".", ",", ")", ";", "(", "?", "[") or self.new[min(close, self.n - 1)] and self.word(close) != ".":
                    return min(close, j)
                k = close
                continue
            k = self.past(k)
        return j

    def condition(self, i: int, j: int) -> tuple[int, int, int]:
        """Start and end of a condition, and the place after it; i is the token after the keyword."""
        if self.d.parens:
            while i < j and self.t[i] != "(":
                i += 1
            if i >= j:
                return j, j, j
            return i + 1, min(self.match[i], j), min(self.past(i), j)
        brace = self.find(i, j, "{")
        return i, brace, brace

    def fact(self, kind: str, i: int, j: int, text: str | None = None, post: bool = False) -> None:
        if self.scope.flows or self.scope.kind != "file":
            self.sink.control(self.scope.owner, kind, self.line(i), self.last_line(max(i, j - 1)), text[:256] if text else None, post)

    def control(self, i: int, j: int) -> tuple[Items, int] | None:
        t, line = self.t[i], self.line(i)
        if t == "if":
            a, b, k = self.condition(i + 1, j)
            test = self.expr(a, b)
            then, k = self.body(k, j)
            other: Items = []
            while self.word(k) == ";" and self.word(k + 1) == "else":
                k += 1
            if k < j and self.t[k] == "else":
                other, k = self.body(k + 1, j)
            self.fact("branch", i, k, self.source(a, b))
            return [("if", line, self.source(a, b), test, then, other)], k
        if t in ("for", "foreach", "while", "loop"):
            return self.loop(i, j)
        if t == "do":
            items, k = self.body(i + 1, j)
            if self.word(k) != "while":
                return [("block", items)], k
            a, b = k + 2, min(self.match[k + 1], j) if k + 1 < self.n else j
            self.fact("loop", i, b, self.source(a, b), post=True)
            return [("loop", line, self.source(a, b), [], self.expr(a, b), [], items, True, self.source(a, b) == "true", None)], min(b + 1, j)
        if t in ("switch", "match", "select"):
            if t in ("match", "select") and self.d.name not in ("rust", "go"):
                return None
            return self.switch(i, j)
        if t == "try":
            return self.attempt(i, j)
        if t in ("return", "throw"):
            stop = i + 1 if self.d.newlines and i + 1 < j and self.new[i + 1] and self.d.name != "rust" else self.finish(i + 1, j)
            self.fact(t, i, stop, self.source(i + 1, stop))
            return [(t, line, self.expr(i + 1, stop))], stop
        if t in ("break", "continue"):
            label = self.t[i + 1] if i + 1 < j and self.k[i + 1] in ("id", "life") and not (self.d.newlines and self.new[i + 1]) else None
            stop = self.finish(i + 1, j)
            self.fact(t, i, i + 1)
            return [(t, line, label)], max(stop, i + 1)
        if t == "goto":
            return [], self.finish(i, j)
        return None

    def loop(self, i: int, j: int) -> tuple[Items, int]:
        a, b, k = self.condition(i + 1, j) if self.t[i] != "loop" else (i + 1, i + 1, i + 1)
        text = self.source(a, b)
        head: Items = []
        test: Items = []
        step: Items = []
        endless = self.t[i] == "loop" or a == b or text in ("true", "1", ";;")
        if self.t[i] == "while":
            test = self.expr(a, b)
        elif not endless:
            first = self.find(a, b, ";")
            if first < b:
                second = self.find(first + 1, b, ";")
                head, test, step = self.expr(a, first), self.expr(first + 1, second), self.expr(second + 1, b)
                endless = first + 1 == second
            else:
                over = self.find(a, b, "of", "in", ":", "range")
                if over < b:
                    head = self.expr(over + 1, b)
                else:
                    test = self.expr(a, b)  # Go's `for condition {`
        items, k = self.body(k, j)
        self.fact("loop", i, k, text or None)
        return [("loop", self.line(i), text, head, test, step, items, False, endless, None)], k

    def switch(self, i: int, j: int) -> tuple[Items, int]:
        a, b, k = self.condition(i + 1, j)
        k = self.find(k, j, "{")
        subject, text = self.expr(a, b), self.source(a, b)
        close = min(self.match[k], j) if k < j else j
        cases, total = self.arms(k + 1, close) if self.d.name == "rust" else self.cases(k + 1, close)
        self.fact("switch", i, close, text)
        return [("switch", self.line(i), text, subject, cases, total)], min(close + 1, j)

    def cases(self, i: int, j: int) -> tuple[list[tuple[Items, bool]], bool]:
        out: list[tuple[Items, bool]] = []
        total = False
        while i < j:
            if self.t[i] not in ("case", "default"):
                i += 1
                continue
            total |= self.t[i] == "default"
            mark = self.find(i + 1, j, ":", "->", "=>")
            arrow = mark < j and self.t[mark] != ":"
            items: Items = []
            i = mark + 1
            if arrow:
                items, i = self.statement(i, j) if i < j else ([], j)
            while not arrow and i < j and not (self.t[i] in ("case", "default") and self.word(i + 1) != "("):
                more, after = self.statement(i, j)
                items += more
                i = max(after, i + 1)
            falls = self.d.falls and not arrow or self.d.name == "go" and self.t[i - 1] == "fallthrough"
            out.append((items, falls))
        return out, total

    def arms(self, i: int, j: int) -> tuple[list[tuple[Items, bool]], bool]:
        out: list[tuple[Items, bool]] = []
        while i < j:
            mark = self.find(i, j, "=>")
            if mark >= j:
                break
            i = mark + 1
            if self.word(i) == "{":
                items, i = self.braces(i, j)
            else:
                stop = self.find(i, j, ",")
                items, i = (self.control(i, stop) if self.t[i] in _CONTROL else None) or (self.expr(i, stop), stop)
                i = max(i, stop)
            out.append((items, False))
            i += self.word(i) == ","
        return out, True  # the compiler asks for all values

    def attempt(self, i: int, j: int) -> tuple[Items, int]:
        k, before = i + 1, []
        if self.word(k) == "(":  # resources
            before = self.expr(k + 1, min(self.match[k], j))
            k = self.past(k)
        items, k = self.body(k, j)
        handlers: list[tuple[int, Items]] = []
        final: Items | None = None
        while k < j and self.t[k] in ("catch", "on", "finally"):
            brace, line = self.find(k, j, "{"), self.line(k)
            self.fact("finally" if self.t[k] == "finally" else "catch", k, min(self.past(brace), j) if brace < j else j)
            if self.t[k] == "finally":
                final, k = self.braces(brace, j) if brace < j else ([], j)
            else:
                part, k = self.braces(brace, j) if brace < j else ([], j)
                handlers.append((line, part))
        self.fact("try", i, k)
        return [*before, ("try", self.line(i), items, handlers, final)], k

    # declarations

    def enter(self, kind: str, name: str, i: int, j: int, **attrs: object) -> tuple[Scope, str]:
        """Make a unit of the tokens i..j-1; the scope that it opens."""
        full = f"{self.scope.full}::{name}"
        id_ = self.sink.unit(self.scope.owner, kind, full, self.line(i), self.last_line(j - 1), (self.at[i], self.end[min(j, self.n) - 1]), **attrs)
        return Scope(id_, kind, full, kind in ("function", "method", "constructor", "lambda")), id_

    def inside(self, scope: Scope, parse: Callable[[], Items]) -> Items:
        """What parse() gives within a scope; statements of functions are kept."""
        outer, self.scope = self.scope, scope
        try:
            items = parse()
        finally:
            self.scope = outer
        if scope.flows:
            self.functions.append((scope.owner, items))
        return items

    def header(self, i: int, j: int) -> str:
        return re.sub(r"\s+", " ", self.source(i, j)).strip()[:512]

    def declaration(self, i: int, j: int) -> int | None:
        """The place after the declaration that starts at i; None if there is none."""
        p, seen = i, []
        while p < j and (self.t[p] in self.d.modifiers or self.t[p] == "*" and self.d.name == "ecma") and not (self.word(p + 1) in ("(", "=", ":", ";", "?") and self.d.name == "ecma" and self.t[p] != "export"):
            if self.t[p] == "pub" and self.word(p + 1) == "(":
                seen.append("pub")
                p = self.past(p + 1)
                continue
            if self.d.name == "rust" and self.t[p] == "extern" and p + 1 < j and self.k[p + 1] == "str":
                p += 1
            seen.append(self.t[p])
            p += 1
        if p >= j:
            return None
        if self.t[p] == "template" and self.d.name == "cpp" and self.word(p + 1) == "<":
            return self.declaration(q, j) if (q := self.angles(p + 1, j)) > p + 1 and q < j else None
        t = self.t[p]
        if t in self.d.types and (self.k[min(p + 1, self.n - 1)] in ("id", "life") or self.word(p + 1) in ("<", "{")) and self.word(p + 1) not in ("instanceof", "in"):
            found = self.type_unit(i, p, j, seen)
            if found is not None:
                return found
        if t == "@" and self.word(p + 1) == "interface":
            return self.type_unit(i, p + 1, j, seen)
        if t == "type" and self.d.name in ("ecma", "go", "rust") and p + 1 < j and self.k[p + 1] == "id":
            return self.type_name(i, p, j, seen)
        if self.d.name == "ecma":
            if t == "function":
                return self.function(i, p + 1, j, seen)
            if self.scope.kind in CONTAINERS:
                return self.member(i, p, j, seen)
            return None
        if self.d.name in ("go", "rust"):
            return self.function(i, p + 1, j, seen) if t == ("func" if self.d.name == "go" else "fn") and self.word(p + 1) != "" else None
        return self.typed_function(i, p, j, seen)

    def type_unit(self, i: int, p: int, j: int, seen: list[str]) -> int | None:
        kind = self.d.types.get(self.t[p], "interface")
        q = p + 1
        if self.t[p] == "enum" and self.word(q) in ("class", "struct") or self.t[p] == "record" and self.word(q) in ("struct", "class") or self.t[p] == "mixin" and self.word(q) == "class":
            q += 1
        if self.d.name == "rust" and kind == "impl":
            q = self.angles(q, j) if self.word(q) == "<" else q
            brace = self.find(q, j, "{", ";")
            over = self.find(q, brace, "for")
            names = [self.t[x] for x in range(over + 1 if over < brace else q, brace) if self.k[x] == "id" and self.t[x] not in ("dyn", "where", "mut")]
            name = names[0] if names else "impl"
            bases = self.source(q, over) if over < brace else None
        else:
            name, k = self.t[q] if self.k[min(q, self.n - 1)] == "id" else "anonymous", q + 1
            while kind in ("namespace", "module") and self.word(k) in ("::", ".") and k + 1 < j:
                name, k = f"{name}::{self.t[k + 1]}", k + 2
            stops = ("{", ";") if self.t[p] != "record" else ("{", ";", "=>")
            brace = self.find(k, j, *stops)
            if self.d.name == "cpp" and kind != "namespace" and any(self.t[x] in ("(", "=", "*", "&") for x in range(k, brace)):
                return None  # a type in front of a name
            if self.d.name == "ecma" and self.t[p] in ("module", "namespace") and brace >= j:
                return None
            bases = self.bases(k, brace)
        if kind == "namespace" and self.word(brace) == ";":  # for the rest of the file
            scope, _ = self.enter(kind, name, i, j, signature=self.header(i, brace))
            self.inside(scope, lambda: self.block(brace + 1, j))
            return j
        if brace >= j:
            if self.d.name in ("ecma", "dart") or kind == "namespace":
                return None
        elif self.t[brace] == ";" and self.d.name == "cpp":
            return None  # only announced
        close = min(self.match[brace], j) if brace < j and self.t[brace] == "{" else brace
        exported = "export" in seen or "pub" in seen or None
        scope, _ = self.enter(kind, name, i, min(close + 1, j), signature=self.header(i, brace), bases=bases, modifiers=" ".join(seen) or None, visibility=self.visibility(name, seen), exported=exported)
        if self.t[p] == "record" and (paren := self.find(q, brace, "(")) < brace:
            self.parameters_of(paren, scope)
        if brace < j and self.t[brace] == "{" and not (self.d.name == "rust" and kind in ("struct", "enum")):
            self.inside(scope, lambda: self.block(brace + 1, close))
        return min(close + 1, j)

    def parameters_of(self, paren: int, record: Scope) -> None:
        """Components of a record are its properties."""
        for name, kind in self.parameters(paren + 1, min(self.match[paren], self.n)):
            self.sink.unit(record.owner, "property", f"{record.full}::{name}", self.line(paren), self.line(paren), (self.at[paren], self.at[paren]), types=f"{name}:{kind}" if kind else None)

    def bases(self, i: int, j: int) -> str | None:
        """Names of the types that a type extends or implements."""
        names: list[str] = []
        k = i
        on = False
        while k < j:
            c = self.t[k]
            if c == "<":
                k = max(self.angles(k, j), k + 1)
                continue
            if c in ("extends", "implements", "with", "on", ":"):
                on = True
            elif c == "where":
                break
            elif c in ("(",):
                k = self.past(k)
                continue
            elif on and self.k[k] == "id" and c not in ("public", "private", "protected", "virtual", "final"):
                if k and self.t[k - 1] in ("::", ".") and names:
                    names[-1] += self.t[k - 1] + c
                else:
                    names.append(c)
            k += 1
        return ", ".join(names) or None

    def type_name(self, i: int, p: int, j: int, seen: list[str]) -> int | None:
        """`type X = ...`, Go's `type X struct {...}`."""
        name, q = self.t[p + 1], p + 2
        q = self.angles(q, j) if self.word(q) == "<" else q
        if self.d.name == "go":
            q = self.past(q) if self.word(q) == "[" and self.word(self.past(q)) in ("struct", "interface") else q
            if self.word(q) in ("struct", "interface") and self.word(q + 1) == "{":
                close = min(self.match[q + 1], j)
                scope, _ = self.enter(self.t[q], name, i, min(close + 1, j), signature=self.header(i, q + 1), visibility=self.visibility(name, seen), bases=self.embedded(q + 2, close))
                if self.t[q] == "interface":
                    k = q + 2
                    while k < close:
                        if self.k[k] == "id" and self.word(k + 1) == "(":
                            outer, self.scope = self.scope, scope
                            stop = self.finish(k, close)
                            self.enter("method", self.t[k], k, stop, signature=self.header(k, stop))
                            self.scope = outer
                            k = stop
                        k += 1
                return min(close + 1, j)
        elif self.word(q) != "=":
            return None
        stop = self.finish(p, j)
        self.enter("typeAlias", name, i, stop, signature=self.header(i, stop), exported="export" in seen or None)
        return stop + (self.word(stop) == ";")

    def embedded(self, i: int, j: int) -> str | None:
        """Types that a Go struct embeds: a name alone on its line."""
        out = []
        for k in range(i, j):
            if self.k[k] == "id" and (k == i or self.new[k] or self.t[k - 1] == "*" and self.new[k - 1]):
                stop = k + 1
                while stop + 1 < j and self.t[stop] == ".":
                    stop += 2
                if stop >= j or self.new[stop]:
                    out.append(self.t[stop - 1])
        return ", ".join(out) or None

    def function(self, i: int, p: int, j: int, seen: list[str]) -> int | None:
        """`function name(...) {`, `func (r T) name(...) {`, `fn name(...) {`; p is the token after the keyword."""
        receiver = None
        p += self.word(p) == "*"
        if self.d.name == "go" and self.word(p) == "(":
            inner = [self.t[x] for x in range(p + 1, min(self.match[p], j)) if self.k[x] == "id"]
            receiver = inner[1] if len(inner) > 1 else inner[0] if inner else None
            p = self.past(p)
            if self.word(p) in ("{", "(") or p >= j:
                return None  # a literal
        if p >= j or self.k[p] != "id":
            return None
        name, q = self.t[p], p + 1
        q = self.angles(q, j) if self.word(q) == "<" else self.past(q) if self.word(q) == "[" else q
        if self.word(q) != "(":
            return None
        after = self.past(q)
        brace = self.find(after, j, "{", ";")
        if self.d.newlines:
            k = after
            while k < min(brace, j):
                if self.new[k] and self.t[k - 1] not in _CONTINUES and self.t[k] not in _CONTINUED:
                    brace = k
                    break
                k = self.past(k)
        kind = "method" if receiver or self.scope.kind in CONTAINERS else "function"
        returns = self.source(after + (self.word(after) in (":", "->")), min(brace, j)).split(" where ")[0].strip() or None
        return self.close_function(i, q, brace, j, kind, f"{receiver}::{name}" if receiver else name, seen, returns)

    def close_function(self, i: int, paren: int, brace: int, j: int, kind: str, name: str, seen: list[str], returns: str | None) -> int:
        """Make the unit of a function whose parameters and body are known, and parse the body."""
        params = self.parameters(paren + 1, min(self.match[paren], j))
        has = brace < j and self.t[brace] == "{"
        arrow = brace < j and self.t[brace] == "=>"
        close = min(self.match[brace], j) if has else self.finish(brace + 1, j) if arrow else brace
        last = name.rpartition("::")[2]
        attrs = {
            "signature": self.header(i, min(brace, j)), "parameters": ", ".join(n for n, _ in params) or None, "types": ", ".join(f"{n}:{k}" for n, k in params if k) or None,
            "returns": re.sub(r"\s+", " ", returns) if returns else None, "modifiers": " ".join(seen) or None, "visibility": self.visibility(last, seen), "exported": "export" in seen or "pub" in seen or None,
        }
        scope, _ = self.enter(kind, name, i, min(close + 1, j), **attrs)
        if has:
            self.inside(scope, lambda: self.block(brace + 1, close))
        elif arrow:
            self.inside(scope, lambda: [("return", self.line(brace), self.expr(brace + 1, close))])
        return min(close + 1, j) if has or self.word(close) == ";" else close

    def visibility(self, name: str, seen: list[str]) -> str:
        for mark in ("public", "private", "protected", "internal"):
            if mark in seen:
                return mark
        if "pub" in seen or "export" in seen:
            return "public"
        if self.d.name == "go":
            return "public" if name[:1].isupper() else "private"
        if self.d.name == "dart":
            return "private" if name.startswith("_") else "public"
        if name.startswith("#") or self.d.name == "rust":
            return "private"
        return "public" if self.d.name == "ecma" and self.scope.kind in CONTAINERS else "unknown"

    def parameters(self, i: int, j: int) -> list[tuple[str, str | None]]:
        """Names and types of parameters."""
        out: list[tuple[str, str | None]] = []
        k = i
        while k < j:
            stop = k
            while stop < j and self.t[stop] != ",":
                nxt = self.angles(stop, j) if self.t[stop] == "<" else stop
                stop = nxt if nxt > stop else self.past(stop)
            if self.t[k] in ("{", "[") and self.d.name == "dart":  # named and optional ones
                out += self.parameters(k + 1, min(self.match[k], j))
            elif k < stop:
                out.append(self.parameter(k, stop))
            k = stop + 1
        if self.d.name == "go":  # `a, b int`: the type is said once
            kind = None
            for x in range(len(out) - 1, -1, -1):
                kind = out[x][1] or kind
                out[x] = out[x][0], kind
        return [x for x in out if x[0]]

    def parameter(self, i: int, j: int) -> tuple[str, str | None]:
        while i < j and (self.t[i] in ("public", "private", "protected", "readonly", "final", "required", "mut", "...", "*", "&", "this", "params", "ref", "out", "in", "late", "covariant", "const", "let", "var") and j - i > 1):
            if self.t[i] == "this" and self.d.name == "dart" and self.word(i + 1) == ".":
                return self.t[min(i + 2, j - 1)], None
            i += 1
        while i < j and self.t[i] == "@":  # annotated
            i = self.past(i + 2) if self.word(i + 2) == "(" else i + 2
        stop = self.find(i, j, "=")
        if i >= stop:
            return "", None
        if self.d.name in ("ecma", "rust"):
            mark = self.find(i, stop, ":")
            name = self.source(i, mark - (mark > i + 1 and self.t[mark - 1] == "?"))
            return re.sub(r"\s+", " ", name), self.source(mark + 1, stop) or None
        if self.d.name == "go":
            return self.t[i], self.source(i + 1, stop) or None
        k = stop - 1
        while k > i and (self.k[k] != "id" or self.t[k] in ("const",)):
            k -= 1
        if self.d.name == "cpp" and k == i:
            return ("", None) if self.t[k] == "void" or stop - i == 1 else (self.t[k], None)
        return self.t[k], self.source(i, k).strip() or None

    def member(self, i: int, p: int, j: int, seen: list[str]) -> int | None:
        """A method or field of an ECMAScript class or interface."""
        if self.scope.kind == "enum":
            return self.finish(p, j)
        computed = self.t[p] == "["
        if not (self.k[p] in ("id", "str") or computed):
            return None
        q = self.past(p) if computed else p + 1
        name = f"[{self.source(p + 1, min(self.match[p], j))}]" if computed else self.t[p].strip("\"'")
        while self.word(q) in ("?", "!"):
            q += 1
        q = self.angles(q, j) if self.word(q) == "<" else q
        if self.word(q) == "(":
            after = self.past(q)
            brace = after
            if self.word(after) == ":":  # a type of braces is not the body
                k = after + 1
                while k < j and not (self.t[k] == "{" and self.t[k - 1] not in (":", "|", "&", "<", ",")) and self.t[k] != ";" and not (self.new[k] and self.t[k - 1] not in _CONTINUES and self.t[k] not in _CONTINUED):
                    k = self.past(k)
                brace = k
            returns = self.source(after + 1, brace) if self.word(after) == ":" else None
            kind = "constructor" if name == "constructor" else "property" if {"get", "set"} & set(seen) else "method"
            if self.word(brace) != "{":
                brace = min(brace, j)
            return self.close_function(i, q, brace, j, kind, name, seen, returns)
        stop = self.finish(p, j)
        equals = self.find(p, stop, "=")
        scope, _ = self.enter("property", name, i, max(stop, p + 1), signature=self.header(i, equals), modifiers=" ".join(seen) or None, visibility=self.visibility(name, seen))
        if equals < stop:
            self.inside(scope, lambda: self.expr(equals + 1, stop, name))
        return max(stop, p + 1)

    def typed_function(self, i: int, p: int, j: int, seen: list[str]) -> int | None:
        """A function, constructor, property or prototype of a language that writes `type name(...)`."""
        held = self.scope.kind in CONTAINERS
        k, name, start = p, None, p
        while k < j:
            c = self.t[k]
            if self.k[k] == "str" or c in (";", "=", "}", ")", "]", ",", "{", "=>", "!", "+", "-", "?.", "&&", "||", "++", "--", "."):
                if c == "." and k + 1 < j and self.k[k + 1] == "id":  # a qualified type
                    k += 1
                    continue
                break
            if c == "<":
                after = self.angles(k, j)
                if after == k:
                    break
                k = after
                continue
            if c == "(":
                if k > p and (self.k[k - 1] == "id" or self.t[k - 1] == ">"):
                    name = k
                break
            if c == "operator" and self.d.name in ("cpp", "csharp", "dart"):
                paren = self.find(k + 1, j, "(")
                if paren == k + 1 and self.word(k + 2) == ")":
                    paren = self.find(k + 3, j, "(")
                if paren < j:
                    return self.finish_typed(i, p, k, paren, j, seen, "operator" + self.source(k + 1, paren).replace(" ", ""), held)
                break
            k = self.past(k) if c == "[" else k + 1
        if name is None:
            if held and self.d.name == "csharp" and k < j and self.t[k] in ("{", "=>") and k > p + 1 and self.k[k - 1] == "id":
                return self.property_unit(i, k, j, seen)
            if held and self.d.name == "dart" and "get" in self.t[i:k] and k < j and self.t[k] in ("{", "=>"):
                return self.property_unit(i, k, j, seen)
            return None
        start = name - 1
        if self.t[start] == ">":
            depth = 0
            while start > p:
                depth += {">": 1, "<": -1}.get(self.t[start], 0)
                start -= 1
                if depth == 0:
                    break
        label = self.t[start]
        first = start
        while first - 2 >= p and self.t[first - 1] in ("::", ".") and self.k[first - 2] == "id":
            first -= 2
        if first - 1 >= p and self.t[first - 1] == "~":
            label, first = "~" + label, first - 1
        if first < start:
            label = "::".join(self.t[x] for x in range(first, start + 1) if self.k[x] == "id" or self.t[x] == "~")
            label = label.replace("~::", "~")
        if label.rpartition("::")[2] in _NEVER_CALLED or self.t[p] in _NO_TYPES and self.word(p + 1) != "::":
            return None
        return self.finish_typed(i, p, first, name, j, seen, label, held)

    def finish_typed(self, i: int, p: int, first: int, paren: int, j: int, seen: list[str], label: str, held: bool) -> int | None:
        after = self.past(paren)
        k = after
        while k < j and self.t[k] not in ("{", ";", "=>", "="):
            if self.t[k] == ":" and self.d.name in ("cpp", "dart", "csharp"):  # initialisers
                k += 1
                while k < j and self.t[k] not in ("{", ";"):
                    if self.t[k] in ("(", "[") or self.t[k] == "{" and self.k[k - 1] == "id":
                        k = self.past(k)
                    else:
                        k += 1
                    if self.d.name == "cpp" and k < j and self.t[k] == "{" and self.k[k - 1] == "id" and self.t[k - 2] in (",", ":"):
                        k = self.past(k)
                break
            if self.t[k] == "[" or self.t[k] == "(":
                k = self.past(k)
                continue
            if self.k[k] != "id" and self.t[k] not in ("->", "<", ">", ",", "::", ".", "*", "&", "?"):
                return None
            if self.t[k] == "," and self.d.name not in ("java", "csharp", "dart"):
                return None
            k += 1
        if k >= j:
            return None
        opens = self.t[k]
        typed = first > p
        own = self.scope.full.rpartition("::")[2]
        last = label.rpartition("::")[2]
        builds = held and (not typed and last == own or self.d.name == "dart" and label.split("::")[0] == own) or "::" in label and label.split("::")[-1] == label.split("::")[-2]
        if opens == "=":  # `= 0;`, `= default;`
            if not (held and self.d.name == "cpp" and self.word(k + 1) in ("0", "default", "delete")):
                return None
            k = self.finish(k, j)
            opens = ";"
        if opens == ";" and self.d.name == "cpp" and last.isupper() and "_" in last:
            return None  # a macro
        if opens == ";" and typed and self.d.name == "cpp" and self.scope.kind in ("file", "namespace"):
            return k + 1  # a prototype
        if opens == ";" and not held or opens == "=>" and not self.d.arrows:
            return None
        if not typed and not builds and not held and not (self.d.name == "dart" and opens in ("{", "=>")) and not label.startswith("~"):
            if not (self.d.name == "cpp" and "::" in label) and not (self.d.name == "cpp" and self.scope.kind in ("file", "namespace") and opens == "{"):
                return None
        if self.scope.flows and self.d.name in ("cpp", "java"):
            return None  # no functions in functions
        if opens == ";" and held and self.d.name == "cpp" and not typed and not builds and not label.startswith("~"):
            return None
        if opens == ";" and self.scope.kind == "enum":
            return None
        kind = "constructor" if builds else "method" if held or "::" in label else "function"
        returns = self.source(p, first) or None
        if self.word(after) == "->":
            returns = self.source(after + 1, k)
        done = self.close_function(i, paren, k, j, kind, label, seen, returns)
        return done + (opens == ";" and self.word(done) == ";")

    def property_unit(self, i: int, k: int, j: int, seen: list[str]) -> int:
        """`Type Name { get; set; }`, `Type Name => value;`."""
        name = self.t[k - 1]
        if self.t[k] == "=>":
            close = self.finish(k + 1, j)
            scope, _ = self.enter("property", name, i, close, signature=self.header(i, k), modifiers=" ".join(seen) or None, visibility=self.visibility(name, seen))
            self.inside(scope, lambda: self.expr(k + 1, close))
            return close + (self.word(close) == ";")
        close = min(self.match[k], j)
        scope, _ = self.enter("property", name, i, min(close + 1, j), signature=self.header(i, k), modifiers=" ".join(seen) or None, visibility=self.visibility(name, seen))
        self.inside(scope, lambda: self.block(k + 1, close))
        after = close + 1
        return self.finish(after, j) + 1 if self.word(after) == "=" else after

    # expressions

    def expr(self, i: int, j: int, named: str | None = None) -> Items:
        """Calls, conditions and nested statements of an expression, in the order in which they run."""
        out: Items = []
        j = min(j, self.n)
        while i < j:
            stop = self.find(i, j, ",", ";")
            out += self.single(i, stop, named)
            i = stop + 1
        return out

    def single(self, i: int, j: int, named: str | None = None) -> Items:
        if i >= j:
            return []
        if self.k[i] == "id" and self.t[i] in _CONTROL and self.d.name in ("rust", "dart", "java", "csharp", "ecma") and self.t[i] not in ("loop", "match", "select", "do") or self.d.name == "rust" and self.t[i] in ("loop", "match", "while", "for", "if"):
            found = self.control(i, j)
            if found is not None:
                return [*found[0], *self.single(found[1], j)]
        mark = self.find(i, j, "=", ":=", "=>", "->" if self.d.name == "java" else "=>")
        if mark < j and self.t[mark] in ("=", ":="):
            left = self.assigned(i, mark)
            before = self.linear(i, mark) if mark - i > 1 and self.t[i] != "let" else []
            return before + self.single(mark + 1, j, left or named)
        if mark < j and (self.d.arrows or self.d.name == "java"):
            first = mark - 1
            if self.t[first] == ")":
                first = next((x for x in range(first, i - 1, -1) if self.t[x] == "(" and self.match[x] == mark - 1), i)
            elif self.k[first] == "id" and first > i and self.find(i, mark, ":") < mark and self.d.name == "ecma":
                first = next((x for x in range(mark - 1, i - 1, -1) if self.t[x] == "("), first)  # a type of the result stands between
            start = first - (first > i and self.t[first - 1] == "async")
            before = self.linear(i, start) if start > i else []
            return before + self.closure(start, first, mark, j, named if start == i else self.key(i, start) or named)
        if self.d.ternary:
            ask = self.question(i, j)
            if ask is not None:
                a, b = ask
                self.fact("branch", i, j, self.source(i, a))
                return [("cond", "?", self.single(i, a), self.single(a + 1, b), self.single(b + 1, j), self.line(a))]
        for ops in (("||", "??"), ("&&",)):
            at = self.operator(i, j, ops)
            if at < j:
                self.fact("branch", i, j, self.source(i, j))
                return [("cond", self.t[at], self.single(i, at), self.single(at + 1, j), [], self.line(at))]
        return self.linear(i, j, named)

    def key(self, i: int, j: int) -> str | None:
        """The name in `name: value`."""
        return self.t[j - 2].strip("\"'") if j - 2 >= i and self.t[j - 1] == ":" and self.k[j - 2] in ("id", "str") else None

    def assigned(self, i: int, j: int) -> str | None:
        """The name that is assigned: `x`, `const x: T`, `a.x`."""
        stop = j
        if self.d.name in ("ecma", "rust"):
            stop = self.find(i, j, ":")
        k = stop - 1
        if k >= i and self.d.name == "go" and self.t[k] != "," and self.k[k] == "id":
            k = next((x - 1 for x in range(i, stop) if self.t[x] == ","), k)
        return self.t[k] if k >= i and self.k[k] == "id" and self.t[k] not in _PLAIN else None

    def operator(self, i: int, j: int, ops: tuple[str, ...]) -> int:
        k = i
        while k < j:
            if self.t[k] in ops and self.k[k] == "op" and k > i:
                if not (self.d.name == "rust" and self.t[k] == "||" and (self.t[k - 1] in _CONTINUES or self.t[k - 1] in ("move", "return"))):
                    return k
            k = self.past(k)
        return j

    def question(self, i: int, j: int) -> tuple[int, int] | None:
        """Places of `?` and its `:`."""
        a = self.find(i + 1, j, "?")
        while a < j and (a + 1 >= j or self.t[a + 1] in (":", ")", ",", ".", "=", ">", "[", "]")):
            a = self.find(a + 1, j, "?")
        depth, k = 0, a + 1
        while k < j:
            if self.t[k] == "?":
                depth += 1
            elif self.t[k] == ":":
                if depth == 0:
                    return a, k
                depth -= 1
            k = self.past(k)
        return None

    def closure(self, start: int, first: int, mark: int, j: int, named: str | None) -> Items:
        """A lambda whose arrow stands at mark."""
        kind, name = ("function", named) if named else ("lambda", self.lambda_name(start))
        params = self.parameters(first + 1, mark - 1) if self.t[first] == "(" else [(self.t[first], None)] if self.k[first] == "id" else []
        block = self.word(mark + 1) == "{"
        close = min(self.match[mark + 1], j) if block else j
        attrs = {"signature": self.header(start, mark + 1), "parameters": ", ".join(n for n, _ in params) or None, "types": ", ".join(f"{n}:{k}" for n, k in params if k) or None, "modifiers": "async" if self.t[start] == "async" else None}
        if self.scope.kind in CONTAINERS | {"property"} and named:
            kind = "method"
        scope, _ = self.enter(kind, name, start, min(close + 1, j), **attrs)
        if block:
            self.inside(scope, lambda: self.block(mark + 2, close))
            return self.linear(close + 1, j) if close + 1 < j else []
        self.inside(scope, lambda: [("return", self.line(mark), self.single(mark + 1, close))])
        return []

    def lambda_name(self, i: int) -> str:
        at = self.at[i]
        n = bisect_right(self.breaks, at - 1)
        return f"<lambda@{n + 1}:{at - (self.breaks[n - 1] + 1 if n else 0) + 1}>"

    def literal(self, i: int, paren: int, j: int, named: str | None) -> int:
        """A function literal: keyword at i, parameters at paren, a body in braces. The place after it."""
        brace = self.find(self.past(paren), j, "{")
        if brace >= j:
            return self.past(paren)
        close = min(self.match[brace], j)
        params = self.parameters(paren + 1, min(self.match[paren], j))
        own = self.t[i + 1] if self.t[i] == "function" and i + 1 < paren and self.k[i + 1] == "id" else named
        kind, name = ("function", own) if own else ("lambda", self.lambda_name(i))
        if self.scope.kind in CONTAINERS | {"property"} and own:
            kind = "method"
        scope, _ = self.enter(kind, name, i, min(close + 1, j), signature=self.header(i, brace), parameters=", ".join(n for n, _ in params) or None, types=", ".join(f"{n}:{k}" for n, k in params if k) or None)
        self.inside(scope, lambda: self.block(brace + 1, close))
        return min(close + 1, j)

    def rust_closure(self, i: int, j: int, named: str | None) -> int:
        if self.t[i] == "||":
            bar = i
        else:
            bar = next((x for x in range(i + 1, j) if self.t[x] == "|"), i)
        params = [] if self.t[i] == "||" else self.parameters(i + 1, bar)
        k = bar + 1
        if self.word(k) == "->":
            k = self.find(k, j, "{")
        block = self.word(k) == "{"
        close = min(self.match[k], j) if block else j
        kind, name = ("function", named) if named else ("lambda", self.lambda_name(i))
        scope, _ = self.enter(kind, name, i, min(close + 1, j), signature=self.header(i, k), parameters=", ".join(n for n, _ in params) or None)
        self.inside(scope, lambda: self.block(k + 1, close) if block else [("return", self.line(i), self.single(k, close))])
        return min(close + 1, j) if block else j

    def linear(self, i: int, j: int, named: str | None = None) -> Items:
        """Calls from left to right: arguments first, then the call."""
        out: Items = []
        k, j = i, min(j, self.n)
        behind = ""  # what stands before a member: "", "call", "index", "group", "text"
        member = ""
        while k < j:
            t, kind = self.t[k], self.k[k]
            if kind == "str":
                if t.startswith("`") and self.d.name == "ecma":
                    out += self.template(k)
                behind, k = "text", k + 1
                continue
            if kind == "id":
                if t == "new" and self.d.name != "go" and k + 1 < j and (self.k[k + 1] == "id"):
                    more, k = self.construction(k, j, named)
                    out += more
                    behind, member = "call", ""
                    continue
                if t in ("function", "func") and (paren := self.find(k, j, "(")) < j and self.d.name in ("ecma", "go") and paren - k <= 3:
                    k = self.literal(k, paren, j, named)
                    behind = "function"
                    continue
                if t == "class" and self.d.name == "ecma" and (found := self.type_unit(k, k, j, [])) is not None:
                    k = found
                    continue
                if self.d.name == "rust" and (t in ("if", "match", "loop", "while", "for") or t in ("unsafe", "async") and self.word(k + 1) in ("{", "move")):
                    stop = j
                    items, k = self.statement(k, stop)
                    out += items
                    behind = "group"
                    continue
                if t in ("switch", "try") and self.d.name in ("java", "dart") and self.word(k + 1) in ("(", "{"):
                    items, k = self.statement(k, j)
                    out += items
                    continue
                if self.d.name == "csharp" and t == "switch" and self.word(k + 1) == "{":
                    close = min(self.match[k + 1], j)
                    out += self.expr(k + 2, close)
                    k = close + 1
                    continue
                if t in _PLAIN and t not in ("this", "super", "self", "default") or t in _CONTROL and self.d.name != "ecma":
                    if t == "delete" and self.d.name == "cpp":
                        pass
                    k += 1
                    behind = ""
                    continue
                more, k, behind, member = self.chain(k, j, behind, member, named)
                out += more
                continue
            if t in (".", "?.", "->", "::") and behind and k + 1 < j and self.k[k + 1] == "id":
                more, k, behind, member = self.chain(k + 1, j, behind, member, named)
                out += more
                continue
            if t == "(":
                close = min(self.match[k], j)
                if self.d.name == "java" and self.word(close + 1) == "->" or self.d.name == "dart" and self.word(close + 1) in ("{", "async") and not behind:
                    if self.d.name == "java":
                        out += self.closure(k, k, close + 1, j, named)
                        return out
                    brace = self.find(close + 1, j, "{", "=>")
                    if self.word(brace) == "{":
                        k = self.literal(k, k, j, named)
                        continue
                if behind in ("index", "group", "function"):
                    out += self.expr(k + 1, close)
                    out.append(self.emit("[anonymous]" if behind == "function" else "[dynamic]", "call", k, close, named))
                    behind = "call"
                else:
                    inner = self.expr(k + 1, close)
                    out += inner
                    behind = "function" if any(self.t[x] in ("=>", "function") for x in range(k + 1, min(close, k + 40))) else "group"
                k = close + 1
                continue
            if t == "[":
                close = min(self.match[k], j)
                nxt = self.word(close + 1)
                if self.d.name == "cpp" and behind == "" and nxt in ("(", "{"):
                    if nxt == "(":
                        k = self.literal(k, close + 1, j, named)
                    else:
                        end = min(self.match[close + 1], j)
                        scope, _ = self.enter("lambda", self.lambda_name(k), k, end + 1, signature=self.header(k, close + 1))
                        self.inside(scope, lambda a=close + 2, b=end: self.block(a, b))
                        k = end + 1
                    behind = "function"
                    continue
                out += self.expr(k + 1, close)
                behind = "index" if behind else "group"
                k = close + 1
                continue
            if t == "{":
                close = min(self.match[k], j)
                out += self.block(k + 1, close) if self.d.name == "rust" and not (k > i and self.k[k - 1] == "id") else self.entries(k + 1, close)
                behind, k = "text", close + 1
                continue
            if self.d.name == "rust" and t in ("|", "||") and (k == i or self.t[k - 1] in _CONTINUES or self.t[k - 1] == "move"):
                k = self.rust_closure(k, j, named)
                continue
            if t not in ("?", "!"):
                behind = ""
            elif t == "!" and behind == "name" and self.d.name == "rust":
                pass
            k += 1
        return out

    def template(self, i: int) -> Items:
        """Calls in `${...}` of a template string, by name."""
        out: Items = []
        for m in re.finditer(r"\$\{([^{}]*)\}", self.t[i]):
            for c in re.finditer(r"(?<![\w.$])((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\(", m[1]):
                out.append(self.emit(c[1], "call", i, i, None))
        return out

    def entries(self, i: int, j: int) -> Items:
        """Entries of an object, a composite or an initialiser."""
        out: Items = []
        while i < j:
            stop = self.find(i, j, ",", ";")
            p = i
            while p < stop and self.t[p] in ("async", "get", "set", "*") and p + 1 < stop and self.k[p + 1] in ("id", "str"):
                p += 1
            if self.d.name == "ecma" and p < stop and self.k[p] in ("id", "str") and self.word(p + 1) == "(" and self.word(self.past(p + 1)) == "{":
                self.literal(p, p + 1, stop, self.t[p].strip("\"'"))
            else:
                colon = self.find(i, stop, ":")
                named = self.t[i].strip("\"'") if colon == i + 1 and self.k[i] in ("id", "str") else None
                out += self.single(colon + 1, stop, named) if colon == i + 1 else self.single(i, stop)
            i = stop + 1
        return out

    def construction(self, k: int, j: int, named: str | None) -> tuple[Items, int]:
        """`new Type(...)`, with the body of an anonymous class or an initialiser."""
        q, names = k + 1, []
        while q < j and self.k[q] == "id":
            names.append(self.t[q])
            q += 1
            if self.word(q) in (".", "::") and q < j:
                names.append(self.t[q])
                q += 1
                continue
            break
        q = self.angles(q, j) if self.word(q) == "<" else q
        if self.word(q) == "[":
            out = self.expr(q + 1, min(self.match[q], j))
            q = self.past(q)
            return (out + self.entries(q + 1, min(self.match[q], j)), self.past(q)) if self.word(q) == "{" and q < j else (out, q)
        out: Items = []
        close = q - 1
        args: list[str] = []
        if q < j and self.t[q] == "(":
            close = min(self.match[q], j)
            out, args = self.expr(q + 1, close), self.arguments(q + 1, close)
            q = close + 1
        out.append(self.emit("".join(names), "constructs", k, close, named, args))
        if q < j and self.t[q] == "{":
            end = min(self.match[q], j)
            if self.d.name == "java":
                scope, _ = self.enter("class", f"<anonymous@{self.line(k)}>", k, end + 1, bases="".join(names))
                self.inside(scope, lambda: self.block(q + 1, end))
            else:
                out += self.entries(q + 1, end)
            q = end + 1
        return out, q

    def arguments(self, i: int, j: int) -> list[str]:
        out = []
        while i < j:
            stop = self.find(i, j, ",")
            out.append(re.sub(r"\s+", " ", self.source(i, stop))[:256])
            i = stop + 1
        return out

    def chain(self, k: int, j: int, behind: str, member: str, named: str | None) -> tuple[Items, int, str, str]:
        """Names joined by dots, and the call that they end in, if any."""
        start, name, last = k, self.t[k], self.t[k]
        k += 1
        if behind and behind != "name" and self.t[start - 1] not in (".", "?.", "->", "::"):
            behind = ""
        while k < j:
            t = self.t[k]
            if t in (".", "?.", "::", "->") and k + 1 < j and self.k[k + 1] == "id" and not (self.d.name == "java" and t == "->"):
                joint = "." if t == "?." else t
                name, last = name + joint + self.t[k + 1], self.t[k + 1]
                k += 2
                continue
            if t == "::" and self.word(k + 1) == "<":
                k = max(self.angles(k + 1, j), k + 1)
                continue
            if t == "!" and k + 1 < j and self.t[k + 1] in (".", "(", "[", "{") and self.d.name in ("ecma", "dart", "csharp", "rust"):
                if self.d.name == "rust":  # a macro
                    close = min(self.match[k + 1], j) if self.t[k + 1] in "([{" else k + 1
                    items = self.expr(k + 2, close)
                    return [*items, self.emit(name + "!", "call", start, close, named, self.arguments(k + 2, close))], close + 1, "call", last
                k += 1
                continue
            if t == "<":
                after = self.angles(k, j)
                if after > k and self.word(after) == "(" and after < j:
                    k = after
                    continue
            break
        if k < j and self.d.name == "java" and self.t[k] == "->":
            return self.closure(start, start, k, j, named), j, "", ""
        if k >= j or self.t[k] != "(" or last in _NEVER_CALLED and name == last and not behind or self.d.newlines and self.new[k] and self.d.name == "go":
            return [], k, "name" if behind in ("", "name") else behind, last
        if self.d.name == "dart" and self.word(min(self.match[k], self.n - 1) + 1) == "{" and self.scope.flows is False and self.scope.kind == "file":
            return [], k, "name", last
        close = min(self.match[k], j)
        items = self.expr(k + 1, close)
        callee = name
        if behind in ("call", "group", "text", "function"):
            callee = f"{member}.{last}" if self.d.name == "java" and behind == "call" and member else last
        elif behind == "index":
            callee = f"[{last}]"
        kind = "constructs" if self.d.name in ("dart",) and last[:1].isupper() and name == last else "call"
        items.append(self.emit(callee, kind, start, close, named, self.arguments(k + 1, close)))
        return items, close + 1, "call", last

    def emit(self, name: str, kind: str, i: int, j: int, assigned: str | None, args: list[str] | None = None) -> tuple:
        name = re.sub(r"\s+", " ", name)
        ref = self.sink.call(self.scope.owner, name, kind, self.line(i), self.last_line(min(j, self.n - 1)), args or [], assigned)
        return ("call", ref, name, self.line(i), "[" in name)
