"""SQL flows in Java methods (D-JAVA): a tokenizer, a statement and expression parser, and an abstract run of each entry point.

A value is known (a literal), clean, or tainted by a request; a prepared statement keeps the state of its
text, so values bound to a literal text leave it clean. Branches are joined: what is tainted in one of them is tainted
behind both; a branch whose condition is a known constant is the only one that runs. Helpers of the same file run with the caller's
values. A file whose braces or statements do not parse gives one row that says so, never silence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

_TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*")|(?P<char>\'(?:\\.|[^\'\\\n])+\')|(?P<num>0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|\d[\d_]*(?:\.[\d_]+)?(?:[eE][+-]?\d+)?[lLfFdD]?)'
    r"|(?P<word>@?[A-Za-z_$][\w$]*)|(?P<op>->|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|[{}()\[\];,.?:=<>!~+\-*/%&|^@])",
    re.S,
)
# Servlet sources, SQL sinks, receivers that make them one, and calls that leave no text behind.
SOURCES = {"getCookies", "getHeader", "getHeaders", "getInputStream", "getParameter", "getParameterMap", "getParameterNames", "getParameterValues", "getPathInfo", "getQueryString", "getReader"}
SINKS = {"addBatch", "batchUpdate", "execute", "executeBatch", "executeLargeBatch", "executeLargeUpdate", "executeQuery", "executeUpdate", "prepareCall", "prepareStatement", "query", "queryForList", "queryForMap", "queryForObject", "queryForRowSet", "update"}
RECEIVERS = ("callablestatement", "connection", "databasehelper", "entitymanager", "jdbctemplate", "namedparameterjdbctemplate", "preparedstatement", "statement")
NUMBERS = {"byteValue", "doubleValue", "floatValue", "intValue", "longValue", "parseDouble", "parseFloat", "parseInt", "parseLong", "shortValue", "length", "size", "hashCode", "indexOf", "lastIndexOf"}
TRUTHS = {"contains", "containsKey", "containsValue", "endsWith", "equals", "equalsIgnoreCase", "hasMoreElements", "isBlank", "isEmpty", "isPresent", "matches", "startsWith"}
PARAMETERS = {"@RequestParam", "@PathVariable", "@RequestHeader", "@CookieValue"}
MAPPINGS = {"@GetMapping", "@PostMapping", "@PutMapping", "@PatchMapping", "@DeleteMapping", "@RequestMapping"}
# End of the fixed values.
_KEYWORDS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "new", "throw", "else", "do", "try", "super", "this", "case", "assert"}
_MODIFIERS = {"final", "static", "public", "private", "protected", "transient", "volatile", "abstract", "strictfp"}
_UNKNOWN = object()
DEPTH = 5


class Unparsed(ValueError):
    """The file is no complete Java source."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int


def tokens(text: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unparsed(f"line {line}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


@dataclass(frozen=True)
class Value:
    """An abstract value: the line of the source that taints it (0: none), a constant, its type, and the parts of a collection."""

    source: int = 0
    const: object = _UNKNOWN
    kind: str = ""
    parts: tuple | None = None  # of (key, value); the key of a list is its place, _UNKNOWN for any

    @property
    def known(self) -> bool:
        return self.const is not _UNKNOWN


CLEAN = Value()


def _joined(values: list[Value]) -> Value:
    if not values:
        return CLEAN
    first = values[0]
    source = min((v.source for v in values if v.source), default=0)
    const = first.const if all(v.known and first.known and type(v.const) is type(first.const) and v.const == first.const for v in values) else _UNKNOWN
    parts = None
    if all(v.parts is not None for v in values):
        keys = list(dict.fromkeys(k for v in values for k, _ in v.parts))
        parts = tuple((k, _joined([x for v in values for j, x in v.parts if j is k or j == k])) for k in keys)
    return Value(source, const, next((v.kind for v in values if v.kind), ""), parts)


def _part(box: Value, key: object) -> Value:
    if box.parts is None:
        return Value(box.source, kind=box.kind)
    exact = [v for k, v in box.parts if k == key] if key is not _UNKNOWN and all(k is not _UNKNOWN for k, _ in box.parts) else []
    return _joined(exact or [v for _, v in box.parts])


class Parser:
    """Statements and expressions as tuples, from tokens of one method body."""

    def __init__(self, toks: list[Token]) -> None:
        self.toks, self.at = toks, 0

    def peek(self, k: int = 0) -> str:
        return self.toks[self.at + k].text if self.at + k < len(self.toks) else ""

    def take(self, text: str | None = None) -> Token:
        if self.at >= len(self.toks) or (text is not None and self.peek() != text):
            raise Unparsed(f"line {self.toks[min(self.at, len(self.toks) - 1)].line if self.toks else 0}")
        self.at += 1
        return self.toks[self.at - 1]

    def block(self) -> tuple:
        self.take("{")
        body = []
        while self.peek() != "}":
            body.append(self.statement())
        self.take("}")
        return ("block", body)

    def statement(self) -> tuple:
        t = self.peek()
        if t == "{":
            return self.block()
        if t == ";":
            self.take()
            return ("block", [])
        if t == "if":
            self.take()
            test = self.parens()
            then = self.statement()
            other = None
            if self.peek() == "else":
                self.take()
                other = self.statement()
            return ("if", test, then, other)
        if t == "while":
            self.take()
            test = self.parens()
            return ("loop", [test], None, self.statement(), [])
        if t == "do":
            self.take()
            body = self.statement()
            self.take("while")
            test = self.parens()
            self.take(";")
            return ("block", [body, ("loop", [test], None, body, [])])
        if t == "for":
            return self.for_()
        if t in ("return", "throw"):
            self.take()
            value = None if self.peek() == ";" else self.expression()
            self.take(";")
            return (t, value)
        if t in ("break", "continue"):
            self.take()
            if self.peek() != ";":
                self.take()
            self.take(";")
            return (t,)
        if t == "try":
            return self.try_()
        if t == "switch":
            return self.switch()
        if t == "synchronized":
            self.take()
            self.parens()
            return self.block()
        if t in ("class", "interface", "enum", "record"):
            while self.peek() != "{":
                self.take()
            self.skip("{", "}")
            return ("block", [])
        if t.isidentifier() and self.peek(1) == ":" and self.peek(2) != ":":
            self.at += 2
            return self.statement()
        found = self.declaration() or ("expr", self.expression())
        self.take(";")
        return found

    def skip(self, a: str, b: str) -> list[Token]:
        start, depth = self.at, 0
        while True:
            t = self.take().text
            depth += (t == a) - (t == b)
            if depth == 0:
                return self.toks[start : self.at]

    def parens(self) -> tuple:
        self.take("(")
        value = self.expression()
        self.take(")")
        return value

    def for_(self) -> tuple:
        self.take("for")
        self.take("(")
        begin = self.at
        kind = self.type_()
        if kind and self.at < len(self.toks) and self.toks[self.at].kind == "word" and self.peek(1) == ":":
            name = self.take().text
            self.take(":")
            source = self.expression()
            self.take(")")
            return ("loop", [], (name, source), self.statement(), [])
        self.at = begin
        first, tests, updates = [], [], []
        if self.peek() != ";":
            first.append(self.declaration() or ("expr", self.expression()))
            while self.peek() == ",":
                self.take()
                first.append(("expr", self.expression()))
        self.take(";")
        if self.peek() != ";":
            tests.append(self.expression())
        self.take(";")
        while self.peek() != ")":
            updates.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return ("block", [*first, ("loop", tests, None, self.statement(), updates)])

    def try_(self) -> tuple:
        self.take("try")
        opened = []
        if self.peek() == "(":
            self.take()
            while self.peek() != ")":
                opened.append(self.declaration() or ("expr", self.expression()))
                if self.peek() == ";":
                    self.take()
            self.take(")")
        body, handlers, last = self.block(), [], None
        while self.peek() == "catch":
            self.take()
            self.skip("(", ")")
            handlers.append(self.block())
        if self.peek() == "finally":
            self.take()
            last = self.block()
        return ("try", opened, body, handlers, last)

    def switch(self) -> tuple:
        self.take("switch")
        value = self.parens()
        self.take("{")
        groups: list[tuple[list, list, bool]] = []
        while self.peek() != "}":
            labels: list = []
            arrow = False
            while self.peek() in ("case", "default"):
                if self.take().text == "default":
                    labels.append(None)
                else:
                    labels.append(self.expression(2))
                    while self.peek() == ",":
                        self.take()
                        labels.append(self.expression(2))
                if self.peek() == "->":
                    arrow = True
                    self.take()
                    break
                self.take(":")
            body = []
            if arrow:
                body.append(self.statement())
            else:
                while self.peek() not in ("case", "default", "}"):
                    body.append(self.statement())
            groups.append((labels, body, arrow))
        self.take("}")
        return ("switch", value, groups)

    def type_(self) -> str:
        """A type at this place, or nothing and no move."""
        begin, name = self.at, ""
        while self.peek() in _MODIFIERS or self.peek().startswith("@"):
            annotated = self.take().text.startswith("@")
            if annotated and self.peek() == "(":
                self.skip("(", ")")
        while self.at < len(self.toks) and self.toks[self.at].kind == "word" and self.peek() not in _KEYWORDS:
            name += self.take().text
            if self.peek() == "<" and not self.generic():
                break
            if self.peek() != ".":
                break
            name += self.take().text
        while self.peek() == "[" and self.peek(1) == "]":
            self.at += 2
            name += "[]"
        if self.peek() == "." and self.peek(1) == ".":
            self.at += 3
        if not name:
            self.at = begin
        return name

    def generic(self) -> bool:
        begin, depth = self.at, 0
        while self.at < len(self.toks):
            t = self.take().text
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return True
            if not (t in "<>,.?&[]" or t.isidentifier() or t.startswith("@")):
                break
        self.at = begin
        return False

    def declaration(self) -> tuple | None:
        begin = self.at
        kind = self.type_()
        if not kind or self.at >= len(self.toks) or self.toks[self.at].kind != "word" or self.peek(1) not in ("=", ";", ",", "[", ")"):
            self.at = begin
            return None
        names = []
        while True:
            name = self.take().text
            while self.peek() == "[":
                self.skip("[", "]")
            value = None
            if self.peek() == "=":
                self.take()
                value = self.array() if self.peek() == "{" else self.expression()
            names.append((name, value))
            if self.peek() != ",":
                return ("decl", kind, names)
            self.take()

    def array(self) -> tuple:
        line = self.take("{").line
        items = []
        while self.peek() != "}":
            items.append(self.array() if self.peek() == "{" else self.expression())
            if self.peek() == ",":
                self.take()
        self.take("}")
        return ("array", items, line)

    _LEVELS = ({"="}, {"?"}, {"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!="}, {"<", ">", "<=", ">=", "instanceof"}, {"+", "-"}, {"*", "/", "%"})

    def expression(self, level: int = 0) -> tuple:
        if level == 0 and self.lambda_():
            return ("opaque",)
        if level >= len(self._LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        if level == 0:
            if self.peek() == "=" or (len(self.peek()) == 2 and self.peek()[1] == "=" and self.peek()[0] in "+-*/%&|^"):
                op = self.take().text
                return ("assign", op, left, self.expression(0))
            return left
        if level == 1:
            if self.peek() == "?":
                self.take()
                then = self.expression(0)
                self.take(":")
                return ("choice", left, then, self.expression(0))
            return left
        while self.peek() in self._LEVELS[level]:
            op = self.take().text
            if op == "instanceof":
                self.type_()
                if self.at < len(self.toks) and self.toks[self.at].kind == "word":
                    self.take()
                left = ("opaque",)
                continue
            if op in "<>" and self.peek() == op:  # shifts
                while self.peek() == op:
                    self.take()
            left = ("binary", op, left, self.expression(level + 1))
        return left

    def lambda_(self) -> bool:
        """Skips a lambda; its body is not run."""
        begin = self.at
        if self.peek() == "(":
            try:
                self.skip("(", ")")
            except Unparsed:
                self.at = begin
                return False
        elif self.at < len(self.toks) and self.toks[self.at].kind == "word":
            self.take()
        if self.at > begin and self.peek() == "->":
            self.take()
            if self.peek() == "{":
                self.skip("{", "}")
            else:
                self.expression(0)
            return True
        self.at = begin
        return False

    def unary(self) -> tuple:
        t = self.peek()
        if t in ("!", "-", "+", "~", "++", "--"):
            self.take()
            return ("unary", t, self.unary())
        if t == "(":
            begin = self.at
            self.take()
            kind = self.type_()
            if kind and self.peek() == ")" and (self.peek(1) in ("(", "!", "~") or (self.at + 1 < len(self.toks) and self.toks[self.at + 1].kind in ("word", "str", "char", "num") and self.peek(1) != "instanceof")):
                self.take(")")
                return ("cast", kind, self.unary())
            self.at = begin
        return self.postfix(self.primary())

    def primary(self) -> tuple:
        token = self.take()
        if token.kind == "str":
            return ("const", token.text[3:-3] if token.text.startswith('"""') else token.text[1:-1])
        if token.kind == "char":
            return ("const", token.text[1:-1])
        if token.kind == "num":
            digits = token.text.rstrip("lLfFdD") if not token.text.lower().startswith("0x") else token.text.rstrip("lL")
            try:
                return ("const", int(digits.replace("_", ""), 0))
            except ValueError:
                try:
                    return ("const", float(digits.replace("_", "")))
                except ValueError:
                    return ("opaque",)
        if token.text == "(":
            value = self.expression()
            self.take(")")
            return value
        if token.text in ("true", "false", "null"):
            return ("const", {"true": True, "false": False, "null": None}[token.text])
        if token.text == "new":
            kind = self.type_()
            if self.peek() == "[":
                while self.peek() == "[":
                    self.skip("[", "]")
                return self.array() if self.peek() == "{" else ("new", kind, [], token.line)
            if kind.endswith("[]"):
                return self.array()
            args = self.arguments()
            if self.peek() == "{":
                self.skip("{", "}")
            return ("new", kind, args, token.line)
        if token.text == "switch":
            self.at -= 1
            self.switch()
            return ("opaque",)
        if token.kind == "word":
            if self.peek() == "(":
                return ("call", None, token.text, self.arguments(), token.line)
            return ("name", token.text)
        raise Unparsed(f"line {token.line}")

    def arguments(self) -> list[tuple]:
        self.take("(")
        found = []
        while self.peek() != ")":
            found.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return found

    def postfix(self, value: tuple) -> tuple:
        while True:
            t = self.peek()
            if t == ".":
                self.take()
                if self.peek() == "<":
                    self.generic()
                token = self.take()
                value = ("call", value, token.text, self.arguments(), token.line) if self.peek() == "(" else ("field", value, token.text)
            elif t == "[":
                self.take()
                value = ("index", value, self.expression())
                self.take("]")
            elif t == "::":
                self.at += 2
                value = ("opaque",)
            elif t in ("++", "--"):
                self.take()
            else:
                return value


@dataclass
class Method:
    name: str
    params: list[tuple[str, str, bool]]  # type, name, whether annotated as input
    entry: bool
    body: list[Token]
    tree: tuple | None = None


def methods(toks: list[Token]) -> list[Method]:
    """Method declarations with a body, found by their shape: type, name, parameters, optional throws, brace."""
    closing: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    pairs = {")": "(", "}": "{", "]": "["}
    for i, t in enumerate(toks):
        if t.kind == "op" and t.text in "({[":
            stack.append((t.text, i))
        elif t.kind == "op" and t.text in pairs:
            if not stack or stack[-1][0] != pairs[t.text]:
                raise Unparsed(f"line {t.line}")
            closing[stack.pop()[1]] = i
    if stack:
        raise Unparsed(f"line {toks[stack[-1][1]].line}")
    found = []
    for i in range(1, len(toks) - 2):
        before = toks[i - 1]
        if toks[i].kind != "word" or toks[i].text in _KEYWORDS or toks[i + 1].text != "(" or not (before.kind == "word" and before.text not in _KEYWORDS or before.text in (">", "]")):
            continue
        end = closing[i + 1]
        k = end + 1
        if k < len(toks) and toks[k].text == "throws":
            while k < len(toks) and toks[k].text not in "{;":
                k += 1
        if k >= len(toks) or toks[k].text != "{":
            continue
        head = i
        while head and toks[head - 1].text not in ("{", "}", ";"):
            head -= 1
        params = []
        part: list[Token] = []
        depth = 0
        for t in [*toks[i + 2 : end], Token("op", ",", 0)]:
            depth += (t.text in "(<[") - (t.text in ")>]") if t.kind == "op" else 0
            if t.text == "," and depth == 0:
                words = [x.text for x in part if x.kind == "word" and not x.text.startswith("@") and x.text not in _MODIFIERS]
                if len(words) >= 2:
                    params.append((words[-2], words[-1], any(x.text in PARAMETERS for x in part)))
                part = []
            else:
                part.append(t)
        marked = any(t.text in MAPPINGS for t in toks[head:i])
        entry = marked or toks[i].text in ("doGet", "doPost", "service") or any(a or "HttpServletRequest" in kind for kind, _, a in params)
        found.append(Method(toks[i].text, params, entry, toks[k : closing[k] + 1]))
    return found


class Run:
    """The abstract run of the entry points of one file."""

    def __init__(self, text: str) -> None:
        self.methods: dict[str, list[Method]] = {}
        for m in methods(tokens(text)):
            self.methods.setdefault(m.name, []).append(m)
        self.found: set[tuple[int, int, str]] = set()
        self.stack: list[tuple] = []
        self.returns: list[Value] = []

    def all(self) -> list[tuple[int, int, str]]:
        """(source line, sink line, subtype) of all entry points."""
        for own in self.methods.values():
            for m in own:
                if m.entry:
                    self.invoke(m, [])
        return sorted(self.found)

    def invoke(self, m: Method, args: list[Value]) -> Value:
        key = (id(m), tuple(bool(a.source) for a in args))
        if key in self.stack or len(self.stack) > DEPTH:
            return _joined(args)
        if m.tree is None:
            m.tree = Parser(m.body).block()
        env: dict[str, Value] = {}
        for i, (kind, name, annotated) in enumerate(m.params):
            value = args[i] if i < len(args) else CLEAN
            if "HttpServletRequest" in kind:
                value = Value(kind="request")
            elif annotated and not args:
                value = Value(m.body[0].line)
            env[name] = value if value.kind else replace(value, kind=kind)
        held, self.returns = self.returns, []
        self.stack.append(key)
        try:
            self.run(m.tree, env)
            return _joined(self.returns)
        finally:
            self.stack.pop()
            self.returns = held

    def branches(self, env: dict[str, Value], bodies: list) -> bool:
        """Runs each of the bodies from ``env`` and joins those that go on; false if none does."""
        ends = []
        for body in bodies:
            own = dict(env)
            if body is None or self.run(body, own):
                ends.append(own)
        if not ends:
            return False
        joined = {k: _joined([e.get(k, CLEAN) for e in ends]) for k in set().union(*ends)}
        env.clear()
        env.update(joined)
        return True

    def run(self, node: tuple, env: dict[str, Value]) -> bool:
        """One statement; false if what follows in its block is not reached."""
        kind = node[0]
        if kind == "block":
            return all(self.run(s, env) for s in node[1])
        if kind == "decl":
            for name, value in node[2]:
                v = self.eval(value, env) if value else CLEAN
                env[name] = replace(v, kind=node[1] if not v.kind or v.kind == "text" else v.kind)
        elif kind == "expr":
            self.eval(node[1], env)
        elif kind == "if":
            test = self.eval(node[1], env)
            if test.const is True:
                return self.run(node[2], env)
            if test.const is False:
                return node[3] is None or self.run(node[3], env)
            return self.branches(env, [node[2], node[3]])
        elif kind == "loop":
            for e in node[1]:
                self.eval(e, env)
            if node[2]:
                env[node[2][0]] = _part(self.eval(node[2][1], env), _UNKNOWN)
            body = ("block", [node[3], *[("expr", e) for e in node[4]]])
            for _ in range(2):  # what one round leaves behind is seen by the next
                self.branches(env, [body, None])
        elif kind in ("return", "throw"):
            value = self.eval(node[1], env) if node[1] else CLEAN
            if kind == "return":
                self.returns.append(value)
            return False
        elif kind in ("break", "continue"):
            return False
        elif kind == "try":
            for s in node[1]:
                self.run(s, env)
            before = dict(env)
            self.branches(env, [node[2], *[("block", [node[2], h]) for h in node[3]]]) or env.update(before)
            for h in node[3]:
                self.run(h, dict(before))
            if node[4]:
                return self.run(node[4], env)
        elif kind == "switch":
            return self.switch(node, env)
        return True

    def switch(self, node: tuple, env: dict[str, Value]) -> bool:
        value = self.eval(node[1], env)
        groups = node[2]
        match: list[int] = []
        default = next((i for i, (labels, _, _) in enumerate(groups) if None in labels), None)
        for i, (labels, _, _) in enumerate(groups):
            if not value.known or any(x is not None and self.eval(x, env).const == value.const for x in labels):
                match.append(i)
        if value.known:
            match = match[:1] or ([default] if default is not None else [])
        bodies: list = []
        for start in match:
            body = []
            for _, part, arrow in groups[start:]:
                body += part
                if arrow or any(s[0] in ("break", "return", "throw", "continue") for s in part):
                    break
            bodies.append(("block", [("until", body)]))
        if not bodies or (not value.known and default is None):
            bodies.append(None)
        return self.branches(env, [b if b is None else ("block", _before_break(b[1][0][1])) for b in bodies])

    def eval(self, node: tuple, env: dict[str, Value]) -> Value:
        kind = node[0]
        if kind == "const":
            return Value(const=node[1], kind="text" if isinstance(node[1], str) else "")
        if kind == "name":
            return env.get(node[1], CLEAN)
        if kind == "field":
            inner = self.eval(node[1], env)
            return env.get(_name(node), Value(inner.source))
        if kind == "index":
            return _part(self.eval(node[1], env), self.eval(node[2], env).const)
        if kind == "array":
            items = [self.eval(x, env) for x in node[1]]
            return Value(min((x.source for x in items if x.source), default=0), parts=tuple(enumerate(items)))
        if kind == "cast":
            return self.eval(node[2], env)
        if kind == "unary":
            v = self.eval(node[2], env)
            if v.known and node[1] in ("!", "-", "+") and not isinstance(v.const, (str, type(None))):
                return Value(v.source, {"!": lambda x: not x, "-": lambda x: -x, "+": lambda x: x}[node[1]](v.const))
            return Value(v.source)
        if kind == "binary":
            return self.binary(node[1], self.eval(node[2], env), self.eval(node[3], env))
        if kind == "choice":
            test = self.eval(node[1], env)
            if test.const is True:
                return self.eval(node[2], env)
            if test.const is False:
                return self.eval(node[3], env)
            return _joined([self.eval(node[2], env), self.eval(node[3], env)])
        if kind == "assign":
            value = self.eval(node[3], env)
            if node[1] != "=":
                value = self.binary(node[1][0], self.eval(node[2], env), value)
            self.assign(node[2], value, env)
            return value
        if kind == "new":
            args = [self.eval(a, env) for a in node[2]]
            lower = node[1].lower()
            if any(x in lower for x in ("list", "vector", "map", "deque", "set")):
                return Value(kind=node[1], parts=tuple(p for a in args if a.parts for p in a.parts))
            if any(a.kind == "request" for a in args):
                return Value(kind="request")
            const = args[0].const if len(args) == 1 and "stringbu" in lower and isinstance(args[0].const, str) else "" if not args and "stringbu" in lower else _UNKNOWN
            return Value(min((a.source for a in args if a.source), default=0), const, node[1])
        if kind == "call":
            return self.call(node, env)
        return CLEAN

    @staticmethod
    def binary(op: str, a: Value, b: Value) -> Value:
        source = min((x.source for x in (a, b) if x.source), default=0)
        if a.known and b.known:
            try:
                if op == "+" and (isinstance(a.const, str) or isinstance(b.const, str)):
                    return Value(source, f"{a.const}{b.const}", "text")
                done = {
                    "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y if isinstance(x, float) or isinstance(y, float) else int(x / y), "%": lambda x, y: x - y * int(x / y),
                    ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "&&": lambda x, y: bool(x and y), "||": lambda x, y: bool(x or y),
                }.get(op)
                if done:
                    return Value(source, done(a.const, b.const))
            except (TypeError, ValueError, ZeroDivisionError, OverflowError):
                pass
        return CLEAN if op in ("==", "!=", "<", ">", "<=", ">=", "&&", "||") else Value(source, kind="text" if op == "+" else "")

    def assign(self, target: tuple, value: Value, env: dict[str, Value]) -> None:
        if target[0] in ("name", "field"):
            name = _name(target)
            old = env.get(name)
            env[name] = replace(value, kind=value.kind or (old.kind if old else ""))
        elif target[0] == "index":
            self.put(_name(target[1]), self.eval(target[2], env).const, value, env)

    @staticmethod
    def put(name: str, key: object, value: Value, env: dict[str, Value]) -> None:
        box = env.get(name, CLEAN)
        parts = tuple((k, v) for k, v in box.parts or () if key is _UNKNOWN or k != key) + ((key, value),)
        env[name] = replace(box, source=min((x for x in (box.source, value.source) if x), default=0), parts=parts)

    def call(self, node: tuple, env: dict[str, Value]) -> Value:
        _, receiver, name, arguments, line = node
        box = self.eval(receiver, env) if receiver else CLEAN
        args = [self.eval(a, env) for a in arguments]
        where = _name(receiver) if receiver else ""
        source = min((x.source for x in (box, *args) if x.source), default=0)
        if name in SOURCES and box.kind == "request" or box.kind == "request" and re.match(r"(?:get|read|extract).*(?:body|cookie|header|input|parameter|path|query)", name, re.I):
            return Value(line, kind="text")
        if name in NUMBERS or name in TRUTHS or name == "encodeForSQL":
            if name == "size" and box.parts is not None and all(k is not _UNKNOWN for k, _ in box.parts):
                return Value(const=len(box.parts))
            return CLEAN
        if name == "charAt" and isinstance(box.const, str) and args and isinstance(args[0].const, int) and 0 <= args[0].const < len(box.const):
            return Value(box.source, box.const[args[0].const])
        if name in SINKS and any(r in f"{where} {box.kind}".lower() for r in RECEIVERS):
            text = args[0] if args else box
            prepared = name in ("prepareCall", "prepareStatement")
            if text.source and not (box.kind == "reported" and not args):
                self.found.add((text.source, line, "prepared_sql" if prepared else "request_to_sql"))
            if prepared:
                return Value(text.source, kind="reported preparedstatement" if text.source else "preparedstatement")
            if name == "addBatch":
                return box
            return CLEAN
        if re.match(r"set[A-Z]", name) and "preparedstatement" in box.kind.lower():
            return box  # a bound value leaves the text as it is
        if name in ("append", "insert", "concat"):
            added = args[-1] if args else CLEAN
            const = f"{box.const}{added.const}" if isinstance(box.const, str) and added.known and name != "insert" else _UNKNOWN
            value = Value(source, const, box.kind)
            root = _chain(receiver) if receiver else ""
            if name != "concat" and root:
                env[root] = value
            return value
        if where and name in ("add", "addFirst", "addLast", "offer", "push", "addAll"):
            known = env.get(where, CLEAN).parts or ()
            if name in ("addAll", "addFirst", "push") or len(args) != 1:
                self.put(where, _UNKNOWN, args[-1] if args else CLEAN, env)
            else:
                self.put(where, len(known), args[0], env)
            return CLEAN
        if where and name in ("put", "setProperty", "putIfAbsent") and len(args) == 2:
            self.put(where, args[0].const, args[1], env)
            return args[1]
        if where and name in ("remove", "poll", "pop"):
            gone = _part(box, args[0].const if args else 0)
            if box.parts is not None and all(k is not _UNKNOWN for k, _ in box.parts):
                key = args[0].const if args else 0
                left = [v for k, v in box.parts if k != key] if isinstance(key, int) else None
                parts = tuple(enumerate(left)) if left is not None else tuple((k, v) for k, v in box.parts if k != key)
                env[where] = replace(box, parts=parts, source=min((v.source for _, v in parts if v.source), default=0))
            return gone
        if box.parts is not None and name in ("get", "elementAt", "peek", "firstElement", "lastElement", "nextElement", "getProperty", "getOrDefault", "iterator", "next", "values"):
            found = _part(box, args[0].const if args else _UNKNOWN)
            return box if name in ("iterator", "values") else _joined([found, *args[1:]])
        own = self.methods.get(name)
        if own and (receiver is None or where in ("this", "super") or receiver[0] == "new"):
            return self.invoke(min(own, key=lambda m: abs(len(m.params) - len(args))), args)
        return Value(source, kind=box.kind if box.kind not in ("text", "request") else "")


def _before_break(body: list) -> list:
    """Statements up to the first break; a break inside ends its own branch."""
    out = []
    for s in body:
        if s[0] == "break":
            break
        out.append(s)
    return out


def _name(node: tuple) -> str:
    """The dotted name of a name or field; nothing for other expressions."""
    if node[0] == "name":
        return node[1]
    if node[0] == "field":
        inner = _name(node[1])
        return f"{inner}.{node[2]}" if inner else ""
    return ""


def _chain(node: tuple) -> str:
    """The name at the root of a chain of calls (``b`` of ``b.append(x).append(y)``)."""
    while node[0] == "call" and node[1] is not None:
        node = node[1]
    return _name(node)


def java_sql_flows(text: str) -> list[tuple]:
    """(rule_id, severity, source, sink, source_line, sink_line) of one Java file; one POLYGLOT_ANALYSIS_INCOMPLETE if it does not parse."""
    try:
        found = Run(text).all()
    except (Unparsed, RecursionError):
        return [("POLYGLOT_ANALYSIS_INCOMPLETE", "low", "none", "sql", 0, 0)]
    return [("WEB_UNTRUSTED_INPUT_TO_SQL", "critical", "request", "sql", a, b) for a, b in sorted({(a, b) for a, b, _ in found})]
