"""Flows of Python code across functions and files (D-TAINT2): facts of each function as rows, closed over the call graph.

One pass over the files gives, for each function, what flows inside it: from a parameter, a source or the
result of a call, to an argument of a call, its own return or a sink. Files are never parsed again. Calls
then meet definitions by name within a project, and joins add what follows until nothing new does:
an argument reaches what the callee's parameter reaches, and a call's result carries what the callee returns.

Most projects are small: one whose texts and flows stay under a size is parsed and closed at once inside a task, by
the same rules and without rows of facts; only larger ones are closed by joins.

A name that a project defines twice is ambiguous: calls of it, as calls of unknown functions, are not
followed; their results carry what their arguments carry. Recursion ends by itself, as facts are a
finite set. Rounds are written to the shared folder, and only rows that are new take part in the next one.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.operators.code import _CLEANERS, _PERSONAL, _REQUEST, _RULES, _SINKS, _dotted
from auditframe.session import materialize, ship

FACT = "array<struct<fid:string,name:string,origin:string,what:string,oline:int,target:string,call:string,callee:string,arg:string,sink:string,tline:int>>"
_FACT_NAMES = ("fid", "name", "origin", "what", "oline", "target", "call", "callee", "arg", "sink", "tline")


@lru_cache(1 << 14)
def _named(name: str) -> tuple[bool, tuple[str, ...], bool]:
    """Whether a dotted name is a request, the kinds of sinks it is called as, and whether it cleans."""
    return bool(_REQUEST.match(name)), tuple(k for k, p in _SINKS.items() if p.search(name)), bool(_CLEANERS.search(name))


@lru_cache(1 << 14)
def _personal(name: str) -> bool:
    return bool(_PERSONAL.search(name))


class _Facts:
    """Labels of values in one function, in the order of statements: ("param" | "source" | "result", name, line)."""

    def __init__(self, path: str, name: str, body: list[ast.stmt], args: ast.arguments | None, line: int, method: bool) -> None:
        self.fid, self.name = f"{path}:{line}:{name}", name
        self.rows: set[tuple] = set()
        self.env: dict[str, frozenset] = {}
        self.calls = 0
        names = [a.arg for a in [*args.posonlyargs, *args.args]] if args else []
        if method and names[:1] in (["self"], ["cls"]):
            names = names[1:]
        extra = [a.arg for a in [*args.kwonlyargs, args.vararg, args.kwarg] if a] if args else []
        for i, p in enumerate(names):
            self._row(("token", p, line), "token", arg=str(i))
        for p in [*names, *extra]:
            self._row(("token", p, line), "token", arg=p)
            self.env[p] = frozenset({("param", p, line)})
        self._row(("def", "", line), "def")
        self.block(body)

    def _row(self, label: tuple, target: str, call: str = "", callee: str = "", arg: str = "", sink: str = "", line: int = 0) -> None:
        self.rows.add((self.fid, self.name, *label, target, call, callee, arg, sink, line))

    def _flow(self, labels: frozenset, target: str, **to) -> None:
        for label in labels:
            self._row(label, target, **to)

    def _bind(self, target: ast.AST, labels: frozenset) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for part in target.elts:
                self._bind(part, labels)
        elif isinstance(target, ast.Starred):
            self._bind(target.value, labels)
        elif isinstance(target, ast.Subscript):  # a part of a container: what it held stays
            name = _dotted(target.value)
            self.env[name] = self.env.get(name, frozenset()) | labels
        else:
            self.env[_dotted(target)] = labels

    def _join(self, *branches: list[ast.stmt]) -> None:
        before, after = dict(self.env), []
        for branch in branches:
            self.env = dict(before)
            self.block(branch)
            after.append(self.env)
        self.env = {k: frozenset().union(*[e.get(k, frozenset()) for e in after]) for k in set().union(*after)}

    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom)):
                continue
            if isinstance(s, ast.Assign):
                labels = self.of(s.value)
                for t in s.targets:
                    self._bind(t, labels)
            elif isinstance(s, ast.AnnAssign):
                if s.value is not None:
                    self._bind(s.target, self.of(s.value))
            elif isinstance(s, ast.AugAssign):
                self._bind(s.target, self.of(s.target) | self.of(s.value))
            elif isinstance(s, ast.Return):
                self._flow(self.of(s.value), "return", line=s.lineno)
            elif isinstance(s, ast.If):
                self.of(s.test)
                self._join(s.body, s.orelse)
            elif isinstance(s, (ast.For, ast.AsyncFor)):
                self._bind(s.target, self.of(s.iter))
                self._join(s.body * 2, [])  # twice: what a round leaves behind is seen by the next
                self.block(s.orelse)
            elif isinstance(s, ast.While):
                self.of(s.test)
                self._join(s.body * 2, [])
                self.block(s.orelse)
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                for item in s.items:
                    labels = self.of(item.context_expr)
                    if item.optional_vars is not None:
                        self._bind(item.optional_vars, labels)
                self.block(s.body)
            elif isinstance(s, (ast.Try, ast.TryStar)):
                self._join([*s.body, *s.orelse], *[[*s.body, *h.body] for h in s.handlers])
                self.block(s.finalbody)
            elif isinstance(s, ast.Match):
                labels = self.of(s.subject)
                for case in s.cases:
                    for part in ast.walk(case.pattern):
                        if isinstance(part, (ast.MatchAs, ast.MatchStar)) and part.name:
                            self.env[part.name] = labels
                self._join(*[c.body for c in s.cases], [])
            else:
                for part in ast.iter_child_nodes(s):
                    self.of(part)

    def of(self, node: ast.AST | None) -> frozenset:
        if node is None or isinstance(node, (ast.Constant, ast.Lambda, ast.expr_context)):
            return frozenset()
        if isinstance(node, ast.Call):
            return self._call(node)
        if isinstance(node, (ast.Name, ast.Attribute)):
            simple = isinstance(node, ast.Name)
            name = node.id if simple else _dotted(node)
            found = self.env.get(name, frozenset())
            if not simple:
                found |= self.of(node.value)
            if _personal(node.id if simple else node.attr):
                found |= {("source", "personal", node.lineno)}
            if _named(name)[0]:
                found |= {("source", "request", node.lineno)}
            return found
        if isinstance(node, ast.Subscript):
            key = node.slice.value if isinstance(node.slice, ast.Constant) else None
            self.of(node.slice)
            return self.of(node.value) | ({("source", "personal", node.lineno)} if isinstance(key, str) and _personal(key) else frozenset())
        if isinstance(node, ast.NamedExpr):
            labels = self.of(node.value)
            self._bind(node.target, labels)
            return labels
        if isinstance(node, ast.IfExp):
            self.of(node.test)
            return self.of(node.body) | self.of(node.orelse)
        if isinstance(node, ast.Compare):  # a truth value
            self.of(node.left)
            for part in node.comparators:
                self.of(part)
            return frozenset()
        if isinstance(node, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            for g in node.generators:
                self._bind(g.target, self.of(g.iter))
            parts = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
            return frozenset().union(*[self.of(p) for p in parts])
        return frozenset().union(*[self.of(c) for c in ast.iter_child_nodes(node)])

    def _call(self, node: ast.Call) -> frozenset:
        name = _dotted(node.func)
        self.calls += 1
        call = f"{self.fid}#{self.calls}"
        receiver = self.of(node.func.value) if isinstance(node.func, ast.Attribute) else frozenset()
        given = [(str(i), self.of(a.value if isinstance(a, ast.Starred) else a)) for i, a in enumerate(node.args)]
        given += [(k.arg or "**", self.of(k.value)) for k in node.keywords]
        if isinstance(node.func, ast.Attribute) and node.func.attr in {"append", "add", "extend", "insert", "update", "appendleft"}:
            box = _dotted(node.func.value)
            self.env[box] = self.env.get(box, frozenset()).union(*[x for _, x in given])
        request, sinks, cleans = _named(name)
        for kind in sinks:
            heard = given[:1] if name.endswith((".execute", ".raw", ".executemany")) else given
            for _, labels in heard:
                self._flow(labels, "sink", sink=kind, line=node.lineno)
        if cleans:
            return frozenset()
        callee = name.rsplit(".", 1)[-1]
        for arg, labels in given:
            self._flow(labels, "arg", call=call, callee=callee, arg=arg, line=node.lineno)
        self._row(("call", "", node.lineno), "call", call=call, callee=callee, line=node.lineno)
        out = receiver | {("result", call, node.lineno)}
        return out | {("source", "request", node.lineno)} if request else out


#: The fields of a node that hold statements, handlers or cases: definitions stand nowhere else.
_BLOCKS = {
    ast.Module: ("body",), ast.ClassDef: ("body",), ast.FunctionDef: ("body",), ast.AsyncFunctionDef: ("body",), ast.With: ("body",), ast.AsyncWith: ("body",), ast.ExceptHandler: ("body",), ast.match_case: ("body",),
    ast.If: ("body", "orelse"), ast.For: ("body", "orelse"), ast.AsyncFor: ("body", "orelse"), ast.While: ("body", "orelse"), ast.Match: ("cases",), ast.Try: ("body", "handlers", "orelse", "finalbody"), ast.TryStar: ("body", "handlers", "orelse", "finalbody"),
}


def _file_facts(path: str, text: str) -> set[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return set()
    found: set[tuple] = set()
    stack: list[tuple[ast.AST, bool]] = [(tree, False)]
    while stack:
        node, in_class = stack.pop()
        inside = isinstance(node, ast.ClassDef)
        for field in _BLOCKS[type(node)]:
            stack += [(child, inside) for child in getattr(node, field) if type(child) in _BLOCKS]
        try:
            if node is tree:
                found |= _Facts(path, "<module>", tree.body, None, 0, False).rows
            elif inside:
                found |= _Facts(path, f"<class {node.name}>", node.body, None, node.lineno, False).rows
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                found |= _Facts(path, node.name, node.body, node.args, node.lineno, in_class).rows
        except RecursionError:
            continue
    return found


def function_facts(path: str, text: str) -> list[tuple]:
    """Facts of each function and of the file's own statements (named ``<module>``). A file that does not parse has none."""
    return sorted(_file_facts(path, text))


def facts(files: DataFrame, project: str = "project", path: str = "path", text: str = "text") -> DataFrame:
    """(project, path, facts of ``function_facts``) of all files that end in .py."""
    ship(files.sparkSession)

    @F.pandas_udf(FACT)
    def parsed(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(_FACT_NAMES, r, strict=True)) for r in function_facts(p, t)] for p, t in zip(paths, texts, strict=True)])

    python = files.filter(F.lower(path).endswith(".py") & F.col(text).isNotNull()).select(F.coalesce(F.col(project).cast("string"), F.lit("")).alias("project"), F.col(path).alias("path"), F.col(text).alias("text"))
    return python.select("project", "path", F.explode(parsed("path", "text")).alias("f")).select("project", "path", "f.*")


#: Rounds after which the tables of the rounds so far become one.
MERGE = 3
_ORIGIN = ["origin", "what", "opath", "oline"]
_TARGET = ["target", "call", "callee", "arg", "sink", "tpath", "tline"]


#: A project of up to so many bytes of paths and texts is closed inside one task, as long as it has no more flows than this.
LOCAL_BYTES = 1 << 18
LOCAL_FLOWS = 200_000
_FLOW = ("rule_id", "severity", "source_kind", "source_path", "source_line", "sink_kind", "sink_path", "sink_line")
_FLOW_SCHEMA = "project string, rule_id string, severity string, source_kind string, source_path string, source_line int, sink_kind string, sink_path string, sink_line int"


def project_flows(files: DataFrame, project: str = "project", path: str = "path", text: str = "text") -> DataFrame:
    """project, rule_id, severity, source_kind, source_path, source_line, sink_kind, sink_path, sink_line, each flow once.

    From files (project, path, text): null projects are one project of their own, files with a null path
    or text and other files than .py take no part.
    """
    ship(files.sparkSession)
    python = files.filter(F.lower(path).endswith(".py") & F.col(text).isNotNull())
    python = python.select(F.coalesce(F.col(project).cast("string"), F.lit("")).alias("project"), F.col(path).alias("path"), F.col(text).alias("text"))
    large = materialize(python.groupBy("project").agg(F.sum((F.octet_length("text") + F.octet_length("path")).cast("long")).alias("n")).filter(F.col("n") > LOCAL_BYTES).select("project"), "large")
    small = python if large.isEmpty() else python.join(large, "project", "left_anti")
    local = materialize(_local_flows(small), "local-flows")
    large = large.unionByName(local.filter("rule_id is null").select("project"))
    if large.isEmpty():
        return local
    return local.filter("rule_id is not null").unionByName(_joined_flows(python.join(large, "project", "left_semi")))


def _local_flows(files: DataFrame) -> DataFrame:
    """Flows of projects that one task holds one at a time; one that has too many flows for that is a row without a rule."""
    limit = LOCAL_FLOWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for name, own in groupby(rows, itemgetter(0)):
            found = closed(((p, t) for _, p, t in own), limit)
            out += [(name, *[None] * len(_FLOW))] if found is None else [(name, *f) for f in found]
            if len(out) >= 10_000:
                yield _flow_batch(out)
                out = []
        if out:
            yield _flow_batch(out)

    return files.repartition("project").sortWithinPartitions("project").mapInArrow(run, _FLOW_SCHEMA)


def _flow_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(("project", *_FLOW), zip(*rows, strict=True), strict=True)
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int32() if n.endswith("_line") else pa.string()) for n, c in columns})


def closed(files: Iterable[tuple[str, str]], limit: int) -> set[tuple] | None:
    """Flows (``_FLOW``) of the files (path, text) of one project by a work list, or None if more than ``limit`` facts follow.

    The same closure as that of ``_joined_flows``, whose comments hold for it.
    """
    single: dict[str, list[str]] = {}
    tokens: dict[tuple, set[str]] = {}
    calls: dict[str, set] = {}
    steps: dict[tuple, set[tuple]] = {}
    todo: list[tuple] = []
    for path, text in files:
        for fid, name, origin, what, oline, target, call, callee, arg, sink, tline in _file_facts(path, text):
            if target == "def":
                if name[0] != "<":
                    single.setdefault(name, []).append(fid)
            elif target == "token":
                tokens.setdefault((fid, arg), set()).add(what)
            elif target == "call":
                calls.setdefault(call, set()).add((fid, callee))
            elif origin == "result":
                steps.setdefault((fid, what), set()).add((target, call, arg, sink, path, tline))
            else:
                of = (origin, what, path, oline) if origin == "source" else (origin, what, "", 0)
                todo.append((fid, of, (target, call, arg, sink, path, tline)))
    resolved: dict[str, set] = {}
    callers: dict[str, list[tuple]] = {}
    for call, places in calls.items():
        for fid, callee in places:
            defined = single.get(callee, ())
            to = defined[0] if len(defined) == 1 else None
            resolved.setdefault(call, set()).add(to)
            if to is not None:
                callers.setdefault(to, []).append((fid, call))
    known = set(todo)
    todo = list(known)
    given: dict[tuple, set[tuple]] = {}
    reach: dict[tuple, set[tuple]] = {}

    def add(fid: str, of: tuple, to: tuple) -> None:
        row = (fid, of, to)
        if row not in known:
            known.add(row)
            todo.append(row)

    def carry(fid: str, of: tuple, call: str) -> None:
        for to in steps.get((fid, call), ()):
            add(fid, of, to)

    def meet(fid: str, of: tuple, call: str, end: tuple) -> None:
        if end[0] == "return":
            carry(fid, of, call)
        else:
            add(fid, of, ("sink", "", "", *end[1:]))

    while todo:
        if len(known) > limit:
            return None
        fid, of, to = todo.pop()
        target, call, arg, sink, tpath, tline = to
        if target == "arg":
            for callee in resolved.get(call, ()):
                if callee is None:
                    carry(fid, of, call)
                    continue
                for param in tokens.get((callee, arg), ()):
                    given.setdefault((callee, param), set()).add((fid, of, call))
                    for end in reach.get((callee, param), ()):
                        meet(fid, of, call, end)
        elif of[0] == "param":
            end = (target, sink, tpath, tline)
            if end not in (ends := reach.setdefault((fid, of[1]), set())):
                ends.add(end)
                for at in given.get((fid, of[1]), ()):
                    meet(*at, end)
        elif target == "return":
            for at, back in callers.get(fid, ()):
                carry(at, of, back)
    found = set()
    for _, (origin, what, opath, oline), (target, _, _, sink, tpath, tline) in known:
        if origin == "source" and target == "sink" and (rule := _RULES.get((what, sink))):
            found.add((*rule, what, opath, oline, sink, tpath, tline))
    return found


def _joined_flows(files: DataFrame) -> DataFrame:
    """``project_flows`` by joins over the facts of all files, for projects of any size."""
    found = materialize(facts(files), "facts")
    defined = found.filter("target = 'def' and name not like '<%'").select("project", "name", "fid")
    single = defined.groupBy("project", "name").agg(F.count("*").alias("n"), F.min("fid").alias("callee_fid")).filter("n = 1").drop("n")
    single = materialize(single.withColumnRenamed("name", "callee"), "definitions")
    tokens = materialize(found.filter("target = 'token'").select("project", F.col("fid").alias("callee_fid"), "arg", F.col("what").alias("param")), "parameters")
    call_rows = found.filter("target = 'call'").select("project", "fid", "call", "callee", F.col("path").alias("cpath"), F.col("tline").alias("cline"))
    resolved = materialize(call_rows.join(single, ["project", "callee"], "left"), "calls")
    flows = found.filter("target in ('arg', 'return', 'sink')").withColumn("tpath", F.col("path")).withColumn("opath", F.when(F.col("origin") == "source", F.col("path")).otherwise(""))
    flows = flows.withColumn("oline", F.when(F.col("origin") == "source", F.col("oline")).otherwise(0))
    keys = ["project", "fid", *_ORIGIN, *_TARGET]
    steps = materialize(flows.filter("origin = 'result'").select("project", "fid", F.col("what").alias("via"), *_TARGET), "steps")
    known = materialize(flows.filter("origin != 'result'").select(*keys).distinct(), "reached")
    fresh, given, rounds = known, None, 0
    while not fresh.isEmpty():
        own = materialize(_arguments(fresh, resolved, tokens), "arguments")
        given = own if given is None else given.unionByName(own)
        new = _followed(known, fresh, own, given, resolved, steps).select(*keys).distinct()
        fresh = materialize(new.join(known, keys, "left_anti"), "reached")
        known = known.unionByName(fresh)
        rounds += 1
        if rounds % MERGE == 0:  # a few tables instead of one for each round keep plans short
            known, given = materialize(known, "reached"), materialize(given, "arguments")
    rules = files.sparkSession.createDataFrame([(s, k, *r) for (s, k), r in _RULES.items()], "what string, sink string, rule_id string, severity string")
    ended = known.filter("origin = 'source' and target = 'sink'").join(F.broadcast(rules), ["what", "sink"])  # a constant of a few rows
    out = ended.select("project", "rule_id", "severity", F.col("what").alias("source_kind"), F.col("opath").alias("source_path"), F.col("oline").alias("source_line"), F.col("sink").alias("sink_kind"), F.col("tpath").alias("sink_path"), F.col("tline").alias("sink_line"))
    return out.distinct()


def _arguments(rows: DataFrame, resolved: DataFrame, tokens: DataFrame) -> DataFrame:
    """Values given to a parameter of a known function, or to an unknown one (callee_fid null)."""
    given = rows.filter("target = 'arg'").select("project", "fid", *_ORIGIN, "call", "arg")
    return given.join(resolved.select("project", "call", "callee_fid"), ["project", "call"]).join(tokens, ["project", "callee_fid", "arg"], "left")


def _followed(known: DataFrame, fresh: DataFrame, own: DataFrame, given: DataFrame, resolved: DataFrame, steps: DataFrame) -> DataFrame:
    """What follows by one call from the rows of ``known`` of which at least one is ``fresh``; ``own`` and ``given`` are the arguments of both."""

    def summaries(rows: DataFrame) -> DataFrame:
        """What parameters reach, beside further calls."""
        reach = rows.filter("origin = 'param' and target in ('return', 'sink')")
        return reach.select("project", F.col("fid").alias("callee_fid"), F.col("what").alias("param"), "target", "sink", "tpath", "tline")

    on = ["project", "callee_fid", "param"]
    met = materialize(own.join(summaries(known), on).unionByName(given.join(summaries(fresh), on)), "calls-met")
    returned = met.filter("target = 'return'").select("project", "fid", *_ORIGIN, "call")
    inside = met.filter("target = 'sink'").select("project", "fid", *_ORIGIN, "target", F.lit("").alias("call"), F.lit("").alias("callee"), F.lit("").alias("arg"), "sink", "tpath", "tline")
    unknown = own.filter("callee_fid is null").select("project", "fid", *_ORIGIN, "call")
    given_out = fresh.filter("origin = 'source' and target = 'return'").select("project", F.col("fid").alias("callee_fid"), *_ORIGIN)
    sources = resolved.select("project", "fid", "call", "callee_fid").join(given_out, ["project", "callee_fid"]).select("project", "fid", *_ORIGIN, "call")
    carried = returned.unionByName(unknown).unionByName(sources)
    # The result of an unknown call may be an argument of the next one: steps chain within a function by further rounds.
    onward = carried.distinct().withColumnRenamed("call", "via").join(steps, ["project", "fid", "via"]).drop("via")
    return onward.unionByName(inside)
