"""Flows across functions and files."""

import random

from auditframe import registry
from auditframe.operators import callgraph
from auditframe.operators.callgraph import function_facts, project_flows
from tests.compare import same


def flows(spark, projects):
    files = [(p, path, text, "x") for p, own in projects.items() for path, text in own.items()]
    rows = project_flows(spark.createDataFrame(files, "project string, path string, text string, callee string")).collect()
    return sorted((r.project, r.rule_id, r.source_path, r.source_line, r.sink_path, r.sink_line) for r in rows)


ENTRY = "from flask import request\ndef handle():\n    value = request.args['q']\n    return first({})\n"
MIDDLE = "def first(value, other=None):\n    return second(other, text=value)\n"
LAST = "import os\ndef second(a, text):\n    os.system(text)\n"
COMMAND = "WEB_UNTRUSTED_INPUT_TO_COMMAND"


def test_three_files_ambiguity_cleaning_and_arguments(spark):
    projects = {
        "three": {"a.py": ENTRY.format("value"), "b.py": MIDDLE, "c.py": LAST},
        "ambiguous": {"a.py": ENTRY.format("value"), "b.py": MIDDLE, "c.py": LAST, "d.py": "def second(a, text):\n    pass\n"},
        "cleaned": {"a.py": ENTRY.format("mask(value)"), "b.py": MIDDLE, "c.py": LAST},
        "other": {"a.py": ENTRY.format("None, other=value"), "b.py": MIDDLE, "c.py": LAST},
        "apart": {"a.py": ENTRY.format("value"), "b.py": MIDDLE},  # the last file belongs to another project only
        "broken": {"a.py": ENTRY.format("value"), "b.py": MIDDLE, "c.py": LAST, "d.py": "def broken(:\n", "e.txt": LAST},
    }
    hit = lambda p: (p, COMMAND, "a.py", 3, "c.py", 3)
    assert flows(spark, projects) == [hit("broken"), hit("three")]


def test_returns_recursion_methods_and_unknown_calls(spark):
    projects = {
        "returned": {"a.py": "def read():\n    return request.form['x']\n", "b.py": "def run():\n    eval(read())\n"},
        "passed": {"a.py": "def same(x):\n    return x\n", "b.py": "def run():\n    eval(same(request.form['x']))\n"},
        "constant": {"a.py": "def fixed(x):\n    return 1\n", "b.py": "def run():\n    eval(fixed(request.form['x']))\n"},
        "unknown": {"b.py": "def run():\n    eval(strange(request.form['x']))\n"},
        "loop": {"a.py": "def even(n):\n    return odd(n)\ndef odd(n):\n    eval(n)\n    return even(n)\n", "b.py": "def run():\n    even(request.form['x'])\n"},
        "method": {"a.py": "class Job:\n    def start(self, text):\n        self.text = text\n        exec(self.text)\n", "b.py": "def run(job):\n    job.start(request.json)\n"},
        "branch": {"b.py": "def run(q):\n    x = 'a'\n    if q:\n        x = request.form['x']\n    else:\n        x = 'b'\n    eval(x)\n    x = 'c'\n    eval(x)\n"},
    }
    code = "WEB_UNTRUSTED_INPUT_TO_CODE_EXECUTION"
    assert flows(spark, projects) == [
        ("branch", code, "b.py", 4, "b.py", 7), ("loop", code, "b.py", 2, "a.py", 4), ("method", code, "b.py", 2, "a.py", 4), ("passed", code, "b.py", 2, "b.py", 2),
        ("returned", code, "a.py", 2, "b.py", 2), ("unknown", code, "b.py", 2, "b.py", 2),
    ]


def test_no_files_and_nulls(spark):
    schema = "project string, path string, text string"
    assert project_flows(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a.py", "def run():\n    eval(request.form['x'])\n"), ("p", None, "x"), ("p", "b.py", None)]
    assert [r.project for r in project_flows(spark.createDataFrame(rows, schema)).collect()] == [""]


def test_facts_of_loops_and_containers():
    rows = function_facts("f.py", "def f(xs):\n    out = []\n    for x in xs:\n        out.append(x)\n    return ','.join([y for y in out])\n")
    assert any(r[5] == "arg" and r[2:4] == ("param", "xs") and r[7] == "join" for r in rows)


def brute(files):
    """Flows by walking the call graph from each source, context by context, over the same facts of functions."""
    rows = [(p, r) for p, path, text in files for r in function_facts(path, text)]
    names = {}
    for p, r in rows:
        if r[5] == "def" and not r[1].startswith("<"):
            names.setdefault((p, r[1]), set()).add(r[0])
    single = {k: min(v) for k, v in names.items() if len(v) == 1}
    tokens = {(p, r[0], r[8]): r[3] for p, r in rows if r[5] == "token"}
    out = {}
    for p, r in rows:
        if r[5] in ("arg", "return", "sink"):
            out.setdefault((p, r[0], *((r[2], r[3]) if r[2] != "source" else (r[2], r[3], r[4]))), []).append(r)
    calls = {}
    for p, r in rows:
        if r[5] == "call" and (p, r[7]) in single:
            calls.setdefault((p, single[p, r[7]]), []).append((r[0], r[6]))

    def reach(p, fid, start, seen):
        """(sinks, whether the function returns it) of an origin."""
        sinks, back, todo, done = set(), False, [start], set()
        while todo:
            at = todo.pop()
            if at in done:
                continue
            done.add(at)
            for r in out.get((p, fid, *at), []):
                if r[5] == "sink":
                    sinks.add((r[9], r[0].rsplit(":", 2)[0], r[10]))
                elif r[5] == "return":
                    back = True
                elif (p, r[7]) not in single:
                    todo.append(("result", r[6]))
                else:
                    g = single[p, r[7]]
                    param = tokens.get((p, g, r[8]))
                    if param is not None and (g, param) not in seen:
                        more, returned = reach(p, g, ("param", param), seen | {(g, param)})
                        sinks |= more
                        todo += [("result", r[6])] * returned
        return sinks, back

    found = set()
    for p, fid, *start in [k for k in out if k[2] == "source"]:
        queue, done = [(fid, tuple(start))], set()
        while queue:
            f, s = queue.pop()
            if (f, s) in done:
                continue
            done.add((f, s))
            sinks, back = reach(p, f, s, frozenset())
            found |= {(p, fid.rsplit(":", 2)[0], start[2], *x) for x in sinks}
            if back:
                queue += [(g, ("result", call)) for g, call in calls.get((p, f), [])]
    return found


def test_random_programs_equal_brute_force(spark):
    rnd = random.Random(3)
    files = []
    for p in range(60):
        names = [f"f{i}" for i in rnd.sample(range(10), 8)]
        if p % 3 == 0:
            names[0] = names[1]  # ambiguous
        for k, name in enumerate(names):
            say = lambda: rnd.choice([f"x = f{rnd.randint(0, 9)}(a, b=x)", "x = request.form['q']", "x = request.json", "x = a + b", f"f{rnd.randint(0, 9)}(x)", "os.system(x)", f"x = f{rnd.randint(0, 9)}(x)", "x = mask(x)", f"b = f{rnd.randint(0, 9)}(b, a)"])
            body = "".join(f"    {say()}\n" for _ in range(rnd.randint(1, 4)))
            files.append((str(p), f"m{k}.py", f"def {name}(a, b=None):\n    x = 0\n{body}    return {rnd.choice(['x', 'a', '0', 'b'])}\n"))
    rows = project_flows(spark.createDataFrame(files, "project string, path string, text string")).filter("source_kind = 'request'").collect()
    want = {x for x in brute(files) if x[3] == "command"}
    assert {(r.project, r.source_path, r.source_line, r.sink_kind, r.sink_path, r.sink_line) for r in rows} == want
    assert len(want) > 20


def test_small_projects_need_no_rounds(spark, monkeypatch):
    tables, write = [], callgraph.materialize
    monkeypatch.setattr(callgraph, "materialize", lambda df, name: tables.append(name) or write(df, name))
    assert len(flows(spark, {"p": {"a.py": ENTRY.format("value"), "b.py": MIDDLE, "c.py": LAST}})) == 1
    assert len(tables) <= 2


def test_large_projects_are_joined_to_the_same_flows(spark, monkeypatch):
    """Within a task, by joins, or begun in a task and left to the joins: no flow differs; a file that stands twice is ambiguous."""
    rnd = random.Random(8)
    projects = {}
    for p in range(12):
        files = {}
        for k in range(6):
            body = "".join(f"    {rnd.choice(['x = g%d(a, b=x)', 'g%d(x)', 'x = request.json', 'x = g%d(x)', 'os.system(x)', 'eval(b)', 'x = a.get(x)', 'print(x)', 'print(b)', 'x = x + a']).replace('%d', str(rnd.randint(0, 6)))}\n" for _ in range(rnd.randint(1, 5)))
            files[f"m{k}.py"] = f"class C{k}:\n  def g{k}(self, a, b=None):\n    x = user.email\n{body}    def inner(y):\n        return g0(y)\n    return {rnd.choice(['x', 'a', 'b', '0'])}\n"
        projects[str(p)] = files
    want = flows(spark, projects)
    assert len(want) > 20
    monkeypatch.setattr(callgraph, "LOCAL_FLOWS", 30)
    assert flows(spark, projects) == want
    monkeypatch.setattr(callgraph, "LOCAL_BYTES", 0)
    assert flows(spark, projects) == want
    twice = spark.createDataFrame([("p", path, text) for path, text in (("a.py", ENTRY.format("value")), ("b.py", MIDDLE), ("c.py", LAST), ("c.py", LAST))], "project string, path string, text string")
    assert project_flows(twice).count() == 0
    monkeypatch.undo()
    assert project_flows(twice).count() == 0


def test_query_equals_sql(spark, data):
    same(registry.queries()["call_graph_flows"](spark, data), registry.oracle_sql()["call_graph_flows"], data)
