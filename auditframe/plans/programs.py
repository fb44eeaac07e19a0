"""Queries over programs that the tables spell out: each order is a project, each of its lines a file.

The tables hold no source code, so the structure of a program (who calls whom, what is cleaned, where a
value ends) is taken from the rows, and the SQL follows the rows themselves, never the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.functions import scalars as S
from auditframe.operators import callgraph, code, governance, migrations, reports, scripts
from auditframe.plans.catalogue import documents, query, table
from auditframe.sources import readers
from auditframe.streaming import stateful

# Lines of an order, numbered from 1 without gaps, with the part of the next line.
_STEPS = """s AS (SELECT l_orderkey AS o, l_partkey AS part, l_returnflag AS flag, CASE l_suppkey % 3 WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL' ELSE 'SHIP' END AS mode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey) AS m, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS same FROM lineitem)"""


def _line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, k, m, part, next_part, flag, mode) of each line of an order."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return rows.select(F.col("l_orderkey").alias("project"), F.row_number().over(line).alias("k"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("m"), F.col("l_partkey").alias("part"), F.lead("l_partkey").over(line).alias("next_part"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_suppkey") % 3 == 0, "AIR").when(F.col("l_suppkey") % 3 == 1, "RAIL").otherwise("SHIP").alias("mode"))


# The main file evaluates what the first step returns and gives it a request; a step calls the next one, the last ends in a
# command (AIR), a statement (RAIL) or its return. Lines with flag R clean the value. Equal parts are equal names.
_FLOW_SQL = f"""WITH RECURSIVE {_STEPS},
down AS (SELECT *, true AS alive FROM s WHERE k = 1 AND same = 1
  UNION ALL SELECT s.*, true FROM s JOIN down d ON s.o = d.o AND s.k = d.k + 1 WHERE d.flag <> 'R' AND s.same = 1),
up AS (SELECT *, flag <> 'R' AND mode NOT IN ('AIR', 'RAIL') AS returns FROM s WHERE k = m
  UNION ALL SELECT s.*, s.flag <> 'R' AND (u.same > 1 OR u.returns) FROM s JOIN up u ON s.o = u.o AND s.k = u.k - 1)
SELECT o AS project, 'WEB_UNTRUSTED_INPUT_TO_COMMAND' AS rule_id, 'command' AS sink_kind, concat(o, '/step_', k, '.py') AS sink_path, 4::INT AS sink_line FROM down WHERE k = m AND flag <> 'R' AND mode = 'AIR'
UNION ALL SELECT o, 'WEB_UNTRUSTED_INPUT_TO_SQL', 'sql', concat(o, '/step_', k, '.py'), 4 FROM down WHERE k = m AND flag <> 'R' AND mode = 'RAIL'
UNION ALL SELECT o, 'WEB_UNTRUSTED_INPUT_TO_CODE_EXECUTION', 'code', concat(o, '/main.py'), 5 FROM up WHERE k = 1 AND (same > 1 OR returns)"""


@query(_FLOW_SQL)
def call_graph_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-TAINT2: each order as a project of one file a line, in which a request passes from file to file."""
    lines = _line_files(spark, sf_dir)
    value = F.when(F.col("flag") == "R", F.lit("mask(value)")).otherwise(F.lit("value"))
    onward = F.concat(F.lit("return step_"), F.col("next_part"), F.lit("(kept)"))
    ends = F.when(F.col("mode") == "AIR", F.lit("os.system('run ' + kept)")).when(F.col("mode") == "RAIL", F.lit("db.execute('select ' + kept)")).otherwise(F.lit("return kept"))
    text = F.concat(F.lit("import os\ndef step_"), F.col("part"), F.lit("(value):\n    kept = "), value, F.lit("\n    "), F.when(F.col("k") == F.col("m"), ends).otherwise(onward), F.lit("\n"))
    step = F.struct(F.concat(F.col("project"), F.lit("/step_"), F.col("k"), F.lit(".py")).alias("path"), text.alias("text"))
    main = F.concat(F.lit("from flask import request\n\ndef handle():\n    out = step_"), F.col("part"), F.lit("(value=request.args['q'])\n    eval(out)\n"))
    both = F.when(F.col("k") == 1, F.array(step, F.struct(F.concat(F.col("project"), F.lit("/main.py")).alias("path"), main.alias("text")))).otherwise(F.array(step))
    found = callgraph.project_flows(lines.select("project", F.explode(both).alias("f")).select("project", "f.path", "f.text"))
    return found.select(F.col("project").cast("long").alias("project"), "rule_id", "sink_kind", "sink_path", "sink_line")


# --- streams ----------------------------------------------------------------------------------------
_PENDING_SQL = """WITH m AS (SELECT user_id % 5 AS session, event_id // 12 AS request_id, event_id % 3 <> 0 AS is_response, ts, event_id AS seq FROM events WHERE event_type <> 'error'),
w AS (SELECT *, lag(is_response) OVER k AS was, lag(ts) OVER k AS was_at, lead(is_response) OVER k AS next, lead(ts) OVER k AS next_at FROM m WINDOW k AS (PARTITION BY session, request_id ORDER BY ts, is_response, seq)),
s AS (SELECT *, CASE WHEN is_response THEN CASE WHEN was IS NULL OR was THEN 'unknown_response' WHEN epoch_us(ts) - epoch_us(was_at) <= 1800000000 THEN 'answered' ELSE 'late_response' END
  WHEN next IS NULL OR epoch_us(next_at) - epoch_us(ts) > 1800000000 THEN 'response_timeout' WHEN NOT next THEN 'superseded' END AS state FROM w)
SELECT session::VARCHAR AS session, request_id::VARCHAR AS request_id, state, CASE WHEN NOT is_response THEN epoch_us(ts) WHEN NOT was THEN epoch_us(was_at) END AS asked_us, CASE WHEN is_response THEN epoch_us(ts) END AS answered_us FROM s WHERE state IS NOT NULL"""


@query(_PENDING_SQL)
def pending_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, ST7 on a stream: events as messages whose answers are due in half an hour, replayed in four slices of time."""
    events = table(spark, sf_dir, "events").filter("event_type != 'error'")
    messages = events.select((F.col("user_id") % 5).cast("string").alias("session"), F.floor(F.col("event_id") / 12).cast("long").cast("string").alias("request_id"), (F.col("event_id") % 3 != 0).alias("is_response"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    last = messages.agg(F.max("ts").alias("ts")).select(F.lit("").alias("session"), F.lit(None).cast("string").alias("request_id"), F.lit(False).alias("is_response"), F.expr("ts + INTERVAL 366 DAY").alias("ts"), F.lit(0).cast("long").alias("seq"))
    found = stateful.replay(messages, lambda stream, delay: stateful.pending_requests(stream, delay, 1_800), 4, stateful.Pending.OUT, last)
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")
    return found.select("session", "request_id", "state", micros("asked_at").alias("asked_us"), micros("answered_at").alias("answered_us"))


# --- code and migrations inside real texts -----------------------------------------------------------
# Each document's text stands in its file as comments (line by line) or as a quoted text, with all its quotes, brackets
# and odd characters; the code behind it has its findings at lines that follow from the number of lines of the text.
_CODE = (  # suffix, comment, code, findings (rule, source line, sink line) counted from the first line behind the text
    ("py", "# ", "def f():\n    q = request.args.get('q')\n    os.system(q)\n", (("WEB_UNTRUSTED_INPUT_TO_COMMAND", 2, 3),)),
    ("js", "// ", "function f(req) {\n  const q = req.query.q;\n}\nfunction g() {\n  exec(q);\n}\n", ()),
    ("ts", "// ", "app.get('/x', (req, res) => {\n  const sql = `select ${req.params.id}`;\n  db.query(sql);\n  db.query('select ?', [sql]);\n});\n", (("WEB_UNTRUSTED_INPUT_TO_SQL", 2, 3),)),
    ("java", "// ", 'class A {\n void doGet(HttpServletRequest r) {\n  String q = r.getParameter("q");\n  StringBuilder b = new StringBuilder("select ").append(q);\n  statement.execute(b.toString());\n  PreparedStatement p = connection.prepareStatement("select ?");\n  p.setString(1, q);\n  p.executeQuery();\n }\n}\n', (("WEB_UNTRUSTED_INPUT_TO_SQL", 3, 5),)),
    ("go", "// ", 'func h(w http.ResponseWriter, r *http.Request) {\n\tf := r.FormValue("f")\n\tos.Open(f)\n}\nfunc g(f string) {\n\tos.Open(f)\n}\n', (("WEB_UNTRUSTED_INPUT_TO_FILE_PATH", 2, 3),)),
    ("php", "# ", "$q = $_GET['q'];\nsystem(\"ls $q\");\n$q = 'a';\nsystem($q);\n", (("WEB_UNTRUSTED_INPUT_TO_COMMAND", 1, 2),)),
    ("rb", "# ", "def a\n  q = params[:q]\n  eval(q)\nend\ndef b\n  eval(q)\nend\n", (("WEB_UNTRUSTED_INPUT_TO_CODE_EXECUTION", 2, 3),)),
    ("kt", "// ", 'fun f(@RequestParam q: String) {\n  em.createQuery("select " + q)\n}\n', (("WEB_UNTRUSTED_INPUT_TO_SQL", 1, 2),)),
    ("jsx", "// ", "let q = 'a';\nif (x) {\n  q = req.body.q;\n}\nfetch(q);\nq = 'b';\nfetch(q);\n", (("WEB_UNTRUSTED_INPUT_TO_OUTBOUND_REQUEST", 3, 5),)),
    ("java", "// ", 'class B {\n void doPost(HttpServletRequest r) {\n  String q = 1 > 2 ? r.getHeader("q") : "fixed";\n  statement.execute(q + Integer.parseInt(r.getParameter("n")));\n }\n}\n', ()),
)


def _commented(mark: str) -> Column:
    """A document's text as comment lines."""
    clean = F.translate(F.coalesce("text", F.lit("")), "\r\x00", "  ")
    return F.concat(F.lit(mark), F.replace(clean, F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))


_BEHIND = "len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1"
_CODE_VALUES = ", ".join(f"({k}, '{rule}', {a}, {b}, {1 if suffix == 'php' else 0})" for k, (suffix, _, _, found) in enumerate(_CODE) for rule, a, b in found)


@query(f"WITH want(k, rule_id, a, b, more) AS (VALUES {_CODE_VALUES}) SELECT doc_id, rule_id, (a + more + {_BEHIND})::INT AS source_line, (b + more + {_BEHIND})::INT AS sink_line FROM documents JOIN want ON doc_id % {len(_CODE)} = k")
def code_flow_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-TAINT1, D-TAINT3, D-POLY, D-JAVA: a source file in one of nine languages behind the text of each document."""
    k = F.col("doc_id") % len(_CODE)
    text = path = None
    for n, (suffix, mark, body, _) in enumerate(_CODE):
        whole = F.concat(F.lit("<?php\n" if suffix == "php" else ""), _commented(mark), F.lit(body))
        text = F.when(k == n, whole) if text is None else text.when(k == n, whole)
        path = F.when(k == n, f"src/a.{suffix}") if path is None else path.when(k == n, f"src/a.{suffix}")
    files = documents(spark, sf_dir).select("doc_id", path.alias("path"), text.alias("text"))
    return code.code_flows(files).select("doc_id", "rule_id", "source_line", "sink_line")


_MIGRATION = """create table app.t{0} (id int, note text default ';');
comment on table app.t{0} is $txt${1}$txt$;
alter table app.t{0} {2} row level security;
/* create policy a on app.t{0} using (true); /* nested */ */
create policy p on app.t{0} for select using ({3});
create function app.f{0}() returns int language sql security definer{4} as $b$ select 1; grant all on t to anon; $b$;
grant {5} on app.t{0}, "T {0}" to anon, reporting;
create table u{0} (id int);
"""
_MIGRATION_SQL = f"""WITH d AS (SELECT doc_id, {_BEHIND} - 1 AS n FROM documents)
SELECT doc_id, concat('app.t', doc_id) AS object, 'DB_POLICY_RLS_DISABLED' AS rule_id, 'critical' AS severity, (3 + n)::INT AS line FROM d WHERE doc_id % 2 = 1
UNION ALL SELECT doc_id, concat('app.t', doc_id), 'DB_POLICY_PERMISSIVE_TRUE', 'critical', (5 + n)::INT FROM d WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, concat('app.f', doc_id), 'DB_POLICY_SECURITY_DEFINER_SEARCH_PATH', 'high', (6 + n)::INT FROM d WHERE doc_id % 5 < 2
UNION ALL SELECT doc_id, unnest([concat('app.t', doc_id), concat('public."T ', doc_id, '"')]), 'DB_POLICY_BROAD_GRANT', 'high', (7 + n)::INT FROM d WHERE doc_id % 7 < 3
UNION ALL SELECT doc_id, concat('public.u', doc_id), 'DB_POLICY_RLS_MISSING', 'high', (8 + n)::INT FROM d"""


@query(_MIGRATION_SQL)
def row_security_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-DBP, O7: a migration for each document, its text in a dollar-quoted comment between the statements."""
    d = F.col("doc_id")
    marks = {
        "{0}": d.cast("string"), "{2}": F.when(d % 2 == 1, "disable").otherwise("enable"), "{3}": F.when(d % 3 == 0, "(true)").otherwise("true and owner = auth.uid()"),
        "{4}": F.when(d % 5 < 2, "").otherwise(" set search_path = app"), "{5}": F.when(d % 7 < 3, "all").otherwise("select"), "{1}": F.coalesce("text", F.lit("")),
    }
    text = F.lit(_MIGRATION)
    for mark, value in marks.items():  # the document's own text last, so that nothing in it is a mark
        text = F.replace(text, F.lit(mark), value)
    files = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("supabase/"), d.cast("string"), F.lit(".sql")).alias("path"), text.alias("text"))
    return migrations.migration_policies(files, key="doc_id").select("doc_id", "object", "rule_id", "severity", "line")


_ROUTE = """app.get('/orders/:orderId', async (req, res) => {
  %s
  const row = await loadOrder(req.params.orderId);
  res.json(row);
});
"""
_SERVICE = """export async function loadOrder(orderId) {
  return db.order.findFirst({ where: { id: orderId%s } });
}
"""
_ACTION = """'use server';
export async function save(form) {
  %s
  await db.user.update({ data: form });
}
"""
_BOUNDARY_SQL = f"""WITH d AS (SELECT doc_id, {_BEHIND} AS n FROM documents)
SELECT doc_id, 'routes.js' AS path, 'JS_TS_EXPRESS_IDOR_ROUTE_PARAM' AS rule_id, (n + 3)::INT AS line, NULL::VARCHAR AS service_path FROM d
UNION ALL SELECT doc_id, 'routes.js', 'JS_TS_INTERPROCEDURAL_ROUTE_SERVICE_IDOR', (n + 3)::INT, 'service.ts' FROM d WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0
UNION ALL SELECT doc_id, 'actions.ts', 'JS_TS_NEXT_SERVER_ACTION_AUTH_BOUNDARY_WEAK', (n + 4)::INT, NULL FROM d WHERE doc_id % 2 = 0"""


@query(_BOUNDARY_SQL)
def framework_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-TAINT3: each document as a project of routes, a service, a server action, and for some a second service of the same name."""
    d = F.col("doc_id")
    head = _commented("// ")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    file = lambda path, body: F.struct(F.lit(path).alias("path"), F.concat(head, body).alias("text"))
    fill = lambda body, value: F.replace(F.lit(body), F.lit("%s"), value)
    each = [
        file("routes.js", fill(_ROUTE, F.when(d % 2 == 0, "// requireAuth(req)").otherwise("log('requireAuth(req)');"))), file("service.ts", fill(_SERVICE, F.when(d % 3 == 0, ", ownerId: me").otherwise(""))),
        file("actions.ts", fill(_ACTION, F.when(d % 2 == 0, "").otherwise("await requireAuth();"))),
    ]
    more = file("other.ts", F.lit("function loadOrder(x) { return x; }\n"))
    own = F.when(d % 5 == 0, F.array(*each, more)).otherwise(F.array(*each))
    files = docs.select(d.cast("string").alias("project"), F.explode(own).alias("f")).select("project", "f.path", "f.text")
    return scripts.framework_findings(files).select(F.col("project").cast("long").alias("doc_id"), "path", "rule_id", "line", "service_path")


# --- set digests -------------------------------------------------------------------------------------
# One level of the tree up to 4,096 leaves, places of one digit up to 65,536.
_TREE_SQL = """WITH a AS (SELECT concat(source, '/', doc_id, '.txt') AS path, text, strlen(text) AS b FROM documents),
e AS (SELECT lower(path) AS p, CASE WHEN text IS NULL THEN 'unreadable' ELSE sha256(text) END AS s FROM a), l AS (SELECT sha256(concat(strlen(p), ':', p, strlen(s), ':', s)) AS d FROM e),
c AS (SELECT sha256(concat('64:', d, strlen(count(*)::VARCHAR), ':', count(*))) AS d FROM l GROUP BY l.d), n AS (SELECT count(*) AS n FROM c),
q AS (SELECT CASE WHEN n > 4096 THEN substr(d, 1, 1) ELSE '' END AS p, d, n FROM c, n),
r AS (SELECT p, any_value(n) AS n, sha256(concat(count(*), '|', string_agg('64:' || d, '' ORDER BY d))) AS d FROM q GROUP BY p),
root AS (SELECT CASE WHEN any_value(n) > 4096 THEN sha256(concat(count(*), '|', string_agg('64:' || d, '' ORDER BY d))) ELSE max(d) END AS d FROM r)
SELECT count(*) AS files, coalesce(sum(b), 0)::BIGINT AS bytes, count(*) FILTER (text IS NULL) AS unreadable, 0::BIGINT AS oversized, count(*) FILTER (text IS NULL) = 0 AS complete, (SELECT d FROM root) AS tree_digest FROM a"""


@query(_TREE_SQL)
def inventory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, SRC18: documents as files: counts and the digest of all paths and contents."""
    text = F.col("text")
    rows = documents(spark, sf_dir).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), text.cast("binary").alias("content"), F.octet_length("text").cast("long").alias("n_bytes"))
    return readers.inventory_fingerprint(rows).select("files", "bytes", "unreadable", "oversized", "complete", "tree_digest")


_BUNDLE_SQL = """WITH a AS (SELECT l_orderkey AS subject, sha256(concat('{"l_linenumber":', l_linenumber, ',"q":"', l_quantity, '"}')) AS entry FROM lineitem),
l AS (SELECT subject, sha256(concat('64:', entry, strlen(count(*)::VARCHAR), ':', count(*))) AS d, count(*) AS n FROM a GROUP BY subject, entry),
p AS (SELECT subject, sum(n) AS n, sha256(concat(count(*), '|', string_agg('64:' || d, '' ORDER BY d))) AS d FROM l GROUP BY subject, substr(d, 1, 3))
SELECT subject, sum(n)::BIGINT AS artifact_count, sha256(concat(count(*), '|', string_agg('64:' || d, '' ORDER BY d))) AS artifacts_sha256 FROM p GROUP BY 1"""


@query(_BUNDLE_SQL)
def bundle_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GV5, F-CANON: count and digest of the bundle of each order's lines, as SQL computes them."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), "l_linenumber", F.col("l_quantity").cast("string").alias("q"))
    payload = S.canonical_json(F.struct(F.col("l_linenumber"), F.col("q")))
    return reports.evidence_bundles(rows, "subject", payload).select("subject", "artifact_count", "artifacts_sha256")


_GOVERNED_SQL = f"""WITH d AS (SELECT doc_id, {_BEHIND} AS n FROM documents)
SELECT doc_id, 'KR_DATA_UNIQUE_IDENTIFIER_CONTROL_GAP' AS rule_id, 'high' AS severity, 1::BIGINT AS n_fields, (n + 2)::INT AS first_line FROM d WHERE doc_id % 6 <> 0
UNION ALL SELECT doc_id, 'KR_DATA_SENSITIVE_INFORMATION_CONTROL_GAP', 'high', 1, (n + 3)::INT FROM d
UNION ALL SELECT doc_id, 'KR_DATA_ACCESS_LOG_EVIDENCE_MISSING', 'medium', 2, (n + 2)::INT FROM d WHERE doc_id % 5 <> 0"""


@query(_GOVERNED_SQL)
def field_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GV1: a class with two personal fields behind the text of each document, some of them encrypted, authorised or logged."""
    d = F.col("doc_id")
    line = lambda test, text: F.concat(F.when(test, F.lit(text)).otherwise(""), F.lit("\n"))
    body = F.concat(F.lit("class A {\n  rrn: string\n  diagnosis: string\n"), line(d % 2 == 0, "  encrypt(rrn)"), line(d % 3 == 0, "  authorize(rrn, diagnosis)"), line(d % 5 == 0, "  audit_log(diagnosis, rrn)"), F.lit("}\n"))
    lines = governance.code_lines(documents(spark, sf_dir).select("doc_id", F.concat(_commented("// "), body).alias("text")), ["doc_id"])
    states = governance.control_states(governance.declared_fields(lines, ["doc_id"]), lines, ["doc_id"])
    return governance.governance_gaps(states, ["doc_id"])
