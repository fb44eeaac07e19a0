"""Queries of decisions, gates, matchings and recorded traffic over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.operators import access, dependencies, evaluate, pii, responses, select
from auditframe.plans.catalogue import query, table
from auditframe.sources import readers
from auditframe.streaming import session

_PAGE_SQL = """WITH r(k, rule_id, severity) AS (VALUES (0, 'DYN_SECURITY_HEADERS_MISSING', 'medium'), (0, 'DYN_HSTS_MISSING', 'medium'), (1, 'DYN_CORS_WILDCARD_CREDENTIALS', 'high'), (2, 'DYN_SESSION_COOKIE_FLAG_WEAK', 'high'), (3, 'DYN_REDIRECT_TO_DISALLOWED_HOST', 'high'), (5, 'DYN_EXPOSED_BACKUP_OR_DUMP', 'critical'), (6, 'DYN_DEBUG_ERROR_LEAK', 'high'), (8, 'DYN_UNAUTH_API_JSON', 'high'), (9, 'DYN_RESPONSE_PII_LEAK', 'high'), (9, 'DYN_SENSITIVE_RESPONSE_CACHE_POLICY_WEAK', 'high'))
SELECT page_id, rule_id, severity FROM pages JOIN r ON page_id % 10 = k"""


@query(_PAGE_SQL)
def response_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-HTTP1: each page as a response of one of ten kinds; most carry the page's own markup."""
    k, html = F.col("page_id") % 10, F.coalesce("html", F.lit(""))
    pick = lambda other, **by: _picked(k, other, by)
    safe = "content-security-policy: x\nx-content-type-options: nosniff\nx-frame-options: DENY\nstrict-transport-security: max-age=1\ncontent-type: text/html"
    headers = pick(F.lit(safe), k0=F.lit("content-type: text/html"), k1=F.lit("access-control-allow-origin: *\naccess-control-allow-credentials: true\ncontent-type: text/html"), k2=F.lit("set-cookie: session=1; Path=/; HttpOnly\ncontent-type: text/html"), k3=F.lit("location: https://other.kr/x\ncontent-type: text/html"), k8=F.lit("content-type: application/json"), k9=F.lit("content-type: application/json"))
    path = pick(F.lit("/x"), k0=F.lit("/"), k4=F.lit("/.env"), k5=F.lit("/dump.sql"), k8=F.lit("/api/list"))
    body = pick(html, k5=F.concat(F.lit("INSERT INTO t VALUES ("), F.col("page_id"), F.lit(");")), k6=F.concat(F.lit("Traceback (most recent call last)\n"), html), k8=F.concat(F.lit('{"users": [{"id": '), F.col("page_id"), F.lit("}]}")), k9=F.lit('{"rrn": "840229-1000001"}'))
    parts = F.transform(F.split(headers, "\n"), lambda x: F.struct(F.regexp_extract(x, "^([^:]*): ", 1), F.regexp_replace(x, "^[^:]*: ", "")))
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("https://a.kr"), path).alias("url"), path.alias("probe_path"), F.when(k == 1, "OPTIONS").otherwise("GET").alias("method"), F.when(k == 3, 302).otherwise(200).alias("status"),
        F.map_from_entries(parts).alias("headers"), body.alias("body_sample"), (k == 9).alias("authenticated"),
    )
    return responses.response_matrix(rows).select("page_id", "rule_id", "severity")


def _picked(k, other, by):
    out = None
    for name, value in by.items():
        test = k == int(name[1:])
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(other)


@query("""WITH v AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'CVE-' || p_partkey WHEN 1 THEN 'GHSA-' || p_partkey WHEN 3 THEN 'N-' || p_partkey END AS id FROM part)
SELECT CASE k % 2 WHEN 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, 'p' || k AS name, id AS vulnerability_id, CASE k % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'medium' END AS severity, k % 3 = 0 AS fixed FROM v WHERE id IS NOT NULL""")
def dependency_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-SCA: each part as a package: alias for a missing id, words of severity, repeats once, entries without any id left out."""
    k = F.col("p_partkey")
    text = k.cast("string")
    ident = F.when(k % 4 == 0, F.concat(F.lit("CVE-"), text)).when(k % 4 == 1, F.lit("")).when(k % 4 == 3, F.concat(F.lit("N-"), text))
    aliases = F.when(k % 4 == 1, F.array(F.lit("X-1"), F.concat(F.lit("GHSA-"), text))).otherwise(F.array().cast("array<string>"))
    severity = F.element_at(F.array(*map(F.lit, ("CRITICAL", "important", "moderate", "minor", "?"))), (k % 5 + 1).cast("int"))
    fixes = F.when(k % 3 == 0, F.array(F.lit("2.0"))).otherwise(F.array().cast("array<string>"))
    one = F.struct(ident.alias("id"), aliases.alias("aliases"), severity.alias("severity"), fixes.alias("fix_versions"))
    rows = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, "pypi").otherwise("npm").alias("ecosystem"), F.concat(F.lit("p"), text).alias("name"), F.lit("1.0").alias("version"), F.array(one, one).alias("vulns"))
    return access.sca_findings(rows).select("ecosystem", "name", "vulnerability_id", "severity", "fixed")


@query("SELECT concat('r', n_regionkey, '/n', n_nationkey, '/c', c_custkey) AS dir, CASE c_custkey % 2 WHEN 0 THEN 'npm' ELSE 'pypi' END AS ecosystem FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT (c_custkey % 2 = 0 AND n_regionkey % 2 = 0) AND NOT (c_custkey % 2 = 1 AND n_nationkey % 3 = 0)")
def uncovered_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, SRC16: customers as manifests under their region and nation, locks at either."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    folder = F.concat(F.lit("r"), F.col("n_regionkey"))
    deeper = F.concat(folder, F.lit("/n"), F.col("n_nationkey"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    manifests = rows.select(F.concat(deeper, F.lit("/c"), F.col("c_custkey")).alias("dir"), F.when(F.col("c_custkey") % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"))
    locks = nations.filter("n_regionkey % 2 = 0").select(folder.alias("dir"), F.lit("npm").alias("ecosystem")).unionByName(nations.filter("n_nationkey % 3 = 0").select(deeper.alias("dir"), F.lit("pypi").alias("ecosystem")))
    return access.uncovered_manifests(manifests, locks).select("dir", "ecosystem")


@query("""SELECT c_nationkey AS file, c_custkey::INT AS decl_line, concat('f', c_custkey % 7) AS field, (c_nationkey % 4 = 0 AND c_custkey % 7 = 3)
  OR EXISTS (SELECT 1 FROM customer x WHERE x.c_nationkey = c.c_nationkey AND x.c_custkey % 10 = 0 AND c.c_custkey BETWEEN x.c_custkey + 2 AND x.c_custkey + 4) AS controlled FROM customer c""")
def field_control_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, GV1: customers as declared fields of their nation's file; controls name a field or stand above it."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").cast("int").alias("line"))
    fields = rows.withColumn("field", F.concat(F.lit("f"), F.col("line") % 7))
    above = rows.filter("line % 10 = 0").select("file", (F.col("line") + 2).alias("line"), F.lit("@Encrypted").alias("text"))
    named = rows.select("file").distinct().filter("file % 4 = 0").select("file", F.lit(0).alias("line"), F.lit("mask(F3)").alias("text"))
    return access.field_controls(fields, above.unionByName(named))


@query("SELECT o_orderkey AS item, CASE WHEN s > 1 THEN 'rejected_conflict' WHEN o_orderkey = k THEN 'kept' ELSE 'rejected_duplicate' END AS decision FROM orders JOIN (SELECT o_custkey, count(DISTINCT o_orderstatus) AS s, min(o_orderkey) AS k FROM orders GROUP BY 1) USING (o_custkey)")
def cluster_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer as a cluster, statuses as strata."""
    orders = table(spark, sf_dir, "orders")
    tokens = orders.select(F.col("o_orderkey").alias("item"), F.concat(F.lit("c"), F.col("o_custkey")).alias("token"))
    items = orders.select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("stratum"))
    return select.cluster_survivors(items, select.token_clusters(tokens), "stratum").select("item", "decision")


# Thirteen inputs of a release, each a figure that is stated and can be counted again.
_INPUTS = (
    ("documents", "documents", "count(*)", True), ("texts", "documents", "count(text)", True), ("characters", "documents", "sum(n_chars)", True), ("sources", "documents", "count(distinct source)", False), ("languages", "documents", "count(distinct lang)", False),
    ("labels", "labels", "count(*)", True), ("toxic", "labels", "sum(toxic)", True), ("good", "labels", "sum(quality)", False), ("pages", "pages", "count(*)", False), ("events", "events", "count(*)", True), ("users", "events", "count(distinct user_id)", True),
    ("turns", "conversations", "count(*)", False), ("conversations", "conversations", "count(distinct conv_id)", True),
)
_RECOUNT = " UNION ALL ".join(f"SELECT '{name}' AS name, {str(blocker).lower()} AS blocker, (SELECT {sql} FROM {of})::BIGINT AS recomputed" for name, of, sql, blocker in _INPUTS)
# Stated: wrong by one where the name has eight letters or more, missing for users.
_STATED = f"SELECT name, blocker, recomputed, CASE WHEN name = 'users' THEN NULL WHEN length(name) >= 8 THEN recomputed + 1 ELSE recomputed END AS stated FROM ({_RECOUNT})"


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = None
    for name, of, sql, blocker in _INPUTS:
        one = table(spark, sf_dir, of).agg(F.expr(sql).cast("long").alias("recomputed")).select(F.lit(name).alias("name"), F.lit(blocker).alias("blocker"), "recomputed")
        counted = one if counted is None else counted.unionByName(one)
    stated = counted.filter("name != 'users'").select("name", F.when(F.length("name") >= 8, F.col("recomputed") + 1).otherwise(F.col("recomputed")).alias("stated"))
    return evaluate.recomputed(stated, counted)


@query(f"SELECT name, stated, recomputed, blocker, CASE WHEN stated IS NULL THEN 'fail' WHEN stated = recomputed THEN 'pass' WHEN blocker THEN 'fail' ELSE 'warn' END AS status FROM ({_STATED})")
def release_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GV6: thirteen stated figures against the same figures counted from the tables."""
    return _inputs(spark, sf_dir).select("name", "stated", "recomputed", "blocker", "status")


@query(f"WITH s AS (SELECT blocker, CASE WHEN stated IS NULL THEN 'fail' WHEN stated = recomputed THEN 'pass' WHEN blocker THEN 'fail' ELSE 'warn' END AS status FROM ({_STATED})) SELECT count(*) AS checks, count(*) FILTER (status = 'fail' AND blocker) AS failed_blockers, count(*) FILTER (status = 'warn') AS warnings, count(*) FILTER (status = 'fail' AND blocker) = 0 AS passed FROM s")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27, A32, GV6: those checks to one verdict."""
    return evaluate.gate(_inputs(spark, sf_dir))


@query("WITH d AS (SELECT concat('c', c_nationkey, '.kr') AS domain, min(c_custkey)::INT AS rank FROM customer GROUP BY 1) SELECT printf('target-%04d', row_number() OVER (ORDER BY rank, domain)) AS target_id, domain, rank FROM (SELECT * FROM d WHERE rank >= 3 ORDER BY rank, domain LIMIT 12)")
def ranked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17: customers as a ranked list of their nations' sites, from rank 3 on."""
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("rank"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "https://www.C").otherwise("c"), F.col("c_nationkey").cast("string"), F.lit(".kr/x")).alias("domain"))
    return readers.ranked_domains(raw, 12, 3).select("target_id", "domain", "rank")


@query("""WITH q AS (SELECT o_orderkey AS query_id, o_orderkey % 3 AS who, o_orderkey % 4 AS cols, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 200 WHEN 2 THEN 80 ELSE 10 END AS lim, o_orderkey % 11 = 0 AS other FROM orders),
c AS (SELECT query_id, CASE WHEN lim IS NULL THEN 'limit_missing' WHEN lim > 100 THEN 'limit_exceeds_gate' WHEN other OR who = 2 THEN 'no_grant' WHEN who = 0 THEN CASE WHEN cols = 3 THEN 'column_denied' WHEN lim > 50 THEN 'limit_exceeds_grant' ELSE '' END ELSE CASE WHEN cols = 2 THEN 'column_denied' ELSE '' END END AS deny_code FROM q)
SELECT query_id, CASE WHEN deny_code = '' THEN 'allow' ELSE 'deny' END AS decision, deny_code FROM c""")
def rbac_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An access request for each order under two roles' grants."""
    k = F.col("o_orderkey")
    columns = F.when(k % 4 == 3, F.array(F.lit("o_orderkey"), F.lit("o_custkey"))).when(k % 4 == 2, F.array(F.lit("o_totalprice"))).otherwise(F.array(F.lit("o_orderkey")))
    asked = table(spark, sf_dir, "orders").select(
        k.alias("query_id"), F.when(k % 3 == 0, F.array(F.lit("analyst"))).when(k % 3 == 1, F.array(F.lit("admin"))).otherwise(F.array(F.lit("guest"))).alias("roles"), F.lit("db").alias("db"), F.lit("s").alias("schema"),
        F.when(k % 11 == 0, "parts").otherwise("orders").alias("table"), columns.alias("columns"), F.when(k % 7 == 1, 200).when(k % 7 == 2, 80).when(k % 7 > 2, 10).alias("row_limit"),
    )
    grants = spark.createDataFrame([("analyst", "db", "s", "orders", ["o_orderkey", "o_totalprice"], 50), ("admin", "db", "s", "orders", ["o_orderkey", "o_custkey"], 100)], "role string, db string, schema string, table string, columns array<string>, max_rows int")
    return access.rbac(asked, grants)


_EVENT_LINES = (  # kind of event, line, its type, whether it is no object, action, rule
    ("signup", '{"event":"tool_result","tool":"crm","result":"mail u@@example.com"}', "tool_result", False, "redact", "MCP_TOOL_RESULT_PII"), ("view", '{"event":"llm_request","tool":"openai","prompt":"summarise @"}', "llm_request", False, "allow", ""),
    ("error", '{"jsonrpc":"2.0","id":@,"result":"x","error":"y"}', "", False, "block", "MCP_CONTRADICTORY_RESPONSE"), ("click", "{not json @", "", True, "allow", ""), ("purchase", '{"event":"tool_result","result":"sk-abcdefghijklmnopqrstuv@"}', "tool_result", False, "block", "MCP_SECRET"),
)
_EVENT_VALUES = ", ".join(f"('{k}', '{t}', {str(bad).lower()}, '{a}', '{r}')" for k, _, t, bad, a, r in _EVENT_LINES)


@query(f"""WITH w(k, t, bad, a, r) AS (VALUES {_EVENT_VALUES})
SELECT event_id, t AS event_type, bad AS parse_error, a AS action, r AS rule_id, CASE a WHEN 'block' THEN '{{"blocked":true,"rule_id":"' || r || '"}}' WHEN 'redact' THEN 'mail <redacted:EMAIL:' || substr(sha256(concat('u', event_id, '@example.com')), 1, 12) || '>' WHEN 'allow' THEN CASE k WHEN 'view' THEN concat('summarise ', event_id) ELSE '' END END AS forwarded FROM events JOIN w ON event_type = k""")
def event_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, F-EVT, ST4, ST5, SNK4: each event as a line of a log, its decision and what is forwarded."""
    line = None
    for kind, text, *_ in _EVENT_LINES:
        test = F.col("event_type") == kind
        value = F.replace(F.replace(F.replace(F.lit(text), F.lit("@@"), F.lit("\u0001@")), F.lit("@e"), F.lit("\u0002")), F.lit("@"), F.col("event_id").cast("string"))
        value = F.replace(F.replace(value, F.lit("\u0001"), F.col("event_id").cast("string")), F.lit("\u0002"), F.lit("@e"))
        line = F.when(test, value) if line is None else line.when(test, value)
    raw = table(spark, sf_dir, "events").select("event_id", line.alias("value")).filter("value is not null")
    decided = session.parse_events(raw).withColumn("decision", session.event_decision())
    return session.enforce(decided).select("event_id", "event_type", "parse_error", "decision.action", "decision.rule_id", "forwarded")


# --- labelled lines, assignments, matchings -----------------------------------------------------------
_SCORED = (
    ("positive", "rrn=840229-1000001", ["PII_RRN_VALID"]), ("positive", "card 4111 1111 1111 1111", ["PII_CREDIT_CARD"]), ("positive", "사업자등록번호: 123-45-67891", ["KR_ORG_BUSINESS_REGISTRATION"]), ("positive", "api_key = abcdefgh12345678", ["SECRET_API_KEY"]),
    ("negative", "rrn=850229-1000008", None), ("negative", "nothing to see", None), ("negative", "서버 장애 발생", ["PII_SENSITIVE_INFO"]),
)


@query("SELECT count(*) FILTER (k < 4) AS positives, count(*) FILTER (k < 4) AS hits, count(*) FILTER (k IN (4, 5)) AS measurable, 0::BIGINT AS false_positives, count(*) FILTER (k = 6) AS targeted, 0::BIGINT AS targeted_failures, 1.0 AS recall, 0.0 AS fpr, true AS passed FROM (SELECT c_custkey % 7 AS k FROM customer)")
def fixture_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors against a labelled line for each customer."""
    k = F.col("c_custkey") % 7
    pick = lambda values: F.element_at(F.array(*values), (k + 1).cast("int"))
    none = F.lit(None).cast("array<string>")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("name"), pick([F.lit(a) for a, _, _ in _SCORED]).alias("kind"), pick([F.lit(t) for _, t, _ in _SCORED]).alias("text"), pick([F.array(*map(F.lit, e)) if e else none for _, _, e in _SCORED]).alias("expected"),
    )
    found = pii.entity_findings(pii.detect_entities(rows.select("name", "text")), F.col("name")).groupBy("name").agg(F.collect_set("rule_id").alias("rules"))
    return evaluate.scoreboard(rows.select("name", "kind", "expected"), found)


@query("""WITH n AS (SELECT n_regionkey::VARCHAR AS app_id, n_nationkey::VARCHAR AS target_id, n_nationkey % 2 = 1 AS two FROM nation)
SELECT app_id, target_id, 'c1' AS case_id, 'f1' AS finding_fingerprint, true AS matched FROM n UNION ALL SELECT app_id, target_id, 'c2', CASE WHEN two THEN 'f2' END, two FROM n
UNION ALL SELECT app_id, target_id, 'c3', NULL, false FROM n UNION ALL SELECT app_id, target_id, 'c4', 'f1', true FROM n""")
def case_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy assignment of four cases of each nation to one or two findings."""
    cases = F.array(*[F.struct(F.lit(c).alias("case_id"), F.lit(r).alias("case_rank"), F.lit(o).alias("expected_outcome"), (F.array(*map(F.lit, rules)) if rules else F.array().cast("array<string>")).alias("expected_rule_ids")) for c, r, o, rules in (("c1", 0, "vulnerable", ["R1"]), ("c2", 1, "vulnerable", ["R1", "R2"]), ("c3", 1, "vulnerable", ["R1"]), ("c4", 2, "clean", []))])
    found = F.array(*[F.struct(F.lit(f).alias("finding_fingerprint"), F.lit(r).alias("rule_id")) for f, r in (("f1", "R1"), ("f2", "R2"))])
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("app_id"), F.col("n_nationkey").cast("string").alias("target_id"), F.explode(cases).alias("c"), F.when(F.col("n_nationkey") % 2 == 1, found).otherwise(F.slice(found, 1, 1)).alias("found"))
    return evaluate.assign_cases(rows.select("app_id", "target_id", "c.*", F.explode("found").alias("f")).select("app_id", "target_id", "case_id", "case_rank", "expected_outcome", "expected_rule_ids", "f.*"))


@query("SELECT l_orderkey AS k, least(count(DISTINCT concat(l_linenumber, '-', l_suppkey)), count(DISTINCT l_suppkey % 4) + 1)::INT AS matched FROM lineitem GROUP BY 1")
def maximum_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order against a part of their supplier each, and one more that all of them fit."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat_ws("-", "l_linenumber", "l_suppkey").alias("l"), F.explode(F.array((F.col("l_suppkey") % 4).cast("string"), F.lit("any"))).alias("r"))
    return evaluate.bipartite_matching(rows, ["k"], "l", "r").groupBy("k").agg(F.count("*").cast("int").alias("matched"))


# --- payloads of dependency audits --------------------------------------------------------------------
_PAYLOADS = (  # ecosystem, payload, lock; @ is the part
    ("python", '{"dependencies": [{"name": "Pkg_@", "version": "1.@", "vulns": [{"id": "CVE-2024-@", "severity": "high", "fix_versions": ["2"]}, {"id": "CVE-2024-@", "severity": "high", "fix_versions": ["2"]}]}]}', None),
    ("npm", '{"vulnerabilities": {"Left@": {"nodes": ["node_modules/left@"], "via": [{"source": @, "severity": "critical"}], "fixAvailable": true}}}', '{"packages": {"node_modules/left@": {"version": "3.@"}, "node_modules/q/node_modules/left@": {"version": "0"}}}'),
    ("go", '{"config": {"protocol_version": "v1.0.0"}}\n{"osv": {"id": "GO-2024-@", "database_specific": {"severity": "LOW"}}}\n{"finding": {"osv": "GO-2024-@", "trace": [{"module": "m/@", "version": "v@"}]}}', None),
    ("python", '{"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "CVE-2024-@"}]}, {"name": "b", "version": "", "vulns": []}]}', None),
    ("npm", '{"vulnerabilities": {"a": {"via": [], "severity": "high"}}}', '{"packages": {}}'),
    ("go", '{"config": {"protocol_version": "v1.0.0"}}\n{"finding"', None),
)


def _audits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    pick = lambda n: F.element_at(F.array(*[F.lit(p[n]).cast("string") for p in _PAYLOADS]), (k % len(_PAYLOADS) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(k.alias("audit_id"), pick(0).alias("ecosystem"), F.replace(pick(1), F.lit("@"), text).alias("payload"), F.replace(pick(2), F.lit("@"), text).alias("lock"))
    return dependencies.audit_findings(rows)


@query("""SELECT k AS audit_id, CASE k % 6 WHEN 0 THEN 'pkg-' || k WHEN 1 THEN 'left' || k ELSE 'm/' || k END AS package, CASE k % 6 WHEN 0 THEN '1.' || k WHEN 1 THEN '3.' || k ELSE 'v' || k END AS version,
  CASE k % 6 WHEN 0 THEN 'CVE-2024-' || k WHEN 1 THEN 'NPM-' || k ELSE 'GO-2024-' || k END AS vulnerability_id, CASE k % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' ELSE 'low' END AS severity, k % 6 < 2 AS fixed FROM (SELECT p_partkey AS k FROM part) WHERE k % 6 < 3""")
def audit_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-SCA: each part as the payload of an audit in one of three forms, versions of npm from a lock."""
    return _audits(spark, sf_dir)[0].select("audit_id", "package", "version", "vulnerability_id", "severity", "fixed")


@query("SELECT p_partkey AS audit_id, CASE p_partkey % 6 WHEN 3 THEN 'schema' WHEN 4 THEN 'schema' WHEN 5 THEN 'malformed' ELSE 'ok' END AS status, CASE WHEN p_partkey % 6 < 3 THEN 1 ELSE 0 END::BIGINT AS n_findings FROM part")
def audit_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-SCA: which of those audits count, and why the others do not."""
    return _audits(spark, sf_dir)[1].select("audit_id", "status", "n_findings")
