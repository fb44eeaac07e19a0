"""Registered queries over the driver tables, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.functions import scalars as S
from auditframe.functions.text import ascii_folded, clamped_depth, lines, rolling_segments
from auditframe.operators import access, evaluate, findings, pii, select
from auditframe.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of texts, dealt over all cores."""
    return spread(table(spark, sf_dir, name).select(*columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")


# --- shared SQL ------------------------------------------------------------------------------------
LINES = """
parts AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, lang, source, unnest(range(1, len(q) + 1))::INT AS line_no, unnest(q) AS line
  FROM (SELECT *, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS q FROM parts)),
folded AS (SELECT *, regexp_replace(line, '[^\\x00-\\x7F]', 'x', 'g') AS f FROM lines)"""
EMAIL_RE = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b"
IP_RE = "\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b"
KEY_RE = "(?i)\\b(?:api[_-]?key|secret|token|password)\\b[\"'']?\\s*[:=]\\s*[\"'']?([A-Za-z0-9_\\-]{8,})"
CARD_RE = "\\b(?:[0-9][ -]?){13,19}\\b"


def luhn_sql(d: str) -> str:
    return f"(list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN (len({d}) - i) % 2 = 1 THEN CASE WHEN substr({d}, i, 1)::INT > 4 THEN substr({d}, i, 1)::INT * 2 - 9 ELSE substr({d}, i, 1)::INT * 2 END ELSE substr({d}, i, 1)::INT END)) % 10 = 0)"


CARD_CONTEXT_RE = "(?i)(credit[_ -]?card|card[_ -]?(?:number|num|no)|\\bpan\\b)"
FOUND = f"""{LINES},
raw AS (
  SELECT doc_id, lang, source, line_no, 'EMAIL' AS label, unnest(regexp_extract_all(f, '{EMAIL_RE}')) AS value, 'high' AS confidence, f FROM folded
  UNION ALL SELECT doc_id, lang, source, line_no, 'IP_ADDRESS', unnest(regexp_extract_all(f, '{IP_RE}')), 'medium', f FROM folded
  UNION ALL SELECT doc_id, lang, source, line_no, 'CREDIT_CARD', unnest(regexp_extract_all(f, '{CARD_RE}')), 'high', f FROM folded
  UNION ALL SELECT doc_id, lang, source, line_no, 'API_KEY', unnest(regexp_extract_all(f, '{KEY_RE}', 1)), 'medium', f FROM folded),
gated AS (
  SELECT DISTINCT doc_id, lang, source, line_no, label, value, confidence FROM raw
  WHERE CASE label
    WHEN 'IP_ADDRESS' THEN list_bool_and(list_transform(string_split(value, '.'), lambda x: x::INT <= 255))
    WHEN 'CREDIT_CARD' THEN substr(value, 1, 1) BETWEEN '2' AND '6' AND {luhn_sql("regexp_replace(value, '[^0-9]', '', 'g')")}
      AND (regexp_matches(trim(value), '[ -]') OR regexp_matches(f, '{CARD_CONTEXT_RE}'))
    WHEN 'API_KEY' THEN NOT regexp_matches(value, '(?i)^your[_-]')
    ELSE true END),
findings AS (
  SELECT doc_id, lang, source AS cohort, line_no AS line_start, label, value, confidence,
    CASE label WHEN 'API_KEY' THEN 'SECRET_API_KEY' ELSE 'PII_' || label END AS rule_id,
    CASE label WHEN 'CREDIT_CARD' THEN 'critical' WHEN 'API_KEY' THEN 'high' WHEN 'EMAIL' THEN 'medium' ELSE 'low' END AS severity,
    '<redacted:' || label || ':' || substr(sha256(trim(value)), 1, 12) || '>' AS evidence,
    CASE doc_id % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'tests/' ELSE 'config/' END || source || '/' || doc_id::VARCHAR || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 3 THEN '.yaml' ELSE '.txt' END AS file,
    CASE doc_id % 4 WHEN 0 THEN 'runtime_source' WHEN 1 THEN 'documentation' WHEN 2 THEN 'test_fixture' ELSE 'configuration' END AS artifact_scope
  FROM gated)"""
SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def hmac_sql(value: str) -> str:
    inner, outer = S.hmac_pads(S.DEFAULT_KEY)
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value})))), 1, 16)"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    z = S.WILSON_Z
    mid = f"(({k})::DOUBLE / ({n}) + {z * z!r} / (2 * ({n}))) / (1 + {z * z!r} / ({n}))"
    half = f"{z!r} * sqrt((({k})::DOUBLE / ({n})) * (1 - ({k})::DOUBLE / ({n})) / ({n}) + {z * z!r} / (4 * ({n}) * ({n}))) / (1 + {z * z!r} / ({n}))"
    return tuple(f"CASE WHEN ({n}) > 0 THEN round({f}, 6) ELSE 0.0 END" for f in (f"greatest(0.0, {mid} - {half})", f"least(1.0, {mid} + {half})"))


def document_path() -> Column:
    turn = F.col("doc_id") % 4
    folder = F.when(turn == 0, "src/").when(turn == 1, "docs/").when(turn == 2, "tests/").otherwise("config/")
    suffix = F.when(turn == 0, ".py").when(turn == 3, ".yaml").otherwise(".txt")
    return F.concat(folder, "source", F.lit("/"), F.col("doc_id").cast("string"), suffix)


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all documents as findings; ``cohort`` is the source column."""
    entities = pii.detect_entities(documents(spark, sf_dir))
    found = pii.entity_findings(entities.withColumnRenamed("source", "cohort"), F.lit(""))
    found = found.withColumn("file", F.col("file")).withColumn("__s", F.col("source")).withColumn("source", F.col("cohort"))
    return found.withColumn("file", document_path()).withColumn("source", F.col("__s")).drop("__s").withColumn("artifact_scope", findings.artifact_scope(F.col("file")))


# --- detection ---------------------------------------------------------------------------------------
@query(f"WITH {FOUND} SELECT lang, rule_id, severity, count(*) AS finding_count, count(DISTINCT doc_id) AS doc_count FROM findings GROUP BY ALL")
def pii_findings_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents to lines to entities to findings, counted (D-PII1, A1, A5)."""
    found = document_findings(spark, sf_dir)
    return found.groupBy("lang", "rule_id", "severity").agg(F.count("*").alias("finding_count"), F.count_distinct("doc_id").alias("doc_count"))


@query(f"WITH {FOUND} SELECT doc_id, string_agg(label || '=' || n, ',' ORDER BY label) AS label_counts FROM (SELECT doc_id, label, count(*)::VARCHAR AS n FROM findings GROUP BY ALL) GROUP BY doc_id")
def pii_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: label counts of each document as text."""
    per = pii.detect_entities(documents(spark, sf_dir)).groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("label", F.lit("="), F.col("n").cast("string")))), ",").alias("label_counts"))


@query(f"""WITH {LINES},
shaped AS (SELECT unnest(regexp_extract_all(f, '{CARD_RE}')) AS v, f FROM folded),
g AS (SELECT substr(v, 1, 1) BETWEEN '2' AND '6' AS a, {luhn_sql("regexp_replace(v, '[^0-9]', '', 'g')")} AS b, regexp_matches(trim(v), '[ -]') OR regexp_matches(f, '{CARD_CONTEXT_RE}') AS c FROM shaped)
SELECT 1 AS gate, 'shaped' AS name, count(*) AS n FROM g UNION ALL SELECT 2, 'issuer', count(*) FILTER (a) FROM g
UNION ALL SELECT 3, 'luhn', count(*) FILTER (a AND b) FROM g UNION ALL SELECT 4, 'separated_or_context', count(*) FILTER (a AND b AND c) FROM g""")
def card_gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-PII4, F-LUHN: how many card shapes pass each gate."""
    line = F.col("line")
    shaped = lines(documents(spark, sf_dir)).select(line, F.explode(F.regexp_extract_all(line, F.lit(pii.CARD), F.lit(0))).alias("v"))
    d = F.regexp_replace("v", "[^0-9]", "")
    a = F.substring("v", 1, 1).isin("2", "3", "4", "5", "6")
    b, c = S.luhn(d), F.trim("v").rlike("[ -]") | line.rlike(pii.CARD_CONTEXT)
    row = shaped.agg(F.count("*").alias("g1"), F.count_if(a).alias("g2"), F.count_if(a & b).alias("g3"), F.count_if(a & b & c).alias("g4"))
    names = ("shaped", "issuer", "luhn", "separated_or_context")
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.lit(n).alias("name"), F.col(f"g{k}").alias("n")) for k, n in enumerate(names, 1)])).alias("r")).select("r.*")


@query(f"WITH {FOUND} SELECT doc_id, line_start, rule_id, evidence FROM findings WHERE label = 'API_KEY'")
def secret_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-SEC: secrets assigned in text."""
    return document_findings(spark, sf_dir).filter("source = 'secret'").select("doc_id", "line_start", "rule_id", "evidence")


@query(f"WITH {FOUND} SELECT doc_id, line_start, label, evidence, substr(sha256(value), 1, 12) AS fingerprint FROM findings")
def masked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-FP, F-MASK, P8: entities without raw values."""
    return document_findings(spark, sf_dir).select("doc_id", "line_start", "label", "evidence", S.fp12(F.col("value")).alias("fingerprint"))


@query(f"WITH {LINES} SELECT doc_id, line_no, {hmac_sql('trim(line)')} AS evidence_hash FROM lines")
def evidence_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-HMAC of every line."""
    return lines(documents(spark, sf_dir)).select("doc_id", "line_no", S.hmac16(F.trim("line")).alias("evidence_hash"))


@query(f"""WITH {LINES},
s AS (SELECT doc_id, line_no, len(regexp_replace(line, '[^(]', '', 'g')) AS o, len(regexp_replace(line, '[^)]', '', 'g')) AS c FROM lines),
r AS (SELECT *, sum(o - c) OVER (PARTITION BY doc_id ORDER BY line_no) AS t FROM s),
d AS (SELECT *, t - least(0, min(t) OVER (PARTITION BY doc_id ORDER BY line_no)) AS depth FROM r),
b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS before FROM d),
n AS (SELECT *, sum(CASE WHEN before = 0 AND o > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS starts FROM b)
SELECT doc_id, line_no, depth::BIGINT AS depth, starts::BIGINT AS block FROM n WHERE before > 0 OR o > 0""")
def bracket_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside brackets, with their depth and block."""
    rows = lines(documents(spark, sf_dir))
    count = lambda ch: F.length(F.regexp_replace("line", f"[^{ch}]", ""))
    return clamped_depth(rows, count("("), count(")"), ["doc_id"], ["line_no"]).filter("block is not null").select("doc_id", "line_no", "depth", "block")


@query("""WITH w AS (SELECT conv_id, turn, text, lead(text) OVER x AS t2, lead(text, 2) OVER x AS t3, lead(turn) OVER x AS l2, lead(turn, 2) OVER x AS l3 FROM conversations WINDOW x AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn AS first_line, l2 AS last_line, sha256(text || chr(10) || t2) AS digest, 2 AS width FROM w WHERE l2 IS NOT NULL AND strlen(text || chr(10) || t2) <= 32768
UNION ALL SELECT conv_id, turn, l3, sha256(text || chr(10) || t2 || chr(10) || t3), 3 FROM w WHERE l3 IS NOT NULL AND strlen(text || chr(10) || t2 || chr(10) || t3) <= 32768""")
def rolling_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation joined with the next one or two."""
    rows = rolling_segments(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")
    return rows.select("conv_id", "first_line", "last_line", F.sha2("segment", 256).alias("digest"), "width")


# --- correlation -------------------------------------------------------------------------------------
PAIR_RULES = (("KR_COMBO_EMAIL_IP", ("EMAIL", "IP_ADDRESS"), "high", "high"), ("KR_COMBO_EMAIL_KEY", ("EMAIL", "API_KEY"), "critical", "high"), ("KR_COMBO_KEY", ("API_KEY",), "medium", "medium"))


@query(f"""WITH {FOUND},
g AS (SELECT doc_id, list(DISTINCT label) AS labels FROM findings GROUP BY doc_id),
r(rule_id, need, severity, confidence) AS (VALUES ('KR_COMBO_EMAIL_IP', ['EMAIL', 'IP_ADDRESS'], 'high', 'high'), ('KR_COMBO_EMAIL_KEY', ['EMAIL', 'API_KEY'], 'critical', 'high'), ('KR_COMBO_KEY', ['API_KEY'], 'medium', 'medium'))
SELECT doc_id, rule_id, severity, confidence, len(need)::INT AS n_components FROM g JOIN r ON list_has_all(labels, need)""")
def composite_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 with a document as the group (``csv_row`` scope keeps the confidence)."""
    entities = pii.detect_entities(documents(spark, sf_dir)).withColumn("context", F.lit("csv_row:1"))
    return findings.composites(entities, ["doc_id"], PAIR_RULES).select("doc_id", "rule_id", "severity", "confidence", F.size("components").alias("n_components"))


@query(f"""WITH {FOUND}, s AS (SELECT cohort, rule_id, confidence FROM findings
  UNION ALL SELECT source, 'FLOW_TO_LLM', CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT source, 'FLOW_EXTERNAL_HTTP', 'medium' FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT source, 'CONNECTOR_PII_AT_REST', 'high' FROM documents WHERE doc_id % 50 = 0),
b AS (SELECT cohort AS scope, count(*) FILTER (regexp_matches(rule_id, '^(PII_|CONNECTOR_(PII|SCHEMA))')) AS p, count(*) FILTER (rule_id LIKE '%LLM%' AND confidence <> 'low') AS a, count(*) FILTER (rule_id LIKE '%EXTERNAL_HTTP%' AND confidence <> 'low') AS e FROM s GROUP BY 1)
SELECT * FROM (
SELECT scope, p AS privacy_count, 'CROSS_PLANE_TO_AGENTIC_SINK' AS rule_id, 'critical' AS severity, a AS sink_count, 'medium' AS confidence FROM b WHERE p > 0 AND a > 0
UNION ALL SELECT scope, p, 'CROSS_PLANE_TO_EXTERNAL_SINK', 'high', e, 'medium' FROM b WHERE p > 0 AND e > 0
UNION ALL SELECT 'project', count(*) FILTER (rule_id LIKE 'CONNECTOR_%'), 'CROSS_PLANE_AT_REST_WITH_FLOW', 'high', count(*) FILTER (rule_id LIKE 'FLOW_%'), 'low' FROM s HAVING count(*) FILTER (rule_id LIKE 'CONNECTOR_%') > 0 AND count(*) FILTER (rule_id LIKE 'FLOW_%') > 0)
ORDER BY {SEV}, scope, rule_id LIMIT 30""")
def cross_scope_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes with personal data and a flow; thirty rows at most."""
    docs = documents(spark, sf_dir)
    flow = lambda rule, conf, every: docs.filter(F.col("doc_id") % every == 0).select(F.col("source").alias("cohort"), F.lit(rule).alias("rule_id"), conf.alias("confidence"))
    found = document_findings(spark, sf_dir).select("cohort", "rule_id", "confidence")
    rows = found.unionByName(flow("FLOW_TO_LLM", F.when(F.col("doc_id") % 2 == 0, "high").otherwise("low"), 7)).unionByName(flow("FLOW_EXTERNAL_HTTP", F.lit("medium"), 11)).unionByName(flow("CONNECTOR_PII_AT_REST", F.lit("high"), 50))
    return findings.cross_plane(rows, "cohort")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events),
j AS (SELECT a.user_id, a.line AS source_line, b.line AS sink_line, b.event_type AS kind, abs(a.line - b.line) AS gap FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type IN ('purchase', 'error') AND abs(a.line - b.line) <= 30),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, source_line, kind ORDER BY gap, sink_line) AS n FROM j),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_line, kind) AS e FROM n WHERE n = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY source_line) AS r FROM c WHERE e <= 60)
SELECT user_id, source_line, sink_line, kind, gap FROM r WHERE r <= 20""")
def nearest_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest purchase or error of each signup of a user, by position in the user's events."""
    e = table(spark, sf_dir, "events").withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    sources = e.filter("event_type = 'signup'").select("user_id", "line", F.col("line").alias("seq"))
    sinks = e.filter("event_type in ('purchase', 'error')").select("user_id", "line", F.col("line").alias("seq"), F.col("event_type").alias("kind"))
    return findings.nearest_sinks(sources, sinks, ["user_id"]).select("user_id", "source_line", "sink_line", "kind", "gap")


# --- findings over findings ----------------------------------------------------------------------------
@query(f"""WITH {FOUND}, two AS (SELECT *, 1 AS o FROM findings UNION ALL SELECT * REPLACE ('critical' AS severity, 'low' AS confidence), 2 FROM findings WHERE doc_id % 3 = 0)
SELECT rule_id, file, line_start, evidence, CASE min({SEV}) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  CASE min(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS merged_count
FROM two GROUP BY rule_id, file, line_start, evidence""")
def dedupe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, O1, O2: findings of two detectors merged by key."""
    found = document_findings(spark, sf_dir).select("source", "rule_id", "severity", "confidence", "file", "line_start", "evidence", "artifact_scope", "detector_ord", "seq", "doc_id")
    again = found.filter("doc_id % 3 = 0").withColumn("severity", F.lit("critical")).withColumn("confidence", F.lit("low")).withColumn("detector_ord", F.lit(9))
    return findings.dedupe_findings(found.unionByName(again)).select("rule_id", "file", "line_start", "evidence", "severity", "confidence", "merged_count")


LANE_SQL = """CASE WHEN severity NOT IN ('critical', 'high') THEN 'supporting_review' WHEN artifact_scope IN ('documentation', 'test_fixture') THEN CASE WHEN confidence = 'high' THEN 'manual_review_hold' ELSE 'supporting_review' END ELSE 'manual_review_hold' END"""


@query(f"""WITH {FOUND}, l AS (SELECT *, {LANE_SQL} AS lane, {hmac_sql("file || ':' || line_start::VARCHAR")} AS place FROM findings),
g AS (SELECT rule_id, severity, artifact_scope, arg_min(lane, (line_start, file)) AS priority_lane, count(*) AS finding_count, count(DISTINCT file) AS affected_file_count, array_to_string((list_sort(list(DISTINCT place)))[:5], ',') AS location_refs, bool_or(lane <> 'supporting_review') AS blocking FROM l GROUP BY 1, 2, 3)
SELECT * FROM g ORDER BY blocking DESC, {SEV}, finding_count DESC, rule_id, artifact_scope LIMIT 50""")
def triage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage groups with hashed locations."""
    found = document_findings(spark, sf_dir).withColumn("detector_ord", F.lit(0)).withColumn("seq", F.col("line_start").cast("long"))
    return findings.triage(found).withColumn("location_refs", F.array_join("location_refs", ","))


@query(f"WITH {FOUND} SELECT {LANE_SQL} AS lane, rule_id, count(*) AS finding_count FROM findings GROUP BY ALL")
def release_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of findings."""
    return document_findings(spark, sf_dir).withColumn("lane", findings.release_lane()).groupBy("lane", "rule_id").agg(F.count("*").alias("finding_count"))


@query(f"WITH {FOUND} SELECT {', '.join(f'''count(*) FILTER (severity = '{s}') AS {s}''' for s in S.SEVERITIES)} FROM findings")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: counts by severity, zeros filled in."""
    return findings.severity_summary(document_findings(spark, sf_dir))


POLICY_ROWS = "SELECT DISTINCT 'app' AS app_id, 'korean_senior' AS audit_profile, repeat('ab', 16) AS release_scope_hash, cohort AS target_id, rule_id, substr(sha256(evidence), 1, 16) AS finding_fingerprint FROM findings WHERE doc_id % 5 = 0 AND line_start <= 3"


@query(f"""WITH {FOUND}, p AS ({POLICY_ROWS})
SELECT f.doc_id, f.line_start, f.rule_id, f.evidence, CASE WHEN p.rule_id IS NULL THEN 'kept' WHEN f.rule_id = 'SECRET_API_KEY' THEN 'suppressed' ELSE 'suppressed' END AS disposition
FROM findings f LEFT JOIN p ON f.cohort = p.target_id AND f.rule_id = p.rule_id AND substr(sha256(f.evidence), 1, 16) = p.finding_fingerprint""")
def suppression_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings split by a suppression policy, as of a fixed day; an expired row does not bind."""
    found = document_findings(spark, sf_dir).select("doc_id", "line_start", "rule_id", "evidence", F.col("cohort").alias("target_id"), "file")
    found = found.withColumn("app_id", F.lit("app")).withColumn("audit_profile", F.lit("korean_senior")).withColumn("release_scope_hash", F.lit("ab" * 16)).withColumn("finding_fingerprint", F.substring(F.sha2("evidence", 256), 1, 16))
    rows = found.filter("doc_id % 5 = 0 and line_start <= 3").select(*findings.SUPPRESSION_KEY).distinct()
    rows = rows.withColumn("owner", F.lit("team")).withColumn("reason", F.lit("accepted")).withColumn("expires", F.lit("2030-01-01"))
    expired = found.select(*findings.SUPPRESSION_KEY).distinct().withColumn("owner", F.lit("team")).withColumn("reason", F.lit("old")).withColumn("expires", F.lit("2020-01-01"))
    policy = rows.unionByName(expired).withColumn("file", F.lit(None).cast("string")).withColumn("line_start", F.lit(None).cast("string"))
    return findings.suppress(found, policy, "2026-01-01").select("doc_id", "line_start", "rule_id", "evidence", "disposition")


@query(f"""WITH {FOUND}, a AS (SELECT DISTINCT rule_id, cohort, confidence FROM findings WHERE doc_id % 2 = 1), b AS (SELECT DISTINCT rule_id, cohort, confidence FROM findings WHERE doc_id % 2 = 0)
SELECT *, 'new' AS drift FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def drift_new_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports against each other."""
    found = document_findings(spark, sf_dir)
    return findings.drift(found.filter("doc_id % 2 = 1"), found.filter("doc_id % 2 = 0"), ["rule_id", "cohort", "confidence"])


@query(f"""WITH {FOUND}, a AS (SELECT DISTINCT rule_id, cohort FROM findings WHERE doc_id % 2 = 1), b AS (SELECT DISTINCT rule_id, cohort FROM findings WHERE doc_id % 2 = 0),
s AS (SELECT count(*) AS shared FROM (SELECT * FROM a INTERSECT SELECT * FROM b)), u AS (SELECT count(*) AS united FROM (SELECT * FROM a UNION SELECT * FROM b))
SELECT shared, united, CASE WHEN united > 0 THEN round(shared / united, 6) ELSE 1.0 END AS jaccard FROM s, u""")
def candidate_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of two reports."""
    found = document_findings(spark, sf_dir)
    return findings.jaccard(found.filter("doc_id % 2 = 1"), found.filter("doc_id % 2 = 0"), ["rule_id", "cohort"])


@query(f"""WITH {FOUND} SELECT rule_id, cohort, count(*) FILTER (doc_id % 2 = 1) AS left_count, count(*) FILTER (doc_id % 2 = 0) AS right_count FROM findings GROUP BY 1, 2 HAVING left_count <> right_count""")
def multiset_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with different multiplicity in two reports."""
    found = document_findings(spark, sf_dir)
    return findings.multiset_difference(found.filter("doc_id % 2 = 1"), found.filter("doc_id % 2 = 0"), ["rule_id", "cohort"])


@query(f"""WITH {FOUND}, n AS (SELECT *, row_number() OVER (PARTITION BY rule_id, cohort ORDER BY doc_id * 100000 + line_start) AS k FROM findings),
g AS (SELECT rule_id, cohort, count(*) AS gone FROM findings WHERE doc_id % 3 = 0 GROUP BY 1, 2)
SELECT rule_id, cohort, count(*) AS remaining FROM n LEFT JOIN g USING (rule_id, cohort) WHERE k > coalesce(gone, 0) GROUP BY 1, 2""")
def multiset_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each key after as many were taken out."""
    found = document_findings(spark, sf_dir).withColumn("pos", F.col("doc_id") * 100_000 + F.col("line_start"))
    return findings.multiset_minus(found, found.filter("doc_id % 3 = 0"), ["rule_id", "cohort"], "pos").groupBy("rule_id", "cohort").agg(F.count("*").alias("remaining"))


@query(f"""WITH {FOUND}, c AS (SELECT rule_id, count(*) AS finding_count FROM findings GROUP BY 1)
SELECT rule_id, finding_count, round(finding_count / sum(finding_count) OVER (), 4) AS share FROM c ORDER BY finding_count DESC, rule_id LIMIT 20""")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, T3, T4."""
    return findings.top_rules(document_findings(spark, sf_dir))


@query(f"""WITH {FOUND}, s AS (SELECT rule_id, artifact_scope, count(*) AS n, min({SEV}) AS sev FROM findings GROUP BY 1, 2),
t AS (SELECT rule_id, count(DISTINCT cohort) AS target_count FROM findings GROUP BY 1)
SELECT rule_id, CASE min(sev) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS max_severity, sum(n)::BIGINT AS finding_count, any_value(target_count) AS target_count,
  string_agg(artifact_scope || '=' || n::VARCHAR, ',' ORDER BY artifact_scope) AS scope_histogram,
  CASE WHEN rule_id = 'PII_CREDIT_CARD' THEN 'remove_card_data' WHEN rule_id LIKE 'PII\\_%' ESCAPE '\\' THEN 'minimize_personal_data' WHEN rule_id LIKE 'SECRET\\_%' ESCAPE '\\' THEN 'rotate_and_remove' ELSE 'review_manually' END AS recipe
FROM s JOIN t USING (rule_id) GROUP BY rule_id ORDER BY min(sev), sum(n) DESC, rule_id LIMIT 20""")
def fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return findings.fix_plan(document_findings(spark, sf_dir), "cohort")


@query(f"""WITH {FOUND}, a AS (SELECT doc_id, cohort AS lineage_id, label AS plane, evidence, rule_id, severity, line_start % 2 AS act, doc_id::VARCHAR AS parent_id, doc_id::VARCHAR || ':' || line_start::VARCHAR || ':' || evidence AS atom_id FROM findings),
r AS (SELECT *, row_number() OVER w AS n, first_value(atom_id) OVER w AS kept_atom_id FROM a WINDOW w AS (PARTITION BY lineage_id, plane ORDER BY {SEV}, act, rule_id, parent_id, atom_id))
SELECT lineage_id, plane, kept_atom_id, atom_id AS removed_atom_id FROM r WHERE n > 1""")
def atomic_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of duplicates by lineage and plane."""
    found = document_findings(spark, sf_dir)
    doc = F.col("doc_id").cast("string")
    atoms = found.select(F.col("cohort").alias("lineage_id"), F.col("label").alias("plane"), "rule_id", "severity", (F.col("line_start") % 2 == 1).alias("actionable"), doc.alias("parent_id"), F.concat(doc, F.lit(":"), F.col("line_start").cast("string"), F.lit(":"), "evidence").alias("atom_id"))
    return findings.canonical_atoms(atoms, ["lineage_id", "plane"])[1]


# --- evaluation ------------------------------------------------------------------------------------------
_WL, _WH = wilson_sql("tp", "tp + fn")


@query(f"""WITH {FOUND}, h AS (SELECT DISTINCT doc_id FROM findings),
r AS (SELECT d.lang AS category, l.toxic = 1 AS t, h.doc_id IS NOT NULL AS p FROM documents d JOIN labels l USING (doc_id) LEFT JOIN h USING (doc_id)),
c AS (SELECT coalesce(category, '__all__') AS category, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM r GROUP BY ROLLUP (category))
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 6) ELSE 0.0 END AS specificity,
  CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) ELSE 0.0 END AS fpr, {_WL} AS recall_low, {_WH} AS recall_high FROM c""")
def confusion_wilson_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as predictor of the toxic label, by language and overall."""
    hit = document_findings(spark, sf_dir).select("doc_id").distinct().withColumn("predicted", F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").join(hit, "doc_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    return evaluate.confusion(rows, "toxic", "predicted", "lang")


@query(f"""WITH {FOUND}, h AS (SELECT DISTINCT doc_id FROM findings), r AS (SELECT d.source AS cohort, l.doc_id IS NOT NULL AS m, h.doc_id IS NOT NULL AS f FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN h USING (doc_id)),
c AS (SELECT cohort, count(*) AS targets, count(*) FILTER (m) AS measured, count(*) FILTER (m AND f) AS flagged FROM r GROUP BY 1)
SELECT *, CASE WHEN targets > 0 THEN round(measured / targets, 4) ELSE 0.0 END AS measured_rate, CASE WHEN measured > 0 THEN round(flagged / measured, 4) ELSE 0.0 END AS flagged_rate FROM c""")
def cohort_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up by source from two partial reports."""
    hit = document_findings(spark, sf_dir).select("doc_id").distinct().withColumn("f", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("m")), "doc_id", "left").join(hit, "doc_id", "left")
    m, f = F.coalesce("m", F.lit(False)), F.coalesce("f", F.lit(False))
    halves = [evaluate.cohort_rollup(rows.filter(F.col("doc_id") % 2 == k), "source", m, f) for k in (0, 1)]
    return evaluate.merge_rollups(halves[0].unionByName(halves[1]))


@query("""WITH v AS (SELECT doc_id, quality AS vote FROM labels UNION ALL SELECT doc_id, toxic FROM labels UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE quality END FROM labels WHERE doc_id % 10 <> 0),
p AS (SELECT doc_id, vote, count(*) AS n FROM v GROUP BY 1, 2), t AS (SELECT doc_id, arg_max(vote, n) AS verdict, max(n) AS best, sum(n)::BIGINT AS votes FROM p GROUP BY 1)
SELECT doc_id, CASE WHEN votes <> 3 OR best = 1 THEN 'inconclusive' WHEN best = 3 THEN 'unanimous' ELSE 'majority' END AS agreement, CASE WHEN votes <> 3 OR best = 1 THEN 'inconclusive' ELSE verdict::VARCHAR END AS verdict, votes FROM t""")
def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three votes of each labelled document."""
    labels = table(spark, sf_dir, "labels")
    third = F.when(F.col("doc_id") % 3 == 0, 2).otherwise(F.col("quality"))
    votes = labels.select("doc_id", F.col("quality").alias("vote")).unionByName(labels.select("doc_id", F.col("toxic").alias("vote"))).unionByName(labels.filter("doc_id % 10 != 0").select("doc_id", third.alias("vote")))
    return evaluate.consensus(votes, "doc_id", "vote")


@query(f"""WITH {FOUND}, rev(target_id, rule_id, verdict) AS (VALUES ('src0', 'PII_EMAIL', 'true_positive'), ('src1', 'PII_IP_ADDRESS', 'false_positive'), ('*', 'PII_EMAIL', 'benign'))
SELECT f.doc_id, f.line_start, f.rule_id, coalesce(a.verdict, b.verdict, 'unreviewed') AS verdict FROM findings f LEFT JOIN rev a ON a.target_id = f.cohort AND a.rule_id = f.rule_id LEFT JOIN rev b ON b.target_id = '*' AND b.rule_id = f.rule_id""")
def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict by target and rule, then by rule, then the default."""
    reviews = spark.createDataFrame([("src0", "PII_EMAIL", "true_positive"), ("src1", "PII_IP_ADDRESS", "false_positive"), ("*", "PII_EMAIL", "benign")], "target_id string, rule_id string, verdict string")
    found = document_findings(spark, sf_dir).select("doc_id", "line_start", "rule_id", F.col("cohort").alias("target_id"))
    return evaluate.review_lookup(found, reviews).select("doc_id", "line_start", "rule_id", "verdict")


@query(f"""WITH {FOUND}, k AS (SELECT doc_id AS case_id, source AS target_id, source || '/' || doc_id::VARCHAR || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 3 THEN '.yaml' ELSE '.txt' END AS case_file, 1 AS case_start, 4 AS case_end FROM documents)
SELECT k.case_id, f.rule_id, f.line_start FROM k JOIN findings f ON f.cohort = k.target_id AND (f.file = k.case_file OR ends_with(f.file, '/' || k.case_file)) AND f.line_start BETWEEN 1 AND 4""")
def case_scope_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings within cases: path suffix and overlapping lines."""
    turn = F.col("doc_id") % 4
    suffix = F.when(turn == 0, ".py").when(turn == 3, ".yaml").otherwise(".txt")
    cases = documents(spark, sf_dir).select(F.col("doc_id").alias("case_id"), F.lit("app").alias("app_id"), F.col("source").alias("target_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("case_file"), F.lit(1).alias("case_start"), F.lit(4).alias("case_end"))
    found = document_findings(spark, sf_dir).select(F.lit("app").alias("app_id"), F.col("cohort").alias("target_id"), "file", "rule_id", "line_start", F.col("line_start").alias("line_end"))
    return evaluate.in_case_scope(cases, found).select("case_id", "rule_id", "line_start")


@query(f"""WITH {FOUND}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_start, rule_id, evidence) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM findings)
SELECT l.doc_id AS case_id, n.rule_id AS first_rule, greatest(coalesce(n.c, 0) - 1, 0) AS extras FROM labels l LEFT JOIN n ON n.doc_id = l.doc_id AND n.k = 1""")
def first_case_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled case with its first finding and the number of extras."""
    cases = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"))
    found = document_findings(spark, sf_dir).select(F.col("doc_id").alias("case_id"), F.col("rule_id").alias("first_rule"), F.struct("line_start", "rule_id", "evidence").alias("pos"))
    return evaluate.first_match(cases, found, ["case_id"], "pos").select("case_id", "first_rule", "extras")


@query(f"""WITH {FOUND}, r(app_id, target_id, split, lo, hi) AS (VALUES ('a', 'src0', 'development', 0, 500), ('a', 'src0', 'holdout', 400, 1000), ('a', 'src1', 'holdout', 0, 1000000)),
m AS (SELECT f.evidence AS k, r.split FROM findings f JOIN r ON f.cohort = r.target_id AND f.doc_id BETWEEN r.lo AND r.hi), p AS (SELECT k, count(DISTINCT split) AS n, min(split) AS s FROM m GROUP BY 1)
SELECT f.k AS finding, CASE WHEN n IS NULL THEN 'unassigned' WHEN n > 1 THEN 'ambiguous' ELSE s END AS binding FROM (SELECT DISTINCT evidence AS k FROM findings) f LEFT JOIN p USING (k)""")
def split_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in one split, several, or none."""
    ranges = spark.createDataFrame([("src0", "development", 0, 500), ("src0", "holdout", 400, 1000), ("src1", "holdout", 0, 1_000_000)], "cohort string, split string, lo long, hi long")
    found = document_findings(spark, sf_dir).select("cohort", "doc_id", F.col("evidence").alias("finding"))
    matches = found.join(ranges, "cohort").filter(F.col("doc_id").between(F.col("lo"), F.col("hi"))).select("finding", "split")
    return evaluate.split_binding(matches, found, "finding")


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def nearest_rank_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


# --- selection --------------------------------------------------------------------------------------------
@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(encode('seed-1') || unhex('00') || encode(doc_id::VARCHAR)), doc_id) AS position FROM documents)
SELECT doc_id, lang, position::INT AS position, position <= 20 AS selected, CASE WHEN position > 20 THEN (position - 20)::INT END AS reserve_position FROM r WHERE position <= 25""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed sample of each language with reserves."""
    return select.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "seed-1", 20, 5)


@query("""WITH RECURSIVE t AS (SELECT doc_id AS item, sha256(text) AS token FROM documents UNION SELECT doc_id, sha256(unnest(string_split(text, chr(10)))) FROM documents),
big AS (SELECT item, token FROM t), h AS (SELECT token, min(item) AS hub FROM big GROUP BY 1), e AS (SELECT DISTINCT item AS a, hub AS b FROM big JOIN h USING (token) WHERE item <> hub),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT doc_id AS item, doc_id AS label FROM documents UNION SELECT s.b, w.label FROM walk w JOIN s ON s.a = w.item WHERE w.label < s.b)
SELECT item, min(label) AS cluster FROM walk GROUP BY 1""")
def lineage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: documents that share their text or a line, in chains."""
    docs = documents(spark, sf_dir)
    whole = docs.select(F.col("doc_id").alias("item"), F.sha2("text", 256).alias("token"))
    per_line = docs.select(F.col("doc_id").alias("item"), F.explode(F.split("text", "\n", -1)).alias("line")).select("item", F.sha2("line", 256).alias("token"))
    return select.token_clusters(whole.unionByName(per_line))


@query("SELECT d.doc_id, array_to_string(list_filter([CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' END, CASE WHEN d.doc_id % 9 = 0 THEN 'prior' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents d LEFT JOIN labels l USING (doc_id)")
def exclusion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that hold a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    out = select.exclusion_reasons(docs, {"labelled": table(spark, sf_dir, "labels").select("doc_id"), "prior": docs.filter("doc_id % 9 = 0")}, "doc_id")
    return out.withColumn("reasons", F.array_join("reasons", ","))


# --- access, chains, responses --------------------------------------------------------------------------
@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id::VARCHAR || '|' || event_type || '|' || coalesce(props, '') AS payload FROM events),
h AS (SELECT *, sha256(seq::VARCHAR || '|' || payload) AS entry FROM e),
c AS (SELECT user_id, seq, entry, coalesce(lag(entry) OVER (PARTITION BY user_id ORDER BY seq), repeat('0', 64)) AS prev, CASE WHEN user_id % 10 = 0 AND seq = 3 THEN payload || 'x' ELSE payload END AS p FROM h),
t AS (SELECT * FROM c WHERE NOT (user_id % 10 = 1 AND seq = 2)),
g AS (SELECT *, seq <> coalesce(lag(seq) OVER w, 0) + 1 OR prev <> coalesce(lag(entry) OVER w, repeat('0', 64)) OR entry <> sha256(seq::VARCHAR || '|' || p) AS bad FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, count(*) AS entries, count(*) FILTER (bad) AS faults, min(seq) FILTER (bad) AS first_fault FROM g GROUP BY 1""")
def hash_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, SNK5: chains of events by user, some with a changed entry or a missing one."""
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.coalesce("props", F.lit("")))
    e = table(spark, sf_dir, "events").withColumn("payload", payload).withColumn("ord", F.struct("ts", "event_id"))
    chain = access.chain_entries(e, "user_id", "ord", F.col("payload"))
    changed = F.when((F.col("user_id") % 10 == 0) & (F.col("sequence") == 3), F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))
    tampered = chain.withColumn("payload", changed).filter(~((F.col("user_id") % 10 == 1) & (F.col("sequence") == 2)))
    return access.verify_chain(tampered, "user_id", F.col("payload"))


PAGE_COUNTS = f"""SELECT page_id, len(regexp_extract_all(f, '{EMAIL_RE}')) AS email, len(list_filter(regexp_extract_all(f, '{IP_RE}'), lambda v: list_bool_and(list_transform(string_split(v, '.'), lambda x: x::INT <= 255)))) AS records FROM (SELECT page_id, regexp_replace(html, '[^\\x00-\\x7F]', 'x', 'g') AS f FROM pages)"""


@query(f"SELECT page_id, email::INT AS email, records::INT AS records, CASE WHEN email >= 8 OR records >= 12 THEN 'bulk_records' WHEN email >= 3 THEN 'contact_cluster' ELSE 'none' END AS tier FROM ({PAGE_COUNTS})")
def response_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-HTTP2: tiers of pages read as bodies of plain responses."""
    f = ascii_folded(F.col("html"))
    ips = F.filter(F.regexp_extract_all(f, F.lit(pii.IPV4), F.lit(0)), S.valid_ipv4)
    counts = table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all(f, F.lit(pii.RULES[0].pattern), F.lit(0))).alias("email"), F.size(ips).alias("records"), F.lit(0).alias("strong"), F.lit(0).alias("person"), F.lit(0).alias("phone"))
    return access.response_tier(counts, F.lit(False)).select("page_id", "email", "records", "tier")


SCHEMAS = ("customer", "orders", "lineitem", "supplier", "part", "nation", "region", "events", "documents")


@query(f"""SELECT table_name, column_name, lower(regexp_extract(column_name, '{access.SENSITIVE_COLUMN}', 1)) AS matched FROM duckdb_columns() WHERE NOT internal AND table_name IN {SCHEMAS} AND regexp_matches(column_name, '{access.SENSITIVE_COLUMN}')""")
def sensitive_schema_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9, J17: columns of the tables whose names look personal."""
    rows = [(t, c) for t in SCHEMAS for c in table(spark, sf_dir, t).columns]
    return access.sensitive_columns(spark.createDataFrame(rows, "table_name string, column_name string"))


@query("""WITH a AS (SELECT user_id AS session, event_id // 7 AS id, count(*) AS requests, min(event_id) AS rs FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id AS session, event_id // 7 AS id, count(*) AS responses, min(event_id) AS ps FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.session, b.session) AS session, coalesce(a.id, b.id) AS id, coalesce(requests, 0) AS requests, coalesce(responses, 0) AS responses,
  CASE WHEN requests IS NULL THEN 'uncorrelated_response' WHEN responses IS NULL THEN 'missing_response' WHEN requests > 1 OR responses > 1 THEN 'duplicate_id' WHEN ps < rs THEN 'uncorrelated_response' ELSE 'correlated' END AS state FROM a FULL JOIN b ON a.session = b.session AND a.id = b.id""")
def lifecycle_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events as requests, odd ones as responses."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 7).cast("long").alias("id"), F.col("event_id").alias("seq"))
    return access.lifecycle(e.filter("seq % 2 = 0"), e.filter("seq % 2 = 1"))


@query("""WITH r AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '[0-9]+$', '') AS path, page_id % 2 = 1 AS auth, md5(html) AS h, len(html) % 2 = 0 AS private FROM pages),
l AS (SELECT path, auth, arg_max(h, page_id) AS h, arg_max(private, page_id) AS p FROM r GROUP BY 1, 2)
SELECT a.path, CASE WHEN a.p AND b.p THEN 'through_wall' ELSE 'newly_revealed' END AS kind FROM l a JOIN l b ON a.path = b.path AND NOT a.auth AND b.auth WHERE (a.p AND b.p) OR (NOT a.p AND b.p AND a.h <> b.h)""")
def through_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages seen with and without a session, by path."""
    path = F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1), "[0-9]+$", "")
    rows = table(spark, sf_dir, "pages").select(path.alias("path"), F.lit("GET").alias("method"), (F.col("page_id") % 2 == 1).alias("authenticated"), F.md5("html").alias("body_sha256"), (F.length("html") % 2 == 0).alias("private"), F.col("page_id").alias("seq"))
    return access.through_wall(rows)


@query("""WITH a AS (SELECT source || '/' || doc_id::VARCHAR AS path, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT source || '/' || doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(a.path, b.path) AS path, a.h AS before_sha256, b.h AS after_sha256, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trees of documents."""
    path, docs = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), documents(spark, sf_dir)
    before = docs.filter("doc_id % 3 != 0").select(path.alias("path"), F.sha2("text", 256).alias("sha256"))
    after = docs.filter("doc_id % 4 != 0").select(path.alias("path"), F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    return access.tree_diff(before, after)


@query(f"WITH {LINES}, s AS (SELECT source, bool_or(contains(line, '@')) AS sig, bool_or(regexp_matches(line, 'License|license')) AS lic, bool_or(contains(line, 'retention')) AS ret FROM lines GROUP BY 1) SELECT source, 'license' AS missing FROM s WHERE sig AND NOT lic UNION ALL SELECT source, 'retention' FROM s WHERE sig AND NOT ret")
def retention_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16, GV2, GV3: sources with contact data and no marker."""
    return access.marker_gaps(lines(documents(spark, sf_dir)), "source", "@", {"license": "License|license", "retention": "retention"})


@query("""WITH c AS (SELECT doc_id AS k, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents), p AS (SELECT k, b, count(*) AS c FROM c GROUP BY 1, 2), q AS (SELECT k, c, c / sum(c) OVER (PARTITION BY k) AS p FROM p)
SELECT k AS doc_id, sum(c)::BIGINT AS n_bytes, round(sum(c) * sum(-p * log2(p)), 6) AS bits FROM q GROUP BY 1""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte entropy of every document."""
    return evaluate.byte_entropy(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("v")), "doc_id", "v")
