"""Queries of readers, sinks and column functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions import scalars as S
from auditframe.operators import code, evaluate, findings
from auditframe.plans.catalogue import FOUND, LANE_SQL, document_findings, documents, hmac_sql, query, table
from auditframe.session import scratch_path
from auditframe.sources import readers, sinks


@query("SELECT coalesce(source, 'none') AS source, sum(len(text) - len(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, sum(len(replace(text, chr(10), '')))::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1")
def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 to SRC4: documents written as text files under a folder of each source, found, decoded and cut into lines again."""
    root = scratch_path(spark, "files")
    rows = documents(spark, sf_dir).filter("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), "text")
    rows.write.option("maxRecordsPerFile", 1_000).partitionBy("source").text(root)
    read = readers.decoded(readers.files(spark, root))
    text = F.regexp_replace("text", "\n\\z", "")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    source = F.regexp_extract("path", "/source=([^/]*)/", 1)
    return read.groupBy(source.alias("source")).agg(F.sum(n_lines).cast("long").alias("n_lines"), F.sum(F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("n_chars"))


@query("SELECT s_suppkey, s_nationkey, sha256(s_name) AS name_sha256, '<redacted:EMAIL:' || substr(sha256(concat('u', s_suppkey, '@example.com')), 1, 12) || '>' AS contact FROM supplier")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK7: suppliers as a report of JSON lines, redacted on its way out, read back."""
    path = scratch_path(spark, "report")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.sha2("s_name", 256).alias("name_sha256"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("contact"))
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


_SCALARS_SQL = f"""WITH c AS (SELECT *, lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0') || (c_custkey % 8 + 1)::VARCHAR AS digits FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal / 1000 >= 9 THEN 'critical' WHEN c_acctbal / 1000 >= 7 THEN 'high' WHEN c_acctbal / 1000 >= 4 THEN 'medium' WHEN c_acctbal > 0 THEN 'low' ELSE 'info' END AS bucket,
  CASE WHEN len(c_name) <= 8 THEN repeat('*', len(c_name)) ELSE substr(c_name, 1, 4) || '****' || substr(c_name, -4) END AS masked, lower(replace(c_mktsegment, ' ', '')) AS header, c_custkey % 6 IN (0, 1, 3) AS flag,
  {hmac_sql("c_name || '||' || c_nationkey::VARCHAR")} AS fingerprint, try_strptime(CASE WHEN digits[7] IN ('1', '2', '5', '6') THEN '19' ELSE '20' END || digits[:6], '%Y%m%d') IS NOT NULL AS plausible FROM c"""


@query(_SCALARS_SQL)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, F-MASK2, F-HDR, F-TRUTHY, F-FPR, F-DATE over customers."""
    k = F.col("c_custkey")
    word = F.element_at(F.array(F.lit("Yes"), F.lit(" on "), F.lit("0"), F.lit("TRUE"), F.lit("n"), F.lit(None).cast("string")), (k % 6 + 1).cast("int"))
    digits = F.concat(F.lpad((k * 7919 % 1_000_000).cast("string"), 6, "0"), (k % 8 + 1).cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.severity_bucket(F.col("c_acctbal") / 1000).alias("bucket"), S.mask_secret(F.col("c_name")).alias("masked"), S.header_label(F.concat(F.lit("﻿ "), "c_mktsegment", F.lit("\t"))).alias("header"),
        S.truthy(word).alias("flag"), S.finding_fingerprint(F.col("c_name"), F.lit(None), F.col("c_nationkey")).alias("fingerprint"), S.plausible_birthdate(digits).alias("plausible"),
    )


@query(f"WITH {FOUND}, p AS (SELECT rule_id, confidence = 'high' AS legacy, {LANE_SQL} <> 'supporting_review' AS now FROM findings) SELECT rule_id, count(*) FILTER (legacy) AS legacy, count(*) FILTER (now) AS held, count(*) FILTER (legacy AND NOT now) AS lost, count(*) FILTER (now AND NOT legacy) AS added, count(*) FILTER (legacy AND NOT now) = 0 AS kept_all FROM p GROUP BY 1")
def policy_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rule, findings that an older policy held (those of high confidence) against those that the lanes hold: lost and added ones."""
    rows = document_findings(spark, sf_dir)
    return findings.policy_projection(rows, F.col("confidence") == "high", findings.release_lane() != "supporting_review")


@query(f"WITH {FOUND} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, file, line_start, rule_id, evidence, doc_id) AS place, doc_id, rule_id, evidence FROM findings QUALIFY place <= 200")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 findings of a report in its order."""
    first = findings.first_ordered(document_findings(spark, sf_dir), 200, "doc_id")
    return first.select("place", "doc_id", "rule_id", "evidence")


@query("WITH s AS (SELECT o_orderpriority AS kind, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS recall, round(count(*) FILTER (o_orderkey % 4 = 0) / count(*), 4) AS fpr FROM orders GROUP BY 1) SELECT kind, recall, fpr, round(recall - fpr, 6) AS score FROM s")
def benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True positive rate less false positive rate by kind of case."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(S.rate(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("recall"), S.rate(F.count_if(F.col("o_orderkey") % 4 == 0), F.count("*")).alias("fpr"))
    return evaluate.owasp_score(rows)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def last_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user as its verdict."""
    return evaluate.last_review(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("SELECT DISTINCT concat(o_custkey, '.py:', o_orderkey % 5, ':request') AS source, concat(o_custkey, '.py:', o_orderkey % 7, ':', o_orderstatus) AS target, o_orderpriority AS label FROM orders")
def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flows within their customer's file, each edge of the graph once."""
    flows = table(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(".py")).alias("path"), F.lit("request").alias("source_kind"), (F.col("o_orderkey") % 5).alias("source_line"), F.col("o_orderstatus").alias("sink_kind"), (F.col("o_orderkey") % 7).alias("sink_line"), F.col("o_orderpriority").alias("rule_id"))
    return code.flow_graph(flows)[1]


@query(f"""WITH {FOUND} SELECT concat('{{"ruleId":"', rule_id, '","level":"', CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END, '","locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"', file, '"}},"region":{{"startLine":', greatest(line_start, 1), '}}}}}}],"partialFingerprints":{{"findingHash":"', substr(sha256(concat(rule_id, '|', file, '|', line_start, '|', evidence)), 1, 16), '"}}}}') AS result FROM findings""")
def sarif_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, P11: one SARIF result for each finding."""
    return sinks.sarif_results(document_findings(spark, sf_dir))
