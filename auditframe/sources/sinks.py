"""Sinks: reports as JSON, SARIF, Markdown and SVG; templates."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.operators.redact import sanitize

#: SARIF level by severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def write_json(df: DataFrame, path: str) -> None:
    """SNK1, SNK7: JSON lines after redaction."""
    sanitize(df).write.mode("errorifexists").json(path)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """SNK2: the rule dictionary: worst level and first title of each rule."""
    order = {k: v for v, k in enumerate(("error", "warning", "note"))}
    level = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(order[v]))])[F.col("severity")]
    worst = findings.groupBy("rule_id").agg(F.min(level).alias("n"), F.count("*").alias("results"))
    return worst.select("rule_id", F.element_at(F.array(*map(F.lit, order)), F.col("n") + 1).alias("level"), "results")


def sarif_results(findings: DataFrame) -> DataFrame:
    """SNK2, P11: one SARIF result a row, as JSON."""
    level = F.create_map(*[x for kv in LEVELS.items() for x in map(F.lit, kv)])[F.col("severity")]
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line_start", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    print_ = F.struct(F.substring(F.sha2(F.concat_ws("|", "rule_id", "file", F.col("line_start").cast("string"), "evidence"), 256), 1, 16).alias("findingHash"))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.array(place).alias("locations"), print_.alias("partialFingerprints"))).alias("result"))


def markdown(summary: DataFrame, limit: int = 200) -> str:
    """SNK3: a Markdown table of a small result; more than ``limit`` rows are refused."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report table holds a small result")
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def html_report(summary: DataFrame, title: str, limit: int = 200) -> str:
    """SNK3: the same as HTML, escaped."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report table holds a small result")
    line = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{line('th', summary.columns)}{''.join(line('td', r) for r in rows)}</table>"


def mermaid(edges: DataFrame, limit: int = 200) -> str:
    """SNK3, G4: a flow graph (source, target, label) as Mermaid text."""
    rows = edges.select("source", "target", "label").distinct().orderBy("source", "target", "label").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a drawing holds a small graph")
    names = {n: f"n{k}" for k, n in enumerate(sorted({x for r in rows for x in (r.source, r.target)}))}
    return "\n".join(["flowchart LR", *(f'  {v}["{html.escape(k)}"]' for k, v in names.items()), *(f"  {names[r.source]} -->|{html.escape(r.label)}| {names[r.target]}" for r in rows)])


def write_template(spark, path: str, columns: list[str]) -> None:
    """SNK6: an empty CSV with a header."""
    spark.createDataFrame([], ", ".join(f"{c} string" for c in columns)).coalesce(1).write.mode("errorifexists").csv(path, header=True)
