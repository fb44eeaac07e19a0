"""Payloads of dependency audits (D-SCA): Python, npm (both forms, with a lock) and Go streams to findings, failing closed.

A payload's entries become rows; installed versions that a payload leaves to a lock are joined in. One entry
that does not fit its form makes the whole audit an error: it gives no finding, and a status that says why.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions import scalars as S
from auditframe.session import ship

# Forms of ids, words of severity, message kinds of a Go stream.
_ID = re.compile(r"[A-Z0-9][A-Z0-9._:+-]{0,127}")
_CANONICAL = re.compile(r"(?:CVE|PYSEC|GO|RUSTSEC)-\d{4}-\d+|GHSA-[23456789CFGHJMPQRVWX]{4}-[23456789CFGHJMPQRVWX]{4}-[23456789CFGHJMPQRVWX]{4}|NPM-(?:\d+|[A-F0-9]{16})|VULN-[A-F0-9]{16}")
_IN_URL = re.compile(r"GHSA(?:-[23456789cfghjmpqrvwx]{4}){3}|CVE-\d{4}-\d+", re.I)
_WORDS = {"critical": "critical", "high": "high", "moderate": "medium", "medium": "medium", "low": "low", "info": "low", "informational": "low"}
_GO_KINDS = {"config", "progress", "SBOM", "osv", "finding"}
_GO_PROTOCOL = "v1.0.0"
# End of the fixed values.
MAX_RESULTS = 10_000


class Refused(ValueError):
    """A payload that does not fit: its message is the status."""


def vulnerability_id(value: object, prefix: str = "") -> str:
    """The normal form of an id, a hash of an unknown form, or nothing."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        return ""
    text = str(value).strip().upper()
    if prefix and text.isdigit():
        text = prefix + text
    if not _ID.fullmatch(text):
        return ""
    return text if _CANONICAL.fullmatch(text) else "VULN-" + hashlib.sha256(text.encode()).hexdigest()[:16].upper()


def severity_word(value: object) -> str:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return "critical" if value >= 9 else "high" if value >= 7 else "medium" if value >= 4 else "low" if value > 0 else "unknown"
    return _WORDS.get(value.strip().lower(), "unknown") if isinstance(value, str) else "unknown"


def _need(ok: bool, status: str = "schema") -> None:
    if not ok:
        raise Refused(status)


def _python(payload: object) -> list[dict]:
    _need(isinstance(payload, dict) and not payload.get("error") and isinstance(payload.get("dependencies"), list))
    out = []
    for d in payload["dependencies"]:
        _need(isinstance(d, dict) and all(isinstance(d.get(k), str) and d[k].strip() for k in ("name", "version")) and isinstance(d.get("vulns"), list))
        for v in d["vulns"]:
            _need(isinstance(v, dict) and isinstance(v.get("fix_versions", []), list))
            aliases = v.get("aliases") if isinstance(v.get("aliases"), list) else []
            ident = next((i for x in [v.get("id"), *aliases] if (i := vulnerability_id(x))), "")
            _need(bool(ident))
            own = v.get("severity")
            if own is None and isinstance(v.get("database_specific"), dict):
                own = v["database_specific"].get("severity")
            out.append({"package": re.sub(r"[-_.]+", "-", d["name"].strip().lower()), "versions": [d["version"]], "nodes": [], "id": ident, "severity": severity_word(own), "fixed": bool(v.get("fix_versions"))})
    return out


def _npm_id(row: dict, fallback: str) -> str:
    cves = row.get("cves") if isinstance(row.get("cves"), list) else []
    for value in (row.get("id"), row.get("cve")):
        if ident := vulnerability_id(value, "NPM-"):
            return ident
    for value in cves:
        if ident := vulnerability_id(value):
            return ident
    if isinstance(row.get("url"), str) and (m := _IN_URL.search(row["url"])):
        return m[0].upper()
    return vulnerability_id(row.get("source"), "NPM-") or "NPM-" + hashlib.sha256(fallback.encode()).hexdigest()[:16].upper()


def _npm(payload: object) -> list[dict]:
    _need(isinstance(payload, dict) and not payload.get("error"))
    out = []
    if payload.get("vulnerabilities") is not None:
        _need(isinstance(payload["vulnerabilities"], dict))
        for key, row in sorted(payload["vulnerabilities"].items()):
            _need(isinstance(row, dict) and isinstance(row.get("via", []), list))
            package = row.get("name", key)
            _need(isinstance(package, str) and bool(package.strip()))
            nodes = [n.replace("\\", "/").strip("/") for n in row.get("nodes") or [] if isinstance(n, str)]
            direct = [row["version"]] if isinstance(row.get("version"), str) and row["version"] else []
            for i, advisory in enumerate([x for x in row.get("via", []) if isinstance(x, dict)] or [row]):
                out.append({"package": package.lower(), "versions": direct, "nodes": nodes, "id": _npm_id(advisory, f"{package}:{i}"), "severity": severity_word(advisory.get("severity", row.get("severity"))), "fixed": bool(row.get("fixAvailable"))})
        return out
    _need(isinstance(payload.get("advisories"), dict))
    for key, row in sorted(payload["advisories"].items()):
        _need(isinstance(row, dict) and isinstance(row.get("module_name"), str) and bool(row["module_name"]))
        found = row.get("findings") if isinstance(row.get("findings"), list) else []
        versions = sorted({f["version"] for f in found if isinstance(f, dict) and isinstance(f.get("version"), str) and f["version"]})
        patched = row.get("patched_versions")
        fixed = isinstance(patched, str) and patched.strip() not in ("", "<0.0.0", "<0.0.0-0")
        out.append({"package": row["module_name"].lower(), "versions": versions, "nodes": ["*"], "id": _npm_id(row, key), "severity": severity_word(row.get("severity")), "fixed": fixed})
    return out


def _go(text: str) -> list[dict]:
    decoder, at, rows = json.JSONDecoder(), 0, []
    while (at := len(text) - len(text[at:].lstrip())) < len(text):
        try:
            row, at = decoder.raw_decode(text, at)
        except ValueError as e:
            raise Refused("malformed") from e
        _need(isinstance(row, dict))
        rows.append(row)
    _need(bool(rows), "malformed")
    first = rows[0].get("config")
    _need(isinstance(first, dict) and first.get("protocol_version") == _GO_PROTOCOL)
    severities: dict[str, str] = {}
    for i, row in enumerate(rows):
        _need(set(row) <= _GO_KINDS and sum(v is not None for v in row.values()) == 1 and ("config" not in row or i == 0))
        osv = row.get("osv")
        if isinstance(osv, dict) and (ident := vulnerability_id(osv.get("id"))):
            specific = osv.get("database_specific")
            severities[ident] = severity_word(specific.get("severity") if isinstance(specific, dict) else None)
    out = []
    for finding in (r["finding"] for r in rows if isinstance(r.get("finding"), dict)):
        ident = vulnerability_id(finding.get("osv"))
        trace = finding.get("trace", [])
        _need(bool(ident) and isinstance(trace, list))
        frame = next((f for f in trace if isinstance(f, dict) and all(isinstance(f.get(k), str) and f[k] for k in ("module", "version"))), None)
        _need(frame is not None)
        fixed = finding.get("fixed_version")
        out.append({"package": frame["module"], "versions": [frame["version"]], "nodes": [], "id": ident, "severity": severities.get(ident, "unknown"), "fixed": isinstance(fixed, str) and bool(fixed.strip())})
    return out


def parse_audit(ecosystem: str, text: str) -> dict:
    """status ("" if it fits) and entries of one payload."""
    try:
        if ecosystem == "go":
            entries = _go(text.removeprefix("﻿"))
        else:
            try:
                payload = json.loads(text)
            except ValueError as e:
                raise Refused("malformed") from e
            _need(ecosystem in ("python", "npm"), "unknown_ecosystem")
            entries = _python(payload) if ecosystem == "python" else _npm(payload)
        _need(len(entries) <= MAX_RESULTS, "limit")
    except Refused as e:
        return {"status": str(e), "entries": []}
    except RecursionError:
        return {"status": "malformed", "entries": []}
    return {"status": "", "entries": entries}


def parse_lock(text: str) -> list[dict]:
    """(name, node, version) of an npm lock; a text that is none gives nothing."""
    try:
        lock = json.loads(text)
    except (ValueError, RecursionError):
        return []
    if not isinstance(lock, dict):
        return []
    out = []
    packages, dependencies = lock.get("packages"), lock.get("dependencies")
    for node, row in (packages.items() if isinstance(packages, dict) else ()):
        if isinstance(row, dict) and isinstance(row.get("version"), str) and row["version"]:
            place = node.replace("\\", "/").strip("/")
            name = row["name"] if isinstance(row.get("name"), str) and row["name"] else place.rsplit("node_modules/", 1)[-1] if "node_modules/" in place else ""
            out.append({"name": name.lower(), "node": place, "version": row["version"]})
    for name, row in (dependencies.items() if isinstance(dependencies, dict) else ()):
        if isinstance(row, dict) and isinstance(row.get("version"), str) and row["version"]:
            out.append({"name": name.lower(), "node": "", "version": row["version"]})
    return out


_ENTRY = "struct<package:string,versions:array<string>,nodes:array<string>,id:string,severity:string,fixed:boolean>"


def audit_findings(audits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and statuses of audits (audit_id, ecosystem, payload, lock; ids unique).

    Findings: audit_id, ecosystem, package, version, vulnerability_id, severity, fixed, fingerprint, each fingerprint of an audit once.
    Statuses: audit_id, ecosystem, status (``ok``, or why the audit gives no finding), n_findings.
    """
    ship(audits.sparkSession)

    @F.pandas_udf(f"struct<status:string,entries:array<{_ENTRY}>>")
    def parsed(ecosystems: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [parse_audit(e or "", t or "") for e, t in zip(ecosystems, texts, strict=True)]
        return pd.DataFrame({"status": [f["status"] for f in found], "entries": [f["entries"] for f in found]})

    @F.pandas_udf("array<struct<name:string,node:string,version:string>>")
    def locked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parse_lock(t or ""))

    rows = audits.select("audit_id", F.lower("ecosystem").alias("ecosystem"), parsed(F.lower("ecosystem"), F.col("payload")).alias("p")).select("audit_id", "ecosystem", "p.*")
    entries = rows.filter("status = ''").select("audit_id", "ecosystem", F.posexplode("entries").alias("n", "e")).select("audit_id", "ecosystem", "n", "e.*")
    lock = audits.filter("lower(ecosystem) = 'npm'").select("audit_id", F.explode(locked("lock")).alias("l")).select("audit_id", "l.*")
    by_node = lock.filter("node != ''").select("audit_id", "node", F.col("version").alias("at_node"))
    by_name = lock.filter("name != ''").select("audit_id", F.col("name").alias("package"), F.col("version").alias("by_name")).distinct()
    nodes = entries.select("audit_id", "n", F.explode("nodes").alias("node")).join(by_node, ["audit_id", "node"]).groupBy("audit_id", "n").agg(F.collect_set("at_node").alias("at_nodes"))
    names = by_name.groupBy("audit_id", "package").agg(F.collect_set("by_name").alias("named"))
    joined = entries.join(nodes, ["audit_id", "n"], "left").join(names, ["audit_id", "package"], "left")
    none = F.array().cast("array<string>")
    direct = F.array_union("versions", F.coalesce("at_nodes", none))
    # The older npm form adds the lock's versions of a name to its own; elsewhere they stand in for missing ones.
    every = F.when(F.array_contains("nodes", "*"), F.array_union("versions", F.coalesce("named", none))).when(F.size(direct) > 0, direct).otherwise(F.coalesce("named", none))
    versioned = joined.withColumn("all_versions", every)
    refused = versioned.filter(F.size("all_versions") == 0).select("audit_id").distinct().withColumn("refused", F.lit(True))
    fine = versioned.join(refused.drop("refused"), "audit_id", "left_anti").withColumn("version", F.explode("all_versions"))
    mark = S.hmac16(F.concat_ws("|", "ecosystem", "package", "version", F.col("id"), "severity", F.col("fixed").cast("string")))
    findings = fine.select("audit_id", "ecosystem", "package", "version", F.col("id").alias("vulnerability_id"), "severity", "fixed", mark.alias("fingerprint")).dropDuplicates(["audit_id", "fingerprint"])
    counted = findings.groupBy("audit_id").agg(F.count("*").alias("n_findings"))
    status = F.when(F.col("status") != "", F.col("status")).when(F.col("refused"), "schema").otherwise("ok")
    statuses = rows.join(refused, "audit_id", "left").join(counted, "audit_id", "left").select("audit_id", "ecosystem", status.alias("status"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
    return findings, statuses
