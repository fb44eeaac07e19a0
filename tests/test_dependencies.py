"""Payloads of dependency audits."""

import json

import pytest

from auditframe.operators.dependencies import audit_findings, parse_audit, severity_word, vulnerability_id

GO = '{"config": {"protocol_version": "v1.0.0"}}\n{"osv": {"id": "GO-2024-1", "database_specific": {"severity": "HIGH"}}}\n{"finding": {"osv": "GO-2024-1", "fixed_version": "v1.2", "trace": [{"module": ""}, {"module": "m/x", "version": "v1.1"}]}}'
PYTHON = {"dependencies": [{"name": "My_Pkg.x", "version": "1.0", "vulns": [{"id": "", "aliases": ["?", "cve-2024-1"], "fix_versions": ["1.1"], "database_specific": {"severity": 9.8}}, {"id": "PYSEC-2024-2", "severity": "moderate"}]}, {"name": "clean", "version": "2", "vulns": []}]}
NPM = {"vulnerabilities": {"a": {"nodes": ["node_modules/a"], "via": ["b", {"source": 1234, "severity": "high", "url": "https://x/GHSA-2345-6789-cfgh"}], "fixAvailable": True}, "b": {"via": [], "severity": "low"}}}
LOCK = {"packages": {"": {"name": "root", "version": "0.1"}, "node_modules/a": {"version": "1.0"}, "node_modules/x/node_modules/b": {"version": "3.1"}}, "dependencies": {"b": {"version": "3.0"}}}
OLD = {"advisories": {"77": {"id": 77, "module_name": "B", "severity": "critical", "findings": [{"version": "2.9"}], "patched_versions": "<0.0.0"}}}


def run(spark, *audits):
    rows = [(str(i), e, p if isinstance(p, str) else json.dumps(p), None if lock is None else json.dumps(lock)) for i, (e, p, lock) in enumerate(audits)]
    findings, statuses = audit_findings(spark.createDataFrame(rows, "audit_id string, ecosystem string, payload string, lock string"))
    found = sorted((r.audit_id, r.package, r.version, r.vulnerability_id, r.severity, r.fixed) for r in findings.collect())
    return found, [r.status for r in statuses.orderBy("audit_id").collect()]


def test_all_forms(spark):
    found, statuses = run(spark, ("python", PYTHON, None), ("npm", NPM, LOCK), ("go", GO, None), ("npm", OLD, LOCK), ("npm", NPM, None), ("npm", NPM, {"dependencies": {}}))
    assert statuses == ["ok", "ok", "ok", "ok", "schema", "schema"]
    npm = [r for r in found if r[0] == "1"]
    assert [r for r in found if r[0] == "0"] == [("0", "my-pkg-x", "1.0", "CVE-2024-1", "critical", True), ("0", "my-pkg-x", "1.0", "PYSEC-2024-2", "medium", False)]
    assert npm[0] == ("1", "a", "1.0", "GHSA-2345-6789-CFGH", "high", True) and [r[2] for r in npm[1:]] == ["3.0", "3.1"] and all(r[3].startswith("NPM-") and r[4] == "low" and not r[5] for r in npm[1:])
    assert [r for r in found if r[0] == "2"] == [("2", "m/x", "v1.1", "GO-2024-1", "high", True)]
    assert [(r[2], r[3], r[5]) for r in found if r[0] == "3"] == [("2.9", "NPM-77", False), ("3.0", "NPM-77", False), ("3.1", "NPM-77", False)]


@pytest.mark.parametrize(
    ("ecosystem", "payload", "status"),
    [
        ("python", "{", "malformed"), ("python", "[]", "schema"), ("python", '{"error": "x", "dependencies": []}', "schema"), ("python", '{"dependencies": [{"name": "a", "version": "", "vulns": []}]}', "schema"),
        ("python", '{"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "??"}]}]}', "schema"), ("python", '{"dependencies": []}', ""), ("npm", "{}", "schema"), ("npm", '{"vulnerabilities": {}}', ""),
        ("go", "", "malformed"), ("go", '{"finding": {}}', "schema"), ("go", GO + '{"other": 1}', "schema"), ("go", GO + "{", "malformed"), ("go", GO.replace("v1.0.0", "v2"), "schema"), ("cargo", "{}", "unknown_ecosystem"),
    ],
)
def test_payloads_that_do_not_fit_fail_closed(ecosystem, payload, status):
    assert parse_audit(ecosystem, payload)["status"] == status


def test_words_and_ids():
    assert [severity_word(x) for x in (9.0, 7, 4, 0.1, 0, None, True, " High ", "info", "?")] == ["critical", "high", "medium", "low", "unknown", "unknown", "unknown", "high", "low", "unknown"]
    assert vulnerability_id(12, "NPM-") == "NPM-12" and vulnerability_id("x y") == "" and vulnerability_id("odd:1").startswith("VULN-") and vulnerability_id(True) == ""


def test_no_audits(spark):
    assert run(spark) == ([], [])
