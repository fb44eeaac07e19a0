"""Declared personal fields, their controls and gaps."""

import pytest

from auditframe.operators import governance as g

CASES = {
    "bare": ("class A:\n    rrn = Column(String)\n", [(2, "rrn", "unique_identifier", False, False, False)]),
    "named": ("rrn: string\nencrypt(rrn)\nauthorize(user, 'x', RRN)\naudit_log(rrn)\n", [(1, "rrn", "unique_identifier", True, True, True)]),
    "strings": ("rrn: string\nlog('encrypt rrn')\n// encrypt(rrn)\n# encrypt(rrn)\n/* encrypt(rrn)\n encrypt(rrn) */ \n", [(1, "rrn", "unique_identifier", False, False, False)]),
    "decorator": ("@Encrypted\n@Other\npassport_no: string\n\ndiagnosis: string\n", [(3, "passport_no", "unique_identifier", True, False, False), (5, "diagnosis", "sensitive_information", False, False, False)]),
    "linked": ("// 본인인증\nverify(identity_verification)\n\nci: string\n", [(4, "ci", "high_impact_service_identifier", False, False, False)]),
    "alone": ("ci: string\n", []),
    "other": ("encrypt(passport_no)\nrrn: string\n", [(2, "rrn", "unique_identifier", False, False, False)]),
    "korean": ('"주민등록번호": "x"\n암호화(주민등록번호)\n', [(1, "주민등록번호", "unique_identifier", True, False, False)]),
    "block": ("/* a\n b */ rrn: string\nurl = 'http://x' // rrn: string\n", [(2, "rrn", "unique_identifier", False, False, False)]),
    "empty": ("", []),
}


@pytest.fixture(scope="module")
def states(spark):
    files = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()] + [("null", None)], "file string, text string")
    lines = g.code_lines(files, ["file"])
    return lines, g.control_states(g.declared_fields(lines, ["file"]), lines, ["file"]).cache()


@pytest.mark.parametrize("name", CASES)
def test_states(states, name):
    rows = states[1].filter(f"file = '{name}'").collect()
    assert sorted((r.line_no, r.name, r.category, r.encryption, r.access_control, r.access_audit) for r in rows) == CASES[name][1]


def test_gaps_and_review(spark, states):
    gaps = {(r.file, r.rule_id): (r.n_fields, r.first_line) for r in g.governance_gaps(states[1], ["file"]).collect()}
    assert gaps["bare", "KR_DATA_UNIQUE_IDENTIFIER_CONTROL_GAP"] == (1, 2) and gaps["decorator", "KR_DATA_ACCESS_LOG_EVIDENCE_MISSING"] == (2, 3) and gaps["decorator", "KR_DATA_SENSITIVE_INFORMATION_CONTROL_GAP"] == (1, 5)
    assert ("linked", "KR_DATA_LINKABLE_IDENTIFIER_CONTROL_GAP") in gaps and not any(f == "named" for f, _ in gaps)
    findings = spark.createDataFrame([("bare", "AST_TAINT_PII_TO_EXTERNAL_HTTP"), ("alone", "AST_TAINT_PII_TO_EXTERNAL_HTTP"), ("named", "PII_EMAIL"), ("x", "PII_EMAIL"), ("x", "EXTERNAL_SINK"), ("y", "PII_EMAIL"), ("y", "EXTERNAL_SINK")], "file string, rule_id string")
    lines = states[0].unionByName(spark.createDataFrame([("y", 1, "our subprocessor")], "file string, line_no int, line string"))
    assert sorted(r.file for r in g.processor_review(states[1], findings, lines, "file").collect()) == ["bare", "x"]
