import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from auditframe.functions import scalars as S
from auditframe.operators import findings, pii

LINES = {
    "rrn=840229-1000001": [("PII_RRN_VALID", "critical", "high")],
    "rrn=850229-1000008": [],
    "주민번호 900101-1234567": [("PII_RRN", "high", "high")],
    "x 900101-1234567": [("PII_RRN", "medium", "low")],
    "000229-3000001": [("PII_RRN_VALID", "critical", "high")],
    "900101-5000007": [("PII_FRN_VALID", "critical", "high")],
    "사업자등록번호: 123-45-67891": [("KR_ORG_BUSINESS_REGISTRATION", "medium", "high")],
    "사업자등록번호: 123-45-67892": [],
    "119999-1234560": [("KR_ORG_CORPORATE_REGISTRATION", "medium", "high")],
    "법인등록번호 840229-1000001": [("PII_RRN_VALID", "critical", "high")],
    "card 4111 1111 1111 1111": [("PII_CREDIT_CARD", "critical", "high")],
    "4111111111111111": [],
    "계좌 110-234-567890": [("PII_BANK_ACCOUNT", "high", "low")],
    "서버 장애 발생": [],
    "장애 등급: 2급": [("PII_SENSITIVE_INFO", "medium", "medium")],
    "ip=999.1.1.1": [],
    "ip=10.0.0.1": [("PII_IP_ADDRESS", "low", "medium")],
    "name: 홍길동, phone=010-1234-5678": [("PII_PERSON", "low", "high"), ("PII_PHONE", "medium", "high")],
    "db=postgres://u:p4ss@host/db": [("SECRET_DB_URL", "critical", "high")],
}


def test_lines(spark):
    rows = list(LINES)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {k: [] for k in rows}
    for r in pii.entity_findings(pii.detect_entities(df), F.lit("f")).collect():
        got[rows[r.doc_id]].append((r.rule_id, r.severity, r.confidence))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in LINES.items()}


def test_composites_keep_confidence_in_blocks(spark):
    df = spark.createDataFrame([(1, "name: 홍길동, phone=010-1234-5678"), (2, '{"name": "홍길동",\n"phone": "010-1234-5678"\n}'), (3, 'name: 홍길동\nphone=010-1234-5678')], "doc_id long, text string")
    found = {r.doc_id: (r.rule_id, r.severity, r.confidence) for r in findings.composites(pii.detect_entities(df), ["doc_id"]).collect()}
    assert found == {1: ("KR_COMBO_PERSON_PHONE", "high", "medium"), 2: ("KR_COMBO_PERSON_PHONE", "high", "high")}


def test_csv_cells(spark):
    table = spark.createDataFrame([(1, "홍길동", "010-1234-5678"), (2, "", None)], "id int, name string, `Phone ` string")
    got = {(r.id, r.label) for r in pii.csv_entities(table, {"name": "PERSON", "phone": "PHONE"}, ["id"]).collect()}
    assert got == {(1, "PERSON"), (1, "PHONE")}


def test_empty_and_null_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n")], "doc_id long, text string")
    assert pii.detect_entities(df).count() == 0


def test_synthetic_cards(spark):
    from auditframe.functions.text import lines

    text = "credit_card: 4111 1111 1111 1111\n# synthetic fixture\nexp_year: 2071"
    df = lines(spark.createDataFrame([(1, text), (2, text.replace("2071", "2030"))], "doc_id long, text string"))
    assert [r.doc_id for r in pii.synthetic_card_lines(df, ["doc_id"]).collect()] == [1]


def test_hashes(spark):
    row = spark.range(1).select(S.fp12(F.lit("a@example.com")).alias("a"), S.fp12(F.lit("홍길동")).alias("b"), S.hmac16(F.lit(" v ")).alias("h")).first()
    assert (row.a, row.b) == ("08168cd80dfd", "9c6b9b1b1627")
    assert row.h == hmac.new(S.DEFAULT_KEY.encode(), b"v", hashlib.sha256).hexdigest()[:16]


@pytest.mark.parametrize(("k", "n", "want"), [(9, 10, (0.59585, 0.982124)), (0, 10, (0.0, 0.277533)), (10, 10, (0.722467, 1.0)), (180, 210, (0.80339, 0.898065))])
def test_wilson(spark, k, n, want):
    low, high = S.wilson(F.lit(k), F.lit(n))
    assert tuple(spark.range(1).select(low, high).first()) == pytest.approx(want)


def test_unknown_severity_raises(spark):
    with pytest.raises(Exception, match="unknown value"):
        spark.range(1).select(S.rank(F.lit("severe"))).collect()


def test_claims_are_spans(spark):
    rows = [(1, "사업자등록번호: 123-45-67891 계좌 123-45-67891"), (2, "계좌 123-45-67892"), (3, '"corp_reg":\n"110199-1234567"'), (4, '"corp_reg": 1\n"110199-1234567"'), (5, "법인번호 110111-1234567"), (6, "110199-1234567")]
    got = {}
    for r in pii.detect_entities(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, set()).add((r.label, r.line_no, r.confidence))
    assert got[1] == {("BUSINESS_REGISTRATION", 1, "high")} and got[2] == {("BANK_ACCOUNT", 1, "low")}
    assert got[3] == {("CORPORATE_REGISTRATION", 2, "medium")} and 4 not in got and got[5] == {("RRN", 1, "low")} and 6 not in got


def test_privacy_classes(spark):
    cls, axes = pii.privacy_class(F.col("label"))
    rows = spark.createDataFrame([(x,) for x in ("EMAIL", "CREDIT_CARD", "API_KEY")], "label string").select("label", cls.alias("c"), axes.alias("a")).collect()
    assert [(r.label, r.c is None, list(r.a)) for r in rows] == [("EMAIL", False, ["contact", "linkable_identifier"]), ("CREDIT_CARD", False, ["financial_identifier", "high_impact"]), ("API_KEY", True, [])]
    assert spark.range(1).select(pii.combined_class(F.array(*map(F.lit, ("EMAIL", "EMAIL", "X", "PERSON")))).alias("v")).first().v.count(" + ") == 1


@pytest.mark.parametrize(("line", "sensitive"), [("장애등급: 3급", True), ("서버 장애 발생 12:00", False), ("네트워크 장애 유형", False), ("지문 등록 완료", True), ("브라우저 지문 수집", False), ("다음 지문을 읽고 답하라", False), ("홍채 인식", True), ("종교: 없음", True), ("사상자 3명", False), ("서버 건강상태: 정상", False), ("disability_type: 2", True), ("장애물 회피", False)])
def test_concepts_with_homonyms(spark, line, sensitive):
    labels = {r.label for r in pii.detect_entities(spark.createDataFrame([(1, line)], "doc_id int, text string")).collect()}
    assert ("SENSITIVE_INFO" in labels) == sensitive
