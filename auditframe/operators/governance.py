"""Protection of personal fields in source code (GV1): declared fields, the controls that stand by them, and the gaps.

Everything is columns and equality joins: declarations and controls are rows of lines, a control meets a field
by the name that both mention in one file, or as a decorator in the two lines above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields by category, marks of controls and of transfers, rules.
UNIQUE = ("rrn", "resident_registration_number", "resident_no", "jumin", "jumin_no", "foreigner_registration_number", "foreigner_no", "passport_number", "passport_no", "driver_license_number", "driver_license_no", "주민등록번호", "외국인등록번호", "여권번호", "운전면허번호")
SERVICE = ("personal_customs_code", "personal_customs_clearance_code", "connecting_info", "duplication_info", "health_insurance_id", "health_insurance_number", "개인통관고유부호", "연계정보", "중복가입확인정보", "건강보험증번호")
AMBIGUOUS = ("ci", "di")
SENSITIVE = (
    "medical_record", "medical_info", "diagnosis", "prescription", "health_condition", "건강상태", "disability", "religion", "race", "ethnicity", "ideology", "belief", "political_opinion", "union_membership", "genetic_data", "biometric_data", "criminal_record", "sexual_life",
    "sexual_orientation", "진료정보", "병력", "진단명", "처방정보", "장애정보", "장애", "종교", "인종", "민족", "사상", "신념", "정치적견해", "노동조합", "유전정보", "생체정보", "지문", "홍채", "범죄경력", "성생활", "성적지향",
)
IDENTITY_CONTEXT = r"(?i)identity[_ -]?(?:verification|proof)|identityprovider|본인\s*인증|실명\s*인증|연계정보|중복가입|\bnice[A-Za-z0-9_.-]*(?:identity|verify|auth)|\bkcb[A-Za-z0-9_.-]*(?:identity|verify|auth)|\bpass[_ -]?auth\b"
ENCRYPTION = r"(?i)encrypt|decrypt|envelope[_ -]?encryption|field[_ -]?encryption|tokeni[sz]e|vault|kms|pgcrypto|fernet|aes[_ -]?(?:gcm|256)|crypto\.subtle|암호화|복호화|토큰화"
ACCESS = r"(?i)authori[sz]e|permission|owner[_ -]?id|tenant[_ -]?id|row[_ -]?level[_ -]?security|\brls\b|access[_ -]?control|scope[_ -]?check|권한\s*확인|접근\s*통제|소유자\s*확인"
AUDIT = r"(?i)audit[_ -]?log|access[_ -]?log|security[_ -]?log|audit[_ -]?trail|접근\s*기록|접속\s*기록|감사\s*로그"
TRANSFER = r"(?i)third[_ -]?party|processor|subprocessor|cross[_ -]?border|overseas[_ -]?transfer|privacy[_ -]?policy|제3자\s*제공|처리\s*위탁|수탁|국외\s*(?:이전|전송)"
EXTERNAL_RULE, PRIVACY_RULE = r"(?i)TO_EXTERNAL|EXTERNAL_HTTP|EXTERNAL_SINK|EXFIL", r"(?i)^PII_|^KR_COMBO_|DYN_RESPONSE_PII|CONNECTOR_.*PII|SENSITIVE"
GAPS = {"unique_identifier": "KR_DATA_UNIQUE_IDENTIFIER_CONTROL_GAP", "high_impact_service_identifier": "KR_DATA_LINKABLE_IDENTIFIER_CONTROL_GAP", "sensitive_information": "KR_DATA_SENSITIVE_INFORMATION_CONTROL_GAP"}
DECLARATIONS = (
    r"['\"`]\s*([^'\"`]+?)\s*['\"`]\s*:", r"['\"`]\s*([^'\"`]+?)\s*['\"`]\s+(?:String|Bytes|Text|varchar|char|text|bytea)\b", r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s*\??\s*:\s*[A-Za-z_$]", r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:Column|Field|mapped_column|db\.Column|models\.)",
    r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s+(?:String|Bytes|Text|varchar|char|text|bytea)\b", r"\b(?:String|Bytes|Text|varchar|char|text|bytea)\s+([A-Za-z_$][A-Za-z0-9_$]*)\b",
)
# End of the fixed values.
_STRING = r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`"


def field_key(name: Column) -> Column:
    """A name by its letters and digits, in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def _without_strings(line: Column) -> Column:
    return F.regexp_replace(line, _STRING, " ")


def code_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line) without comments; marks of comments in strings are none."""
    blank = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"(?s)/\*.*?\*/", "\u0001")
    # Block comments keep their line breaks: they are counted before and put back.
    breaks = F.transform(F.regexp_extract_all(F.regexp_replace(F.col(text), "\r\n?", "\n"), F.lit(r"(?s)/\*.*?\*/"), F.lit(0)), lambda c: F.regexp_replace(c, "[^\n]", ""))
    parts = F.split(blank, "\u0001")
    whole = F.array_join(F.zip_with(parts, breaks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    rows = files.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(whole, "\n")).alias("line_no", "line"))
    mark = rf"^((?:{_STRING}|[^'\"`#/-]|/(?!/)|(?<!\s)-|-(?!-))*+)(?:#|//|--).*$"
    return rows.withColumn("line_no", (F.col("line_no") + 1).cast("int")).withColumn("line", F.regexp_replace("line", mark, "$1"))


def declared_fields(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, name, key, category) of personal fields that lines declare; one of a category and line.

    ``ci`` and ``di`` count where a line from four above to two below speaks of identity verification.
    """
    names = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("line", F.lit(f"(?i){p}"), F.lit(1)) for p in DECLARATIONS])))
    rows = lines.select(*keys, "line_no", F.posexplode(names).alias("n", "name")).withColumn("key", field_key(F.col("name")))
    known = [(c, ns) for c, ns in (("unique_identifier", UNIQUE), ("high_impact_service_identifier", SERVICE), ("ambiguous", AMBIGUOUS), ("sensitive_information", SENSITIVE))]
    table = F.create_map(*[F.lit(x) for c, ns in known for n in ns for x in ("".join(ch for ch in n.lower() if ch.isalnum()), c)])
    found = rows.withColumn("category", table[F.col("key")]).filter("category is not null")
    first = found.groupBy(*keys, "line_no", "category").agg(F.min(F.struct("n", "name", "key")).alias("f")).select(*keys, "line_no", "category", "f.name", "f.key")
    context = lines.filter(_without_strings(F.col("line")).rlike(IDENTITY_CONTEXT)).select(*keys, F.explode(F.sequence(F.col("line_no") - 2, F.col("line_no") + 4)).alias("line_no")).distinct()
    linked = first.filter("category = 'ambiguous'").join(context, [*keys, "line_no"], "left_semi").withColumn("category", F.lit("high_impact_service_identifier"))
    return first.filter("category != 'ambiguous'").unionByName(linked)


def control_states(fields: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """``fields`` with encryption, access_control and access_audit: whether such a mark stands by the field in its file.

    A line counts that names the field; for encryption a decorator in the two lines above does, too.
    """
    code = _without_strings(F.col("line"))
    marks = {"encryption": code.rlike(ENCRYPTION), "access_control": code.rlike(ACCESS), "access_audit": code.rlike(AUDIT)}
    marked = lines.select(*keys, "line_no", "line", *[m.alias(c) for c, m in marks.items()]).filter(" or ".join(marks))
    words = F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*|[가-힣]+"), F.lit(0)), field_key))
    by_name = marked.select(*keys, F.explode(words).alias("key"), *marks).groupBy(*keys, "key").agg(*[F.bool_or(c).alias(c) for c in marks])
    above = marked.filter(F.ltrim("line").startswith("@") & F.col("encryption")).select(*keys, F.explode(F.sequence(F.col("line_no") + 1, F.col("line_no") + 2)).alias("line_no")).distinct().withColumn("near", F.lit(True))
    both = fields.join(by_name, [*keys, "key"], "left").join(above, [*keys, "line_no"], "left")
    no = F.lit(False)
    return both.select(*fields.columns, (F.coalesce("encryption", no) | F.coalesce("near", no)).alias("encryption"), F.coalesce("access_control", no).alias("access_control"), F.coalesce("access_audit", no).alias("access_audit"))


def governance_gaps(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule_id, severity, n_fields, first_line): gaps of each category, and missing access logs of unique and sensitive fields and service identifiers."""
    gap = states.filter("not (encryption and access_control)")
    rule = F.create_map(*[F.lit(x) for kv in GAPS.items() for x in kv])
    out = lambda rows, rule_id, severity: rows.groupBy(*keys, rule_id.alias("rule_id")).agg(F.count("*").alias("n_fields"), F.min("line_no").alias("first_line")).withColumn("severity", F.lit(severity))
    gaps = out(gap, rule[F.col("category")], "high").unionByName(out(states.filter("not access_audit"), F.lit("KR_DATA_ACCESS_LOG_EVIDENCE_MISSING"), "medium"))
    return gaps.select(*keys, "rule_id", "severity", "n_fields", "first_line")


def processor_review(states: DataFrame, findings: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, rule_id, severity) of projects with personal data and a flow to the outside, but no line about transfers or processors."""
    private = states.select(key).unionByName(findings.filter(F.col("rule_id").rlike(PRIVACY_RULE)).select(key)).distinct()
    outside = findings.filter(F.col("rule_id").rlike(EXTERNAL_RULE)).select(key).distinct()
    covered = lines.filter(F.col("line").rlike(TRANSFER)).select(key).distinct()
    hit = private.join(outside, key, "left_semi").join(covered, key, "left_anti")
    return hit.select(key, F.lit("KR_DATA_EXTERNAL_PROCESSOR_REVIEW_REQUIRED").alias("rule_id"), F.lit("medium").alias("severity"))
