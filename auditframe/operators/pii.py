"""Personal-data and secret entities: lines to entities, entities to findings.

Rules are data. A rule's pattern runs once per line by ``regexp_extract_all``; its gates are built-in
expressions over the match and the line. Only organisation numbers, whose spans are claimed one after
another, need Python, on the few lines that can hold one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.functions import scalars as S
from auditframe.functions.text import clamped_depth, lines
from auditframe.session import ship


@dataclass(frozen=True)
class EntityRule:
    """``group`` of the match is the value. ``context`` must occur on the line, if given."""

    label: str
    pattern: str
    group: int = 0
    confidence: str = "medium"
    context: str | None = None
    hint: str | None = None  # a cheap pattern that every match holds
    unless: str | None = None  # a value that is none


# Patterns of entity labels, in Java syntax with Unicode classes.
_U, _UI = "(?U)", "(?Uiu)"
_FIELD = "[\"'\\s:=]+[\"']?"
_TAG = "[\"'\\s:=#-]+"
RULES = (
    EntityRule("EMAIL", _U + r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, "high", hint="@"),
    EntityRule("PHONE", _U + r"\b(?:010|011|016|017|018|019|02|0[3-6][1-6]|070|080)[- ]?\d{3,4}[- ]?\d{4}\b", 0, "high", hint=r"\p{Nd}{4}"),
    EntityRule("PASSPORT", _U + r"\b[MSROD][0-9]{8}\b", hint="[MSROD][0-9]{8}"),
    EntityRule("DRIVER_LICENSE", _U + r"\b\d{2}[- ]?\d{2}[- ]?\d{6}[- ]?\d{2}\b", context=_UI + r"(driver(?:[_\s-]?license)?|운전\s*면허|면허번호)", hint=r"\p{Nd}{6}"),
    EntityRule("PERSONAL_CUSTOMS_CODE", _U + r"\bP\d{12}\b", hint=r"P\p{Nd}{12}"),
    EntityRule("CI", _UI + r"(?:\bci\b|connecting[_ -]?info(?:rmation)?|연계정보)" + _FIELD + "([A-Za-z0-9+/=_-]{20,})", 1, hint="[A-Za-z0-9+/=_-]{20}"),
    EntityRule("DI", _UI + r"(?:\bdi\b|duplication[_ -]?info(?:rmation)?|중복가입확인정보)" + _FIELD + "([A-Za-z0-9+/=_-]{20,})", 1, hint="[A-Za-z0-9+/=_-]{20}"),
    EntityRule("HEALTH_INSURANCE_ID", _UI + r"(?:health[_ -]?insurance[_ -]?(?:id|no|number)|건강보험(?:증)?번호|보험증번호)" + _TAG + "([A-Za-z0-9_.-]{6,})", 1, hint="(?i)insurance|보험"),
    EntityRule("PATIENT_ID", _UI + r"(?:patient[_ -]?(?:id|no|number)|medical[_ -]?record[_ -]?(?:id|no|number)|환자번호|차트번호|진료번호|의무기록번호|병록번호)" + _TAG + "([A-Za-z0-9_.-]{4,})", 1, hint="(?i)patient|record|번호"),
    EntityRule("ACCOUNT_ID", _UI + r"(?:student[_ -]?id|employee[_ -]?id|member[_ -]?(?:id|no|number)|customer[_ -]?(?:no|number)|학번|사번|회원번호|회원ID|고객번호|수험번호)" + _TAG + "([A-Za-z0-9_.-]{4,})", 1, hint="(?i)student|employee|member|customer|학번|사번|회원|고객|수험"),
    EntityRule("DEVICE_ID", _UI + r"(?:device[_ -]?id|deviceId|idfa|gaid|adid|advertising[_ -]?id|firebase[_ -]?installation[_ -]?id|installation[_ -]?id|기기ID|기기식별자)[\"'\s:=]+([A-Za-z0-9_.:-]{12,})", 1, "low", hint="(?i)device|idfa|gaid|adid|advertis|installation|기기"),
    EntityRule("VEHICLE_NUMBER", _U + r"\b\d{2,3}[가-힣]\s?\d{4}\b", hint="[가-힣]"),
    EntityRule("BIRTHDATE", _U + r"\b(?:19|20)\d{2}[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01])\b", context=_UI + r"(?:\bbirth(?:date|day)?\b|\bdate[_ -]?of[_ -]?birth\b|\bdob\b|생년월일|생일)", hint=r"(?:19|20)\p{Nd}"),
    EntityRule("TIMESTAMP", _U + r"\b(?:19|20)\d{2}[-./]\d{2}[-./]\d{2}[ T]\d{2}:\d{2}(?::\d{2})?\b", hint=r"(?:19|20)\p{Nd}.*:"),
    EntityRule("PERSON", _UI + r"(?:name|user_name|customer_name|full_name|이름|성명|고객명|사용자명)" + _FIELD + "([가-힣]{2,4})", 1, "high", hint="[가-힣]{2}"),
    EntityRule("ADDRESS", _UI + r"(?:address|addr|주소)" + _FIELD + r"([가-힣A-Za-z0-9\s\-]+(?:시|도|구|군|동|로|길)[가-힣A-Za-z0-9\s\-]*)", 1, hint="[시도구군동로길]"),
    EntityRule("LOCATION", _UI + r"(?:location|loc|place|위치|장소)" + _FIELD + r"([가-힣A-Za-z0-9\s\-]+(?:시|도|구|군|동|로|길|역|점)[가-힣A-Za-z0-9\s\-]*)", 1, hint="[시도구군동로길역점]"),
    EntityRule("ORDER_ID", _UI + r"\b(?:order|주문|reservation|예약|tracking|송장)[_-]?(?:id|no|번호)?" + _TAG + "([A-Za-z0-9-]{6,})", 1, hint="(?i)order|reservation|tracking|주문|예약|송장"),
    EntityRule("ACCOUNT_ID", _UI + r"\b(?:account|user|customer)[_-]?id[\"'\s:=]+([A-Za-z0-9_.-]{4,})", 1, hint="(?i)account|user|customer"),
)
PERSON_NUMBER = _U + r"\b\d{6}[- ]?[1-8]\d{6}\b"
RRN_CONTEXT = _UI + r"(?:\brrn\b|resident[_ -]?(?:registration|id)|주민(?:등록)?번호|주민등록)"
FRN_CONTEXT = _UI + r"(?:\bfrn\b|alien[_ -]?(?:registration|id)|foreigner[_ -]?(?:registration|id)|외국인(?:등록)?번호)"
CARD = _U + r"\b(?:\d[ -]?){13,19}\b"
CARD_CONTEXT = _UI + r"(?:credit[_ -]?card|card[_ -]?(?:number|num|no)|\bpan\b|카드(?:번호)?)"
BANK = _U + r"\b\d{2,6}[- ]\d{2,6}[- ]\d{2,8}(?:[- ]\d{1,4})?\b"
BANK_CONTEXT = _UI + "(account|bank|계좌|은행)"
BANK_FIELD = _UI + r"(?:bank[_ -]?account(?:[_ -]?(?:number|no))?|account[_ -]?(?:number|no)|deposit[_ -]?account|은행[_ -]?계좌(?:번호)?|입금[_ -]?계좌(?:번호)?|계좌번호)[\"'\s]*[:=]\s*[\"']?(\d{9,18})(?!\d)"
IPV4 = _U + r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
MEDICAL = _UI + r"(진료|처방|병력|진단명|질병|검사결과|혈압|당뇨|암(?!호)|수술|투약|medical[_ -]?(?:record|info)|diagnosis|prescription)"
SENSITIVE = _UI + r"(정당\s*(?:가입|명|원)|전과|수형|정신질환|genetic[_ -]?data|criminal[_ -]?record|religion|political[_ -]?opinion|union[_ -]?membership|labor\s+union|trade\s+union|health[_ -]?condition|biometric[_ -]?data)"
# Concepts with homonyms: the first pattern counts where it does not lie in a harmless phrase, the second.
CONCEPTS = (
    (
        _UI + "장애\\s*(?:유형|종류|등급|여부|유무|구분|등록|복지|인|정도)|장애(?:정보)?\\s*[:=]|</?장애\\s*>|\\|\\s*장애\\s*\\||(?:청각|지체|시각|발달|정신)장애",
        _UI + "(?:네트워크|서버|시스템|서비스|장비|회선|트래픽|프로세스|인스턴스|클러스터|노드|애플리케이션|앱|인프라|데이터베이스|통신)\\s*장애(?:\\s*(?:유형|종류|등급|여부|유무|정보))?|장애\\s*[:=]?\\s*(?:발생|조치|대응|복구|처리|현황|원인|구간|시간|알람|알림|로그|모니터링|전파|공지|티켓|코드|신고|접수|이력)|장애정보\\s*[:=]?\\s*(?:대시보드|알림|채널|모니터링|로그|현황|복구)|장애인\\s*접근성|접근성\\s*가이드|장애물",
    ),
    (
        _UI + "지문(?:정보|데이터|패턴|인식|인증|등록|스캔|수집|생체|코드|값|템플릿)|지문\\s*(?:등록|인증|인식|수집|스캔|검증|채취|대조|저장|입력)|지문(?:정보)?\\s*[\"'`]?\\s*[:=]",
        _UI + "(?:디지털|파일|코드|해시|인증서|브라우저|콘텐츠|문서|커밋|git|tls|ja3|sha-?1|sha-?256|md5|checksum|빌드|바이너리)\\s*지문(?:\\s*\\S+)?|지문\\s*(?:해시|알고리즘|비교|분석)|(?:수능|국어|독해|시험|문제|영어|논술|교과서).{0,12}지문|(?:다음|제시된|해당|아래)\\s*지문|(?:면접|대본|연극|스크립트)\\s*지문|지문을\\s*읽고",
    ),
    (_UI + "홍채\\s*(?:정보|데이터|패턴|인식|인증|등록|스캔|수집|생체|코드|값|검증|채취|대조)|홍채\\s*[\"'`]?\\s*[:=]", None),
    (
        _UI + "(?:종교|인종|민족|사상|신념|정치적\\s*견해|유전정보|범죄경력|성생활|성적\\s*지향|건강상태|진료정보|병력|진단명|처방정보|노동조합(?:\\s*가입(?:여부)?)?|생체정보(?:\\s*수집(?:여부)?)?)[\"'`]?\\s*[:=]",
        _UI + "(?:시스템|서버|클러스터|서비스|인스턴스|노드|애플리케이션|앱)\\s*건강상태|사상자|사상\\s*(?:최대|최다|최고|최초|유례|최저|최악)",
    ),
    (_UI + "[\"'`]?\\bdisability(?:_type|_status|_grade|_code)?[\"'`]?\\s*[:=]|disability(?:_type|_status|_grade|_code)", None),
    (_UI + "[\"'`]?\\bsexual[_ -]?(?:orientation|life)", None),
)
HINT = r"(?i)[@\p{Nd}가-힣]|\b(?:ci|di|connecting|duplication|health|insurance|patient|medical|record|student|employee|member|customer|device|idfa|gaid|adid|firebase|installation|driver|license|name|full_name|user_name|address|addr|location|loc|place|order|reservation|tracking|account|user_id|customer_id|diagnosis|prescription|genetic[_ -]?data|criminal[_ -]?record|disability(?:_type|_status|_grade|_code)?|religion|political[_ -]?opinion|union[_ -]?membership|labor\s+union|trade\s+union|sexual[_ -]?(?:orientation|life)|corporate(?:_?registration)?|medical[_ -]?(?:record|info)|biometric(?:_data)?|health_condition|biz|brn|crn)\b"
#: Secrets, reconstructed from the public shapes of the credentials.
SECRETS = (
    EntityRule("PRIVATE_KEY", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "high", hint="-----BEGIN"),
    EntityRule("DB_URL", r"\b(?:postgres|postgresql|mysql|mongodb|redis)://[^:\s]+:[^@\s]+@[^)\s'\"`]+", 0, "high", hint="://"),
    EntityRule("GITHUB_PAT", r"\bgh[pousr]_[A-Za-z0-9_]{30,}\b", 0, "high", hint="gh[pousr]_"),
    EntityRule("AWS_ACCESS_KEY", r"\bAKIA[0-9A-Z]{16}\b", 0, "high", hint="AKIA"),
    EntityRule("JWT", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", 0, "high", hint="eyJ"),
    EntityRule("OPENAI_STYLE_KEY", r"\bsk-[A-Za-z0-9_-]{20,}\b", 0, "high", hint="sk-"),
    EntityRule("WEBHOOK_URL", r"https://hooks\.[A-Za-z0-9.-]+/[A-Za-z0-9/_-]{16,}", 0, "high", hint="https://hooks"),
    EntityRule("API_KEY", "(?i)\\b(?:api[_-]?key|secret|token|password)\\b[\"']?\\s*[:=]\\s*[\"']?([A-Za-z0-9_\\-]{8,})", 1, "medium", hint="(?i)key|secret|token|password", unless="(?i)^your[_-]"),
)

#: Severity of a lone entity by label; RRN and FRN also depend on confidence.
SEVERITY = {
    "critical": ("RRN_VALID", "FRN_VALID", "CREDIT_CARD"),
    "high": ("PASSPORT", "DRIVER_LICENSE", "PERSONAL_CUSTOMS_CODE", "BANK_ACCOUNT", "CI", "DI", "HEALTH_INSURANCE_ID"),
    "medium": ("PHONE", "EMAIL", "ADDRESS", "VEHICLE_NUMBER", "MEDICAL_INFO", "PATIENT_ID", "SENSITIVE_INFO", "BUSINESS_REGISTRATION", "CORPORATE_REGISTRATION"),
}
SECRET_SEVERITY = {"critical": ("PRIVATE_KEY", "DB_URL", "AWS_ACCESS_KEY", "GITHUB_PAT"), "high": ("JWT", "OPENAI_STYLE_KEY", "API_KEY", "WEBHOOK_URL")}
# Fixed values, D-PII9: label, privacy class, axes.
TAXONOMY = (
    ("RRN_VALID", "고유식별정보/직접식별자", ("direct_identifier", "unique_identifier", "high_impact")),
    ("RRN", "고유식별정보/직접식별자 후보", ("direct_identifier", "unique_identifier", "high_impact")),
    ("FRN", "고유식별정보/외국인 식별자 후보", ("direct_identifier", "unique_identifier", "high_impact")),
    ("FRN_VALID", "고유식별정보/외국인 식별자", ("direct_identifier", "unique_identifier", "high_impact")),
    ("PASSPORT", "여권번호/고유식별정보 후보", ("direct_identifier", "unique_identifier", "high_impact")),
    ("DRIVER_LICENSE", "운전면허번호/고유식별정보 후보", ("direct_identifier", "unique_identifier", "high_impact")),
    ("PERSONAL_CUSTOMS_CODE", "개인통관고유부호/직접식별자 후보", ("direct_identifier", "service_identifier")),
    ("CI", "본인확인 연계정보/서비스 식별자", ("service_identifier", "linkable_identifier", "high_impact")),
    ("DI", "중복가입확인정보/서비스 식별자", ("service_identifier", "linkable_identifier", "high_impact")),
    ("CREDIT_CARD", "금융 식별정보", ("financial_identifier", "high_impact")),
    ("BANK_ACCOUNT", "계좌번호/금융 식별정보", ("financial_identifier", "high_impact")),
    ("HEALTH_INSURANCE_ID", "건강보험 식별자", ("health_identifier", "sensitive_context", "high_impact")),
    ("PATIENT_ID", "환자/진료 식별자", ("health_identifier", "sensitive_context")),
    ("MEDICAL_INFO", "건강/의료 민감정보 후보", ("sensitive_category", "health_context")),
    ("SENSITIVE_INFO", "민감정보 후보", ("sensitive_category", "high_impact")),
    ("PERSON", "성명/직접식별자", ("direct_identifier",)),
    ("PHONE", "연락처/직접식별자", ("direct_identifier", "contact")),
    ("EMAIL", "이메일/연락처 식별자", ("contact", "linkable_identifier")),
    ("ADDRESS", "주소/위치 식별자", ("contact", "location", "linkable_identifier")),
    ("BIRTHDATE", "생년월일/준식별자", ("quasi_identifier",)),
    ("ACCOUNT_ID", "회원/고객/학생/직원 식별자", ("service_identifier", "linkable_identifier")),
    ("ORDER_ID", "주문/예약 식별자", ("service_identifier", "activity_context")),
    ("DEVICE_ID", "기기/광고 식별자", ("device_identifier", "behavioral_context")),
    ("IP_ADDRESS", "접속기록/IP 식별자 후보", ("technical_identifier", "access_log")),
    ("TIMESTAMP", "시각 정보/행위 문맥", ("activity_context", "quasi_identifier")),
    ("VEHICLE_NUMBER", "차량번호/이동 식별자", ("location", "direct_identifier")),
    ("LOCATION", "위치정보 후보", ("location", "sensitive_context")),
    ("BUSINESS_REGISTRATION", "조직 식별정보/사업자등록번호", ("organization_identifier",)),
    ("CORPORATE_REGISTRATION", "조직 식별정보/법인등록번호", ("organization_identifier",)),
)
# End of the fixed values.


def privacy_class(label: Column) -> tuple[Column, Column]:
    """D-PII9: class and axes of a label; null and no axes outside the taxonomy."""
    pairs = [x for name, cls, axes in TAXONOMY for x in (F.lit(name), F.struct(F.lit(cls).alias("c"), F.array(*map(F.lit, axes)).alias("a")))]
    found = F.element_at(F.create_map(*pairs), label)
    return found["c"], F.coalesce(found["a"], F.array().cast("array<string>"))


def combined_class(labels: Column) -> Column:
    """D-PII9: the first four distinct classes of an array of labels, as one text."""
    classes = F.array_distinct(F.array_compact(F.transform(labels, lambda x: privacy_class(x)[0])))
    return F.array_join(F.slice(classes, 1, 4), " + ")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _matches(label: str, confidence: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value"), F.lit(confidence).alias("confidence")))


def _rule(rule: EntityRule, line: Column) -> Column:
    found = F.regexp_extract_all(line, F.lit(rule.pattern), F.lit(rule.group))
    if rule.unless:
        found = F.filter(found, lambda v: ~v.rlike(rule.unless))
    tests = [line.rlike(p) for p in (rule.hint, rule.context) if p]
    if tests:
        found = F.when(reduce(and_, tests), found).otherwise(F.array().cast("array<string>"))
    return _matches(rule.label, rule.confidence, found)


def _hinted(line: Column, hint: str, found: Column) -> Column:
    return F.when(line.rlike(hint), found).otherwise(F.array().cast("array<struct<label:string,value:string,confidence:string>>"))


def _person_numbers(line: Column) -> Column:
    found = F.filter(F.regexp_extract_all(line, F.lit(PERSON_NUMBER), F.lit(0)), lambda v: S.plausible_birthdate(_digits(v)))

    def one(v: Column) -> Column:
        d = _digits(v)
        foreign = F.substring(d, 7, 1) >= "5"
        valid = S.valid_rrn(d)
        context = F.when(foreign, line.rlike(FRN_CONTEXT)).otherwise(line.rlike(RRN_CONTEXT))
        label = F.concat(F.when(foreign, "FRN").otherwise("RRN"), F.when(valid, "_VALID").otherwise(""))
        return F.struct(label.alias("label"), v.alias("value"), F.when(valid | context, "high").otherwise("low").alias("confidence"))

    return _hinted(line, r"\p{Nd}{6}[- ]?\p{Nd}{7}", F.transform(found, one))


def _cards(line: Column) -> Column:
    def gate(v: Column) -> Column:
        d = _digits(v)
        return F.length(d).between(13, 19) & F.substring(d, 1, 1).isin("2", "3", "4", "5", "6") & S.luhn(d) & (F.trim(v).rlike("[ -]") | line.rlike(CARD_CONTEXT))

    return _hinted(line, r"(?:\p{Nd}[ -]?){13}", _matches("CREDIT_CARD", "high", F.filter(F.regexp_extract_all(line, F.lit(CARD), F.lit(0)), gate)))


def _banks(line: Column) -> Column:
    phone, licence = RULES[1].pattern, RULES[3].pattern

    def gate(v: Column) -> Column:
        d = _digits(v)
        return line.rlike(BANK_CONTEXT) & F.length(d).between(9, 18) & ~S.luhn(d) & ~v.rlike(f"^(?:{phone})$") & ~v.rlike(f"^(?:{licence})$")

    def field(v: Column) -> Column:
        return (F.size(F.array_distinct(F.split(v, ""))) >= 2) & ~v.rlike(f"^(?:{phone})$") & ~v.rlike(f"^(?:{PERSON_NUMBER})$")

    loose = F.filter(F.regexp_extract_all(line, F.lit(BANK), F.lit(0)), gate)
    named = F.filter(F.regexp_extract_all(line, F.lit(BANK_FIELD), F.lit(1)), field)
    return _hinted(line, r"\p{Nd}{2}[- ]?\p{Nd}{2}", F.concat(_matches("BANK_ACCOUNT", "low", loose), _matches("BANK_ACCOUNT", "medium", named)))


def _keywords(line: Column, line_no: Column) -> Column:
    concept = line.rlike(SENSITIVE)
    for yes, no in CONCEPTS:
        rest = F.regexp_replace(line, no, " ") if no else line
        concept = concept | rest.rlike(yes)

    def flag(label: str, prefix: str, test: Column) -> Column:
        values = F.when(test, F.array(F.concat(F.lit(prefix), line_no.cast("string")))).otherwise(F.array().cast("array<string>"))
        return _matches(label, "medium", values)

    return F.concat(flag("MEDICAL_INFO", "medical-info:", line.rlike(MEDICAL)), flag("SENSITIVE_INFO", "sensitive-info:", concept))


_BIZ_LABEL = r"(?:사업자[^\S\r\n]*등록[^\S\r\n]*번호|사업자[^\S\r\n]*번호|사업자번호|biz[_ -]?(?:reg(?:istration)?|no|number)|\bbrn\b|business[_ -]?registration(?:[_ -]?(?:no|num(?:ber)?))?)"
_CORP_LABEL = r"(?:법인[^\S\r\n]*등록[^\S\r\n]*번호|법인[^\S\r\n]*번호|법인번호|corporate(?:[_ -]?registration)?(?:[_ -]?(?:no|num(?:ber)?))?|corp[_ -]?(?:reg(?:istration)?|no|num(?:ber)?)|\bcrn\b)"
_BETWEEN = r"[^\S\r\n]*[\"'\t :=#-]*[\"']?"
_ORG_HINT = r"(?U)(?<!\d)(?:\d{3}[- ]\d{2}[- ]\d{5}|\d{10}|\d{6}[- ]?\d{7})(?!\d)"
_ORG_STEPS = (
    ("BUSINESS_REGISTRATION", re.compile(_BIZ_LABEL + _BETWEEN + r"(?P<v>(?<!\d)(?:\d{3}[- ]\d{2}[- ]\d{5}|\d{10})(?!\d))", re.I), True),
    ("BUSINESS_REGISTRATION", re.compile(r"(?P<v>(?<!\d)\d{3}[- ]\d{2}[- ]\d{5}(?!\d))"), False),
    ("CORPORATE_REGISTRATION", re.compile(_CORP_LABEL + _BETWEEN + r"(?P<v>(?<!\d)(?:\d{6}[- ]?\d{7}|\d{13})(?!\d))", re.I), True),
    ("CORPORATE_REGISTRATION", re.compile(r"(?P<v>(?<!\d)\d{6}[- ]\d{7}(?!\d))"), False),
)


def _mod_check(digits: str, weights: tuple[int, ...], extra: int = 0) -> bool:
    return (10 - (sum(int(d) * w for d, w in zip(digits, weights, strict=False)) + extra) % 10) % 10 == int(digits[-1])


def _is_person(digits: str) -> bool:
    import datetime

    try:
        datetime.date((1900 if digits[6] in "1256" else 2000) + int(digits[:2]), int(digits[2:4]), int(digits[4:6]))
    except ValueError:
        return False
    return digits[6] in "12345678"


def organisation_numbers(line: str, kind: str | None = None) -> tuple[list[tuple[str, str, str]], str]:
    """D-PII3: (label, value, confidence) on one line, and the line with all claimed spans masked by ``x``.

    ``kind`` is the label that a key alone on the line before gives to the first value of this one (W2).
    Then labelled business, bare business, labelled corporate and bare corporate numbers; a span that an
    earlier step has claimed is not looked at again. Bound numbers are claimed by their shape, bare ones
    only with a right check digit. A plausible person number is never an organisation's.
    """
    found, spans = [], []
    steps = [(label, pattern, labelled) for label, pattern, labelled in _ORG_STEPS]
    if kind:
        first = re.compile("(?P<v>" + (BUSINESS_SHAPE if kind == "BUSINESS_REGISTRATION" else CORPORATE_SHAPE) + ")").search(line)
        steps.insert(0, (kind, first, True))
    for label, pattern, labelled in steps:
        for m in ([pattern] if isinstance(pattern, re.Match) else pattern.finditer(line) if pattern else ()):
            a, b = m.span("v")
            if any(a < y and x < b for x, y in spans):
                continue
            digits = re.sub(r"\D", "", m["v"])
            business = label == "BUSINESS_REGISTRATION"
            if not business and _is_person(digits):
                continue
            ok = _mod_check(digits, (1, 3, 7, 1, 3, 7, 1, 3, 5), int(digits[8]) * 5 // 10) if business else _mod_check(digits, (1, 2) * 6)
            if ok or labelled:
                spans.append((a, b))
            if ok or labelled and not business:
                found.append((label, m["v"], "high" if ok else "medium"))
    for a, b in spans:
        line = line[:a] + "x" * (b - a) + line[b:]
    return found, line


BUSINESS_SHAPE = r"(?<!\d)(?:\d{3}[- ]\d{2}[- ]\d{5}|\d{10})(?!\d)"
CORPORATE_SHAPE = r"(?<!\d)(?:\d{6}[- ]?\d{7}|\d{13})(?!\d)"
_KEY_LINE = "^\\s*[\\[{,]?\\s*[\"']([^\"']+)[\"']\\s*:\\s*[\"']?[\\s,]*$"


def key_kind(line: Column) -> Column:
    """The organisation label that a line names which is only the key of the value below, else null."""
    name = F.lower(F.regexp_replace(F.regexp_extract(line, _KEY_LINE, 1), "[\\s_-]+", ""))
    return F.when(name.isin("법인등록번호", "법인번호", "crn", "corpreg", "corporateregistration", "corporateregistrationnumber", "corporateregistrationno"), "CORPORATE_REGISTRATION").when(
        name.isin("사업자등록번호", "사업자번호", "bizno", "biznumber", "brn", "businessregistration", "businessregistrationnumber", "businessregistrationno"), "BUSINESS_REGISTRATION"
    )


def detect_entities(artifacts: DataFrame, secrets: bool = True) -> DataFrame:
    """D-PII1 to D-PII6 and D-SEC: one row for each entity of each line.

    Adds line_no, label, value, confidence, evidence, context, scope, seq. Lines without a hint are
    dropped before any rule runs (secrets have a hint of their own). ``context`` names the
    bracketed block that a line stands in, if any; equal entities of a line are kept once. Depth
    changes only where a bracket stands, so its windows see hinted lines, lines with brackets and lone keys.
    """
    ship(artifacts.sparkSession)
    keys = [c for c in artifacts.columns if c != "text"]
    secret_hint = "(?i)-----BEGIN|://|gh[pousr]_|AKIA|eyJ|sk-|api[_-]?key|secret|token|password"
    line, empty = F.col("line"), F.array().cast("array<struct<label:string,value:string,confidence:string>>")
    hint = line.rlike(HINT) | (line.rlike(secret_hint) if secrets else F.lit(False))
    numbered = lines(artifacts).withColumn("__hint", hint).filter(F.col("__hint") | line.rlike("[\\[\\]{}]|[\"']\\s*:\\s*[\"']?[\\s,]*$"))
    by_line = Window.partitionBy(*keys).orderBy("line_no")
    kind = F.when(F.lag("line_no").over(by_line) == F.col("line_no") - 1, F.lag(key_kind(line)).over(by_line))
    count = lambda chars: F.length(line) - F.length(F.regexp_replace(line, f"[{chars}]", ""))
    blocks = clamped_depth(numbered.withColumn("__kind", kind), count("\\[{"), count("\\]}"), keys, ["line_no"])
    hinted = blocks.filter("__hint")

    @F.pandas_udf("struct<found:array<struct<label:string,value:string,confidence:string>>,masked:string>")
    def organisations(s: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = [organisation_numbers(x, k) if x is not None else ([], None) for x, k in zip(s, kinds, strict=True)]
        return pd.DataFrame({"found": [[dict(zip(("label", "value", "confidence"), f, strict=True)) for f in r[0]] for r in rows], "masked": [r[1] for r in rows]})

    # Lines without the shape of an organisation number are null to Python.
    shaped = line.rlike(_ORG_HINT)
    both = hinted.withColumn("org", organisations(F.when(shaped, line), F.when(shaped, F.col("__kind"))))
    # Claimed spans are no person, card or account numbers.
    free = F.coalesce(F.col("org.masked"), line)
    groups = [F.concat(*[_rule(r, line) for r in RULES[:10]]), F.concat(*[_rule(r, line) for r in RULES[10:]]), F.concat(_person_numbers(free), _cards(free), _banks(free), _keywords(line, F.col("line_no")))]
    ips = _hinted(line, r"\p{Nd}\.\p{Nd}", _matches("IP_ADDRESS", "medium", F.filter(F.regexp_extract_all(line, F.lit(IPV4), F.lit(0)), S.valid_ipv4)))
    groups.append(F.concat(ips, *[_rule(r, line) for r in SECRETS]) if secrets else ips)
    entities = both.withColumn("e", F.concat(*groups, F.coalesce("org.found", empty))).select(*keys, "line_no", "block", F.posexplode("e").alias("pos", "e"))
    context = F.when(F.col("block").isNotNull(), F.concat(F.lit("jsonish_block:"), F.col("block").cast("string"))).otherwise(F.lit("line"))
    out = entities.select(
        *keys, "line_no", F.col("e.label").alias("label"), F.col("e.value").alias("value"), F.col("e.confidence").alias("confidence"),
        F.when(F.col("e.label").isin("MEDICAL_INFO", "SENSITIVE_INFO"), F.col("e.value")).otherwise(S.mask_value(F.col("e.label"), F.col("e.value"))).alias("evidence"),
        context.alias("context"), (F.col("line_no").cast("long") * 10_000 + F.col("pos")).alias("seq"),
    )
    first = Window.partitionBy(*keys, "label", "evidence", "line_no", "context").orderBy("seq")
    return out.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


# Fixed values, D-PII6: label, confidence, headers (null: any), whole-value pattern.
_TOKEN = r"^[A-Za-z0-9+/=_-]{20,}$"
CELL_RULES = (
    ("EMAIL", "high", None, "^(?:" + RULES[0].pattern + ")$"),
    ("PHONE", "high", None, "^(?:" + RULES[1].pattern + ")$"),
    ("BIRTHDATE", "medium", ("birth", "birthdate", "birthday", "date_of_birth", "dob", "생년월일", "생일"), r"^(?:19|20)\d{2}[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01])$"),
    ("VEHICLE_NUMBER", "medium", None, r"^\d{2,3}[가-힣]\s?\d{4}$"),
    ("TIMESTAMP", "medium", None, r"^(?:19|20)\d{2}[-./]\d{2}[-./]\d{2}[ T]\d{2}:\d{2}(?::\d{2})?$"),
    ("PERSON", "high", ("name", "user_name", "customer_name", "full_name", "이름", "성명", "고객명", "사용자명"), "^[가-힣]{2,4}$"),
    ("ADDRESS", "medium", ("address", "addr", "주소"), "."),
    ("LOCATION", "medium", ("location", "loc", "place", "위치", "장소"), "."),
    ("ACCOUNT_ID", "medium", ("account_id", "user_id", "customer_id", "userid", "customerid"), "."),
    ("CI", "medium", ("ci", "connecting_info", "connecting_information", "연계정보"), _TOKEN),
    ("DI", "medium", ("di", "duplication_info", "duplication_information", "중복가입확인정보"), _TOKEN),
    ("ACCOUNT_ID", "medium", ("student_id", "employee_id", "member_id", "member_no", "customer_no", "학번", "사번", "회원번호", "고객번호", "수험번호"), "^.{4,}$"),
    ("PATIENT_ID", "medium", ("patient_id", "patient_no", "medical_record_no", "환자번호", "차트번호", "진료번호", "의무기록번호", "병록번호"), "^.{4,}$"),
    ("HEALTH_INSURANCE_ID", "medium", ("health_insurance_id", "health_insurance_no", "건강보험번호", "건강보험증번호", "보험증번호"), "^.{6,}$"),
    ("DEVICE_ID", "low", ("device_id", "deviceid", "idfa", "gaid", "adid", "advertising_id", "firebase_installation_id", "installation_id", "기기id", "기기식별자"), "^.{12,}$"),
    ("DRIVER_LICENSE", "medium", ("driver_license", "driver_license_no", "driver_license_number", "운전면허", "운전면허번호", "면허번호"), r"^\d{2}[- ]?\d{2}[- ]?\d{6}[- ]?\d{2}$"),
    ("BANK_ACCOUNT", "medium", ("bank_account", "bank_account_no", "bank_account_number", "account_no", "account_number", "deposit_account", "계좌번호", "은행계좌", "은행계좌번호", "입금계좌", "입금계좌번호"), r"^\d[\d -]{7,22}\d$"),
)
# End of the fixed values.


def cell_entities(cells: DataFrame, keys: list[str]) -> DataFrame:
    """D-PII6: cells (keys, row, header, value) of tables in texts as entities; the row is the context.

    A cell may have several labels. Organisation columns are told as keys of split values are: a business
    number needs a right check digit, a corporate one its shape alone, and no plausible person number.
    """
    value, header = F.trim("value"), F.col("header")
    compact = F.regexp_replace(header, "[\\s_-]+", "")
    digits = _digits(value)
    kind = key_kind(F.concat(F.lit('"'), compact, F.lit('":')))
    person = F.coalesce(digits.rlike("^[0-9]{6}[1-8][0-9]{6}$") & S.plausible_birthdate(digits), F.lit(False))
    row = lambda label, confidence: F.struct(F.lit(label).alias("label"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"))
    found = [F.when((header.isin(*names) if names else F.lit(True)) & value.rlike(pattern), row(label, confidence)) for label, confidence, names, pattern in CELL_RULES]
    found.append(F.when((kind == "BUSINESS_REGISTRATION") & S.valid_brn(digits), row("BUSINESS_REGISTRATION", "high")))
    found.append(F.when((kind == "CORPORATE_REGISTRATION") & digits.rlike("^[0-9]{13}$") & ~person, row("CORPORATE_REGISTRATION", F.when(S.valid_crn(digits), "high").otherwise("medium"))))
    rows = cells.filter(value != "").select(*keys, "row", value.alias("value"), F.posexplode(F.array_compact(F.array(*found))).alias("pos", "e"))
    return rows.select(
        *keys, F.col("row").alias("line_no"), F.col("e.label").alias("label"), "value", F.col("e.confidence").alias("confidence"), S.mask_value(F.col("e.label"), F.col("value")).alias("evidence"),
        F.concat(F.lit("csv_row:"), F.col("row").cast("string")).alias("context"), (F.col("row").cast("long") * 10_000 + F.col("pos")).alias("seq"),
    ).distinct()


def csv_entities(table: DataFrame, headers: dict[str, str], keys: list[str]) -> DataFrame:
    """D-PII6: cells of named columns as entities, ``context`` one row each. ``headers``: normal header to label."""
    columns = {c: headers[h] for c in table.columns if (h := "".join(c.lower().split())) in headers}
    cells = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"`{c}`").cast("string").alias("value")) for c, label in columns.items()])
    rows = table.select(*keys, F.explode(cells).alias("e")).select(*keys, "e.label", "e.value").filter(F.trim("value") != "")
    return rows.withColumn("confidence", F.lit("high")).withColumn("evidence", S.mask_value(F.col("label"), F.col("value"))).withColumn("context", F.concat_ws(":", F.lit("csv_row"), *keys))


def standalone_severity(label: Column, confidence: Column) -> Column:
    out = F.when(label.isin("RRN", "FRN"), F.when(confidence == "high", "high").otherwise("medium"))
    for severity, labels in [*SEVERITY.items(), *SECRET_SEVERITY.items()]:
        out = out.when(label.isin(*labels), severity)
    return out.otherwise("low")


def entity_findings(entities: DataFrame, file: Column) -> DataFrame:
    """D-PII7: entities as findings."""
    secret = F.col("label").isin(*[r.label for r in SECRETS])
    org = F.col("label").isin("BUSINESS_REGISTRATION", "CORPORATE_REGISTRATION")
    return entities.select(
        "*", F.when(secret, "secret").otherwise("pii").alias("source"),
        F.concat(F.when(secret, "SECRET_").when(org, "KR_ORG_").otherwise("PII_"), F.col("label")).alias("rule_id"),
        standalone_severity(F.col("label"), F.col("confidence")).alias("severity"),
        file.alias("file"), F.col("line_no").alias("line_start"),
        F.when(secret, 0).otherwise(3).alias("detector_ord"),
    )


def synthetic_card_lines(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """D-PII7, W5: card lines with a test marker and an expiry of 2070 or later within six lines, before the next card line."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    ahead = F.collect_list("line").over(w.rowsBetween(1, 6))
    is_card = F.col("line").rlike(CARD_CONTEXT) & F.col("line").rlike(CARD)
    marker = _UI + r"(?:synthetic|test[_ -]?card|dummy[_ -]?(?:card|pan)|fixture[_ -]?card|\bfixture\b)"
    rows = numbered.withColumn("ahead", ahead).filter(is_card).filter(F.exists(F.concat(F.array("line"), F.col("ahead")), lambda x: x.rlike(marker)))
    stops = F.array_position(F.transform("ahead", lambda x: x.rlike(CARD_CONTEXT) & x.rlike(CARD)), F.lit(True))
    until = F.when(stops > 0, F.slice("ahead", F.lit(1), (stops - 1).cast("int"))).otherwise(F.col("ahead"))
    year = lambda x: F.coalesce(F.regexp_extract(x, _UI + r"\b(?:exp(?:iration)?[_ -]?(?:year|yr)|expYear)\b[^\d]*(20\d{2})", 1).try_cast("int"), F.lit(0)) >= 2070
    return rows.filter(F.exists(until, year)).drop("ahead")

