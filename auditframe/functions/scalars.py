"""Scalar column functions: hashes, masks, ranks, rates and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
#: Key of evidence hashes unless a session gives its own; public, so hashes under it are no secret.
DEFAULT_KEY = "auditframe-public-evidence-key"
WILSON_Z = 1.959963984540054
#: White space that Python's strip removes, as a Java class.
_STRIP = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def rank(value: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    """Position in an enumeration; an unknown value raises."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for k, name in enumerate(order):
        out = out.when(value == name, k)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown value: "), value)).cast("int"))


def at_least(severity: Column, threshold: str) -> Column:
    """Severity at or above a threshold."""
    return rank(severity) <= SEVERITIES.index(threshold)


def strip(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, f"^{_STRIP}+", ""), f"{_STRIP}+$", "")


def fp12(value: Column) -> Column:
    """F-FP: the first 12 hex digits of sha256."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 12)


def redaction_token(label: Column | str, value: Column) -> Column:
    name = F.lit(label) if isinstance(label, str) else label
    return F.concat(F.lit("<redacted:"), name, F.lit(":"), fp12(value), F.lit(">"))


def hmac_pads(key: str) -> tuple[str, str]:
    """Hex of the inner and outer pads of HMAC-SHA256."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac16(value: Column, key: str = DEFAULT_KEY, length: int = 16) -> Column:
    """F-HMAC: the first digits of HMAC-SHA256(key, stripped value), in built-in functions."""
    inner, outer = hmac_pads(key)
    message = F.concat(F.unhex(F.lit(inner)), F.encode(strip(value), "UTF-8"))
    digest = F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(message, 256))), 256)
    return F.substring(digest, 1, length)


#: Labels masked by a redaction token (fixed values); RRN and FRN fold their _VALID forms.
TOKEN_LABELS = (
    "PRIVATE_KEY", "JWT", "API_KEY", "GITHUB_PAT", "AWS_ACCESS_KEY", "SECRET", "DB_URL", "PHONE", "EMAIL",
    "PERSON", "ADDRESS", "PASSPORT", "DRIVER_LICENSE", "PERSONAL_CUSTOMS_CODE", "BANK_ACCOUNT",
    "VEHICLE_NUMBER", "BIRTHDATE", "TIMESTAMP", "LOCATION", "ORDER_ID", "ACCOUNT_ID", "PATIENT_ID",
    "HEALTH_INSURANCE_ID", "DEVICE_ID", "CI", "DI", "IP_ADDRESS", "BUSINESS_REGISTRATION",
    "CORPORATE_REGISTRATION", "CREDIT_CARD",
)


def mask_value(label: Column, value: Column) -> Column:
    """F-MASK: a token for known labels, else the ends of the value."""
    v, name = strip(value), F.upper(label)
    folded = F.when(name.startswith("RRN"), "RRN").when(name.startswith("FRN"), "FRN").otherwise(name)
    known = folded.isin("RRN", "FRN", *TOKEN_LABELS)
    short_card = (folded == "CREDIT_CARD") & (F.length(F.regexp_replace(v, "[^0-9]", "")) < 10)
    plain = F.when(F.length(v) <= 4, F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), F.length(v) - 1))).otherwise(F.concat(F.substring(v, 1, 3), F.lit("****"), F.substring(v, -3, 3)))
    return F.when(v == "", "").when(known & ~short_card, redaction_token(folded, v)).otherwise(plain)


def mask_secret(value: Column) -> Column:
    """F-MASK2: first and last four characters of a long secret."""
    return F.when(F.length(value) <= 8, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(F.substring(value, 1, 4), F.lit("****"), F.substring(value, -4, 4)))


def mask_email(value: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(F.substring(local, 1, 1), F.lit("***@"), domain)


def mask_person(value: Column) -> Column:
    return F.when(F.length(value) <= 1, value).otherwise(F.concat(F.substring(value, 1, 1), F.repeat(F.lit("*"), F.length(value) - 1)))


def mask_address(value: Column) -> Column:
    return F.concat_ws(" ", F.slice(F.split(value, "\\s+"), 1, 2), F.lit("****"))


def rate(n: Column, d: Column, digits: int = 4) -> Column:
    """F-RATE: a guarded ratio, 0 over an empty denominator."""
    return F.when(d > 0, F.round(n.cast("double") / d.cast("double"), digits)).otherwise(F.lit(0.0))


def wilson(successes: Column, n: Column, digits: int = 6) -> tuple[Column, Column]:
    """F-WILS: the two-sided 95 % interval, clamped to [0, 1]; (0, 0) without trials."""
    k, m, z = successes.cast("double"), n.cast("double"), WILSON_Z
    p = k / m
    middle = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    low = F.when(n > 0, F.round(F.greatest(F.lit(0.0), middle - half), digits)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.round(F.least(F.lit(1.0), middle + half), digits)).otherwise(F.lit(0.0))
    return low, high


def truthy(value: Column) -> Column:
    """F-TRUTHY."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def luhn(digits: Column) -> Column:
    """F-LUHN over a string of digits."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def valid_ipv4(value: Column) -> Column:
    """F-IP: four octets of at most 255."""
    return F.forall(F.split(value, "\\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))


def weighted_sum(digits: Column, weights: tuple[int, ...]) -> Column:
    out = F.lit(0)
    for k, w in enumerate(weights):
        out = out + F.substring(digits, k + 1, 1).cast("int") * w
    return out


def _check_digit(digits: Column, length: int, value: Column) -> Column:
    plain = digits.rlike(f"^[0-9]{{{length}}}$")
    return F.coalesce(plain & (F.when(plain, value) == F.when(plain, F.substring(digits, length, 1).cast("int"))), F.lit(False))


def valid_rrn(digits: Column) -> Column:
    """F-RRN: resident and foreigner numbers of 13 digits."""
    safe = F.when(digits.rlike("^[0-9]{13}$"), digits)
    return _check_digit(digits, 13, F.pmod(11 - weighted_sum(safe, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)) % 11, F.lit(10)))


def valid_brn(digits: Column) -> Column:
    """F-BRN: business numbers of 10 digits."""
    safe = F.when(digits.rlike("^[0-9]{10}$"), digits)
    total = weighted_sum(safe, (1, 3, 7, 1, 3, 7, 1, 3, 5)) + F.floor(F.substring(safe, 9, 1).cast("int") * 5 / 10)
    return _check_digit(digits, 10, F.pmod(10 - total % 10, F.lit(10)).cast("int"))


def valid_crn(digits: Column) -> Column:
    """F-CRN: corporate numbers of 13 digits, by the historical check digit."""
    safe = F.when(digits.rlike("^[0-9]{13}$"), digits)
    return _check_digit(digits, 13, F.pmod(10 - weighted_sum(safe, (1, 2) * 6) % 10, F.lit(10)))


def plausible_birthdate(digits: Column) -> Column:
    """F-DATE: the first six digits are a date in the century that the seventh names."""
    century = F.when(F.substring(digits, 7, 1).isin("1", "2", "5", "6"), "19").otherwise("20")
    return F.try_to_date(F.concat(century, F.substring(digits, 1, 6)), "yyyyMMdd").isNotNull()


def normal_path(value: Column) -> Column:
    """F-PATH: leading dots and slashes off, lower case."""
    return F.lower(F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), "^[./]+", ""))


def header_label(value: Column) -> Column:
    """F-HDR: no byte-order mark, no white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, "^\\uFEFF", ""), "\\s+", ""))


def canonical_json(record: Column) -> Column:
    """F-CANON over a struct whose fields stand in alphabetical order."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def finding_fingerprint(*fields: Column, key: str = DEFAULT_KEY) -> Column:
    """F-FPR: keyed hash of fields joined by a bar, null as empty."""
    return hmac16(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), key)


def severity_bucket(score: Column) -> Column:
    """P5: bucket of a score from 0 to 10."""
    return F.when(score.isNull(), "info").when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score > 0.0, "low").otherwise("info")


# Bounds and names of P6 and P7.
RANK_BUCKETS = ((1_000, "top_1k"), (10_000, "top_10k"), (100_000, "top_100k"), (500_000, "mid_500k"))
ERROR_WORDS = (
    ("error_timeout", ("timed out", "timeout")), ("error_tls", ("certificate", "ssl", "tls")),
    ("error_dns", ("name or service not known", "getaddrinfo", "nodename")), ("error_connection", ("refused", "reset", "connection")),
)
CANONICAL_SCOPES = ("same_host_redirect", "same_site_canonical_redirect", "relative_redirect")
# End of the fixed values.


def rank_bucket(rank_text: Column) -> Column:
    """Bucket of a popularity rank; anything but a whole number is ``unknown``."""
    n = F.trim(rank_text.cast("string")).try_cast("long")
    out = F.when(n.isNull(), "unknown")
    for bound, name in RANK_BUCKETS:
        out = out.when(n <= bound, name)
    return out.otherwise("long_tail")


def hygiene_tier(role: Column, status: Column, code: Column, severe: Column, rules: Column, observed: Column, boundary: Column) -> Column:
    """The first tier that fits a measured page; ``severe`` counts critical and high findings, rules are arrays of ids."""
    has = lambda name, where=rules: F.array_contains(where, name)
    return (
        F.when(role == "probable_infrastructure", "not_homepage_candidate").when(status != "measured", "unmeasured")
        .when(has("DYN_DEBUG_ERROR_LEAK") | (severe > 0), "messy_or_risky_signal").when(has("DYN_DIRECTORY_LISTING"), "messy_directory_listing")
        .when(code >= 500, "messy_server_error").when(code >= 400, "blocked_or_missing_page").when(has("DYN_SECURITY_HEADERS_MISSING"), "hardening_gap")
        .when(has("DYN_CANONICAL_REDIRECT", observed), "canonical_redirect").when(boundary | has("DYN_REDIRECT_TO_DISALLOWED_HOST", observed), "boundary_redirect")
        .when(code.between(200, 299) & (F.size(rules) == 0), "well_managed_quiet").otherwise("measured_other")
    )


def outcome_bucket(role: Column, status: Column, code: Column, error: Column, boundary: Column, redirect: Column) -> Column:
    """What came of a measurement."""
    low = F.lower(F.coalesce(error, F.lit("")))
    failed = F.lit("error_other")
    for name, words in reversed(ERROR_WORDS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        failed = F.when(hit, name).otherwise(failed)
    return (
        F.when(role == "probable_infrastructure", "skipped_probable_infrastructure").when(status == "skipped", "skipped").when(status != "measured", failed)
        .when(boundary, "http_3xx_boundary_redirect").when(redirect.isin(*CANONICAL_SCOPES), "http_3xx_canonical_redirect").when(code.isNull(), "error_unknown")
        .when(code.between(200, 299), "http_2xx").when(code.between(300, 399), "http_3xx_allowed_redirect").when(code.between(400, 499), "http_4xx").when(code >= 500, "http_5xx").otherwise("http_other")
    )
