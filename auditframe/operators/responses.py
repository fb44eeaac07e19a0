"""Rules over recorded responses (D-HTTP1): cookies, redirects, admin pages, bodies, JSON, the CORS matrix, headers, exposed files.

All rules are column expressions of one array, so a response is read once and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.operators.access import response_tier
from auditframe.operators.agent_config import private_json
from auditframe.streaming.session import SECRET

# Probed paths, and what bodies, cookies and headers are told by.
DEFAULT_PATHS = ("/", "/admin", "/api", "/api/users", "/swagger.json", "/openapi.json", "/_next/static/chunks/app.js.map")
DEEP_PATHS = ("/.env", "/.git/config", "/backup.sql", "/dump.sql", "/database.sql", "/backup.zip", "/server-status", "/phpinfo.php", "/actuator/env", "/debug", "/debug/vars", "/administrator", "/admin/", "/wp-admin/")
UNTRUSTED_ORIGIN = "https://trusted.example.eviltrusted.example"
SESSION_COOKIE = r"(?:^|[_.-])(?:session|auth|access[_-]?token|refresh[_-]?token|jwt|sid|connect\.sid|next-auth|supabase-auth)(?:$|[_.-])"
AUTH_WALL = "login|log in|sign in|signin|password|비밀번호|로그인|인증|unauthorized|forbidden|권한"
FORM = "<form|type=[\"']password[\"']|csrf|otp|2fa"
ADMIN_WORDS = ("admin dashboard", "administrator", "user management", "users table", "delete user", "role management", "system settings", "관리자", "관리자 대시보드", "회원관리", "사용자 관리", "권한 관리", "설정 변경", "삭제", "차단", "승인")
SHELL = "id=[\"'](?:root|__next)[\"']|vite|_next/static|react|vue|ng-version"
DEBUG = r"traceback \(most recent call last\)|exception in thread|prismaclientknownrequesterror|prismaclientinitializationerror|sql syntax|fatal error:|uncaught exception|org\.springframework\.web|werkzeug\.debug"
ENV_WORDS = "(?i)SECRET|TOKEN|API_KEY|DATABASE_URL|DB_PASSWORD|PRIVATE_KEY|NEXTAUTH|JWT"
DUMP = "CREATE TABLE|INSERT INTO|MYSQL DUMP|POSTGRESQL DATABASE DUMP|SQLITE FORMAT 3"
DEBUG_PAGES = {"/server-status": "apache server status|server uptime[\\s\\S]*total accesses|total accesses[\\s\\S]*server uptime", "/phpinfo.php": "phpinfo\\(\\)|php version", "/actuator/env": "propertysources|activeprofiles|systemenvironment", "/debug": "goroutine|memstats|debug toolbar|werkzeug", "/debug/vars": "goroutine|memstats|debug toolbar|werkzeug"}
# End of the fixed values.


def _origin(url: Column) -> Column:
    """Scheme, host and port of a URL, the port written out."""
    low = F.lower(url)
    scheme, rest = F.regexp_extract(low, "^([a-z][a-z0-9+.-]*)://", 1), F.regexp_extract(low, "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    port = F.regexp_extract(rest, ":([0-9]+)$", 1)
    return F.concat_ws("|", scheme, F.regexp_replace(rest, ":[0-9]+$", ""), F.when(port != "", port).when(scheme == "https", "443").when(scheme == "http", "80").otherwise("0"))


def _weak_cookie(raw: Column) -> Column:
    """Whether a session's cookie (one a line) lacks Secure, HttpOnly or SameSite; cookies against forgery are none."""
    def weak(cookie: Column) -> Column:
        parts = F.transform(F.split(cookie, ";"), lambda p: F.lower(F.trim(p)))
        name = F.trim(F.regexp_extract(F.get(parts, 0), "^([^=]*)=", 1))
        names = F.transform(F.slice(parts, 2, 100), lambda p: F.trim(F.regexp_replace(p, "=.*$", "")))
        lacks = [~F.array_contains(names, a) for a in ("secure", "httponly", "samesite")]
        return name.rlike(SESSION_COOKIE) & ~name.rlike("csrf|xsrf") & (lacks[0] | lacks[1] | lacks[2])

    return F.exists(F.split(raw, "\n"), weak)


def response_matrix(responses: DataFrame) -> DataFrame:
    """D-HTTP1: (all columns but headers and body, rule_id, severity, confidence), one row a rule and response.

    From url, probe_path, method, status, headers (map of lower-case names), body_sample, authenticated.
    Responses without a status have no rows; redirects are judged by their cookie and target alone.
    """
    h = lambda name: F.coalesce(F.col("headers")[name], F.lit(""))
    has = lambda name: F.coalesce(F.map_contains_key("headers", F.lit(name)), F.lit(False))
    body = F.coalesce("body_sample", F.lit(""))
    low, begin = F.lower(body), F.lower(F.substring(F.ltrim(body), 1, 8192))
    kind, path, status = F.lower(h("content-type")), F.coalesce("probe_path", F.lit("")), F.col("status")
    get, ok, known = F.col("method") == "GET", status == 200, F.coalesce("authenticated", F.lit(False))
    html = begin.rlike("^(?:<!doctype html|<html)")
    redirect = status.isin(301, 302, 303, 307, 308)
    target = h("location")
    leaves = (target != "") & target.rlike("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//") & (_origin(F.when(target.startswith("//"), F.concat(F.regexp_extract("url", "^([a-zA-Z]+:)", 1), target)).otherwise(target)) != _origin(F.col("url")))
    admin_words = sum((F.contains(low, F.lit(w)).cast("int") for w in ADMIN_WORDS), F.lit(0))
    wall = low.rlike(AUTH_WALL) & (low.rlike(FORM) | (F.length(body) < 12_000))
    shell = F.contains(low, F.lit("<html")) & low.rlike(SHELL) & (admin_words < 2)
    admin_path = ~known & F.rtrim(F.lower(path), F.lit("/")).rlike("^/admin|^/wp-admin$") & ok & ~wall & ~shell
    secret = body.rlike(SECRET)
    counts = F.struct(F.regexp_count(body, F.lit(r"\b\d{6}-[1-8]\d{6}\b")).alias("strong"), F.regexp_count(body, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).alias("email"), F.regexp_count(body, F.lit(r"\b01[016-9]-?\d{3,4}-?\d{4}\b")).alias("phone"))
    leak, review = F.col("tier").isin("strong_identifier", "bulk_records", "linked_record"), F.col("tier") == "contact_cluster"
    json_open = ~known & get & ok & F.contains(kind, F.lit("json"))
    private = secret | leak | private_json(body)
    origin, credentials = h("access-control-allow-origin"), F.lower(h("access-control-allow-credentials")) == "true"
    options, reflected = F.col("method") == "OPTIONS", F.lower(origin) == UNTRUSTED_ORIGIN
    cached = F.arrays_overlap(F.transform(F.split(F.lower(h("cache-control")), ","), lambda d: F.trim(F.regexp_replace(d, "=.*$", ""))), F.array(F.lit("no-store"), F.lit("private")))
    root, https = (path == "/") & ok, F.lower(F.col("url")).startswith("https:")
    lacks = ~has("content-security-policy") | ~has("x-content-type-options") | ~has("x-frame-options")
    document = F.startswith(F.ltrim(body), F.lit("{")) & ~F.contains(kind, F.lit("html"))
    deep = get & ok & path.isin(*DEEP_PATHS)
    debug_page = F.lit(False)
    for name, words in DEBUG_PAGES.items():
        debug_page = debug_page | ((F.lower(path) == name) & begin.rlike(words))
    debug = low.rlike(DEBUG) | body.rlike(r'(?m)^\s*File "[^"]+", line \d+, in ') | (body.rlike(r"\b(?:ReferenceError|TypeError|SyntaxError|RangeError):\s+[^\n\r<]") & (F.regexp_count(body, F.lit(r"(?m)^\s*at\s+[^\n(]+\(")) >= 2))
    env_lines = F.regexp_count(F.substring(body, 1, 8192), F.lit(r"(?m)^[A-Za-z][A-Za-z0-9_]{2,}=(?!$).+"))
    settled = ~redirect  # all but cookies and targets
    rules = (
        ("DYN_SESSION_COOKIE_FLAG_WEAK", "high", "high", _weak_cookie(h("set-cookie"))),
        ("DYN_REDIRECT_TO_DISALLOWED_HOST", "high", "high", redirect & leaves),
        ("DYN_UNAUTH_ADMIN_ACCESS", "critical", "high", settled & admin_path & (admin_words >= 2)),
        ("DYN_ADMIN_ROUTE_REVIEW_REQUIRED", "info", "low", settled & admin_path & (admin_words < 2)),
        ("DYN_RESPONSE_SECRET_LEAK", "critical", "high", settled & secret),
        ("DYN_RESPONSE_PII_LEAK", "high", "high", settled & leak),
        ("DYN_RESPONSE_PII_REVIEW", "medium", "low", settled & review),
        ("DYN_UNAUTH_API_JSON", "high", "medium", settled & json_open & private),
        ("DYN_PUBLIC_API_JSON_REVIEW", "info", "low", settled & json_open & ~private & (path.startswith("/api") | ~path.isin(*DEFAULT_PATHS))),
        ("DYN_SENSITIVE_RESPONSE_CACHE_POLICY_WEAK", "high", "medium", settled & known & (secret | leak) & ~cached),
        ("DYN_SOURCE_MAP_ACCESSIBLE", "medium", "high", settled & path.endswith(".map") & ok & document & F.contains(begin, F.lit('"version"')) & F.contains(begin, F.lit('"sources"')) & F.contains(begin, F.lit('"mappings"'))),
        ("DYN_OPENAPI_EXPOSED", "medium", "medium", settled & path.rlike("/(?:swagger|openapi)\\.json$") & ok & document & begin.rlike('"(?:openapi|swagger)"') & F.contains(begin, F.lit('"paths"'))),
        ("DYN_CORS_WILDCARD_CREDENTIALS", "high", "high", settled & options & (origin == "*") & credentials),
        ("DYN_CORS_ORIGIN_REFLECTION_CREDENTIALS", "critical", "high", settled & options & reflected & credentials),
        ("DYN_CORS_ORIGIN_REFLECTION", "high", "high", settled & options & reflected & ~credentials),
        ("DYN_CORS_NULL_ORIGIN", "high", "medium", settled & options & (F.lower(origin) == "null")),
        ("DYN_CORS_WILDCARD", "medium", "medium", settled & options & (origin == "*") & ~credentials),
        ("DYN_SECURITY_HEADERS_MISSING", "medium", "medium", settled & root & lacks),
        ("DYN_HSTS_MISSING", "medium", "high", settled & root & https & ~has("strict-transport-security")),
        ("DYN_DEBUG_ERROR_LEAK", "high", "medium", settled & debug),
        ("DYN_DIRECTORY_LISTING", "medium", "medium", settled & low.rlike("<title>index of /|directory listing for")),
        ("DYN_EXPOSED_ENV_FILE", "critical", "high", settled & deep & path.endswith("/.env") & ~html & (env_lines >= 2) & F.substring(body, 1, 8192).rlike(ENV_WORDS)),
        ("DYN_EXPOSED_GIT_CONFIG", "high", "high", settled & deep & path.endswith("/.git/config") & ~html & F.contains(begin, F.lit("[core]")) & begin.rlike("repositoryformatversion|\\[remote ")),
        ("DYN_EXPOSED_BACKUP_OR_DUMP", "critical", "high", settled & deep & path.rlike("\\.(?:sql|zip)$") & ~html & ((path.endswith(".zip") & body.startswith("PK")) | F.upper(begin).rlike(DUMP))),
        ("DYN_PUBLIC_DEBUG_ENDPOINT", "high", "medium", settled & deep & debug_page),
    )
    row = lambda rule, severity, confidence: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
    hits = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), row(*r)) for *r, test in rules]))
    counted = responses.filter("status is not null").withColumn("__c", counts)
    counted = counted.select("*", "__c.*", F.lit(0).alias("person"), F.lit(0).alias("records")).drop("__c")
    tiered = response_tier(counted, F.contains(kind, F.lit("html")))
    keys = [c for c in responses.columns if c not in ("headers", "body_sample")]
    return tiered.withColumn("r", F.explode(hits)).select(*keys, "r.*")
