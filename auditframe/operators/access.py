"""Access decisions, control gates, hash chains, responses, trees, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.functions import scalars as S


def rbac(queries: DataFrame, grants: DataFrame, max_limit: int = 100) -> DataFrame:
    """Decision and first deny code of each query.

    queries (query_id, roles, db, schema, table, columns, row_limit); grants (role, db, schema, table,
    columns, max_rows). Codes in order: limit_missing, limit_exceeds_gate, no_grant, column_denied,
    limit_exceeds_grant. Of several grants the one that allows, or denies last in this order, decides.
    """
    g = grants.select("role", F.col("db").alias("g_db"), F.col("schema").alias("g_schema"), F.col("table").alias("g_table"), F.col("columns").alias("g_columns"), "max_rows")
    on = (F.col("db") == F.col("g_db")) & (F.col("schema") == F.col("g_schema")) & (F.col("table") == F.col("g_table")) & F.array_contains("roles", F.col("role"))
    hit = queries.join(g, on, "left")
    code = (
        F.when(F.col("row_limit").isNull(), 0).when(F.col("row_limit") > max_limit, 1).when(F.col("role").isNull(), 2)
        .when(F.size(F.array_except("columns", "g_columns")) > 0, 3).when(F.col("row_limit") > F.col("max_rows"), 4).otherwise(5)
    )
    worst = hit.groupBy("query_id").agg(F.max(code).alias("code"))
    names = F.array(*map(F.lit, ("limit_missing", "limit_exceeds_gate", "no_grant", "column_denied", "limit_exceeds_grant", "")))
    return worst.select("query_id", F.when(F.col("code") == 5, "allow").otherwise("deny").alias("decision"), F.element_at(names, F.col("code") + 1).alias("deny_code"))


def chain_entries(rows: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """SNK5: each row's sha256 over the digest before it and its payload is sequential; the digest of a row alone is not.

    Here an entry's digest covers its sequence number and payload, and the row names the digest of the
    one before: both are windows over the key.
    """
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("sequence", F.row_number().over(w).cast("long")).withColumn("entry_sha256", F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), payload), 256))
    return numbered.withColumn("previous_sha256", F.coalesce(F.lag("entry_sha256").over(w), F.lit("0" * 64)))


def verify_chain(entries: DataFrame, key: str, payload: Column) -> DataFrame:
    """Per key entries, faults, and the first sequence that fails: gap, wrong link or wrong digest."""
    w = Window.partitionBy(key).orderBy("sequence")
    gap = F.col("sequence") != F.coalesce(F.lag("sequence").over(w), F.lit(0)) + 1
    link = F.col("previous_sha256") != F.coalesce(F.lag("entry_sha256").over(w), F.lit("0" * 64))
    digest = F.col("entry_sha256") != F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), payload), 256)
    marked = entries.withColumn("__bad", gap | link | digest)
    return marked.groupBy(key).agg(F.count("*").alias("entries"), F.count_if("__bad").alias("faults"), F.min(F.when(F.col("__bad"), F.col("sequence"))).alias("first_fault"))


def response_tier(counts: DataFrame, html: Column) -> DataFrame:
    """D-HTTP2: tier of a response by counts of labels (strong, person, email, phone, records); HTML counts strong ids only."""
    contacts = F.col("email") + F.col("phone")
    tier = (
        F.when(F.col("strong") > 0, "strong_identifier").when(html, F.lit(None).cast("string"))
        .when(((F.col("person") >= 3) & (contacts >= 3)) | (contacts >= 8) | (F.col("records") >= 12), "bulk_records")
        .when((F.col("person") >= 1) & (contacts >= 1), "linked_record").when(contacts >= 3, "contact_cluster")
    )
    return counts.withColumn("tier", F.coalesce(tier, F.lit("none")))


def response_rules(responses: DataFrame) -> DataFrame:
    """D-HTTP1: rules on status and headers (map of lower-case names), one row each."""
    h = lambda name: F.coalesce(F.col("headers")[name], F.lit(""))
    cookie = F.lower(h("set-cookie"))
    https = F.col("url").startswith("https://")
    listing = F.lower("body_sample").rlike("<title>index of /")
    rules = {
        "DYN_COOKIE_NO_HTTPONLY": ("medium", (cookie != "") & ~F.contains(cookie, F.lit("httponly"))),
        "DYN_COOKIE_NO_SECURE": ("medium", (cookie != "") & https & ~F.contains(cookie, F.lit("secure"))),
        "DYN_COOKIE_NO_SAMESITE": ("low", (cookie != "") & ~F.contains(cookie, F.lit("samesite"))),
        "DYN_CORS_WILDCARD_CREDENTIALS": ("high", (h("access-control-allow-origin") == "*") & (F.lower(h("access-control-allow-credentials")) == "true")),
        "DYN_CORS_WILDCARD": ("low", (h("access-control-allow-origin") == "*") & (F.lower(h("access-control-allow-credentials")) != "true")),
        "DYN_NO_HSTS": ("low", https & (h("strict-transport-security") == "")),
        "DYN_NO_CSP": ("low", h("content-security-policy") == ""),
        "DYN_NO_NOSNIFF": ("low", F.lower(h("x-content-type-options")) != "nosniff"),
        "DYN_HTTP_TO_HTTP_REDIRECT": ("medium", F.col("status").between(300, 399) & h("location").startswith("http://")),
        "DYN_DEBUG_TRACE": ("high", F.col("body_sample").rlike("Traceback \\(most recent call last\\)|at [\\w.$]+\\([\\w]+\\.java:\\d+\\)")),
        "DYN_DIRECTORY_LISTING": ("medium", listing),
        "DYN_EXPOSED_ENV_FILE": ("critical", F.col("url").rlike("/\\.env$") & (F.col("status") == 200) & F.col("body_sample").rlike("(?m)^[A-Z_]+=")),
        "DYN_EXPOSED_GIT": ("high", F.col("url").rlike("/\\.git/(HEAD|config)$") & (F.col("status") == 200)),
        "DYN_ADMIN_OPEN": ("high", F.col("url").rlike("/admin(/|$)") & (F.col("status") == 200) & ~F.col("authenticated")),
    }
    array = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("rule_id"), F.lit(sev).alias("severity"))) for name, (sev, test) in rules.items()]))
    return responses.select("url", F.explode(array).alias("r")).select("url", "r.*")


def through_wall(responses: DataFrame) -> DataFrame:
    """Paths whose last GET without a session shows private data, or shows other content with a session that does."""
    last = lambda rows: rows.groupBy("path").agg(F.max_by(F.struct("body_sha256", "private"), "seq").alias("r"))
    plain = last(responses.filter("method = 'GET' and not authenticated")).select("path", F.col("r.body_sha256").alias("h0"), F.col("r.private").alias("p0"))
    inside = last(responses.filter("method = 'GET' and authenticated")).select("path", F.col("r.body_sha256").alias("h1"), F.col("r.private").alias("p1"))
    both = plain.join(inside, "path")
    kind = F.when(F.col("p0") & F.col("p1"), "through_wall").when(~F.col("p0") & F.col("p1") & (F.col("h0") != F.col("h1")), "newly_revealed")
    return both.withColumn("kind", kind).filter("kind is not null").select("path", "kind")


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, sha256) trees: added, removed and changed paths with both hashes."""
    a, b = before.select("path", F.col("sha256").alias("before_sha256")), after.select("path", F.col("sha256").alias("after_sha256"))
    kind = F.when(F.col("before_sha256").isNull(), "added").when(F.col("after_sha256").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full").filter(~F.col("before_sha256").eqNullSafe(F.col("after_sha256"))).withColumn("change", kind)


def lifecycle(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests and responses by (session, id): correlated, missing_response, uncorrelated_response, duplicate ids."""
    a = requests.groupBy("session", "id").agg(F.count("*").alias("requests"), F.min("seq").alias("request_seq"))
    b = responses.groupBy("session", "id").agg(F.count("*").alias("responses"), F.min("seq").alias("response_seq"))
    both = a.join(b, ["session", "id"], "full").na.fill(0, ["requests", "responses"])
    state = (
        F.when(F.col("requests") == 0, "uncorrelated_response").when(F.col("responses") == 0, "missing_response")
        .when((F.col("requests") > 1) | (F.col("responses") > 1), "duplicate_id").when(F.col("response_seq") < F.col("request_seq"), "uncorrelated_response").otherwise("correlated")
    )
    return both.select("session", "id", "requests", "responses", state.alias("state"))


def uncovered_manifests(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """Manifests (dir, ecosystem) without a lock of their ecosystem in the same or an ancestor directory.

    A directory's ancestors are listed, so coverage is an equality join.
    """
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = locks.select(F.array_join(F.filter(F.split("dir", "/"), lambda x: x != ""), "/").alias("anc"), "ecosystem").distinct()
    covered = manifests.withColumn("anc", F.explode(ancestors)).join(held, ["anc", "ecosystem"], "left_semi").select("dir", "ecosystem").distinct()
    return manifests.join(covered, ["dir", "ecosystem"], "left_anti")


def field_controls(declarations: DataFrame, controls: DataFrame) -> DataFrame:
    """Declarations (file, line, field) and whether a control line (file, line, text) of the file names the field, or a decorator stands within two lines above.

    Control lines are spread over their words, decorators over the lines that they cover: both joins are equalities.
    """
    d = declarations.select("file", F.col("line").alias("decl_line"), "field").distinct()
    words = controls.select("file", F.explode(F.array_distinct(F.split(F.lower("text"), "[^A-Za-z0-9_]+"))).alias("word")).distinct()
    above = controls.filter(F.startswith("text", F.lit("@"))).select("file", F.explode(F.sequence(F.col("line"), F.col("line") + 2)).alias("decl_line")).distinct()
    named = d.join(words.withColumn("named", F.lit(True)), (d["file"] == words["file"]) & (F.lower("field") == F.col("word")), "left").select(d["file"], "decl_line", "field", "named")
    out = named.join(above.withColumn("near", F.lit(True)), ["file", "decl_line"], "left")
    return out.select("file", "decl_line", "field", (F.coalesce("named", F.lit(False)) | F.coalesce("near", F.lit(False))).alias("controlled"))


def grant_calls(calls: DataFrame, grants: DataFrame) -> DataFrame:
    """ST9: decision on each call (call_id, grant_id, nonce, tool, at) under time-bound grants (grant_id, tools, not_before, expires_at, max_calls).

    Codes in order: unknown_grant, not_yet_valid, expired, tool_not_granted, replayed (a nonce that an earlier
    call of the grant has used), calls_exhausted (earlier accepted calls reach max_calls). Calls count in the
    order of time and id; one grant's calls are one group, bound by its life time.
    """
    both = calls.join(grants, "grant_id", "left")
    first = F.row_number().over(Window.partitionBy("grant_id", "nonce").orderBy("at", "call_id")) == 1
    code = (
        F.when(F.col("max_calls").isNull(), "unknown_grant").when(F.col("at") < F.col("not_before"), "not_yet_valid").when(F.col("at") >= F.col("expires_at"), "expired")
        .when(~F.array_contains("tools", F.col("tool")), "tool_not_granted").when(~F.col("first"), "replayed")
    )
    judged = both.withColumn("first", first).withColumn("code", code)
    # A call that passes so far is accepted if fewer than max_calls such calls came before it.
    turn = F.sum(F.col("code").isNull().cast("int")).over(Window.partitionBy("grant_id").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    final = F.when(F.col("code").isNull() & (F.col("turn") > F.col("max_calls")), "calls_exhausted").otherwise(F.col("code"))
    return judged.withColumn("turn", turn).select("call_id", "grant_id", F.when(final.isNull(), "allow").otherwise("deny").alias("decision"), F.coalesce(final, F.lit("")).alias("deny_code"))


def budget_faults(rows: DataFrame, key: str, columns: list[str], max_rows: int, max_bytes: int, max_cell: int) -> DataFrame:
    """P10: per result (``key``) its rows, bytes and largest cell, and the first budget that it breaks, or an empty code.

    Cells count by the UTF-8 bytes of their text, nulls as 4 (their printed form). Counts are sums, so no result
    is gathered; a caller that must fail closed takes only results without a code.
    """
    sizes = [F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns]
    total = sizes[0].cast("long")
    for s in sizes[1:]:
        total = total + s
    out = rows.groupBy(key).agg(F.count("*").alias("rows"), F.sum(total).alias("bytes"), F.max(F.greatest(*sizes) if len(sizes) > 1 else sizes[0]).alias("largest_cell"))
    code = F.when(F.col("largest_cell") > max_cell, "cell_budget_exceeded").when(F.col("bytes") > max_bytes, "result_budget_exceeded").when(F.col("rows") > max_rows, "row_budget_exceeded").otherwise("")
    return out.withColumn("deny_code", code)


def line_context(lines: DataFrame, keys: list[str], above: int = 4, below: int = 2) -> DataFrame:
    """Each line with the text of the lines from ``above`` before it to ``below`` after it, as ``context``."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-above, below)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(w), "\n"))


def marker_gaps(lines: DataFrame, scope: str, signal: str, markers: dict[str, str]) -> DataFrame:
    """J16, GV2, GV3: scopes with a signal, and the markers that none of their lines has."""
    out = lines.groupBy(scope).agg(F.bool_or(F.col("line").rlike(signal)).alias("signal"), *[F.bool_or(F.col("line").rlike(p)).alias(n) for n, p in markers.items()])
    gaps = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in markers]))
    return out.filter("signal").select(scope, F.explode(gaps).alias("missing"))


SENSITIVE_COLUMN = "(?i)(rrn|ssn|resident|passport|driver|birth|phone|mobile|email|address|account|card|customer|user|name|ip_addr|ci|di)"


def sensitive_columns(columns: DataFrame) -> DataFrame:
    """SRC9: (table_name, column_name) rows whose name looks personal; short alternates match inside words."""
    return columns.filter(F.col("column_name").rlike(SENSITIVE_COLUMN)).select("table_name", "column_name", F.lower(F.regexp_extract("column_name", SENSITIVE_COLUMN, 1)).alias("matched"))


def sca_findings(packages: DataFrame) -> DataFrame:
    """D-SCA: audit payload rows (ecosystem, name, version, vulns) to findings, one for each fingerprint.

    The id is the row's own, else its first CVE or GHSA alias; severity words of other tools are mapped.
    """
    v = packages.select("ecosystem", "name", "version", F.explode("vulns").alias("v"))
    alias = F.get(F.filter("v.aliases", lambda a: a.rlike("^(CVE|GHSA)-")), 0)
    ident = F.coalesce(F.when(F.col("v.id") != "", F.col("v.id")), alias)
    word = F.lower(F.coalesce("v.severity", F.lit("")))
    severity = F.when(word.isin("critical"), "critical").when(word.isin("high", "important"), "high").when(word.isin("moderate", "medium"), "medium").when(word.isin("low", "minor"), "low").otherwise("medium")
    rows = v.select("ecosystem", "name", "version", ident.alias("vulnerability_id"), severity.alias("severity"), (F.size("v.fix_versions") > 0).alias("fixed")).filter("vulnerability_id is not null")
    return rows.withColumn("fingerprint", S.hmac16(F.concat_ws("|", "ecosystem", "name", "version", "vulnerability_id"))).dropDuplicates(["fingerprint"])
