"""Findings over findings: dedupe, correlation, triage, policy, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.functions import scalars as S

# --- J1 composite rules -----------------------------------------------------------------------
# Rule ids, label sets, severity, confidence.
COMPOSITES = (
    ("KR_COMBO_PERSON_PHONE", ("PERSON", "PHONE"), "high", "high"),
    ("KR_COMBO_PERSON_EMAIL", ("PERSON", "EMAIL"), "high", "high"),
    ("KR_COMBO_PERSON_ADDRESS", ("PERSON", "ADDRESS"), "high", "high"),
    ("KR_COMBO_PERSON_BIRTHDATE", ("PERSON", "BIRTHDATE"), "high", "high"),
    ("KR_COMBO_PERSON_RRN", ("PERSON", "RRN"), "critical", "high"),
    ("KR_COMBO_PERSON_CI", ("PERSON", "CI"), "critical", "high"),
    ("KR_COMBO_PERSON_DI", ("PERSON", "DI"), "critical", "high"),
    ("KR_COMBO_PERSON_BANK_ACCOUNT", ("PERSON", "BANK_ACCOUNT"), "critical", "high"),
    ("KR_COMBO_PERSON_CREDIT_CARD", ("PERSON", "CREDIT_CARD"), "critical", "high"),
    ("KR_COMBO_PERSON_HEALTH_INSURANCE", ("PERSON", "HEALTH_INSURANCE_ID"), "critical", "high"),
    ("KR_COMBO_PERSON_ACCOUNT_ID", ("PERSON", "ACCOUNT_ID"), "high", "medium"),
    ("KR_COMBO_PERSON_PATIENT_ID", ("PERSON", "PATIENT_ID"), "high", "high"),
    ("KR_COMBO_PHONE_ADDRESS", ("PHONE", "ADDRESS"), "high", "medium"),
    ("KR_COMBO_EMAIL_ORDER", ("EMAIL", "ORDER_ID"), "medium", "medium"),
    ("KR_COMBO_IP_ACCOUNT_TIME", ("IP_ADDRESS", "ACCOUNT_ID", "TIMESTAMP"), "high", "medium"),
    ("KR_COMBO_VEHICLE_LOCATION_TIME", ("VEHICLE_NUMBER", "LOCATION", "TIMESTAMP"), "high", "medium"),
    ("KR_COMBO_MEDICAL_DIRECT_IDENTIFIER", ("MEDICAL_INFO", "PERSON"), "critical", "high"),
    ("KR_COMBO_MEDICAL_PATIENT_ID", ("MEDICAL_INFO", "PATIENT_ID"), "critical", "high"),
    ("KR_COMBO_SENSITIVE_DIRECT_IDENTIFIER", ("SENSITIVE_INFO", "PERSON"), "critical", "high"),
    ("KR_COMBO_SENSITIVE_ACCOUNT_ID", ("SENSITIVE_INFO", "ACCOUNT_ID"), "high", "medium"),
)
# End of the fixed values.


def composites(entities: DataFrame, keys: list[str], rules: tuple = COMPOSITES) -> DataFrame:
    """Rules whose labels all occur in one group (CSV row, bracketed block, or line).

    The rule table is a literal of the plan, so the subset test is an array expression on each group
    and no join is planned. Outside rows and blocks, high confidence becomes medium. ``components``
    hold the first entity of each label by line.
    """
    structured = F.col("context").rlike("^(csv_row:|jsonish_block:)")
    scope = F.when(structured, F.col("context")).otherwise(F.concat(F.lit("same_line:"), F.col("line_no").cast("string")))
    label = F.when(F.col("label") == "RRN_VALID", "RRN").otherwise(F.col("label"))
    place = F.struct("line_no", "seq")
    item = F.struct("line_no", "seq", "label", "evidence")
    # The first entity of each label, with partial minima: a group has no more rows than there are labels.
    firsts = entities.withColumns({"scope": scope, "label": label}).groupBy(*keys, "scope", "label").agg(F.min_by(item, place).alias("item"))
    grouped = firsts.groupBy(*keys, "scope").agg(F.array_sort(F.collect_list("item")).alias("items"))
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, ls)).alias("labels"), F.lit(s).alias("severity"), F.lit(c).alias("confidence")) for n, ls, s, c in rules])
    have = F.transform("items", lambda x: x["label"])
    hits = grouped.withColumn("have", have).withColumn("rule", F.explode(F.filter(table, lambda r: F.size(F.array_except(r["labels"], F.col("have"))) == 0)))
    parts = F.transform(F.col("rule.labels"), lambda name: F.filter(F.col("items"), lambda x: x["label"] == name)[0])
    confidence = F.when(F.col("scope").startswith("same_line:") & (F.col("rule.confidence") == "high"), "medium").otherwise(F.col("rule.confidence"))
    return hits.select(*keys, "scope", F.col("rule.name").alias("rule_id"), F.col("rule.severity").alias("severity"), confidence.alias("confidence"), parts.alias("components"))


# --- J2 cross-plane ---------------------------------------------------------------------------
PRIVACY = "^(PII_|KR_COMBO_|KR_DATA_(UNIQUE|SENSITIVE|LINKABLE)|DYN_RESPONSE_PII|CONNECTOR_(PII|SCHEMA)|MCP_TOOL_RESULT_PII)"
AGENTIC = "AGENTIC|LLM"
EXTERNAL = "EXTERNAL_HTTP|EXTERNAL_SINK|EXFIL"
AT_REST = "^CONNECTOR_.*(PII|SECRET|SCHEMA)"


def cross_plane(findings: DataFrame, scope: str = "scope", limit: int = 30) -> DataFrame:
    """Scopes that hold personal data and a sink, and the project-level rule (whose sinks may be of low confidence)."""
    rule = F.col("rule_id")
    privacy, agentic, external = rule.rlike(PRIVACY), rule.rlike(AGENTIC), rule.rlike(EXTERNAL)
    sure = F.col("confidence") != "low"
    by_scope = findings.groupBy(scope).agg(F.count_if(privacy).alias("privacy_count"), F.count_if(agentic & sure).alias("agentic"), F.count_if(external & sure).alias("external"))
    out = by_scope.filter((F.col("privacy_count") > 0) & (F.col("agentic") + F.col("external") > 0))
    kinds = F.array(F.struct(F.lit("CROSS_PLANE_TO_AGENTIC_SINK").alias("rule_id"), F.lit("critical").alias("severity"), F.col("agentic").alias("sink_count")), F.struct(F.lit("CROSS_PLANE_TO_EXTERNAL_SINK").alias("rule_id"), F.lit("high").alias("severity"), F.col("external").alias("sink_count")))
    rows = out.select(F.col(scope).alias("scope"), "privacy_count", F.explode(F.filter(kinds, lambda k: k["sink_count"] > 0)).alias("k")).select("scope", "privacy_count", "k.*").withColumn("confidence", F.lit("medium"))
    whole = findings.agg(F.count_if(rule.rlike(AT_REST)).alias("privacy_count"), F.count_if(agentic | external).alias("sink_count")).filter("privacy_count > 0 and sink_count > 0")
    project = whole.select(F.lit("project").alias("scope"), "privacy_count", F.lit("CROSS_PLANE_AT_REST_WITH_FLOW").alias("rule_id"), F.lit("high").alias("severity"), "sink_count", F.lit("low").alias("confidence"))
    return rows.unionByName(project).orderBy(S.rank(F.col("severity")), "scope", "rule_id").limit(limit)


# --- J3 nearest sink --------------------------------------------------------------------------
def nearest_sinks(sources: DataFrame, sinks: DataFrame, keys: list[str], distance: int = 30, edges: int = 60, per_rule: int = 20) -> DataFrame:
    """For each source and sink kind the nearest sink within ``distance`` lines of the same file.

    sources (keys, line, seq), sinks (keys, line, seq, kind). Ties go to the first sink. Distances are
    bucketed, so the join is an equality on file and bucket, not all pairs of a file.
    """
    bucket = F.floor(F.col("line") / distance)
    left = sources.select(*keys, F.col("line").alias("source_line"), F.col("seq").alias("source_seq"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    right = sinks.select(*keys, F.col("line").alias("sink_line"), F.col("seq").alias("sink_seq"), "kind", bucket.alias("bucket"))
    near = left.join(right, [*keys, "bucket"]).withColumn("gap", F.abs(F.col("source_line") - F.col("sink_line"))).filter(F.col("gap") <= distance)
    best = near.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "source_seq", "kind").orderBy("gap", "sink_seq"))).filter("__n = 1").drop("__n", "bucket")
    best = best.withColumn("__e", F.row_number().over(Window.partitionBy(*keys).orderBy("source_seq", "kind"))).filter(F.col("__e") <= edges).drop("__e")
    return best.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("source_seq"))).filter(F.col("__r") <= per_rule).drop("__r")


# --- A2 dedupe --------------------------------------------------------------------------------
EXACT_KEY = ("source", "rule_id", "file", "line_start", "line_end", "url", "method", "status", "evidence")
ACTION_KEY = ("rule_id", "file", "line_start", "line_end", "url", "method", "status", "scope", "artifact_scope")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """A2: merge findings of equal key; first by (detector_ord, seq) wins, severity and confidence are the best, components are united.

    Rules about flows to a sink share a key without source and evidence, so their traces meet in one
    row, as components ``source_trace:<source>``. Missing key columns count as null.
    """
    have = {c: F.col(c) if c in findings.columns else F.lit(None).cast("string") for c in {*EXACT_KEY, *ACTION_KEY}}
    evidence = F.coalesce(have["evidence"], F.lit(""))
    semantic = F.contains(evidence, F.lit("detector_subtype=")) & F.col("rule_id").rlike("^(WEB_|API_|AUTH_)")
    multipath = F.col("rule_id").rlike("^(AST_TAINT_|FLOW_|JS_TS_TAINT_)") | (F.contains(evidence, F.lit("source_line=")) & evidence.rlike("sink_line=|call_line="))
    action = ~F.contains(evidence, F.lit("object_ref=")) & (semantic | multipath)
    text = lambda names: F.to_json(F.array(*[F.coalesce(have[c].cast("string"), F.lit("\u0000")) for c in names]))
    key = F.when(action, F.concat(F.lit("sink-action"), text(ACTION_KEY))).otherwise(F.concat(F.lit("exact"), text(EXACT_KEY)))
    order = F.struct("detector_ord", "seq")
    kind = "array<struct<label:string,evidence:string,line:int>>"
    own = F.coalesce(F.col("components").cast(kind), F.array().cast(kind)) if "components" in findings.columns else F.array().cast(kind)
    line = F.coalesce(F.regexp_extract(evidence, r"\bsource_line=(\d+)\b", 1).try_cast("int"), F.col("line_start").cast("int"))
    trace = F.struct(F.concat(F.lit("source_trace:"), F.col("source")).alias("label"), evidence.alias("evidence"), line.alias("line"))
    rows = findings.withColumn("__key", key).withColumn("__action", action).withColumn("__pair", F.to_json(F.struct("source", "evidence")))
    merged = rows.groupBy("__key").agg(
        F.min_by(F.struct(*[c for c in findings.columns if c not in {"severity", "confidence", "audit_depth", "components"}]), order).alias("first"),
        F.min(S.rank(F.col("severity"))).alias("sev"), F.min(S.rank(F.col("confidence"), S.CONFIDENCES)).alias("conf"),
        *([F.max("audit_depth").alias("audit_depth")] if "audit_depth" in findings.columns else []),
        (F.first("__action") & (F.min("__pair") != F.max("__pair"))).alias("traced"), F.count("*").alias("merged_count"),
    )
    # Components: the first of equal ones, so that what one key gathers is its distinct components, not its rows.
    parts = F.concat(F.transform(own, lambda c: F.struct(c.alias("c"), F.lit(0).alias("kind"))), F.when(F.col("__action"), F.array(F.struct(trace.cast("struct<label:string,evidence:string,line:int>").alias("c"), F.lit(1).alias("kind")))).otherwise(F.array().cast("array<struct<c:struct<label:string,evidence:string,line:int>,kind:int>>")))
    spread = rows.select("__key", order.alias("o"), F.posexplode(parts).alias("at", "p")).groupBy("__key", F.col("p.c").alias("c"), F.col("p.kind").alias("kind")).agg(F.min(F.struct(F.col("p.kind").alias("kind"), "o", "at")).alias("place"))
    components = spread.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("all"))
    names = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    every = F.coalesce("all", F.array().cast(components.schema["all"].dataType))
    kept = F.transform(F.filter(every, lambda x: F.col("traced") | (x["place"]["kind"] == 0)), lambda x: x["c"])
    return merged.join(components, "__key", "left").select(
        "first.*", names(S.SEVERITIES, F.col("sev")).alias("severity"), names(S.CONFIDENCES, F.col("conf")).alias("confidence"),
        *([F.col("audit_depth")] if "audit_depth" in findings.columns else []), F.array_distinct(kept).alias("components"), "merged_count",
    )


def ordered(findings: DataFrame) -> DataFrame:
    """The total order of a report."""
    return findings.orderBy(S.rank(F.col("severity")), F.coalesce("file", F.lit("")), F.coalesce("line_start", F.lit(0)), "rule_id", "evidence")


def first_ordered(findings: DataFrame, n: int, *ties: str) -> DataFrame:
    """The first ``n`` findings of that order (``ties`` behind it) with their place; Spark keeps ``n`` rows a task."""
    order = [S.rank(F.col("severity")), F.coalesce("file", F.lit("")), F.coalesce("line_start", F.lit(0)), "rule_id", "evidence", *ties]
    first = findings.orderBy(*order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # n rows


def policy_projection(findings: DataFrame, legacy: Column, current: Column) -> DataFrame:
    """By rule how many findings either policy holds, which ones the current one lost or added, and whether it lost none."""
    rows = findings.select("rule_id", F.coalesce(legacy, F.lit(False)).alias("l"), F.coalesce(current, F.lit(False)).alias("c"))
    lost = F.count_if(F.col("l") & ~F.col("c"))
    return rows.groupBy("rule_id").agg(F.count_if("l").alias("legacy"), F.count_if("c").alias("held"), lost.alias("lost"), F.count_if(F.col("c") & ~F.col("l")).alias("added"), (lost == 0).alias("kept_all"))


# --- P2, P3, P4 scopes and lanes ----------------------------------------------------------------
DIRECT_SCOPES = ("runtime_source", "configuration", "database_migration", "deployable_artifact", "workspace_evidence")
SUPPORTING_SCOPES = ("benchmark", "content_data", "documentation", "example", "generated", "repository_asset", "test_fixture", "third_party")
#: Rules that block without review, by policy version (fixed values).
AUTOMATIC_RULES = {
    "v6": ("AUTH_JWT_DECODE_WITHOUT_VERIFY", "CONFIG_CSP_UNSAFE_EVAL", "MCP_STATIC_CREDENTIAL_IN_CONFIG", "WEB_UNTRUSTED_INPUT_TO_COMMAND", "WEB_UNTRUSTED_INPUT_TO_CODE_EXECUTION"),
    "v5": ("AUTH_JWT_DECODE_WITHOUT_VERIFY", "CONFIG_CSP_UNSAFE_EVAL", "CONFIG_GHA_MUTABLE_ACTION_REF", "MCP_STATIC_CREDENTIAL_IN_CONFIG", "WEB_UNTRUSTED_INPUT_TO_COMMAND", "WEB_UNTRUSTED_INPUT_TO_CODE_EXECUTION"),
}
INTEGRITY = (
    "^(DB_POLICY_ANALYSIS_INCOMPLETE|STATIC_ANALYSIS_LIMIT_REACHED)$|^(DEEP_ANALYSIS_|GUARDIAN_RELEASE_|GUARDIAN_SCAN_|GUARDIAN_TARGET_|MCP_ARGUMENT_BUDGET_|MCP_EXHAUSTIVE_|MCP_GUARDIAN_|MCP_SCAN_INVENTORY_|MCP_SECURITY_GATE_|MCP_WORKSPACE_|SCA_COVERAGE_)"
    "|(_ANALYSIS_INCOMPLETE|_CONTRACT_INVALID|_COVERAGE_INCOMPLETE|_EVIDENCE_MISSING|_LIMIT_REACHED|_PARSE_FAILED)$"
)
REPOSITORY_WIDE = "^(CONNECTOR_SECRET_AT_REST|KR_PII_|PII_|SECRET_)"
MANUAL = "^(KR_|PII_|SECRET_)"

# Path parts by scope, in the order of the cascade, and lock files.
PATH_PARTS = (
    ("test_fixture", ("test", "tests", "fixture", "fixtures", "__tests__", "spec", "specs")),
    ("benchmark", ("benchmark", "benchmarks")),
    ("documentation", ("doc", "docs", "documentation", "tutorial", "tutorials")),
    ("example", ("example", "examples", "demo", "demos", "sample", "samples")),
    ("deployable_artifact", ("build", "dist", "generated", ".next", ".nuxt")),
    ("generated", ("coverage",)),
    ("third_party", ("bower_components", "third-party", "third_party", "vendor", "vendors")),
    ("content_data", ("content", "data", "locales", "locale", "i18n", "translations", "translation")),
)
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "uv.lock", "go.sum", "cargo.lock", "composer.lock", "gemfile.lock")


def artifact_scope(path: Column) -> Column:
    """Scope of a path by an ordered cascade; null or empty is the workspace itself."""
    clean = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(clean, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")
    out = F.when(F.coalesce(path, F.lit("")) == "", "workspace_evidence")
    for scope, values in PATH_PARTS:
        hit = F.arrays_overlap(parts, F.array(*map(F.lit, values)))
        if scope == "test_fixture":
            hit = hit | stem.startswith("test_") | name.rlike("\\.test\\.|\\.spec\\.|_test\\.")
        elif scope == "documentation":
            hit = (F.array_contains(parts, "resources") & F.arrays_overlap(parts, F.array(F.lit("lesson"), F.lit("lessons")))) | hit | stem.isin("readme", "changelog", "contributing", "security", "code_of_conduct", "license") | name.startswith("readme.")
        elif scope == "example":
            hit = hit | (name.rlike("demo|example|sample|template") & name.rlike("config|configuration|env|mcp|settings"))
        out = out.when(hit, scope)
        if scope == "example":
            out = out.when(name.isin(*LOCKFILES), "repository_asset")
    return (
        out.when(name.rlike("(?<=.)\\.(json|yaml|yml|toml|ini|conf|env|dockerfile)$") | name.isin("dockerfile", "compose.yaml", "compose.yml"), "configuration")
        .when(name.rlike("(?<=.)\\.(cjs|cts|js|jsx|mjs|mts|ts|tsx|py|go|java|kt|php|rb|cs|html|htm|vue|svelte|sql|prisma)$"), "runtime_source")
        .otherwise("repository_asset")
    )


def release_lane(policy: str = "v6", threshold: str = "high") -> Column:
    """Lane of a finding (severity, artifact_scope, rule_id, confidence); an unknown policy or scope holds it."""
    if policy not in AUTOMATIC_RULES:
        return F.lit("policy_integrity_hold")
    rule, scope = F.coalesce("rule_id", F.lit("")), F.coalesce("artifact_scope", F.lit(""))
    confidence = F.coalesce("confidence", F.lit("low"))
    return (
        F.when(~S.at_least(F.coalesce("severity", F.lit("info")), threshold), "supporting_review")
        .when(~scope.isin(*DIRECT_SCOPES, *SUPPORTING_SCOPES) | rule.rlike(INTEGRITY), "policy_integrity_hold")
        .when(scope.isin(*SUPPORTING_SCOPES), F.when((scope != "third_party") & (confidence == "high") & rule.rlike(REPOSITORY_WIDE), "manual_review_hold").otherwise("supporting_review"))
        .when((rule == "CONFIG_DOCKER_SOCK") | (confidence != "high") | rule.rlike(MANUAL) | ~rule.isin(*AUTOMATIC_RULES[policy]), "manual_review_hold")
        .otherwise("release_blocking")
    )


def triage(findings: DataFrame, limit: int = 50) -> DataFrame:
    """Groups by rule, severity and scope: lane, counts, at most five hashed locations, in priority order."""
    scope = F.coalesce("artifact_scope", F.lit("workspace_evidence"))
    place = S.hmac16(F.concat(F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce("line_start", F.lit(0)).cast("string")))
    rows = findings.withColumn("artifact_scope", scope).withColumn("lane", release_lane()).withColumn("place", place)
    group = ["rule_id", "severity", "artifact_scope"]
    places = rows.groupBy(*group, "place").agg(F.count("*").alias("n"))  # distinct, with partial sums
    five = places.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("place"))).filter("k <= 5")
    refs = five.groupBy(*group).agg(F.array_sort(F.collect_list("place")).alias("location_refs"))
    counted = rows.groupBy(*group).agg(
        F.min_by("lane", F.struct("detector_ord", "seq", "file")).alias("priority_lane"), F.count("*").alias("finding_count"),
        F.count_distinct(F.when(F.col("file") != "", F.col("file"))).alias("affected_file_count"), F.bool_or(F.col("lane") != "supporting_review").alias("blocking"),
    )
    grouped = counted.join(refs, group).select(*group, "priority_lane", "finding_count", "affected_file_count", "location_refs", "blocking")
    return grouped.orderBy(F.desc("blocking"), S.rank(F.col("severity")), F.desc("finding_count"), "rule_id", "artifact_scope").limit(limit)


def severity_summary(findings: DataFrame) -> DataFrame:
    """A1: one row, a column for each severity, zeros filled in."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES])


# --- J8, P9, P12 suppression --------------------------------------------------------------------
UNSUPPRESSIBLE = "^(GUARDIAN_|SUPPRESSION_|MCP_SECURITY_GATE_|SCA_COVERAGE_)"
SUPPRESSION_KEY = ("app_id", "audit_profile", "release_scope_hash", "target_id", "rule_id", "finding_fingerprint")


def policy_row_error(as_of: str, profile: str = "korean_senior") -> Column:
    """The first fault of a suppression row, or an empty string."""
    required = (*SUPPRESSION_KEY, "owner", "reason", "expires")
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing_{c}")) for c in required]
    day = F.when(F.col("expires").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("expires", "yyyy-MM-dd"))
    return F.coalesce(*missing, F.when(F.col("audit_profile") != profile, "audit_profile_must_match"), F.when(~F.col("release_scope_hash").rlike("^[0-9a-f]{16,64}$"), "invalid_release_scope_hash"), F.when(day.isNull(), "invalid_expires"), F.when(day < F.lit(as_of).cast("date"), "expired"), F.lit(""))


def suppress(findings: DataFrame, policy: DataFrame, as_of: str) -> DataFrame:
    """Findings with ``disposition`` kept, suppressed or violation (an unsuppressible rule that a row names).

    Rows with a fault match nothing. File and line of a row bind only where given. The policy is a
    hand-written table; Spark broadcasts it by its size.
    """
    rows = policy.withColumn("error", policy_row_error(as_of)).filter("error = ''")
    keyed = rows.select(*[F.col(c).alias(f"p_{c}") for c in SUPPRESSION_KEY], F.coalesce("file", F.lit("")).alias("p_file"), F.coalesce(F.col("line_start").cast("string"), F.lit("")).alias("p_line"))
    on = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(f"p_{c}") for c in SUPPRESSION_KEY])
    on = on & F.col("p_file").isin("") | on & (F.col("p_file") == F.coalesce("file", F.lit("")))
    hit = findings.withColumn("__id", F.monotonically_increasing_id()).join(keyed, on, "left")
    hit = hit.withColumn("__hit", F.col("p_app_id").isNotNull() & ((F.col("p_line") == "") | (F.col("p_line") == F.coalesce(F.col("line_start").cast("string"), F.lit("")))))
    one = hit.groupBy("__id", *findings.columns).agg(F.bool_or("__hit").alias("__hit"))
    disposition = F.when(~F.col("__hit"), "kept").when(F.col("rule_id").rlike(UNSUPPRESSIBLE), "violation").otherwise("suppressed")
    return one.withColumn("disposition", disposition).drop("__id", "__hit")


# --- O3, O4, O5, O8 set operations ----------------------------------------------------------------
def drift(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """O3: rows new in ``current`` and resolved since ``previous``, by key."""
    a, b = current.select(*key).distinct(), previous.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("drift", F.lit("new")).unionByName(b.join(a, key, "left_anti").withColumn("drift", F.lit("resolved")))


def jaccard(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Shared, united and their ratio (1.0 if both are empty)."""
    both = a.select(*key).distinct().withColumn("a", F.lit(1)).unionByName(b.select(*key).distinct().withColumn("a", F.lit(2))).groupBy(*key).agg(F.sum("a").alias("s"))
    counted = both.agg(F.count_if(F.col("s") == 3).alias("shared"), F.count("*").alias("united"))
    return counted.withColumn("jaccard", F.when(F.col("united") > 0, F.round(F.col("shared") / F.col("united"), 6)).otherwise(F.lit(1.0)))


def multiset_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose multiplicity differs, with both counts; no row means equal."""
    both = a.select(*key, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*key, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return both.groupBy(*key).agg(F.sum("x").alias("left_count"), F.sum("y").alias("right_count")).filter("left_count != right_count")


def multiset_minus(rows: DataFrame, removed: DataFrame, key: list[str], order: str) -> DataFrame:
    """``rows`` without as many of each key as ``removed`` holds, the first ones going."""
    counts = removed.groupBy(*key).agg(F.count("*").alias("__gone"))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("__turn", turn).join(counts, key, "left").filter(F.col("__turn") > F.coalesce("__gone", F.lit(0))).drop("__turn", "__gone")


# --- A18, A19, A5 roll-ups -------------------------------------------------------------------------
def top_rules(findings: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent rules with their share; ties by name."""
    counts = findings.groupBy("rule_id").agg(F.count("*").alias("finding_count"))
    return counts.withColumn("share", F.round(F.col("finding_count") / F.sum("finding_count").over(Window.partitionBy()), 4)).orderBy(F.desc("finding_count"), "rule_id").limit(k)


#: Recipes: exact rule, prefix, or default.
RECIPES = (("PII_CREDIT_CARD", "remove_card_data"), ("PII_", "minimize_personal_data"), ("SECRET_", "rotate_and_remove"), ("", "review_manually"))


def recipe(rule: Column) -> Column:
    out = None
    for prefix, name in RECIPES:
        test = (rule == prefix) if prefix and not prefix.endswith("_") else rule.startswith(prefix)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def fix_plan(findings: DataFrame, target: str, k: int = 20) -> DataFrame:
    """Per rule worst severity, counts, distinct targets, histogram of scopes, recipe."""
    by_scope = findings.groupBy("rule_id", "artifact_scope").agg(F.count("*").alias("n"), F.min(S.rank(F.col("severity"))).alias("sev"))
    scopes = by_scope.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("artifact_scope", F.lit("="), F.col("n").cast("string")))), ",").alias("scope_histogram"), F.min("sev").alias("sev"), F.sum("n").alias("finding_count"))
    targets = findings.groupBy("rule_id").agg(F.count_distinct(target).alias("target_count"))
    return scopes.join(targets, "rule_id").select("rule_id", F.element_at(F.array(*map(F.lit, S.SEVERITIES)), F.col("sev") + 1).alias("max_severity"), "finding_count", "target_count", "scope_histogram", recipe(F.col("rule_id")).alias("recipe"), "sev").orderBy("sev", F.desc("finding_count"), "rule_id").limit(k).drop("sev")


# --- O9 atoms ----------------------------------------------------------------------------------
def canonical_atoms(atoms: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The kept atom of each duplicate key, and the ledger (removed to kept)."""
    order = [S.rank(F.col("severity")), F.col("actionable").cast("int"), F.col("rule_id"), F.col("parent_id"), F.col("atom_id")]
    w = Window.partitionBy(*key)
    ranked = atoms.withColumn("__n", F.row_number().over(w.orderBy(*order))).withColumn("kept_atom_id", F.first("atom_id").over(w.orderBy(*order)))
    return ranked.filter("__n = 1").drop("__n", "kept_atom_id"), ranked.filter("__n > 1").select(*key, "kept_atom_id", F.col("atom_id").alias("removed_atom_id"))
