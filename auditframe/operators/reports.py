"""Aggregates of reports: language packs, targets, intents, feedback, queues, probes, mutations, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions import scalars as S
from auditframe.operators import setdigest


def pack_score(cases: DataFrame, findings: DataFrame, by: str = "language") -> DataFrame:
    """Confusion counts and rates of labelled files by language and overall (``__all__``).

    cases (file, language, expected vulnerable or clean, rule_id), findings (file, rule_id). A vulnerable
    file counts by the expected rule alone, a clean one by any finding.
    """
    per = findings.groupBy("file", "rule_id").agg(F.count("*").alias("n"))
    every = per.groupBy("file").agg(F.sum("n").alias("any"))
    rows = cases.join(per, ["file", "rule_id"], "left").join(every, "file", "left")
    bad, hit = F.col("expected") == "vulnerable", F.when(F.col("expected") == "vulnerable", F.col("n").isNotNull()).otherwise(F.col("any").isNotNull())
    flags = rows.select(F.col(by).alias("category"), bad.alias("t"), hit.alias("p"))
    counts = [F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"), F.count_if(~F.col("t") & ~F.col("p")).alias("tn")]
    out = flags.rollup("category").agg(*counts).withColumn("category", F.coalesce("category", F.lit("__all__")))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"recall": S.rate(tp, tp + fn, 6), "specificity": S.rate(tn, tn + fp, 6), "precision": S.rate(tp, tp + fp, 6)})


def unmapped_findings(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of files without a case, and of vulnerable files under another rule than the expected one."""
    known = cases.select("file", "expected", F.col("rule_id").alias("wanted"))
    return findings.join(known, "file", "left").filter(F.col("expected").isNull() | ((F.col("expected") == "vulnerable") & (F.col("rule_id") != F.col("wanted")))).drop("expected", "wanted")


def target_summary(targets: DataFrame) -> DataFrame:
    """One row over targets (kind, status, passed, coverage_gap, and a count column for each severity)."""
    def histogram(name: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e), ",").alias(name)

    parts = {}
    for name in ("kind", "status"):
        counts = targets.groupBy(F.coalesce(F.col(name), F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))
        parts[name] = counts.withColumn("e", F.concat("k", F.lit("="), F.col("n").cast("string"))).agg(histogram(f"{name}_counts"))
    one = targets.agg(
        F.count("*").alias("target_count"), F.count_if(~F.coalesce("passed", F.lit(True))).alias("blocking_target_count"), F.count_if(F.coalesce("coverage_gap", F.lit(False))).alias("coverage_gap_target_count"),
        *[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in S.SEVERITIES],
    )
    return one.join(parts["kind"]).join(parts["status"])  # one row each


#: What an intent contract asks of each target.
INTENTS = ("purpose_present", "purpose_explicit", "data_class_present", "user_scope_present", "scope_assertion_present")


def intent_contract(targets: DataFrame, intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """Of each boolean column how many targets have it, and whether all do (no target at all is complete)."""
    counted = targets.agg(F.count("*").alias("target_count"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"{c}_count") for c in intents])
    return counted.withColumns({f"{c}_complete": F.col(f"{c}_count") == F.col("target_count") for c in intents})


def feedback_export(lines: DataFrame, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """Counts (facet type or rule, name, n; facet invalid for lines that are no JSON object) and the parsed rows.

    Blank lines do not count; missing fields are ``unknown``.
    """
    parsed = lines.filter(F.trim(text) != "").withColumn("r", F.from_json(text, "struct<type:string,rule:string,text:string>", {"mode": "PERMISSIVE"}))
    good = F.col(text).rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(F.col(text)).isNotNull()
    rows = parsed.withColumn("ok", F.coalesce(good, F.lit(False))).select(*[c for c in lines.columns if c != text], "ok", F.coalesce("r.type", F.lit("unknown")).alias("type"), F.coalesce("r.rule", F.lit("unknown")).alias("rule"), F.coalesce("r.text", F.lit("")).alias("text"))
    facets = F.when(F.col("ok"), F.array(F.struct(F.lit("type").alias("facet"), F.col("type").alias("name")), F.struct(F.lit("rule").alias("facet"), F.col("rule").alias("name")))).otherwise(F.array(F.struct(F.lit("invalid").alias("facet"), F.lit("").alias("name"))))
    counts = rows.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.name").agg(F.count("*").alias("n"))
    return counts, rows.filter("ok").drop("ok")


VERDICTS = ("true_positive", "false_positive", "false_negative", "inconclusive", "benign")


def claim_status(reviews: DataFrame) -> DataFrame:
    """Rates of review verdicts over a sample (app_id, verdict, reviewed, valid), and the first reason against a claim.

    Rates are over valid reviewed rows; a candidate is any row.
    """
    seen = F.col("reviewed") & F.col("valid")
    c = reviews.agg(F.count_distinct("app_id").alias("apps"), F.count("*").alias("candidates"), F.count_if(seen).alias("reviewed"), F.count_if(F.col("reviewed") & ~F.col("valid")).alias("invalid"), *[F.count_if(seen & (F.col("verdict") == v)).alias(v) for v in VERDICTS])
    status = (
        F.when(F.col("invalid") > 0, "blocked_invalid_review_labels").when(F.col("apps") < 5, "insufficient_design_partner_sample").when(F.col("apps") > 20, "sample_scope_too_broad_for_manual_claim")
        .when(F.col("false_negative") > 0, "blocked_false_negatives_need_rule_work").when(F.col("benign") > 0, "blocked_benign_high_critical_labels")
        .when((F.col("candidates") < 5) | (F.col("reviewed") < 5), "insufficient_candidate_review_coverage")
        .when((F.col("reviewed") < F.col("candidates")) | (F.col("inconclusive") > 0), "manual_review_incomplete").otherwise("validation_sample_ready")
    )
    rates = [F.round(F.col(v) / F.greatest("reviewed", F.lit(1)), 6).alias(f"{v}_rate") for v in VERDICTS]
    return c.select("apps", "candidates", "reviewed", *rates, status.alias("claim_status"))


def queue_summary(candidates: DataFrame) -> DataFrame:
    """One row over review candidates (location_kind, severity, response_hash): counts by kind and severity, hashed and null ones."""
    source, response = F.col("location_kind") == "source", F.col("location_kind") == "response"
    return candidates.agg(
        F.count("*").alias("candidate_count"), F.count_if(response).alias("response_candidate_count"), F.count_if(response & F.col("response_hash").isNotNull()).alias("response_hashed_count"),
        F.count_if(source).alias("source_candidate_count"), F.count_if(source & F.col("response_hash").isNull()).alias("source_null_response_hash_count"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES],
    )


def probe_contract(probes: DataFrame, required: DataFrame) -> DataFrame:
    """Coverage of required paths by probes (path, method, status, result, source).

    A path is reached by a GET answered 2xx, 401 or 403. Coverage is complete with a probe, without an
    error, and with every required path reached; a missing leading slash of a required path is added.
    """
    reached = (F.col("method") == "GET") & (F.col("status").between(200, 299) | F.col("status").isin(401, 403))
    paths = probes.groupBy("path").agg(F.bool_or(F.coalesce(reached, F.lit(False))).alias("reached"), F.count("*").alias("n"), F.count_if(F.col("result") == "error").alias("errors"), F.bool_or(F.coalesce(F.startswith("source", F.lit("openapi_discovered")), F.lit(False))).alias("discovered"))
    wanted = required.select(F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit("/"), "path")).alias("path")).distinct().withColumn("wanted", F.lit(True))
    both = paths.join(wanted, "path", "full")
    out = both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("request_count"), F.coalesce(F.sum("errors"), F.lit(0)).alias("error_request_count"), F.count("n").alias("observed_path_count"), F.count_if("reached").alias("successful_get_path_count"),
        F.count_if("discovered").alias("openapi_discovered_path_count"), F.count_if("wanted").alias("required_path_count"), F.count_if(F.col("wanted") & F.col("reached")).alias("required_path_reached_count"),
    )
    return out.withColumn("coverage_complete", (F.col("request_count") > 0) & (F.col("error_request_count") == 0) & (F.col("required_path_reached_count") == F.col("required_path_count")))


def mutation_outcomes(mutations: DataFrame, baseline: DataFrame, mutated: DataFrame) -> DataFrame:
    """GV4: per mutation whether its expected rule is found in the mutated tree and absent from the baseline.

    mutations (mutation_id, relative_path, expected_rule_ids), findings (file, rule_id). A file matches by its
    whole path or by a suffix of it that begins a folder; each finding stands under all such suffixes, so the join is by equality.
    """
    wanted = mutations.select("mutation_id", S.normal_path(F.col("relative_path")).alias("want"), F.explode("expected_rule_ids").alias("rule_id"))

    def hits(found: DataFrame, column: str) -> DataFrame:
        parts = F.split(F.lower(F.replace(F.coalesce("file", F.lit("")), F.lit("\\"), F.lit("/"))), "/")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
        rows = found.select(F.explode(suffixes).alias("want"), "rule_id").distinct()
        return wanted.join(rows, ["want", "rule_id"]).select("mutation_id").distinct().withColumn(column, F.lit(True))

    out = mutations.select("mutation_id").join(hits(mutated, "detected"), "mutation_id", "left").join(hits(baseline, "before"), "mutation_id", "left")
    detected, before = F.coalesce("detected", F.lit(False)), F.coalesce("before", F.lit(False))
    outcome = F.when(before, "baseline_contaminated").when(detected, "killed").otherwise("survived")
    return out.select("mutation_id", detected.alias("detected"), before.alias("in_baseline"), outcome.alias("outcome"))


BUNDLE_SCHEMA = "evidence_bundle.v1"
#: The artifacts of a subject for which the tree of its digest is laid out; it only gets wider beyond.
BUNDLE_ENTRIES = 1 << 24


def evidence_bundles(artifacts: DataFrame, subject: str, payload: Column, key: str = S.DEFAULT_KEY) -> DataFrame:
    """GV5: one signed bundle for each subject: artifact_count, artifacts_sha256, bundle_sha256, signature_sha256.

    An artifact enters by the digest of its canonical payload, equal ones by their number; the digests of a subject
    are folded in a tree (``setdigest``) of fixed depth, so a bundle does not depend on the order of rows, and no
    list holds all artifacts of a large subject.
    """
    folded = setdigest.set_digest(artifacts.select(subject, payload.alias("__payload")), F.col("__payload"), [subject], "artifacts_sha256", n=BUNDLE_ENTRIES)
    digests = folded.withColumnRenamed("n_entries", "artifact_count")
    record = S.canonical_json(F.struct(F.col("artifact_count"), F.col("artifacts_sha256"), F.lit(False).alias("raw_returned"), F.lit(BUNDLE_SCHEMA).alias("schema"), F.col(subject).cast("string").alias("subject")))
    signed = digests.withColumn("bundle_sha256", F.sha2(record, 256))
    return signed.withColumn("signature_sha256", S.hmac16(F.col("bundle_sha256"), key, 64))


def verify_bundles(bundles: DataFrame, artifacts: DataFrame, subject: str, payload: Column, key: str = S.DEFAULT_KEY) -> DataFrame:
    """GV5: per subject whether count, digest and signature of a bundle are those of its artifacts now."""
    names = ("artifact_count", "artifacts_sha256", "bundle_sha256", "signature_sha256")
    now = evidence_bundles(artifacts, subject, payload, key).select(subject, *[F.col(c).alias(f"now_{c}") for c in names])
    both = bundles.join(now, subject, "left")
    faults = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"now_{c}")), c) for c in names]))
    return both.select(subject, (F.size(faults) == 0).alias("valid"), F.array_join(faults, ",").alias("faults"))
