"""Scoring against labelled cases, matching, votes, gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditframe.functions import scalars as S
from auditframe.session import ship


def confusion(rows: DataFrame, truth: str, predicted: str, by: str | None = None) -> DataFrame:
    """Tp, fp, fn, tn, rates and Wilson bounds of recall, by category and overall (``__all__``)."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    flags = rows.select(F.coalesce(F.col(by).cast("string"), F.lit("__null__")).alias("category") if by else F.lit("__all__").alias("category"), t.alias("t"), p.alias("p"))
    counts = [F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"), F.count_if(~F.col("t") & ~F.col("p")).alias("tn")]
    out = flags.rollup("category").agg(*counts).withColumn("category", F.coalesce("category", F.lit("__all__"))) if by else flags.groupBy("category").agg(*counts)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    low, high = S.wilson(tp, tp + fn)
    return out.withColumns({"precision": S.rate(tp, tp + fp, 6), "recall": S.rate(tp, tp + fn, 6), "specificity": S.rate(tn, tn + fp, 6), "fpr": S.rate(fp, fp + tn, 6), "recall_low": low, "recall_high": high})


def owasp_score(scored: DataFrame) -> DataFrame:
    """A13 over ``confusion`` rows: true positive rate less false positive rate."""
    return scored.withColumn("score", F.round(F.col("recall") - F.col("fpr"), 6))


def scoreboard(cases: DataFrame, found: DataFrame) -> DataFrame:
    """One row of a labelled corpus.

    cases (name, kind positive or negative, expected array or null); found (name, rules array).
    Recall: positives with any expected rule. FPR: over negatives without an expectation, any rule.
    Negatives with one are targeted: none of the named rules may occur.
    """
    rows = cases.join(found, "name", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    positive, negative = F.col("kind") == "positive", F.col("kind") == "negative"
    hit = F.arrays_overlap("rules", F.col("expected"))
    counted = rows.agg(
        F.count_if(positive).alias("positives"), F.count_if(positive & hit).alias("hits"),
        F.count_if(negative & F.col("expected").isNull()).alias("measurable"), F.count_if(negative & F.col("expected").isNull() & (F.size("rules") > 0)).alias("false_positives"),
        F.count_if(negative & F.col("expected").isNotNull()).alias("targeted"), F.count_if(negative & F.col("expected").isNotNull() & hit).alias("targeted_failures"),
    )
    scored = counted.withColumn("recall", S.rate(F.col("hits"), F.col("positives"))).withColumn("fpr", S.rate(F.col("false_positives"), F.col("measurable")))
    return scored.withColumn("passed", (F.col("recall") >= 0.95) & (F.col("fpr") <= 0.20) & (F.col("targeted_failures") == 0))


def missing_required(expected: Column, observed: Column) -> Column:
    """O6."""
    return F.array_except(expected, observed)


def consensus(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """Of exactly three votes unanimous or majority; other numbers and three-way splits are inconclusive."""
    per = votes.groupBy(key, vote).agg(F.count("*").alias("n"))
    top = per.groupBy(key).agg(F.max_by(vote, "n").alias("verdict"), F.max("n").alias("best"), F.sum("n").alias("votes"))
    kind = F.when(F.col("votes") != 3, "inconclusive").when(F.col("best") == 3, "unanimous").when(F.col("best") == 2, "majority").otherwise("inconclusive")
    return top.select(key, kind.alias("agreement"), F.when(kind == "inconclusive", F.lit("inconclusive")).otherwise(F.col("verdict").cast("string")).alias("verdict"), "votes")


def cohort_rollup(rows: DataFrame, cohort: str, measured: Column, flagged: Column) -> DataFrame:
    """Targets, measured, flagged and rates of each cohort; re-aggregating its counts is A8."""
    out = rows.groupBy(F.col(cohort).alias("cohort")).agg(F.count("*").alias("targets"), F.count_if(measured).alias("measured"), F.count_if(measured & flagged).alias("flagged"))
    return out.withColumn("measured_rate", S.rate(F.col("measured"), F.col("targets"))).withColumn("flagged_rate", S.rate(F.col("flagged"), F.col("measured")))


def merge_rollups(reports: DataFrame) -> DataFrame:
    """Rates of merged reports from the sums, never from rates."""
    out = reports.groupBy("cohort").agg(F.sum("targets").alias("targets"), F.sum("measured").alias("measured"), F.sum("flagged").alias("flagged"))
    return out.withColumn("measured_rate", S.rate(F.col("measured"), F.col("targets"))).withColumn("flagged_rate", S.rate(F.col("flagged"), F.col("measured")))


def last_review(reports: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The last row of each key."""
    return reports.groupBy(*key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def gate(checks: DataFrame) -> DataFrame:
    """Checks (name, status pass/warn/fail, blocker) to one verdict; no check at all does not pass."""
    failed = F.count_if((F.col("status") == "fail") & F.col("blocker"))
    out = checks.agg(F.count("*").alias("checks"), failed.alias("failed_blockers"), F.count_if(F.col("status") == "warn").alias("warnings"))
    return out.withColumn("passed", (F.col("failed_blockers") == 0) & (F.col("checks") > 0))


def recomputed(stated: DataFrame, counted: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """GV6: stated figures (name, stated) against those counted again (name, recomputed, blocker), as checks for ``gate``.

    A figure that is not stated, or that cannot be counted, fails; one that differs by more than ``tolerance`` fails
    if it blocks and warns otherwise. Stated figures that nobody counts are checks that fail, too.
    """
    both = counted.join(stated, "name", "full").withColumn("blocker", F.coalesce("blocker", F.lit(True)))
    same = F.abs(F.col("stated") - F.col("recomputed")) <= tolerance
    status = F.when(F.col("stated").isNull() | F.col("recomputed").isNull(), "fail").when(same, "pass").when(F.col("blocker"), "fail").otherwise("warn")
    return both.withColumn("status", status)


def review_lookup(findings: DataFrame, reviews: DataFrame, default: str = "unreviewed") -> DataFrame:
    """Verdict of (target, rule), else of (*, rule), else the default."""
    own = reviews.filter("target_id != '*'").select("target_id", "rule_id", F.col("verdict").alias("v1"))
    any_ = reviews.filter("target_id = '*'").select("rule_id", F.col("verdict").alias("v2"))
    return findings.join(own, ["target_id", "rule_id"], "left").join(any_, "rule_id", "left").withColumn("verdict", F.coalesce("v1", "v2", F.lit(default))).drop("v1", "v2")


def in_case_scope(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings within a case: same app and target, equal path or path suffix, overlapping lines.

    The equality on app, target and file name carries the join; suffix and overlap are residual.
    """
    name = lambda p: F.element_at(F.split(S.normal_path(p), "/"), -1)
    left = cases.withColumn("__name", name(F.col("case_file"))).withColumn("__path", S.normal_path(F.col("case_file")))
    right = findings.withColumn("__name", name(F.col("file"))).withColumn("__fpath", S.normal_path(F.col("file")))
    both = left.join(right, ["app_id", "target_id", "__name"])
    same = (F.col("__path") == F.col("__fpath")) | F.col("__fpath").endswith(F.concat(F.lit("/"), F.col("__path"))) | F.col("__path").endswith(F.concat(F.lit("/"), F.col("__fpath")))
    lines = F.col("case_start").isNull() | ((F.col("line_start") <= F.coalesce("case_end", "case_start")) & (F.coalesce("line_end", "line_start") >= F.col("case_start")))
    return both.filter(same & lines).drop("__name", "__path", "__fpath")


def assign_cases(matches: DataFrame) -> DataFrame:
    """Per app and target, vulnerable cases in order of severity and id take the smallest unclaimed fingerprint that names an expected rule."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        claimed: set[str] = set()
        out = []
        ordered = pdf.drop_duplicates("case_id").sort_values(["case_rank", "case_id"])
        for case in ordered.itertuples():
            rows = pdf[pdf["case_id"] == case.case_id]
            if case.expected_outcome == "clean":
                hits = sorted(set(rows["finding_fingerprint"]))
                out.append((case.app_id, case.target_id, case.case_id, hits[0] if hits else None, bool(hits)))
                continue
            fits = sorted({f for f, r in zip(rows["finding_fingerprint"], rows["rule_id"], strict=True) if r in set(case.expected_rule_ids)} - claimed)
            if fits:
                claimed.add(fits[0])
            out.append((case.app_id, case.target_id, case.case_id, fits[0] if fits else None, bool(fits)))
        return pd.DataFrame(out, columns=["app_id", "target_id", "case_id", "finding_fingerprint", "matched"])

    return matches.groupBy("app_id", "target_id").applyInPandas(one, "app_id string, target_id string, case_id string, finding_fingerprint string, matched boolean")


def bipartite_matching(edges: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """A maximum matching within each key, by augmenting paths in the order of ids. Edges without one of their ends take no part.

    Keys are dealt over tasks and follow one another in a task, so that small keys cost no more than their edges; a task
    holds the edges of one key at a time.
    """
    ship(edges.sparkSession)
    kinds = dict(edges.dtypes)
    names = [*key, left, right]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, near, out, kind = None, {}, [], None

        def end() -> None:
            out.extend([(*at, a, b) for a, b in matched(near)] if at is not None else [])

        for batch in batches:
            kind = batch.schema
            for *k, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != at:
                    end()
                    at, near = k, {}
                own = near.setdefault(a, [])
                if not own or own[-1] != b:
                    own.append(b)
            if len(out) >= 10_000:
                yield _batch(out, kind)
                out.clear()
        end()
        if out:
            yield _batch(out, kind)

    rows = edges.select(*names).filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    return rows.repartition(*key).sortWithinPartitions(*names).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def matched(near: dict) -> list[tuple]:
    """The pairs of a maximum matching of lefts with their rights (``near``, rights in order), by right."""
    owner, mate = {}, {}
    for start in sorted(near):
        free = next((b for b in near[start] if b not in owner), None)
        if free is not None:  # the shortest augmenting path
            owner[free], mate[start] = start, free
            continue
        # An augmenting path by breadth, so that depth is not bound by recursion.
        before, queue, seen, end = {}, [start], set(), None
        for a in queue:
            for b in near[a]:
                if b in seen:
                    continue
                seen.add(b)
                before[b] = a
                if b not in owner:
                    end = b
                    break
                queue.append(owner[b])
            if end is not None:
                break
        while end is not None:
            a = before[end]
            owner[end], mate[a], end = a, end, mate.get(a) if a != start else None
    return [(a, b) for b, a in sorted(owner.items())]


def split_binding(matches: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """The one split a finding falls in, else ambiguous or unassigned."""
    per = matches.groupBy(key).agg(F.count_distinct("split").alias("n"), F.min("split").alias("split"))
    return findings.select(key).distinct().join(per, key, "left").select(key, F.when(F.col("n").isNull(), "unassigned").when(F.col("n") > 1, "ambiguous").otherwise(F.col("split")).alias("binding"))


def first_match(cases: DataFrame, findings: DataFrame, on: list[str], order: str) -> DataFrame:
    """Every case with its first finding, and how many more there were; cases without stay."""
    w = Window.partitionBy("case_id").orderBy(F.col(order).asc_nulls_last())
    rows = cases.join(findings, on, "left").withColumn("__n", F.row_number().over(w)).withColumn("extras", F.greatest(F.count(order).over(Window.partitionBy("case_id")) - 1, F.lit(0)))
    return rows.filter("__n = 1").drop("__n")


def actionability(findings: DataFrame) -> DataFrame:
    """Verdicts of findings that block (lane column): true-positive rate and its lower bound."""
    tp, n = F.count_if(F.col("verdict") == "true_positive"), F.count_if(F.col("verdict").isin("true_positive", "false_positive"))
    out = findings.filter("lane != 'supporting_review'").agg(tp.alias("tp"), n.alias("reviewed"))
    low, _ = S.wilson(F.col("tp"), F.col("reviewed"))
    return out.withColumn("tp_rate", S.rate(F.col("tp"), F.col("reviewed"), 6)).withColumn("tp_rate_low", low)


def byte_entropy(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Shannon bits of the bytes of a value: n * H."""
    octets = rows.select(key, F.explode(F.filter(F.split(F.hex(F.encode(value, "UTF-8")), "(?<=\\G..)"), lambda x: x != "")).alias("b"))
    per = octets.groupBy(key, "b").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(key))
    bits = per.withColumn("p", F.col("c") / total).groupBy(key).agg(F.sum("c").alias("n_bytes"), F.sum(-F.col("p") * F.log2("p")).alias("h"))
    return bits.select(key, "n_bytes", F.round(F.col("n_bytes") * F.col("h"), 6).alias("bits"))


def roster_readiness(roster: DataFrame, strata: tuple[str, ...], low: int, high: int) -> DataFrame:
    """Distinct and repeated apps, range, strata that lack."""
    out = roster.agg(F.count("*").alias("rows"), F.count_distinct("app_id").alias("apps"), F.array_sort(F.collect_set("stratum")).alias("have"))
    missing = F.array_except(F.array(*map(F.lit, strata)), F.col("have"))
    blockers = F.array_compact(F.array(F.when(F.col("rows") > F.col("apps"), "duplicate_app"), F.when(~F.col("apps").between(low, high), "app_count_out_of_range"), F.when(F.size(missing) > 0, "missing_stratum")))
    return out.withColumn("missing", missing).withColumn("blockers", blockers)
