import pytest
from pyspark.sql import functions as F

from auditframe.functions.text import clamped_depth
from auditframe.operators import evaluate, findings, rulepack, select

COLUMNS = "source string, rule_id string, severity string, confidence string, file string, line_start int, evidence string, detector_ord int, seq long"


def test_sink_action_merges_traces(spark):
    rows = [("a", "WEB_X", "high", "low", "f", 9, "detector_subtype=q source_line=3", 1, 1), ("a", "WEB_X", "critical", "high", "f", 9, "detector_subtype=q source_line=5", 1, 2), ("a", "WEB_X", "high", "low", "f", 9, "detector_subtype=q object_ref=u", 1, 3), ("b", "WEB_X", "low", "low", "f", 9, "detector_subtype=z source_line=7", 2, 1)]
    got = findings.dedupe_findings(spark.createDataFrame(rows, COLUMNS)).orderBy("merged_count").collect()
    assert [r.merged_count for r in got] == [1, 3]
    assert (got[1].severity, got[1].confidence) == ("critical", "high")
    assert {(c.label, c.line) for c in got[1].components} == {("source_trace:a", 3), ("source_trace:a", 5), ("source_trace:b", 7)}


def test_order_of_input_does_not_matter(spark):
    rows = [("a", "R", "high", "low", "f", k % 3, "e", k, k) for k in range(12)]
    one = findings.dedupe_findings(spark.createDataFrame(rows, COLUMNS)).collect()
    two = findings.dedupe_findings(spark.createDataFrame(rows[::-1], COLUMNS).repartition(3)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


@pytest.mark.parametrize(("path", "want"), [("src/a.py", "runtime_source"), ("tests/x.py", "test_fixture"), ("a/b.test.js", "test_fixture"), ("docs/x.md", "documentation"), ("README.md", "documentation"), ("conf/app.yaml", "configuration"), ("vendor/x.js", "third_party"), ("dist/x.js", "deployable_artifact"), ("yarn.lock", "repository_asset"), ("", "workspace_evidence"), ("x.bin", "repository_asset"), ("config.example.json", "example"), ("locales/ko.json", "content_data")])
def test_scopes(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(findings.artifact_scope(F.col("p"))).first()[0] == want


def test_lanes(spark):
    rows = [("critical", "runtime_source", "WEB_UNTRUSTED_INPUT_TO_COMMAND", "high", "release_blocking"), ("critical", "runtime_source", "PII_EMAIL", "high", "manual_review_hold"), ("low", "runtime_source", "PII_EMAIL", "high", "supporting_review"), ("high", "nowhere", "X", "high", "policy_integrity_hold"), ("high", "third_party", "PII_X", "high", "supporting_review"), ("high", "documentation", "SECRET_X", "high", "manual_review_hold"), ("high", "runtime_source", "X_PARSE_FAILED", "high", "policy_integrity_hold"), ("high", "configuration", "CONFIG_GHA_MUTABLE_ACTION_REF", "high", "manual_review_hold")]
    df = spark.createDataFrame(rows, "severity string, artifact_scope string, rule_id string, confidence string, want string")
    assert df.filter(findings.release_lane() != F.col("want")).count() == 0
    assert df.filter(F.col("rule_id") == "CONFIG_GHA_MUTABLE_ACTION_REF").select(findings.release_lane("v5")).first()[0] == "release_blocking"
    assert df.select(findings.release_lane("v0")).first()[0] == "policy_integrity_hold"


def test_suppression_errors(spark):
    base = dict(app_id="a", audit_profile="korean_senior", release_scope_hash="ab" * 8, target_id="t", rule_id="r", finding_fingerprint="f", owner="o", reason="x", expires="2030-01-01")
    cases = [({}, ""), ({"owner": ""}, "missing_owner"), ({"expires": "soon"}, "invalid_expires"), ({"expires": "2020-01-01"}, "expired"), ({"release_scope_hash": "zz"}, "invalid_release_scope_hash")]
    df = spark.createDataFrame([{**base, **change, "want": want} for change, want in cases])
    assert df.filter(findings.policy_row_error("2026-01-01") != F.col("want")).count() == 0


def test_clamped_depth(spark):
    import random

    rnd = random.Random(3)
    rows = [(k, n, rnd.randint(0, 2), rnd.randint(0, 2)) for k in range(5) for n in range(30)]
    got = {(r.k, r.n): r.depth for r in clamped_depth(spark.createDataFrame(rows, "k int, n int, o int, c int"), F.col("o"), F.col("c"), ["k"], ["n"]).collect()}
    for k in range(5):
        d = 0
        for kk, n, o, c in rows:
            if kk == k:
                d = max(0, d + o - c)
                assert got[k, n] == d


def test_clusters_chain(spark):
    rows = [(k, f"t{k}") for k in range(40)] + [(k + 1, f"t{k}") for k in range(40)] + [(100, "x"), (101, None), (None, "x")]
    got = {r.item: r.cluster for r in select.token_clusters(spark.createDataFrame(rows, "item long, token string")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == 100
    assert select.token_clusters(spark.createDataFrame([], "item long, token string")).count() == 0


def test_quota_contract(spark):
    df = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(30)], "id long, s string")
    picked = select.stratified(df, "s", "id", "seed", 5, 2)
    assert select.quota_contract(picked, "s", {"a": 5, "b": 5}).count() == 0
    assert {r.s for r in select.quota_contract(picked, "s", {"a": 5, "b": 4, "c": 1}).collect()} == {"b", "c"}
    assert picked.filter("reserve_position = 2").count() == 2


def test_matching_is_maximum(spark):
    import itertools
    import random

    rnd = random.Random(5)
    edges = sorted({(f"k{g}", a, b) for g in range(20) for _ in range(8) for a, b in [(rnd.randint(0, 4), rnd.randint(0, 4))]})
    df = evaluate.bipartite_matching(spark.createDataFrame(edges, "k string, l int, r int"), ["k"], "l", "r").collect()
    for g in range(20):
        own = {(a, b) for k, a, b in edges if k == f"k{g}"}
        got = [(r.l, r.r) for r in df if r.k == f"k{g}"]
        assert set(got) <= own and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        best = max(len(s) for n in range(6) for s in itertools.combinations(own, n) if len({a for a, _ in s}) == len({b for _, b in s}) == len(s))
        assert len(got) == best


def test_matching_of_many_small_keys(spark):
    """No data frame is made for a key: keys share tasks, and equal edges and edges without an end do not count."""
    edges = [(k, a, b) for k in (None, "a", "b") for a in (1, 1, 2, 3, None) for b in (7, 7, None, 8)]
    rows = evaluate.bipartite_matching(spark.createDataFrame(edges, "k string, l int, r int").repartition(3), ["k"], "l", "r")
    assert "FlatMapGroups" not in rows._jdf.queryExecution().toString()
    assert sorted((r.k or "", r.l, r.r) for r in rows.collect()) == [(k, a, b) for k in ("", "a", "b") for a, b in ((1, 7), (2, 8))]


def test_config_rules(spark):
    rows = [("a.yml", 1, "privileged: true"), (".github/workflows/x.yml", 2, "- uses: actions/checkout@main"), ("x.yml", 3, "- uses: actions/checkout@main"), ("a.py", 4, "requests.get(u, verify=False)")]
    got = {(r.path, r.rule_id) for r in rulepack.line_rules(spark.createDataFrame(rows, "path string, line_no int, line string"), rulepack.CONFIG, "path").collect()}
    assert got == {("a.yml", "CONFIG_DOCKER_PRIVILEGED"), (".github/workflows/x.yml", "CONFIG_GHA_MUTABLE_ACTION_REF"), ("x.yml", "CONFIG_GHA_MUTABLE_ACTION_REF"), ("a.py", "CONFIG_TLS_VERIFY_DISABLED")}
