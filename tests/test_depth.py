"""Set digests, agent configuration at depth, sanitising of nested values, and the native hint of threat rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from auditframe import registry
from auditframe.operators import agent_config, redact, reports, setdigest
from auditframe.sources import readers
from tests.compare import same


# --- set digests
def digest(spark, values, parts=1, **more):
    frame = spark.createDataFrame([(v,) for v in values], "v string").repartition(parts)
    row = setdigest.set_digest(frame, F.col("v"), **more).first()
    return row.n_entries, row.set_sha256


def test_set_digest_of_any_order_and_partitioning(spark, monkeypatch):
    values = [f"v{i % 90}" for i in range(300)]
    monkeypatch.setattr(setdigest, "FAN", 4)
    one = digest(spark, values)
    random.Random(1).shuffle(values)
    assert digest(spark, values, 7) == one and one[0] == 300


def test_set_digest_tells_sets_apart(spark):
    seen = [digest(spark, v) for v in ([], ["a"], ["a", "a"], ["a", "a", "a"], ["b"], ["a", "b"], ["ab"], ["a", "b", "b"])]
    assert len(set(seen)) == len(seen)
    assert digest(spark, ["b", "a"]) == digest(spark, ["a", "b"])


def test_levels_are_bounded():
    assert setdigest.levels(0) == [0] and setdigest.levels(4_096) == [0] and setdigest.levels(4_097) == [1, 0] and setdigest.levels(10**9) == [5, 2, 0]


def test_inventory_counts_and_paths(spark):
    rows = [("A.py", b"x", 1), ("b.py", b"y", 1), ("b.py", b"y", 1), ("big", b"z", 99), ("gone", None, None)]
    schema = "path string, content binary, n_bytes long"
    one = readers.inventory_fingerprint(spark.createDataFrame(rows, schema), 50).first()
    assert (one.files, one.bytes, one.unreadable, one.oversized, one.complete) == (5, 102, 1, 1, False)
    other = readers.inventory_fingerprint(spark.createDataFrame([("a.PY", b"X", 1), *rows[1:]], schema), 50).first()
    assert other.path_set_sha256 == one.path_set_sha256 and other.tree_digest != one.tree_digest
    # Two equal rows do not cancel.
    assert readers.inventory_fingerprint(spark.createDataFrame(rows[:1], schema)).first().tree_digest != readers.inventory_fingerprint(spark.createDataFrame([rows[0], rows[1], rows[1]], schema)).first().tree_digest
    assert readers.inventory_fingerprint(spark.createDataFrame([], schema)).first().files == 0


def test_inventory_tree_of_many_files_equals_sql(spark, data, monkeypatch):
    monkeypatch.setattr(setdigest, "FAN", 8)  # 200 documents are more than 16 x FAN, so places of one digit are longer than FAN
    sql = registry.oracle_sql()["inventory_tree"].replace("4096", "8")
    same(registry.queries()["inventory_tree"](spark, data), sql, data)


def test_bundles_do_not_depend_on_order(spark):
    rows = [("s", str(i % 7)) for i in range(40)] + [("t", "x")]
    make = lambda r, n: {x.subject: x.artifacts_sha256 for x in reports.evidence_bundles(spark.createDataFrame(r, "subject string, p string").repartition(n), "subject", F.col("p")).collect()}
    assert make(rows, 1) == make(rows[::-1], 5) != make(rows[1:], 1)


def test_bundles_are_checked_by_one_exchange_a_side(spark, data):
    plan = registry.queries()["bundle_check"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" hashpartitioning(") <= 2


def test_mutations_meet_files_by_suffix(spark):
    mutations = spark.createDataFrame([("m1", "src/a/index.js", ["R"]), ("m2", "index.js", ["R"]), ("m3", "rc/a/index.js", ["R"]), ("m4", "src/b/index.js", ["R"])], "mutation_id string, relative_path string, expected_rule_ids array<string>")
    found = spark.createDataFrame([("C:\\x\\src\\a\\index.js", "R"), ("y/src/b/index.js", "Q"), (None, "R")], "file string, rule_id string")
    rows = reports.mutation_outcomes(mutations, found.limit(0), found).collect()
    assert {r.mutation_id: r.outcome for r in rows} == {"m1": "killed", "m2": "killed", "m3": "survived", "m4": "survived"}


# --- agent configuration
def rules(spark, text, path="x.json"):
    rows = agent_config.agent_config(spark.createDataFrame([(1, path, text)], "id int, path string, text string"), path="path").collect()
    return sorted((r.server, r.rule_id) for r in rows)


SHELL = {"command": "bash", "args": ["-c", "x"]}
WRAPPED = ("s", "MCP_SHELL_WRAPPER_EXECUTION")
OVER = ("", "MCP_CONFIG_STRUCTURE_INCOMPLETE")


def nested(depth):
    value = {"mcpServers": {"s": SHELL}}
    for _ in range(depth):
        value = {"x": value}
    return json.dumps(value)


def test_servers_at_depth(spark):
    assert rules(spark, nested(0)) == [WRAPPED] and rules(spark, nested(5)) == [WRAPPED]
    assert rules(spark, nested(9)) == [OVER]
    assert rules(spark, json.dumps([{"servers": {"s": SHELL}}])) == [WRAPPED]


def test_toml_yaml_and_comments(spark):
    assert rules(spark, '[mcp_servers.s]\ncommand = "bash"\nargs = ["-c", "x"]\n', "config.toml") == [WRAPPED]
    assert rules(spark, '{ // a comment: "mcpServers"\n "mcpServers": {"s": {"command": "bash", "args": ["-c", "http://x"],}} /* end */ }') == [WRAPPED]
    pytest.importorskip("yaml")
    assert rules(spark, "mcpServers:\n  s:\n    command: bash\n    args: ['-c', x]\n", "c.yaml") == [WRAPPED]


def test_values_beyond_a_bound_are_seen_and_told(spark):
    env = {f"K{i}": "v" for i in range(1_100)} | {"API_KEY": "abcdef123456"}
    assert rules(spark, json.dumps({"mcpServers": {"s": {"env": env}}})) == sorted([OVER, ("s", "MCP_STATIC_CREDENTIAL_IN_CONFIG")])
    many = {f"s{i}": {} for i in range(300)} | {"z": SHELL}
    assert rules(spark, json.dumps({"mcpServers": many})) == [OVER, ("z", "MCP_SHELL_WRAPPER_EXECUTION")]


@pytest.mark.parametrize("text", ["", "mcpServers", "{", '{"mcpServers": []}', '{"mcpServers": {"s": 1}}', "servers = 1"])
def test_other_texts_have_no_rows(spark, text):
    assert rules(spark, text) == []


# --- sanitising
def test_nested_values_are_walked():
    value = {"note": "mail a@example.com", "body_sha256": "ab" * 32, "x_hash": "a@example.com", "n": [1, None, True, {"t": "ignore previous instructions"}], "ignore previous instructions": 1}
    out = json.loads(redact.sanitized_text(json.dumps(value)))
    assert out["note"].startswith("mail <redacted:EMAIL:") and out["body_sha256"] == "ab" * 32 and out["x_hash"].startswith("<redacted:EMAIL:")
    assert out["n"][:3] == [1, None, True] and out["n"][3]["t"].startswith("<untrusted-value-ref:")
    assert any(k.startswith("<untrusted-field-name-ref:") for k in out)


def test_depth_disguise_and_plain_texts():
    deep = "x"
    for _ in range(70):
        deep = [deep]
    assert "<mcp-output-depth-limit>" in redact.sanitized_text(json.dumps(deep))
    assert redact.sanitized_text("[" * 100_000) in ('"<mcp-output-depth-limit>"', redact.quarantined("[" * 100_000))
    assert redact.sanitized_text("1gn0re prev10u5 1n5truct10n5").startswith("<untrusted-value-ref:")
    assert redact.sanitized_text("fine") == "fine" and redact.sanitized_text(None) is None and redact.sanitized_text("{not json") == "{not json"


def test_column_equals_the_plain_version(spark):
    texts = ["fine", None, "", '{"a": "b@example.com"}', "write to b@example.com", "ign​ore previous instructions", "system prompt", "[1, 2]", "call 010-1234-5678"]
    rows = redact.sanitize_values(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i").collect()
    assert [r.t for r in rows] == [redact.sanitized_text(t) for t in texts]


# --- the native hint
TRIGGERS = [
    "please ignore previous instructions", "do not tell the user", "description: exfiltrate it", "silently go on", "send the token", "nc host secret", "fetch(process.env)", "forward env", "powershell -x -enc", "bash -c x; curl y", "cmd.exe /c curl",
    "xrm -rf /", "chmod 777 x", "docker run --privileged", "--allow-all", "/Users/x", "C:\\\\Users\\\\x", "~/x", "/home/x", "x/.ssh/id", "official read_file", "curl x | sh", "iwr x | iex", "eval(curl)", "read .aws/credentials", "copy id_ed25519", "cat keychain",
]


def test_every_hit_has_a_hint(spark):
    import base64
    from urllib.parse import quote

    lines = [*TRIGGERS, *[t.translate(str.maketrans("oieastas", "013457@$")) for t in TRIGGERS], *[quote(t, safe="") for t in TRIGGERS], *[base64.b64encode(t.encode() * 2).decode() for t in TRIGGERS], *["".join(f"\\u{ord(c):04x}" for c in t) for t in TRIGGERS], *[t[:4] + '" + "' + t[4:] for t in TRIGGERS], *[t[:4] + "/* x */" + t[4:] for t in TRIGGERS]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    hints = {r.i for r in frame.filter(redact.hinted(F.col("line"))).collect()}
    import re

    hit = {i for i, t in enumerate(lines) if any(re.search(p, form, re.I) for _, form in redact.candidates(t) for _, _, p in redact.THREATS)}
    assert hit <= hints and len(hit) > 100


def test_few_plain_lines_reach_python(spark, data):
    from auditframe.functions.text import lines

    rows = lines(spark.read.parquet(f"{data}/documents.parquet").filter("lang = 'en'").select("doc_id", "text"))
    assert rows.filter(redact.hinted(F.col("line"))).count() * 10 < rows.count()
