import sqlite3  # noqa: F401

from pyspark.sql import functions as F

from auditframe.operators import access, code
from auditframe.sources import readers, sinks


def test_files_and_decoding(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n", encoding="utf-8-sig")
    (tmp_path / "src/b.txt").write_bytes("안녕하세요".encode("cp949"))
    (tmp_path / "src/c.txt").write_bytes("hello".encode("utf-16"))
    (tmp_path / "src/d.json").write_bytes(b"\x7fELF\0\0")
    (tmp_path / "src/e.exe").write_bytes(b"MZ")
    (tmp_path / "node_modules/f.js").write_text("x")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in readers.decoded(readers.files(spark, str(tmp_path), 5 << 20)).collect()}
    assert got == {"a.py": "x = 1\n", "b.txt": "안녕하세요", "c.txt": "hello", "d.json": None}
    one = readers.inventory_fingerprint(readers.files(spark, str(tmp_path))).first()
    assert one.files == 4 and one.tree_digest == readers.inventory_fingerprint(readers.files(spark, str(tmp_path)).repartition(3)).first().tree_digest


def test_embedded_csv(spark):
    df = spark.createDataFrame([(1, 'Name,phone\n홍길동,"010-1,2"\n'), (2, "no table"), (3, None)], "doc_id long, text string")
    assert {(r.row, r.header, r.value) for r in readers.embedded_csv(df, "doc_id").collect()} == {(2, "name", "홍길동"), (2, "phone", "010-1,2")}


def test_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿app_id,authorized\n a ,YES\n b,no\n", encoding="utf-8")
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.csv"), "app_id string, authorized string", ("authorized",)).collect()] == [("a", True), ("b", False)]
    (tmp_path / "e.csv").write_text("# head\nBenchmarkTest00001,sqli,true,89\n")
    assert readers.expected_results(spark, str(tmp_path / "e.csv")).first().real_vulnerability is True


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("R|1", "high", "f.py", 3, "a@example.com")], "rule_id string, severity string, file string, line_start int, evidence string")
    sinks.write_json(df, str(tmp_path / "out"))
    assert "a@example.com" not in spark.read.text(str(tmp_path / "out")).first()[0]
    assert "R\\|1" in sinks.markdown(df.select("rule_id", "severity")) and "&lt;" in sinks.html_report(df.select(F.lit("<x>").alias("v")), "t")
    assert '"level":"error"' in sinks.sarif_results(df).first()[0]
    nodes, edges = code.flow_graph(code.code_flows(spark.createDataFrame([("a.py", "import os\nos.system(input())\n")], "path string, text string")))
    assert nodes.count() == 2 and "flowchart" in sinks.mermaid(edges)


def test_sample_under_grant(spark, data):
    df = spark.read.parquet(f"{data}/customer.parquet")
    assert readers.sample_under_grant(df, ["c_custkey", "c_name"]).count() == min(25, df.count())


def test_chain_is_whole(spark):
    rows = spark.createDataFrame([(k, n, f"p{n}") for k in range(3) for n in range(5)], "k long, n long, payload string")
    good = access.verify_chain(access.chain_entries(rows, "k", "n", F.col("payload")), "k", F.col("payload"))
    assert good.filter("faults > 0").count() == 0
