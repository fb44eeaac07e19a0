"""Operators on transformWithState: replays in several batches equal the batch result."""

import datetime
import random

from auditframe import registry
from auditframe.streaming import session, stateful
from tests.compare import same

START = datetime.datetime(2026, 1, 1)
MESSAGE = "session string, request_id string, is_response boolean, ts timestamp, seq long"


def at(n):
    return START + datetime.timedelta(seconds=n)


def rows_of(df):
    return sorted(map(str, df.collect()))


def end(spark, schema):
    return spark.createDataFrame([("", None, None, at(10**6), None)], schema)


def test_pending_batch(spark):
    rows = [("a", "1", False, 0), ("a", "1", True, 30), ("a", "2", False, 0), ("a", "2", True, 31), ("a", "3", True, 5), ("a", "4", False, 1), ("a", "4", False, 2), ("a", "4", True, 3), ("a", "5", False, 9), ("b", "1", False, 0), ("b", "1", False, 40), ("b", None, False, 1)]
    got = stateful.pending_batch(spark.createDataFrame([(*r[:3], at(r[3]), i) for i, r in enumerate(rows)], MESSAGE)).collect()
    assert sorted((r.session, r.request_id, r.state) for r in got) == [
        ("a", "1", "answered"), ("a", "2", "late_response"), ("a", "2", "response_timeout"), ("a", "3", "unknown_response"), ("a", "4", "answered"), ("a", "4", "superseded"),
        ("a", "5", "response_timeout"), ("b", "1", "response_timeout"), ("b", "1", "response_timeout"),
    ]


def test_pending_stream_equals_batch(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), str(rnd.randint(0, 5)), rnd.random() < 0.5, at(rnd.randint(0, 400)), i) for i in range(150)]
    frame = spark.createDataFrame(rows, MESSAGE)
    got = stateful.replay(frame, stateful.pending_requests, 3, stateful.Pending.OUT, end(spark, MESSAGE))
    want = stateful.pending_batch(frame)
    assert rows_of(got) == rows_of(want) and {r.state for r in want.collect()} == {"answered", "superseded", "response_timeout", "late_response", "unknown_response"}


def test_response_after_the_timer_is_late(spark):
    """In a later batch than the one that told of the limit: the same as without batches."""
    rows = [("a", "1", False, at(0), 0), ("a", "1", True, at(9_000), 1), ("a", "1", True, at(9_001), 2), ("a", "2", False, at(1), 3), ("a", "2", False, at(9_000), 4)]
    frame = spark.createDataFrame([*rows, *[(s, "x", True, at(t), 9) for t in range(0, 9_000, 300) for s in "bcdefghi"]], MESSAGE)
    got = stateful.replay(frame, lambda stream, delay: stateful.pending_requests(stream, "1 second"), 30, stateful.Pending.OUT, end(spark, MESSAGE))
    want = stateful.pending_batch(frame)
    assert rows_of(got) == rows_of(want)
    assert sorted((r.request_id, r.state) for r in got.filter("session = 'a'").collect()) == [("1", "late_response"), ("1", "response_timeout"), ("1", "unknown_response"), ("2", "response_timeout"), ("2", "response_timeout")]


def test_pending_state_is_of_buckets_not_of_requests(spark, tmp_path):
    """5,000 open requests are a few values and timers of their buckets; null sessions and ids stay apart."""
    rows = [("a", str(i), False, at(0), i) for i in range(5_000)] + [(None, "1", False, at(0), 0), ("a", None, False, at(0), 1), ("a", "1", True, at(20), 2)]
    frame = spark.createDataFrame(rows, MESSAGE)
    frame.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.pending_requests(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("pending").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    assert 0 < max(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators) <= 3 * 1_024
    assert [(r.session, r.request_id, r.state) for r in spark.table("pending").collect()] == [("a", "1", "answered")]


def test_correlation_stream_equals_batch(spark):
    rnd = random.Random(4)
    schema = "session string, event_index long, ts timestamp, sensitive boolean, sink_kind string, correlation_keys array<string>"
    rows = [(s, i, at(i * 5), rnd.random() < 0.4, rnd.choice([None, None, "llm"]), rnd.choice([None, [], ["k=1"], ["k=2"]])) for s in "abc" for i in range(60)]
    frame = spark.createDataFrame(rows, schema)
    got = stateful.replay(frame, stateful.correlate, 3, stateful.Correlation.OUT)
    want = session.correlate_batch(frame)
    assert rows_of(got) == rows_of(want) and want.count() > 10


def test_state_ends_with_idleness_in_processing_time(spark, tmp_path):
    schema = "session string, event_index long, ts timestamp, sensitive boolean, sink_kind string, correlation_keys array<string>"
    frame = spark.createDataFrame([("a", 0, at(0), True, None, None), ("a", 1, at(1), False, "http", None)], schema)
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = stateful.correlate(stream, processing_time=True).writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    assert query.awaitTermination(60)  # in processing time batches go on without data, so the trigger is a single one
    assert [(r.sink_index, r.source_index) for r in spark.table("ttl").collect()] == [(1, 0)]


def test_query_equals_sql(spark, data):
    same(registry.queries()["pending_replay"](spark, data), registry.oracle_sql()["pending_replay"], data)
