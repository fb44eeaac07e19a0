"""Runtime events: decisions per event, correlation within a session, batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.operators.redact import redact_column

MAX_DISTANCE = 4
MAX_AGE_S = 30
BUFFER = 8
IDLE_MS = 300_000
#: Kinds of sinks by a word in the event's type, tool or text.
SINKS = (("llm", "llm|openai|anthropic|model|prompt|completion"), ("http", "http|fetch|request|webhook|url"), ("file", "write_file|save|export"), ("message", "slack|mail|sms|message"))
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b\d{6}-?[1-8]\d{6}\b|\b01[016-9]-?\d{3,4}-?\d{4}\b"
SECRET = r"\bsk-[A-Za-z0-9_-]{20,}\b|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9_]{30,}\b"
INSTRUCTION = "(?i)(ignore (?:all )?previous instructions|developer message|system prompt|do not reveal|이전 지시.*무시|숨겨진 지시)"
_KEYS = ("correlation_id", "correlationId", "request_id", "requestId", "trace_id", "traceId", "conversation_id", "session_id")


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """SRC8, F-EVT: JSON lines to event columns; ``parse_error`` marks a line that is no object."""
    v = F.try_parse_json(F.col(value))
    get = lambda path: F.try_variant_get(v, f"$.{path}", "string")
    first = lambda *paths: F.coalesce(*[get(p) for p in paths])
    content = first("content", "result", "error", "response", "arguments", "args", "input", "prompt", "message", "data", "payload")
    keys = F.array_compact(F.array(*[F.when(get(p + k).isNotNull(), F.concat(F.lit(k.lower().replace("_", "") + "="), get(p + k))) for p in ("", "metadata.", "context.") for k in _KEYS if k != "session_id"]))
    kind = F.lower(F.coalesce(first("event", "type"), F.lit("")))
    tool = F.lower(F.coalesce(first("tool", "name", "server", "provider"), F.lit("")))
    sink = None
    for name, words in SINKS:
        test = F.concat_ws(" ", kind, tool).rlike(words)
        sink = F.when(test, name) if sink is None else sink.when(test, name)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    both = (get("jsonrpc").isNotNull() & get("result").isNotNull() & get("error").isNotNull())
    return raw.select(
        *[c for c in raw.columns if c != value], kind.alias("event_type"), tool.alias("tool"), F.coalesce(content, F.lit("")).alias("content"),
        F.when(kind.rlike("request|sink|call") | kind.isin("llm", "http"), sink).alias("sink_kind"), keys.alias("correlation_keys"), both.alias("contradictory"), (~is_object).alias("parse_error"),
    )


def event_decision() -> Column:
    """ST5, without correlation: block, redact or allow, with the rule."""
    result = F.col("event_type").rlike("result|response")
    return (
        F.when(F.col("contradictory"), F.struct(F.lit("block").alias("action"), F.lit("MCP_CONTRADICTORY_RESPONSE").alias("rule_id")))
        .when(result & F.col("content").rlike(INSTRUCTION), F.struct(F.lit("block").alias("action"), F.lit("MCP_HIDDEN_INSTRUCTION").alias("rule_id")))
        .when(F.col("content").rlike(SECRET), F.struct(F.lit("block").alias("action"), F.lit("MCP_SECRET").alias("rule_id")))
        .when(result & F.col("content").rlike(PERSONAL), F.struct(F.lit("redact").alias("action"), F.lit("MCP_TOOL_RESULT_PII").alias("rule_id")))
        .otherwise(F.struct(F.lit("allow").alias("action"), F.lit("").alias("rule_id")))
    )


def _step(buffer: list[tuple], index: int, ts: float | None, sensitive: bool, sink: str | None, keys: list[str]) -> tuple[list[tuple], int | None]:
    """One event against the buffer of (index, ts, keys); returns the buffer and the matched source.

    A source is at most ``MAX_DISTANCE`` events and ``MAX_AGE_S`` old; if either side has keys they
    must meet; the newest source wins and is consumed.
    """
    buffer = [s for s in buffer if index - s[0] <= MAX_DISTANCE and (ts is None or s[1] is None or ts - s[1] <= MAX_AGE_S)]
    matched = None
    if sink:
        for s in reversed(buffer):
            if (s[2] or keys) and not set(s[2]) & set(keys):
                continue
            matched = s[0]
            buffer.remove(s)
            break
    if sensitive:
        buffer = [*buffer, (index, ts, tuple(keys))][-BUFFER:]
    return buffer, matched


def correlate_batch(events: DataFrame) -> DataFrame:
    """J4 over a log: (session, event_index, sensitive, sink_kind, correlation_keys) to sink matches.

    Events of a session go to one task in order and stream through a buffer of eight: sorted within
    partitions, a session of any length needs no more memory. Age does not bind in a replay.
    """
    columns = ["session", "event_index", "sensitive", "sink_kind", "correlation_keys"]
    ordered = events.select(*columns).repartition(F.col("session")).sortWithinPartitions("session", "event_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, buffer = None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.session != session:
                    session, buffer = r.session, []
                keys = list(r.correlation_keys) if r.correlation_keys is not None else []
                buffer, matched = _step(buffer, int(r.event_index), None, bool(r.sensitive), r.sink_kind or None, keys)
                if matched is not None:
                    out.append((r.session, int(r.event_index), r.sink_kind, matched))
            yield pd.DataFrame(out, columns=["session", "sink_index", "sink_kind", "source_index"])

    return ordered.mapInPandas(run, "session string, sink_index long, sink_kind string, source_index long")


def correlate_stream(events: DataFrame) -> DataFrame:
    """ST1 to ST3: the same on a stream in event time, state kept per session for 300 idle seconds.

    events (session, event_index, ts, sensitive, sink_kind, correlation_keys). Idleness is told by the
    watermark, 60 seconds behind the newest event. A global cap of sessions has no equivalent: state is
    partitioned by session.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer = [(i, t, tuple(k)) for i, t, k in zip(*state.get, strict=True)] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("event_index")
        out = []
        for r in rows.itertuples(index=False):
            keys = list(r.correlation_keys) if r.correlation_keys is not None else []
            buffer, matched = _step(buffer, int(r.event_index), r.ts.timestamp(), bool(r.sensitive), r.sink_kind or None, keys)
            if matched is not None:
                out.append((key[0], int(r.event_index), r.sink_kind, matched))
        state.update(([b[0] for b in buffer], [b[1] for b in buffer], [list(b[2]) for b in buffer]))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + IDLE_MS)
        yield pd.DataFrame(out, columns=["session", "sink_index", "sink_kind", "source_index"])

    return events.withWatermark("ts", "60 seconds").groupBy("session").applyInPandasWithState(update, "session string, sink_index long, sink_kind string, source_index long", "i array<long>, t array<double>, k array<array<string>>", "append", GroupStateTimeout.EventTimeTimeout)


def enforce(events: DataFrame, decision: str = "decision", text: str = "content") -> DataFrame:
    """ST4: what is forwarded: a stub for blocked events, tokens for personal data, or the text itself."""
    action = F.col(f"{decision}.action")
    stub = F.to_json(F.struct(F.lit(True).alias("blocked"), F.col(f"{decision}.rule_id").alias("rule_id")))
    clean = redact_column(events.withColumn("__clean", F.when(action == "redact", F.col(text))), "__clean")
    return clean.withColumn("forwarded", F.when(action == "block", stub).when(action == "redact", F.col("__clean")).otherwise(F.col(text))).drop("__clean")
