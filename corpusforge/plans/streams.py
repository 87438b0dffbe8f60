"""Streaming queries, each run over what its table holds now."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusforge.operators import sensitive as S
from corpusforge.plans.registry import query
from corpusforge.plans.sensitive import _kinds, _snippets
from corpusforge.session import checkpoint_folder, checkpointed, removed, table
from corpusforge.streaming import capture


def _gated(spark, d, name, keys, refused):
    folder = f"{checkpoint_folder(spark)}/gate-{uuid.uuid4().hex}"
    capture.gated(capture.read_stream(spark, f"{d}/{name}.parquet").select(*keys, "text"), folder)
    rows = checkpointed(capture.gate_rows(spark, folder, refused))
    removed(spark, folder)
    return rows


@query("st1_capture_gate", f"SELECT conv_id, turn, array_to_string({_kinds(S.WARN)}, ',') AS warnings FROM conversations WHERE len({_kinds(S.BLOCK)}) = 0")
def st1(spark, d):
    return _gated(spark, d, "conversations", ["conv_id", "turn"], False).select("conv_id", "turn", "warnings")


@query("st1_refused_captures", f"SELECT doc_id, array_to_string({_kinds(S.BLOCK)}, ',') AS types, {_snippets()} AS snippets FROM documents WHERE len({_kinds(S.BLOCK)}) > 0")
def st1_refused(spark, d):
    """What the gate refused, with the rules and their findings: the second sink of the same pass."""
    return _gated(spark, d, "documents", ["doc_id"], True).select("doc_id", F.array_join("types", ",").alias("types"), F.array_join("snippets", "\n").alias("snippets"))


@query(
    "st3_latest_values",
    """WITH l AS (SELECT event_type, user_id, arg_max(struct_pack(event_id, ts), event_id) AS v, max(max(ts)) OVER () AS now FROM events GROUP BY event_type, user_id)
    SELECT event_type, user_id, v.event_id AS event_id FROM l WHERE v.ts + CASE event_type WHEN 'click' THEN INTERVAL 2 DAY WHEN 'view' THEN INTERVAL 12 HOUR ELSE INTERVAL 20 DAY END >= now""",
)
def st3(spark, d):
    """The latest entry of each key by a stream with state and timers, those that haven't expired at the time of the last event."""
    folder = f"{checkpoint_folder(spark)}/latest-{uuid.uuid4().hex}"
    events = capture.read_stream(spark, f"{d}/events.parquet").select("event_type", "user_id", "event_id", "ts")
    hours = F.when(F.col("event_type") == "click", 48).when(F.col("event_type") == "view", 12).otherwise(480)
    capture.latest_values(events, ["event_type", "user_id"], "event_id", "ts", hours * 3600, folder)
    now = table(spark, d, "events").agg(F.max("ts")).first()[0]
    rows = checkpointed(capture.live_values(spark, folder, ["event_type", "user_id"], F.lit(now).cast("timestamp")).select("event_type", "user_id", "event_id"))
    removed(spark, folder)
    return rows


@query("st2_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def st2(spark, d):
    stream = capture.read_stream(spark, f"{d}/events.parquet")
    return capture.drained(capture.first_seen(stream, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"))
