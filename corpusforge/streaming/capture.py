"""Structured Streaming: a write gate for captured texts, and de-duplication with bounded state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from corpusforge.operators.sensitive import gate
from corpusforge.session import checkpoint_folder, checkpointed, removed, ship

#: Keys with state are dealt into so many slices; the time (in milliseconds) of what never ends.
KEY_SLICES, NEVER = 4096, 1 << 62


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The parquet files at ``path``, a folder or a file, as a stream (a stream takes a file only by a pattern)."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there now; its rows. What the run leaves in the shared folder is deleted."""
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = checkpointed(spark.read.schema(stream.schema).parquet(f"{folder}/rows"))
    removed(spark, folder)
    return found


def gated(captures: DataFrame, folder: str, text_col: str = "text", most_files: int | None = None) -> None:
    """Send captures that are there now through the write gate, into accepted and refused ones; go on later with the same folder.

    A batch is looked at once: it is written as one table with both parts, under its number, in one commit. A batch that is run again after a stop has the
    same rows and takes the place of what it wrote before.
    """
    rules = gate(F.col(text_col))
    marked = captures.withColumns({"refused": rules["blocked"], "types": rules["block"], "snippets": rules["snippets"], "warnings": F.array_join(rules["warn"], ",")})

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("refused").parquet(f"{folder}/rows/batch={number}")

    marked.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def gate_rows(spark: SparkSession, folder: str, refused: bool) -> DataFrame:
    """What the gate has let through so far, or refused: refused captures keep the types of the rules and what these found."""
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").where(F.col("refused") == refused)
    return rows.drop("batch", "refused", *(("types", "snippets") if not refused else ()))


def accepted(captures: DataFrame, text_col: str = "text") -> DataFrame:
    """Captures that no block rule matches, with the types of their warnings."""
    rules = gate(F.col(text_col))
    return captures.where(~rules["blocked"]).withColumn("warnings", F.array_join(rules["warn"], ","))


def first_seen(events: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """The first event of each key; a key is forgotten ``delay`` after its time, which bounds the state."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def _kept_bytes(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def latest_values(
    events: DataFrame, keys: list[str], order: str, time_col: str | None = None, ttl_seconds: Column | None = None, folder: str | None = None, delay: str = "0 seconds"
) -> DataFrame | None:
    """Keep the latest event of each key, until it expires, in a table that grows by changes; go on later with the same folder.

    Keys are dealt by their hash into ``KEY_SLICES`` slices. The state of a slice is the newest event of each of its keys and a timer at their
    first end, so a batch calls Python once for each slice that it touches, not once for each key. An event that isn't newer changes nothing; events
    without ``order`` are left out. Each batch writes the keys that it set or that expired, under its number: nothing else is written. State and table
    are in the folder, so a run that stopped goes on where it was, and a batch that is run again takes the place of what it wrote.

    Without ``time_col`` nothing expires, and the latest events of what is there now are given as rows.
    """
    if time_col is None:
        return _newest(events, keys, order)
    columns = [c for c in events.columns if c not in keys and c != time_col]
    rows = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withColumn("expires_at", F.col(time_col) + F.make_dt_interval(secs=ttl_seconds.cast("decimal(18,6)"))).withWatermark(time_col, delay)
    kept = rows.select(*keys, *columns, time_col, "expires_at").where(F.col(order).isNotNull())
    out = StructType([*kept.schema.fields, StructField("change", StringType())])
    names = kept.columns

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # What is held comes first, so of equal events it stays.
        found = [pa.ipc.open_stream(state.get[0]).read_pandas().assign(new_=False)] if state.exists else []
        if not state.hasTimedOut:
            found += [part.assign(new_=True) for part in parts]
        best = pd.concat(found, ignore_index=True).sort_values(order, ascending=False, kind="stable").drop_duplicates(keys)
        over = best["ends_"] <= state.getCurrentWatermarkMs()
        live = best[~over]
        if len(live):
            state.update((_kept_bytes(live.drop(columns="new_")),))
            if (first := int(live["ends_"].min())) < NEVER:
                state.setTimeoutTimestamp(first)
        elif state.exists:
            state.remove()
        yield pd.concat([best[best["new_"]].assign(change="set"), best[over].assign(change="expired")])[[*names, "change"]]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    ship(events.sparkSession)
    sliced = kept.withColumn("ends_", F.coalesce(F.unix_millis("expires_at"), F.lit(NEVER))).withColumn("slice_", F.pmod(F.xxhash64(*keys), F.lit(KEY_SLICES)))
    changes = sliced.groupBy("slice_").applyInPandasWithState(step, out, StructType([StructField("held", BinaryType())]), "update", GroupStateTimeout.EventTimeTimeout)
    changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return None


def _newest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest event of each key, of all that is there now."""
    spark = events.sparkSession
    folder, rest = f"{checkpoint_folder(spark)}/newest-{uuid.uuid4().hex}", [c for c in events.columns if c not in keys]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    newest = events.where(F.col(order).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("v")).select(*keys, "v.*")
    newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(newest.schema.add("batch", "long")).parquet(f"{folder}/changes")
    last = checkpointed(changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("v")).select(*keys, "v.*"))
    removed(spark, folder)
    return last


def live_values(spark: SparkSession, folder: str, keys: list[str], now: Column) -> DataFrame:
    """The table of latest values: each key's last change, unless it is expired at ``now``."""
    changes = spark.read.option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", (F.col("change") == "expired").alias("after"))).alias("v")).select(*keys, "v.*")
    return last.where((F.col("change") == "set") & (F.col("expires_at") >= now)).drop("batch", "change")
