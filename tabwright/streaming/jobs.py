"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tabwright.operators import drift, logs, pii
from tabwright.operators.cdc import event_key


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, name: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A file stream over the Parquet files of a folder that match a name."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


#: Images travel through the state operator as text; times keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def latest_state(events: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """The table a change stream has built so far: the last image per key by (ts, seq), deletes as nulls, as updates.

    The state of a key is the place of its last change, so that an older change that arrives after it is left out, and a
    delete is not undone by it.  Events behind the watermark are dropped; therefore a key whose last change lies behind it
    needs no state any more, tombstone or not, and its timer removes it.  State is bounded by the keys of the last
    ``lateness`` of event time.
    """
    image = events.schema["after"].dataType
    # a null time has no place in the order
    rows = events.where("ts IS NOT NULL").withWatermark("ts", lateness)
    rows = rows.select(*event_key(events, keys), F.to_json("after", _JSON).alias("after"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("seq").cast("bigint").alias("seq"))
    kinds = rows.schema
    shape = T.StructType([T.StructField(k, kinds[k].dataType) for k in keys] + T._parse_datatype_string("after string, micros bigint").fields)

    def advance(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        found = None
        for part in parts:
            for after, micros, seq in zip(part["after"], part["micros"], part["seq"]):
                place = (int(micros), int(seq))
                if last is None or place > last:
                    last, found = place, (None if pd.isna(after) else after, place[0])
        if found is not None:
            state.update(last)
            yield pd.DataFrame([(*key, *found)], columns=shape.names)
        # a timer has to lie ahead of the watermark
        state.setTimeoutTimestamp(max(last[0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    made = rows.groupBy(*keys).applyInPandasWithState(advance, shape, "micros bigint, seq bigint", "update", GroupStateTimeout.EventTimeTimeout)
    changed = F.timestamp_micros("micros").cast(events.schema["ts"].dataType)
    return made.select(*keys, F.from_json("after", image, _JSON).alias("after"), F.col("after").isNull().alias("deleted"), changed.alias("changed_at"))


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, table, operation, events) per tumbling or sliding window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", lateness).groupBy(window.alias("w"), "table", "operation").agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "table", "operation", "events")


def access_error_rate(lines: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, requests, errors, error_rate) of access-log lines by their own timestamps."""
    stamp = F.try_to_timestamp("timestamp", F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    rows = logs.parse_access(lines.select("line")).withColumn("ts", stamp).withWatermark("ts", lateness)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = rows.groupBy(window.alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"))
    return counted.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_rate")
    )


def application_error_rate(lines: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(start, level, lines) of application-log lines."""
    stamp = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = logs.parse_application(lines.select("line")).withColumn("ts", stamp).withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", width).alias("w"), "level").agg(F.count("*").alias("lines")).select(F.col("w.start").alias("start"), "level", "lines")


def masked(stream: DataFrame, plan: dict[str, tuple[str, str]]) -> DataFrame:
    """Masking keeps no state: the batch projection runs on a stream as it is."""
    return pii.mask_table(stream, plan)


# --- running ----------------------------------------------------------------


def run_append(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process everything available and append it to a Parquet table, exactly once."""
    return stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_table(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available; each batch writes ``output/batch=<id>``, so a repeated batch replaces itself.

    In append mode a window is written once, when the watermark has passed its end, and leaves the state; rows of windows
    that are closed are dropped.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={epoch}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def finished_windows(spark: SparkSession, output: str) -> DataFrame:
    """What :func:`run_table` has written in append mode."""
    return spark.read.parquet(output).drop("batch")


def upserts(spark: SparkSession, output: str, keys: list[str]) -> DataFrame:
    """The table told by batches of updates: per key the row of the latest batch, tombstones dropped."""
    rows = spark.read.parquet(output)
    value = F.struct(*[c for c in rows.columns if c not in (*keys, "batch")])
    last = rows.groupBy(*keys).agg(F.max_by(value, "batch").alias("_v")).select(*keys, "_v.*")
    return last.where("NOT deleted").drop("deleted")


def watch_drift(stream: DataFrame, baseline: DataFrame, columns: list[str], output: str, checkpoint: str, use_p_value: bool = False) -> StreamingQuery:
    """Compare every micro-batch with the baseline's stored profile; each batch writes its report to ``output/batch=<id>``."""
    profile = drift.baseline_profile(baseline, columns)  # the baseline's rows are read once

    def compare(batch: DataFrame, epoch: int) -> None:
        report = drift.profile_drift(profile, batch.select(*columns), use_p_value)
        report.write.mode("overwrite").parquet(f"{output}/batch={epoch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(compare).trigger(availableNow=True).start()
