"""Session events as streams: exactly-once by id, progress, watchdog, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with time zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events once each, however often they are delivered within the watermark."""
    rows = timed(events)
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])


def known(events: DataFrame, types: list[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(types))


def progress(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The latest event of each key: cumulative snapshots, last write wins. For update mode."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def daily_rounds(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events of each day as one round: late ones count until the watermark passes."""
    rows = timed(events)
    rows = rows.withWatermark("ts", delay) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def silent(events: DataFrame, key: str = "user_id", seconds: int = 120) -> DataFrame:
    """A watchdog for streams: a key that stays silent for `seconds` of event time yields one row."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def watch(k, batches, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_ms": [last]})
            return
        last = state.get[0] if state.exists else 0
        for b in batches:
            last = max(last, int(b["ms"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + seconds * 1000)

    kind = dict(events.dtypes)[key]
    rows = timed(events).withWatermark("ts", "0 seconds").select(key, "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy(key).applyInPandasWithState(watch, f"{key} {kind}, last_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def folded_into(stream: DataFrame, fold, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch through `fold(batch, batch_id)`, which must be idempotent: a batch may come again."""
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def messages(turns: DataFrame) -> DataFrame:
    """The longest message (first on ties) and the last one of each conversation."""
    longest = F.max_by("text", F.struct(F.char_length("text").alias("n"), (-F.col("turn")).alias("t")))
    return turns.groupBy("conv_id").agg(longest.alias("longest"), F.max_by("text", "turn").alias("last"), F.count("*").alias("n_turns"))


def answers(uses: DataFrame, asked: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Tool uses that an action requires: (event_id, name) of `uses` for every id in `asked.event_ids`.

    Both may be streams: a use waits for its request, and a request for its use, within `delay`.
    """
    left = timed(uses).select("event_id", "name", F.col("ts").alias("used_at"))
    right = timed(asked).select(F.explode("event_ids").alias("required"), F.col("ts").alias("asked_at"))
    if uses.isStreaming:
        left = left.withWatermark("used_at", delay)
    if asked.isStreaming:
        right = right.withWatermark("asked_at", delay)
    near = (F.col("asked_at") >= F.col("used_at")) & (F.col("asked_at") <= F.col("used_at") + F.expr(f"interval {delay}"))
    return left.join(right, (F.col("event_id") == F.col("required")) & near).select("event_id", "name")


def activity(event_type: Column) -> Column:
    """A short label for an event's type."""
    return F.when(event_type.contains("tool"), "using a tool").when(event_type.contains("message"), "writing").when(event_type.contains("error"), "failed").otherwise("working")


def session_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Events of sessions as a stream of JSON lines; records that don't fit come as nulls and are left out."""
    schema = "event_id string, ts timestamp, event_type string, name string, event_ids array<string>, text string, error string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)
    return rows.where("event_id is not null and event_type is not null")


def outcomes(events: DataFrame) -> DataFrame:
    """The events that end a session, with the error if there is one."""
    return events.where(F.col("event_type").isin("outcome", "terminated", "error")).select("event_id", "event_type", F.coalesce("error", F.when(F.col("event_type") == "terminated", "terminated")).alias("error"))
