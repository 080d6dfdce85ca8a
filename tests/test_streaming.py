from pyspark.sql import functions as F

from claimloom.streaming import events

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def delivered(spark, tmp_path, times=2):
    rows = spark.range(100).select("id", F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("tool").alias("event_type")).withColumnRenamed("id", "event_id")
    for _ in range(times):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_events_delivered_twice_count_once(spark, tmp_path):
    seen = []
    q = events.folded_into(events.deduplicated(delivered(spark, tmp_path)), lambda b, i: seen.append(b.count()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sum(seen) == 100


def test_daily_rounds_and_progress_in_batches(spark, tmp_path):
    delivered(spark, tmp_path, 1)
    rows = spark.read.parquet(str(tmp_path / "in"))
    assert events.daily_rounds(rows).agg(F.sum("n")).head()[0] == 100
    last = events.progress(rows).where("user_id = 4").head()
    assert last.n == 20 and last.last_ts == rows.agg(F.max("ts")).head()[0]


def test_silence_is_reported(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 7), (2, 10, 8), (3, 1000, 8)], "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "user_id", F.lit("x").alias("event_type"))
    for i in (1, 2, 3):
        rows.where(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = []
    q = events.folded_into(events.silent(stream), lambda b, i: found.extend(r.user_id for r in b.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert 7 in found


def test_longest_and_last_message(spark):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (1, 2, "e")], "conv_id long, turn long, text string")
    r = events.messages(rows).head()
    assert (r.longest, r.last, r.n_turns) == ("ab", "e", 3)
