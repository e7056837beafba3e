"""Sentences over a stream of Parquet files."""

import pytest
from plainframe import PlainError
from plainframe.streaming import run_stream
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.mode("overwrite").parquet(str(folder))
    return rows, spark.readStream.schema(rows.schema).parquet(str(folder))


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_rows_one_by_one(spark, events):
    rows, stream = events
    users = spark.createDataFrame([(k, f"u{k}") for k in range(50)], "user_id long, who string")
    out = run_stream('e then keep where [value] > 20 then add [v] as [value] * 2 then join u by [user_id] unmatched "none" then pick [event_id, v, who]', e=stream, u=users)
    assert out.isStreaming
    got = drained(spark, out, "one_by_one")
    want = rows.filter("value > 20").join(users, "user_id").select("event_id", (F.col("value") * 2).alias("v"), "who")
    assert sorted(got.collect()) == sorted(want.collect())


def test_windows(spark, events):
    rows, stream = events
    out = run_stream("e then summarize [n] as row_count() by [event_type]", time="ts", watermark="1 day", window="30 days", e=stream)
    got = drained(spark, out, "windows", "complete")
    assert got.agg(F.sum("n")).first()[0] == rows.count()
    assert got.columns == ["window_start", "window_end", "event_type", "n"]


@pytest.mark.parametrize("sentence", ["e then sort [ts]", "e then take 3", "e then drop_duplicates", "e then summarize [n] as row_count()", "e then add [n] as row_count() by [user_id]"])
def test_refused(events, sentence):
    with pytest.raises(PlainError, match="on a stream"):
        run_stream(sentence, e=events[1])
