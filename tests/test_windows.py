"""Windows over streams: late rows, sessions across batches, restarts, and the same windows of a table."""

from datetime import datetime

from pyspark.sql import functions as F

from lectern.streaming import windows

SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def at(clock):
    return datetime.fromisoformat(f"2024-03-01 {clock}")


def drop(spark, folder, rows):
    """One more file."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def shown(df):
    return sorted((r.start.strftime("%H:%M"), r.end.strftime("%H:%M"), r.user_id, r.n, r.total) for r in df.collect())


def test_late_rows_are_dropped_and_rows_out_of_order_count(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [
        [(1, 1, at("10:05"), 1.0), (2, 1, at("10:50"), 2.0), (9, 1, None, 9.0)],
        [(3, 1, at("10:20"), 4.0), (4, 2, at("13:00"), None)],  # out of order, in time
        [(5, 1, at("10:40"), 100.0), (6, 2, at("12:30"), 3.0)],  # the first is late: 10:00 to 11:00 closed at 12:00
        [(7, 3, at("18:00"), 0.0)],
    ]
    for rows in batches:
        drop(spark, source, rows)
        made = windows.sliding(windows.event_stream(spark, source, SCHEMA, files=1), ["user_id"], "value", "1 hour", "1 hour")
        windows.write_closed(made, sink, state).awaitTermination()
    got = shown(spark.read.parquet(sink))
    assert got == [("10:00", "11:00", 1, 3, 7.0), ("12:00", "13:00", 2, 1, 3.0), ("13:00", "14:00", 2, 1, None)]
    # A table has all windows, late rows too.
    rows = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    assert shown(windows.sliding(rows, ["user_id"], "value", "1 hour", "1 hour"))[0] == ("10:00", "11:00", 1, 4, 107.0)
    assert windows.sliding(rows.where("false"), ["user_id"], "value").count() == 0


def test_sessions_across_batches(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([(1, 1, at("10:00"), 1.0), (2, 1, at("10:25"), 1.0), (3, None, at("10:00"), 5.0)], [(4, 1, at("10:50"), 1.0), (5, 1, at("11:40"), 1.0)], [(6, 2, at("20:00"), 1.0)]):
        drop(spark, source, rows)
        made = windows.sessions(windows.event_stream(spark, source, SCHEMA, files=1), ["user_id"], "value")
        windows.write_closed(made, sink, state).awaitTermination()
    got = sorted((r.start.strftime("%H:%M"), r.end.strftime("%H:%M"), r.user_id or 0, r.n, r.total) for r in spark.read.parquet(sink).collect())
    assert got == [("10:00", "10:30", 0, 1, 5.0), ("10:00", "11:20", 1, 3, 3.0), ("11:40", "12:10", 1, 1, 1.0)]


def test_repeated_events_count_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([(1, 1, at("10:00"), 1.0), (1, 1, at("10:00"), 1.0)], [(1, 1, at("10:10"), 1.0), (2, 1, at("10:10"), 1.0)]):
        drop(spark, source, rows)
        made = windows.once(windows.event_stream(spark, source, SCHEMA, files=1), ["event_id"])
        windows.write_closed(made, sink, state).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == [1, 2]
    assert windows.once(spark.createDataFrame([(1, 1, at("10:00"), 1.0)] * 2, SCHEMA).withColumn("w", F.lit(1)), ["event_id"]).count() == 1
