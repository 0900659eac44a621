"""Streaming operators, run to the end of what lies in a folder."""

import datetime as dt

from pyspark.sql import functions as F

from stratakb.streaming import ingest


def run(stream, mode, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def at(minute, day=1):
    return dt.datetime(2024, 1, day, 0, 0) + dt.timedelta(minutes=minute)


def test_ingest_drops_known_bodies(spark, tmp_path):
    rows = [("a", "x\r\n", at(0)), ("b", "x", at(1)), ("c", "y", at(2)), ("d", None, at(3))]
    schema = "doc_id string, body string, stored_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.new_documents(ingest.read_stream(spark, str(tmp_path / "in"), schema), "stored_at")
    assert sorted(r.body.strip() for r in run(stream, "append", "docs").collect()) == ["x", "y"]


def test_windows_and_sessions(spark, tmp_path):
    rows = [(1, at(0)), (1, at(5)), (2, at(61)), (1, at(100))]
    spark.createDataFrame(rows, "user_id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: ingest.read_stream(spark, str(tmp_path / "in"), "user_id int, ts timestamp")
    counts = run(ingest.windowed_counts(source(), "ts", "user_id", "1 hour"), "complete", "counts").collect()
    assert sorted((r.user_id, r.events) for r in counts) == [(1, 1), (1, 2), (2, 1)]
    sessions = run(ingest.session_counts(source(), "ts", "user_id", "30 minutes"), "complete", "sessions").collect()
    assert sorted((r.user_id, r.events) for r in sessions) == [(1, 1), (1, 2), (2, 1)]


def test_hit_state_over_batches(spark, tmp_path):
    schema = "skill string, ts timestamp"
    for i, rows in enumerate([[("s", at(0)), ("s", at(1)), ("t", at(2))], [("s", at(0, 2)), (None, at(0, 2))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.hit_state(ingest.read_stream(spark, str(tmp_path / "in"), schema, files=1), "skill", "ts")
    last = run(stream, "update", "hits").groupBy("key").agg(F.max_by(F.struct("hits", "days", "promoted"), "hits").alias("r")).collect()
    assert {r.key: tuple(r.r) for r in last} == {"s": (3, 2, True), "t": (1, 1, False)}


def test_counter_versions(spark, tmp_path):
    write = ingest.keep_counts(str(tmp_path / "state"), "kw")
    write(spark.createDataFrame([("a",), ("a",), ("b",)], "kw string"), 0)
    write(spark.createDataFrame([("a",)], "kw string"), 1)
    write(spark.createDataFrame([("a",)], "kw string"), 1)  # a batch that is repeated after a failure
    got = {r.kw: r["count"] for r in spark.read.parquet(str(tmp_path / "state" / "v1")).collect()}
    assert got == {"a": 3, "b": 1}


def test_days_that_come_late_count_once(spark, tmp_path):
    """Three days in any order are three days; a day seen before isn't another."""
    schema = "skill string, ts timestamp"
    for rows in ([("s", at(0, 3))], [("s", at(0, 1)), ("s", at(9, 3))], [("s", at(0, 2)), (None, at(0, 2)), ("s", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.hit_state(ingest.read_stream(spark, str(tmp_path / "in"), schema, files=1), "skill", "ts", hits=4, days=3)
    out = ingest.last_rows(ingest.drain(stream, "update", str(tmp_path / "run")), "key").collect()
    assert [(r.key, r.hits, r.days, r.promoted) for r in out] == [("s", 4, 3, True)]


def test_keys_without_hits_are_forgotten(spark, tmp_path):
    schema = "skill string, ts timestamp"
    for rows in ([("s", at(0, 1))], [("t", at(0, 25))], [("t", at(0, 26))], [("s", at(0, 27))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.hit_state(ingest.read_stream(spark, str(tmp_path / "in"), schema, files=1), "skill", "ts", late="1 day", keep_days=2)
    out = {r.key: r.hits for r in ingest.last_rows(ingest.drain(stream, "update", str(tmp_path / "run")), "key").collect()}
    assert out == {"s": 1, "t": 2}
