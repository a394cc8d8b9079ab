import json

from quire.streaming import load_events


def test_log_is_read_once_and_appended(spark, tmp_path):
    log, out, state = (tmp_path / n for n in ("log", "out", "state"))
    log.mkdir()
    line = {"session_id": "s", "event": "SessionStart", "file_path": "f", "source": "compact", "cwd": "c", "ts": "2026-01-01T00:00:00Z"}
    (log / "a.json").write_text(json.dumps(line) + "\nnot json\n" + json.dumps({**line, "load_reason": "other", "ts": "?"}) + "\n")
    for _ in range(2):
        events = load_events.reshaped(load_events.read_log(spark, str(log)))
        load_events.append(events, str(out), str(state)).awaitTermination(60)
    rows = spark.read.json(str(out)).collect()
    assert sorted((r.load_reason or "", r.ts is None) for r in rows) == [("", True), ("compact", False), ("other", True)]
    (log / "b.json").write_text(json.dumps(line) + "\n")
    events = load_events.compactions(load_events.reshaped(load_events.read_log(spark, str(log))))
    load_events.append(events, str(out), str(state)).awaitTermination(60)
    assert spark.read.json(str(out)).count() == 4


def test_windows_count_repeated_events_once(spark, tmp_path):
    data = tmp_path / "events"
    rows = [(1, "2026-01-01 00:10:00", "view"), (1, "2026-01-01 00:10:00", "view"), (2, "2026-01-01 00:20:00", "view"), (3, "2026-01-01 05:00:00", "click")]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, event_type string").selectExpr("event_id", "to_timestamp(ts) AS ts", "event_type")
    df.write.parquet(str(data))
    stream = spark.readStream.schema(df.schema).parquet(str(data))
    query = load_events.windowed(stream).writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.event_type, r.n) for r in spark.table("windowed").collect()) == [("click", 1), ("view", 2)]
