import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import fusion, temporal
from lodestrata.sources import records
from lodestrata.streaming import live

ROWS = "key string, t long, value double"


def batches(spark, folder, parts, schema=ROWS):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)
    return live.dropped_files(spark, f"{folder}/in", schema, 1)


def run(stream, folder, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name).collect()


def test_throttle_keeps_its_state_between_batches(spark, folder):
    s = batches(spark, folder, [[("a", 0, 1.0), ("a", 50, 2.0), ("b", 60, 3.0)], [("a", 99, 4.0), ("a", 100, 5.0)], [("a", 150, 6.0), ("a", 200, 7.0), ("b", 160, 8.0)]])
    got = run(live.throttled_stream(s, "key", "t", 100), folder, "throttled")
    assert sorted((r.key, r.t) for r in got) == [("a", 0), ("a", 100), ("a", 200), ("b", 60), ("b", 160)]


def test_segments_go_on_between_batches(spark, folder):
    s = batches(spark, folder, [[("a", 0, 1.0), ("a", 1, 20.0)], [("a", 2, 21.0), ("a", 3, 40.0)]])
    got = run(live.segment_stream(s, "key", "t", "value", 8.0), folder, "segmented")
    assert sorted((r.t, r.segment) for r in got) == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_envelope(spark, folder):
    s = batches(spark, folder, [[("a", 0, 3.0), ("a", 400_000, 1.0), ("a", 600_000, 2.0)], [("a", 60_000_000, 5.0)], [("a", 120_000_000, 5.0)]])
    timed = s.withColumn("at", F.timestamp_micros("t"))
    got = run(live.envelope_stream(timed, ["key"], "at", "value"), folder, "enveloped")
    assert sorted(r.delay for r in got)[:2] == [1.0, 2.0]


def test_newest_rows(spark, folder):
    s = batches(spark, folder, [[("a", 1, 1.0), ("b", 1, 1.0)], [("a", 3, 3.0), ("a", 2, 2.0)]])
    q = s.writeStream.foreachBatch(live.keep_newest(f"{folder}/newest", ["key"], "t")).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert {r.key: r.value for r in live.newest(spark, f"{folder}/newest", s.schema, 1).collect()} == {"a": 3.0, "b": 1.0}


def test_newest_rows_are_a_log_of_runs(spark, folder, monkeypatch):
    monkeypatch.setattr(live, "MERGED_RUNS", 3)
    put, at = live.keep_newest(f"{folder}/log", ["key"], "t"), {}
    for number in range(14):
        rows = [(f"k{(5 * number + j) % 17}", number * 10 + j % 4, float(number)) for j in range(8)]
        for again in range(2 if number in (2, 8, 13) else 1):  # a batch that is run again changes nothing
            put(spark.createDataFrame(rows, ROWS), number)
        for k, t, v in rows:
            at[k] = max(at.get(k, (-1, 0.0)), (t, v))
        if number in (2, 7, 13):
            got = {r.key: (r.t, r.value) for r in live.newest(spark, f"{folder}/log", ROWS).collect()}
            assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in at.items()}
        if number == 7:
            then = dict(got)
    assert live._outer(live._runs(spark, f"{folder}/log")) == [(0, 8), (9, 11), (12, 12), (13, 13)]
    assert {k: t for k, (t, _) in then.items()} != {k: t for k, (t, _) in got.items()}
    assert spark.read.schema(ROWS).parquet(f"{folder}/log/run=13-13").count() <= 8  # a batch writes its own keys alone


def test_windows_from_the_series_start(spark, folder):
    rng = random.Random(3)
    rows = [(k, 1_003_000 + 40_000 * i + rng.randrange(20_000), float(rng.randrange(50)), i) for k in "ab" for i in range(90)]
    last = [(k, 600_000_000, 1.0, 10_000) for k in "ab"]
    parts = [[r for r in rows if r[3] // 30 == n] for n in range(3)] + [last, [(k, 900_000_000, 1.0, 10_001) for k in "ab"]]
    schema = "key string, t long, delay double, seq long"
    s = batches(spark, folder, parts, schema).withColumn("at", F.timestamp_micros("t"))
    got = run(live.series_envelope_stream(s, "key", "at", "t", "delay", "seq", 500_000), folder, "series")
    want = temporal.envelope(spark.createDataFrame(rows, schema), ["key"], "t", "delay", "seq", 500_000).collect()
    assert sorted((r.key, r.bin, r.t, r.delay) for r in got if r.t < 500_000_000) == sorted((r.key, r.bin, r.t, r.delay) for r in want)


def test_times_wait_for_their_clock_segment(spark, folder):
    key, second = ["session_id"], 1_000_000
    rows = [("s", n, 10 * second + n * second // 4) for n in range(200)] + [("s", 900, 1_000 * second), ("u", 901, 12 * second), ("u", 902, 1_000 * second)]
    cuts = [("s", 12 * second, 5_000.0, -300e-6), ("s", 25 * second, 9_000.0, -300e-6), ("s", 47 * second, 2_000.0, -300e-6), ("s", 58 * second, 100.0, -300e-6)]
    segments = spark.createDataFrame(cuts, "session_id string, start_us long, intercept double, pooled double")
    want = {r.n: r.host for r in fusion.device_to_host(spark.createDataFrame(rows[:200], "session_id string, n long, t_device_us long"), segments, name="host").collect()}
    left = batches(spark, f"{folder}/left", [rows[:80], rows[80:150], rows[150:200], rows[200:], [("s", 950, 2_000 * second)]], "session_id string, n long, t long").withColumn("at", F.timestamp_micros("t"))
    late = [("s", 1_900 * second, 0.0, 0.0), ("u", 1_900 * second, 0.0, 0.0)]  # moves the watermark of both streams
    right = batches(spark, f"{folder}/right", [cuts[:1], cuts[1:3], cuts[3:], late, late], "session_id string, start_us long, intercept double, slope double").withColumn("at", F.timestamp_micros("start_us"))
    got = run(live.mapped_stream(left, right, "session_id", "at", "t", "100 seconds"), folder, "mapped")
    found = {r.n: r.host_us for r in got}
    assert len(found) == len(got) and {n: found[n] for n in want} == want
    assert found[901] is not None  # its key's first segment, though that begins later


def test_live_wire(spark, folder):
    payload = records.pack_pose(dict(t_device_us=9, px=1.0, py=0.0, pz=0.0, qx=0.0, qy=0.0, qz=0.0, qw=1.0, fx=1.0, fy=1.0, cx=0.0, cy=0.0, tracking_state=2))
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        link, _ = server.accept()
        data = records.wire(records.HELLO, records.pack_hello(1, "p", "o", 1)) + records.wire(records.POSE_TYPE, payload) * 3
        link.sendall(data[:40])
        time.sleep(0.1)
        link.sendall(data[40:])
        time.sleep(30)

    threading.Thread(target=serve, daemon=True).start()
    spark.dataSource.register(live.WireSource)
    stream = spark.readStream.format("wire").option("port", server.getsockname()[1]).option("wait_s", 2).load()
    q = stream.writeStream.format("memory").queryName("wired").option("checkpointLocation", f"{folder}/ck").start()
    for _ in range(100):
        if q.exception() is not None or spark.table("wired").count() >= 4:
            break
        time.sleep(0.2)
    q.stop()
    rows = spark.table("wired").orderBy("seq").collect()
    assert [r.type for r in rows] == [records.HELLO, records.POSE_TYPE, records.POSE_TYPE, records.POSE_TYPE]
    gap = rows[-1].t_arrival_us - rows[0].t_arrival_us  # both halves may lie in one batch
    assert 50_000 < gap < 5_000_000 and live.greeting(bytes(rows[0].payload))["name"] == "p"
    with pytest.raises(RuntimeError, match="fresh checkpoint"):
        live.WireReader({"port": 1}).readBetweenOffsets({"message": 0}, {"message": 2})
    with pytest.raises(ValueError, match="version"):
        live.greeting(records.pack_hello(3, "", "", 0))
