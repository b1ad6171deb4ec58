"""Recording of live streams: each row once whatever happens to the driver, timers, dropped rows, decoders of wire messages."""

import datetime
import glob
import json
import os
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import records, schemas, sessions
from lodestrata.streaming import live, record

POSE = dict(px=1.0, py=0.0, pz=0.0, qx=0.0, qy=0.0, qz=0.0, qw=1.0, fx=1.0, fy=1.0, cx=0.0, cy=0.0, tracking_state=2)
DEPTH = dict(t_device_us=5, width=2, height=1, fx=1.0, fy=1.0, cx=0.5, cy=0.5, depth_mm=[1000, 2000], confidence=[2, 1])
MESH = dict(t_device_us=6, anchor_id="ab" * 16, transform=[1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], vertices=[0.0, 0, 0, 1, 0, 0, 0, 0, 1], faces=[0, 1, 2], classification=[2])
FRAME = dict(t_device_us=4, width=640, height=480, jpeg=b"\xff\xd8jpeg")


def pose(k):
    return records.wire(records.POSE_TYPE, records.pack_pose(POSE | {"t_device_us": k}))


def sender(parts, hold=60.0):
    """A port where each connection in turn gets its parts, (seconds, bytes) each, and stays open for a while."""
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        for part in parts:
            link, _ = server.accept()
            threading.Thread(target=send, args=(link, part), daemon=True).start()

    def send(link, part):
        with link:
            for wait, data in part:
                time.sleep(wait)
                link.sendall(data)
            time.sleep(hold)

    threading.Thread(target=serve, daemon=True).start()
    return server.getsockname()[1]


def rows_of(reader, want, seconds=10):
    got, at, until = [], reader.initialOffset(), time.monotonic() + seconds
    while len(got) < want and time.monotonic() < until:
        rows, at = reader.read(at)
        got += list(rows)
    return got, at


def test_names():
    assert record.session_name(datetime.datetime(2026, 8, 12, 23, 4, 6)) == "2026-08-12T23-04-06"


def test_timers():
    assert (live.WireReader({"port": 1}).first, live.WireReader({"port": 1}).quiet) == (5.0, 5.0)
    assert (live.RangeReader({"port": 1}).first, live.RangeReader({"port": 1}).quiet) == (8.0, 2.0)
    reader = live.WireReader({"port": sender([[(0, pose(1) + pose(2)[:9])]]), "quiet_s": 0.4})
    got, at = rows_of(reader, 1)
    assert len(got) == 1 and at["message"] == 1
    began = time.monotonic()
    with pytest.raises(TimeoutError, match="quiet"):
        while time.monotonic() < began + 5:
            reader.read(at)
    assert time.monotonic() - began < 2
    late = live.RangeReader({"port": sender([[(0.8, b"\x00")]]), "first_s": 2.0, "quiet_s": 0.2})
    with pytest.raises(TimeoutError, match="0.2 s"):  # the first bytes had longer
        rows_of(late, 1)
    with pytest.raises(TimeoutError, match="0.3 s"):
        rows_of(live.RangeReader({"port": sender([[(5, b"\x00")]]), "first_s": 0.3}), 1)
    closed = live.WireReader({"port": sender([[(0, pose(1) * 3)]], hold=0)})
    assert len(rows_of(closed, 3)[0]) == 3
    with pytest.raises(ConnectionError, match="closed"):
        rows_of(closed, 1)
    with pytest.raises(ValueError, match="limit"):
        rows_of(live.WireReader({"port": sender([[(0, records.WIRE_HEAD.pack(records.LIMIT + 1, 2))]])}), 1)


@pytest.mark.parametrize("drops", ["newest", "oldest"])
def test_dropped_rows_are_counted(drops):
    reader = live.WireReader({"port": sender([[(0, b"".join(map(pose, range(20))))]]), "most_waiting": 5, "drops": drops})
    rows, at = reader.read(reader.initialOffset())
    time.sleep(0.5)
    more, at = reader.read(at)
    first = [records.pose_payload(r[2])["t_device_us"] for r in [*rows, *more]]
    assert at["dropped"] + len(first) == 20 and at["dropped"] >= 10 and first == sorted(first)
    assert live.dropped_rows({"sources": [{"endOffset": json.dumps(at)}, {"endOffset": None}]}) == at["dropped"]


def test_nothing_is_dropped_without_a_limit():
    reader = live.WireReader({"port": sender([[(0, b"".join(map(pose, range(500))))]]), "max_rows": 7})
    got, at = rows_of(reader, 500)
    assert [records.pose_payload(r[2])["t_device_us"] for r in got] == list(range(500)) and at == {"message": 500, "dropped": 0}


def packet(start, degrees, mm, quality=15):
    q6, q2 = int(degrees * 64), int(mm * 4)
    return bytes([quality << 2 | (1 if start else 2), (q6 & 0x7F) << 1 | 1, q6 >> 7, q2 & 0xFF, q2 >> 8])


def test_revolutions_of_a_byte_stream():
    data = b"\x00\x00" + b"".join(packet(k % 10 == 0, k % 10 * 30.5, 1000 + k) for k in range(41))
    reader = live.RangeReader({"port": sender([[(0, data[:33]), (0.1, data[33:90]), (0.1, data[90:])]])})
    got, _ = rows_of(reader, 4)
    assert [(r[0], r[1], len(r[2])) for r in got] == [(0, 0, 10), (1, 1, 10), (2, 2, 10), (3, 3, 10)]
    assert got[1][2][3] == {"angle_q6": 91 * 64 + 32, "dist_q2": 1013 * 4, "quality": 15} and all(a[3] <= b[3] for a, b in zip(got, got[1:]))


def test_log(folder):
    log = f"file://{folder}/log"
    first = live.WireReader({"port": sender([[(0, b"".join(map(pose, range(6))))]]), "log": log, "max_rows": 4})
    got, at = rows_of(first, 4)
    more, end = rows_of_from(first, at, 2)
    fresh = live.WireReader({"port": 1, "log": log})  # another driver: nothing is connected
    assert list(fresh.readBetweenOffsets({"message": 1}, {"message": 5})) == (got + more)[1:5]
    assert list(fresh.read({"message": 4})[0]) == more
    fresh.commit({"message": 4})
    assert len(glob.glob(f"{folder}/log/*.arrow")) == 1 and list(fresh.read({"message": 4})[0]) == more
    with pytest.raises(RuntimeError, match="went with the connection"):
        fresh.readBetweenOffsets({"message": 0}, {"message": 2})


def rows_of_from(reader, at, want):
    got, until = [], time.monotonic() + 10
    while len(got) < want and time.monotonic() < until:
        rows, at = reader.read(at)
        got += list(rows)
    return got, at


def test_wire_decoders(spark):
    pay = [(records.POSE_TYPE, records.pack_pose(POSE | {"t_device_us": 3})), (records.FRAME_TYPE, records.pack_frame(FRAME)), (records.DEPTH_TYPE, records.pack_depth(DEPTH)), (records.MESH_TYPE, records.pack_mesh(MESH)), (0x7F, b"later")]
    raw = spark.createDataFrame([(i, k, p, 10 * i) for i, (k, p) in enumerate(pay)], live.WIRE)
    for stream, want in (("frames", FRAME), ("depth", DEPTH), ("mesh", MESH)):
        (row,) = records.decoded_messages(raw, stream, ("t_arrival_us",)).collect()
        got = row.asDict()
        assert {k: (bytes(v) if k == "jpeg" else v) for k, v in got.items() if k in want} == want and got["t_arrival_us"] == 10 * got["seq"]
    bad = spark.createDataFrame([(0, records.FRAME_TYPE, records.pack_frame(FRAME)[:-3], 0), (1, records.FRAME_TYPE, records.pack_frame(FRAME), 0)], live.WIRE)
    assert [r.seq for r in records.decoded_messages(bad, "frames", strict=False).collect()] == [1]
    with pytest.raises(Exception, match="could not decode message 0 of type 0x03"):
        records.decoded_messages(bad, "frames").collect()


def test_a_session_is_recorded_once_though_the_driver_goes(spark, folder):
    spark.dataSource.register(live.WireSource)
    hello = records.wire(records.HELLO, records.pack_hello(1, "phone", "26", 5))
    rest = records.wire(records.FRAME_TYPE, records.pack_frame(FRAME)) + records.wire(records.DEPTH_TYPE, records.pack_depth(DEPTH)) + records.wire(records.MESH_TYPE, records.pack_mesh(MESH))
    # two reads take what the first connection sends; the second batch doesn't end
    port = sender([[(0, hello + b"".join(map(pose, range(28))) + rest)], [(0, hello + b"".join(map(pose, range(28, 60))))]])
    recorder, out = record.Recorder(f"{folder}/out", "s1"), f"{folder}/out"

    def start(batch):
        stream = spark.readStream.format("wire").option("port", port).option("max_rows", 16).option("wait_s", 1).option("log", f"file://{folder}/log").load()
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/ck").start()

    class Gone(Exception):
        pass

    def fails(raw, number):
        if number == 1:
            recorder._put(records.decoded_messages(raw, "poses", ("t_arrival_us",)), "poses", "phone", number)  # written, not committed
            raise Gone
        recorder.messages()(raw, number)

    q = start(fails)
    with pytest.raises(Exception, match="Gone"):
        q.awaitTermination(60)
    held = record.recorded(spark, out, "poses")
    assert 0 < held.count() < spark.read.schema(schemas.POSES).parquet(f"{out}/poses").count()  # what isn't committed isn't there
    q = start(recorder.messages())
    for _ in range(150):
        if q.exception() is not None or record.recorded(spark, out, "poses").where("t_device_us = 59").count():
            break
        time.sleep(0.2)
    q.stop()
    assert q.exception() is None
    poses = record.recorded(spark, out, "poses").orderBy("seq").collect()
    assert [p.t_device_us for p in poses] == list(range(60)) and len({p.seq for p in poses}) == 60 and {p.session_id for p in poses} == {"s1"}
    turns = [(k, k, [{"angle_q6": 64 * k, "dist_q2": 4000, "quality": 9}] * 3, 100 * k) for k in range(5)]
    spark.createDataFrame(turns, live.RANGES).coalesce(1).write.parquet(f"{folder}/turns")
    lidar = live.dropped_files(spark, f"{folder}/turns", live.RANGES)
    lidar.writeStream.foreachBatch(recorder.rows("lidar", "ranges")).option("checkpointLocation", f"{folder}/ck2").trigger(availableNow=True).start().awaitTermination(60)
    assert not os.path.exists(f"{out}/manifests/s1/manifest.json")
    said = recorder.finish(spark, "kitchen loop")
    assert said["counts"] == {"poses": 60, "lidar": 5, "frames": 1, "depth": 1, "mesh": 1, "lidar_samples": 15}
    assert said["device"] == {"name": "phone", "os": "26", "capabilities": ["scene-reconstruction", "camera-frames"]}
    assert sessions.count_mismatches(spark, f"{out}/manifests", out).count() == 0 and sessions.latest_session(spark, f"{out}/manifests") == "s1"
    assert recorder.finish(spark, "kitchen loop") == said  # again, in its place
    assert sessions.stream_table(spark, out, "lidar").columns == ["session_id", "seq", "t_arrival_us", "rev_id", "samples"]


def test_streams_may_be_left_out(spark, folder):
    raw = spark.createDataFrame([(0, records.FRAME_TYPE, records.pack_frame(FRAME), 1), (1, records.POSE_TYPE, records.pack_pose(POSE | {"t_device_us": 3}), 2)], live.WIRE)
    recorder = record.Recorder(f"{folder}/out", "s", skip=("frames",))
    for number in (0, 0, 1):
        recorder.messages()(raw, number)
    assert recorder.finish(spark)["counts"]["frames"] == 0 and record.recorded(spark, f"{folder}/out", "poses").count() == 2
    assert record.recorded(spark, f"{folder}/out", "frames").count() == 0


def test_quiet_keys(spark, folder):
    def put(rows):
        spark.createDataFrame(rows, "key string, t long").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    put([("a", 1), ("b", 1), ("b", 2)])
    q = live.quiet_keys(live.dropped_files(spark, f"{folder}/in", "key string, t long", 1), "key", "t", 60_000, 1_500)
    q = q.writeStream.format("memory").queryName("quiet").option("checkpointLocation", f"{folder}/ck").start()
    for _ in range(100):
        if spark.table("quiet").count():
            break
        time.sleep(0.2)
    put([("b", 9)])
    time.sleep(1)
    q.stop()
    assert q.exception() is None
    rows = spark.table("quiet").where("t < 9").collect()
    assert [(r.key, r.t, r.waited_ms) for r in rows] == [("b", 2, 1_500)]
