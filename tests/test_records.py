import json
import os

import pytest

from lodestrata.functions.scalars import CAPABILITIES, TRACKING, bit_names, evenly_spread, first_rule, named
from lodestrata.sources import records, schemas, sessions
from pyspark.sql import functions as F

POSE = dict(t_arrival_us=5, t_device_us=7, px=1.0, py=2.0, pz=3.0, qx=0.0, qy=0.0, qz=0.0, qw=1.0, fx=60.0, fy=55.0, cx=31.5, cy=23.5, tracking_state=2)
LIDAR = dict(t_arrival_us=6, rev_id=3, samples=[dict(angle_q6=64 * k, dist_q2=4000 + k, quality=15) for k in range(3)])
FRAME = dict(t_arrival_us=8, t_device_us=9, width=4, height=2, jpeg=b"jpeg")
DEPTH = dict(t_arrival_us=0, t_device_us=9, width=2, height=2, fx=1.0, fy=1.0, cx=0.5, cy=0.5, depth_mm=[0, 1000, 2000, 3000], confidence=[0, 1, 2, 2])
MESH = dict(t_arrival_us=0, t_device_us=9, anchor_id="00" * 15 + "ff", transform=[float(k) for k in range(16)], vertices=[0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0], faces=[0, 1, 2], classification=[7])
ALL = {"poses": POSE, "lidar": LIDAR, "frames": FRAME, "depth": DEPTH, "mesh": MESH}


@pytest.fixture
def root(folder):
    for session in ("2026-01-01T00-00-00", "2026-01-02T00-00-00"):
        os.makedirs(f"{folder}/raw/{session}")
        for stream, row in ALL.items():
            if stream == "mesh" and session.startswith("2026-01-01"):
                continue
            whole = records.stored(stream, row) * 2
            with open(f"{folder}/raw/{session}/{records.FILES[stream]}", "wb") as f:
                f.write(whole + records.stored(stream, row)[:-1])  # the last record is cut short
        with open(f"{folder}/raw/{session}/manifest.json", "w") as f:
            json.dump({"format_version": 1, "counts": {s: 2 for s in ALL}}, f)
    return folder


@pytest.mark.parametrize("stream", list(ALL))
def test_round_trip(spark, root, stream):
    rows = records.read_stream(spark, f"{root}/raw", stream).orderBy("session_id", "seq").collect()
    assert len(rows) == (2 if stream == "mesh" else 4)
    got = rows[-1].asDict(recursive=True)
    assert {k: got[k] for k in ALL[stream]} == ALL[stream] and got["seq"] == 1


def test_import_and_manifest(spark, root):
    for _ in range(2):  # again: the same rows
        sessions.import_sessions(spark, f"{root}/raw", f"{root}/tables")
    assert sessions.stream_table(spark, f"{root}/tables", "poses").count() == 4
    assert sessions.latest_session(spark, f"{root}/raw") == "2026-01-02T00-00-00"
    wrong = sessions.count_mismatches(spark, f"{root}/raw", f"{root}/tables").collect()
    assert [(r.session_id, r.stream, r.recorded, r.stored) for r in wrong] == [("2026-01-01T00-00-00", "mesh", 2, 0)]
    order = [(r.t_arrival_us, r.stream, r.seq) for r in sessions.merged_records(spark, f"{root}/tables").where("session_id like '2026-01-02%'").collect()]
    assert order == sorted(order) and len(order) == 10


def test_manifest_needs_version(spark, folder):
    os.makedirs(f"{folder}/x")
    with open(f"{folder}/x/manifest.json", "w") as f:
        json.dump({"notes": "none"}, f)
    with pytest.raises(Exception, match="format_version"):
        sessions.manifests(spark, folder).collect()


def test_wire(spark):
    data = records.wire(records.HELLO, records.pack_hello(1, "phone", "1.0", 5)) + records.wire(records.POSE_TYPE, records.pack_pose(POSE)) + records.wire(0x7F, b"later") + records.wire(records.POSE_TYPE, records.pack_pose(POSE))[:-2]
    found = list(records.messages(data))
    assert [k for k, _ in found] == [records.HELLO, records.POSE_TYPE, 0x7F]
    assert records.hello_payload(found[0][1]) == {"version": 1, "name": "phone", "os": "1.0", "capabilities": 5}
    raw = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(found)], schemas.MESSAGES)
    rows = records.decode_poses(raw).collect()
    assert len(rows) == 1 and rows[0].pz == 3.0 and rows[0].t_device_us == 7
    with pytest.raises(ValueError, match="limit"):
        list(records.messages(records.WIRE_HEAD.pack(records.LIMIT + 1, 2)))
    with pytest.raises(ValueError, match="version"):
        list(records.messages(records.wire(records.HELLO, records.pack_hello(9, "", "", 0))))


def test_packets_slide_to_the_next_mark(spark):
    def packet(start, degrees, mm, quality=15):
        q6, q2 = int(degrees * 64), int(mm * 4)
        return bytes([quality << 2 | (1 if start else 2), (q6 & 0x7F) << 1 | 1, q6 >> 7, q2 & 0xFF, q2 >> 8])

    data = b"\x00" + packet(True, 10.5, 1000) + packet(False, 20.25, 0) + packet(True, 1, 5.25)
    got = list(records.lidar_packets(data))
    assert got == [(True, 10.5, 1000.0, 15), (False, 20.25, 0.0, 15), (True, 1.0, 5.25, 15)]
    rows = spark.createDataFrame([("s", i, *g) for i, g in enumerate(got)], "session_id string, seq long, start boolean, degrees double, mm double, quality int")
    assert [(r.rev_id, len(r.samples)) for r in records.revolutions(rows).orderBy("rev_id").collect()] == [(1, 2), (2, 1)]


def test_truth_and_calibration(spark, folder):
    with open(f"{folder}/truth.json", "w") as f:
        json.dump({"_note": "tape", "wall span A": 4.0, "door width": 0.9}, f)
    with open(f"{folder}/timing.json", "w") as f:
        json.dump({"lidar_lag_us": -11200.0, "lidar_yaw_sign": 1, "rest": {"a": 1}}, f, indent=1)
    assert {r.name: r.tape_m for r in sessions.truth(spark, f"{folder}/truth.json").collect()} == {"wall span A": 4.0, "door width": 0.9}
    assert sessions.calibration(spark, f"{folder}/timing.json", sessions.TIMING) == {"lidar_lag_us": -11200.0, "lidar_yaw_sign": 1}


def test_codes(spark):
    r = spark.range(8).select(bit_names(F.col("id"), CAPABILITIES).alias("n"), named(F.col("id"), TRACKING).alias("t"), first_rule((F.col("id") > 5, "high"), (F.col("id") > 2, "middle")).alias("w")).collect()
    assert r[5].n == ["scene-reconstruction", "camera-frames"] and r[0].n == []
    assert r[2].t == "normal" and r[7].t == "unknown(7)"
    assert [x.w for x in r] == [None, None, None, "middle", "middle", "middle", "high", "high"]


def test_even_sample(spark):
    for n, most in ((10, 4), (1000, 7), (5, 9), (800, 800), (801, 800)):
        got = [r.id for r in spark.range(n).where(evenly_spread(F.col("id"), F.lit(n), most)).orderBy("id").collect()]
        assert got == (list(range(n)) if n <= most else sorted({i * (n - 1) // (most - 1) for i in range(most)}))
