"""Files read in byte ranges give the rows of a single pass."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.sources import ranges, records, schemas

from .test_records import ALL


def varied(stream, rng, k):
    row = dict(ALL[stream])
    if stream == "lidar":
        row |= {"rev_id": k, "samples": [dict(angle_q6=rng.randrange(1 << 16), dist_q2=rng.randrange(1 << 16), quality=rng.randrange(64)) for _ in range(rng.choice([0, 1, 7, 40]))]}
    elif stream == "frames":
        row |= {"t_device_us": k, "jpeg": rng.randbytes(rng.choice([0, 3, 500]))}
    elif stream == "mesh":
        n = rng.randrange(4)
        row |= {"t_device_us": k, "vertices": [float(rng.randrange(9)) for _ in range(3 * n)], "faces": [0] * 3 * n, "classification": [1] * n}
    else:
        row |= {"t_device_us": k}
    return row


@pytest.mark.parametrize("size", [1, 700])
@pytest.mark.parametrize("stream", list(ALL))
def test_any_range_size_gives_the_same_rows(spark, folder, stream, size):
    rng = random.Random(size)
    want = {}
    for session, n in (("a", 23), ("b", 1), ("c", 0)):
        rows = [varied(stream, rng, k) for k in range(n)]
        os.makedirs(f"{folder}/{session}")
        with open(f"{folder}/{session}/{records.FILES[stream]}", "wb") as f:
            f.write(b"".join(records.stored(stream, r) for r in rows) + records.stored(stream, varied(stream, rng, 99))[:-1])
        want |= {(session, k): r for k, r in enumerate(rows)}
    found = records.read_stream(spark, folder, stream, size).collect()
    got = {(r.session_id, r.seq): r.asDict(recursive=True) for r in found}
    assert len(got) == len(found) and set(got) == set(want)
    for key, row in want.items():
        assert {k: bytes(got[key][k]) if k == "jpeg" else got[key][k] for k in row} == row
    split = ranges.fixed_ranges(ranges.files(spark, folder, records.FILES[stream]), records.STORED_POSE.itemsize, size) if stream == "poses" else ranges.record_ranges(ranges.files(spark, folder, records.FILES[stream]), *records.HEADS[stream], size)
    assert split.count() >= (20 if size == 1 else 2)


def test_whole_files_give_the_same_rows(spark, folder, monkeypatch):
    os.makedirs(f"{folder}/a")
    for stream, row in ALL.items():
        with open(f"{folder}/a/{records.FILES[stream]}", "wb") as f:
            f.write(records.stored(stream, row) * 5)
    split = {s: sorted(map(str, records.read_stream(spark, folder, s).collect())) for s in ALL}
    monkeypatch.setattr(ranges, "in_reach", lambda path: False)
    assert {s: sorted(map(str, records.read_stream(spark, folder, s).collect())) for s in ALL} == split


def packet(rng):
    start, q6, q2 = rng.random() < 0.1, rng.randrange(1 << 15), rng.randrange(1 << 16)
    return bytes([rng.randrange(64) << 2 | (1 if start else 2), (q6 & 0x7F) << 1 | 1, q6 >> 7, q2 & 0xFF, q2 >> 8])


def noisy(seed, n):
    rng = random.Random(seed)
    return b"".join(rng.randbytes(rng.randrange(9)) if rng.random() < 0.3 else packet(rng) for _ in range(n))


@pytest.mark.parametrize("limit", [5, 6, 13, 64, 1 << 20])
def test_a_serial_capture_is_split_anywhere(spark, folder, limit):
    streams = {"a": noisy(1, 400), "b": noisy(2, 3), "c": bytes(100), "d": b"", "e": noisy(3, 60)[:-2]}
    for session, data in streams.items():
        os.makedirs(f"{folder}/{session}")
        with open(f"{folder}/{session}/lidar.serial", "wb") as f:
            f.write(data)
    found = ranges.serial_packets(spark, folder, limit=limit).collect()
    want = sorted((s, k, *p) for s, data in streams.items() for k, p in enumerate(records.lidar_packets(data)))
    assert sorted(tuple(r) for r in found) == want


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(5, 20))
def test_exits_chain_to_a_single_pass(data, each):
    want = [p[0] - 5 for p in records.packets(data)]
    entry, got = 0, []
    for start in range(0, len(data), each):
        end = min(start + each, len(data))
        good = ranges._steps(data[start : min(end + 4, len(data))])
        found, at = ranges.packets_from(good, entry, end - start) if entry < end - start else ([], entry)
        got += [start + p for p in found]
        entry = at - (end - start)
    assert got == want


@pytest.mark.parametrize("stream", list(ALL))
def test_a_long_stream_is_written_in_several_files(spark, folder, monkeypatch, stream):
    """No task writes a session; readers number the rows over all files, whole or in ranges."""
    monkeypatch.setattr(records, "SEGMENT_BYTES", 1000)
    rng = random.Random(1)
    want = {("a" if k % 3 else "b", k): varied(stream, rng, k) for k in range(90)}
    rows = spark.createDataFrame([{"session_id": s, "seq": k} | r for (s, k), r in want.items()], schemas.STREAMS[stream])
    assert records.write_stream(rows, folder, stream) > 2
    assert len(os.listdir(f"{folder}/a")) > 2
    places = {s: {k: n for n, k in enumerate(sorted(k for t, k in want if t == s))} for s in "ab"}
    for reach in (True, False):
        monkeypatch.setattr(ranges, "in_reach", lambda path: reach)  # noqa: B023
        got = {(r.session_id, r.seq): r.asDict(recursive=True) for r in records.read_stream(spark, folder, stream, 500).collect()}
        assert len(got) == len(want)
        for (s, k), row in want.items():
            found = got[s, places[s][k]]
            assert {c: bytes(found[c]) if c == "jpeg" else found[c] for c in row} == row


@pytest.mark.parametrize("sizes", [(7,), (1, 2, 1, 3, 50), (500, 333)])
def test_a_serial_capture_goes_on_in_files_cut_anywhere(spark, folder, sizes):
    streams = {"a": noisy(5, 400), "b": noisy(6, 30)}
    for session, data in streams.items():
        os.makedirs(f"{folder}/{session}")
        at = number = 0
        while at < len(data):
            size = sizes[number % len(sizes)] if len(sizes) > 1 or number < 20 else len(data)
            with open(f"{folder}/{session}/lidar.serial.{number:05}", "wb") as f:
                f.write(data[at : at + size])
            at, number = at + size, number + 1
    found = ranges.serial_packets(spark, folder, limit=64).collect()
    assert sorted(tuple(r) for r in found) == sorted((s, k, *p) for s, data in streams.items() for k, p in enumerate(records.lidar_packets(data)))
