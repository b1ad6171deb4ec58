"""Binary records of a session's streams, as arrays of bytes in and rows out.

Each stream is a file of records; a record cut short at the end is left out. Layouts are little-endian.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges, schemas
from .tables import stow

#: Record layouts, wire message types and limits.
POSE = np.dtype([("t_device_us", "<u8"), ("p", "<f4", 3), ("q", "<f4", 4), ("k", "<f4", 4), ("tracking_state", "u1")])
STORED_POSE = np.dtype([("t_arrival_us", "<u8"), ("pose", POSE)])
SAMPLE = np.dtype([("angle_q6", "<u2"), ("dist_q2", "<u2"), ("quality", "u1")])
LIDAR_HEAD, FRAME_HEAD, SIZED_HEAD = struct.Struct("<QIH"), struct.Struct("<QQHHI"), struct.Struct("<QI")
DEPTH_HEAD, MESH_HEAD, WIRE_HEAD, WIRE_FRAME_HEAD = struct.Struct("<QHH4f"), struct.Struct("<Q16s16fII"), struct.Struct("<IB"), struct.Struct("<QHHI")
HELLO, POSE_TYPE, FRAME_TYPE, DEPTH_TYPE, MESH_TYPE = 0x01, 0x02, 0x03, 0x04, 0x05
LIMIT, VERSION = 16 << 20, 1
#: Bytes of a stream from which it is written in several files, each by a task of its own; a row counts as so many more.
SEGMENT_BYTES, ROW_BYTES = 32 << 20, 64
FILES = {"poses": "poses.bin", "lidar": "lidar.bin", "frames": "frames.bin", "depth": "depth.bin", "mesh": "mesh.bin"}


def _pose(x) -> dict:
    return {"t_device_us": int(x["t_device_us"]), **dict(zip(("px", "py", "pz"), x["p"].tolist(), strict=True)), **dict(zip(("qx", "qy", "qz", "qw"), x["q"].tolist(), strict=True)), **dict(zip(("fx", "fy", "cx", "cy"), x["k"].tolist(), strict=True)), "tracking_state": int(x["tracking_state"])}


def poses(data: bytes) -> Iterator[dict]:
    for x in np.frombuffer(data, STORED_POSE, len(data) // STORED_POSE.itemsize):
        yield {"t_arrival_us": int(x["t_arrival_us"])} | _pose(x["pose"])


def lidar(data: bytes) -> Iterator[dict]:
    at = 0
    while at + LIDAR_HEAD.size <= len(data):
        arrival, rev, n = LIDAR_HEAD.unpack_from(data, at)
        at += LIDAR_HEAD.size + n * SAMPLE.itemsize
        if at > len(data):
            return
        found = np.frombuffer(data, SAMPLE, n, at - n * SAMPLE.itemsize)
        yield {"t_arrival_us": arrival, "rev_id": rev, "samples": [dict(zip(SAMPLE.names, map(int, s), strict=True)) for s in found.tolist()]}


def frames(data: bytes) -> Iterator[dict]:
    at = 0
    while at + FRAME_HEAD.size <= len(data):
        arrival, device, w, h, n = FRAME_HEAD.unpack_from(data, at)
        at += FRAME_HEAD.size + n
        if at > len(data):
            return
        yield {"t_arrival_us": arrival, "t_device_us": device, "width": w, "height": h, "jpeg": data[at - n : at]}


def sized(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + SIZED_HEAD.size <= len(data):
        arrival, n = SIZED_HEAD.unpack_from(data, at)
        at += SIZED_HEAD.size + n
        if at > len(data):
            return
        yield arrival, data[at - n : at]


def depth_payload(x: bytes) -> dict:
    device, w, h, fx, fy, cx, cy = DEPTH_HEAD.unpack_from(x)
    at = DEPTH_HEAD.size
    return {"t_device_us": device, "width": w, "height": h, "fx": fx, "fy": fy, "cx": cx, "cy": cy, "depth_mm": np.frombuffer(x, "<u2", w * h, at).tolist(), "confidence": np.frombuffer(x, "u1", w * h, at + 2 * w * h).tolist()}


def mesh_payload(x: bytes) -> dict:
    device, anchor, *m, nv, nf = MESH_HEAD.unpack_from(x)
    at = MESH_HEAD.size
    vertices, faces = np.frombuffer(x, "<f4", 3 * nv, at), np.frombuffer(x, "<u4", 3 * nf, at + 12 * nv)
    return {"t_device_us": device, "anchor_id": anchor.hex(), "transform": list(m), "vertices": vertices.tolist(), "faces": faces.tolist(), "classification": np.frombuffer(x, "u1", min(nf, len(x) - at - 12 * (nv + nf)), at + 12 * (nv + nf)).tolist()}


def depth(data: bytes) -> Iterator[dict]:
    for arrival, x in sized(data):
        yield {"t_arrival_us": arrival} | depth_payload(x)


def mesh(data: bytes) -> Iterator[dict]:
    for arrival, x in sized(data):
        yield {"t_arrival_us": arrival} | mesh_payload(x)


READERS = {"poses": poses, "lidar": lidar, "frames": frames, "depth": depth, "mesh": mesh}


def _pose_frame(data: bytes) -> pd.DataFrame:
    x = np.frombuffer(data, STORED_POSE)
    p = x["pose"]
    named = {f"{c}": p[f][:, k] for f, cs in (("p", ("px", "py", "pz")), ("q", ("qx", "qy", "qz", "qw")), ("k", ("fx", "fy", "cx", "cy"))) for k, c in enumerate(cs)}
    return pd.DataFrame({"t_arrival_us": x["t_arrival_us"].astype(np.int64), "t_device_us": p["t_device_us"].astype(np.int64), **named, "tracking_state": p["tracking_state"].astype(np.int16)})


def lidar_size(head: bytes) -> int:
    return LIDAR_HEAD.size + LIDAR_HEAD.unpack(head)[2] * SAMPLE.itemsize


def frame_size(head: bytes) -> int:
    return FRAME_HEAD.size + FRAME_HEAD.unpack(head)[4]


def sized_size(head: bytes) -> int:
    return SIZED_HEAD.size + SIZED_HEAD.unpack(head)[1]


#: By stream of records of unlike sizes: bytes of a head, and the size of a record from it.
HEADS = {"lidar": (LIDAR_HEAD.size, lidar_size), "frames": (FRAME_HEAD.size, frame_size), "depth": (SIZED_HEAD.size, sized_size), "mesh": (SIZED_HEAD.size, sized_size)}


def _frames(stream: str, data: bytes) -> Iterator[pd.DataFrame]:
    """Rows of whole records, some hundred at a time."""
    if stream == "poses":
        for k in range(0, len(data) // STORED_POSE.itemsize, 50_000):
            yield _pose_frame(data[k * STORED_POSE.itemsize : min(k + 50_000, len(data) // STORED_POSE.itemsize) * STORED_POSE.itemsize])
        return
    rows = READERS[stream](data)
    while part := list(islice(rows, 200)):
        yield pd.DataFrame(part)


def read_stream(spark: SparkSession, root: str, stream: str, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """Rows of one stream of all sessions below root; empty where no session has it. A task reads a range of a session's file.

    In a store that only Spark reads a task reads a whole file.
    """
    schema = schemas.STREAMS[stream]
    found = ranges.files(spark, root, ranges.rolled(FILES[stream]))
    one = found.first()
    if one is None:
        return spark.createDataFrame([], schema)
    if not ranges.in_reach(one.path):
        return _read_whole(spark, root, stream, schema)
    if stream == "poses":
        held = ranges.fixed_ranges(found, STORED_POSE.itemsize, range_bytes)
    else:
        held = ranges.record_ranges(found, *HEADS[stream], range_bytes)
    names = [f.split()[0] for f in stream_fields(stream)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for session, path, start, end, first, _ in part.itertuples(index=False):
                for rows in _frames(stream, ranges.range_bytes(path, start, end)):
                    yield rows.assign(session_id=session, seq=first + np.arange(len(rows)))[names]
                    first += len(rows)

    return ranges.spread(ranges.numbered(stow(held))).mapInPandas(run, schema)


def _read_whole(spark: SparkSession, root: str, stream: str, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", ranges.rolled(FILES[stream])).option("recursiveFileLookup", "true").load(root).select(F.element_at(F.split("path", "/"), -2).alias("session_id"), "path", "content")
    names = [f.split()[0] for f in stream_fields(stream)]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[["session_id", "path"]].assign(first=0, n=[sum(map(len, _frames(stream, bytes(data)))) for data in part["content"]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for session, data, first in part[["session_id", "content", "first"]].itertuples(index=False):
                for rows in _frames(stream, bytes(data)):
                    yield rows.assign(session_id=session, seq=first + np.arange(len(rows)))[names]
                    first += len(rows)

    if files.groupBy("session_id").count().where("count > 1").isEmpty():
        return files.withColumn("first", F.lit(0)).mapInPandas(run, schema)
    firsts = ranges.numbered(stow(files.mapInPandas(count, "session_id string, path string, first long, n long")))
    return files.join(F.broadcast(firsts.select("path", "first")), "path").mapInPandas(run, schema)


def pack_pose(x: dict) -> bytes:
    out = np.zeros(1, POSE)
    out["t_device_us"], out["p"], out["q"] = x["t_device_us"], [x["px"], x["py"], x["pz"]], [x["qx"], x["qy"], x["qz"], x["qw"]]
    out["k"], out["tracking_state"] = [x["fx"], x["fy"], x["cx"], x["cy"]], x["tracking_state"]
    return out.tobytes()


def pack_depth(x: dict) -> bytes:
    return DEPTH_HEAD.pack(x["t_device_us"], x["width"], x["height"], x["fx"], x["fy"], x["cx"], x["cy"]) + np.array(x["depth_mm"], "<u2").tobytes() + np.array(x["confidence"], "u1").tobytes()


def pack_mesh(x: dict) -> bytes:
    head = MESH_HEAD.pack(x["t_device_us"], bytes.fromhex(x["anchor_id"]), *x["transform"], len(x["vertices"]) // 3, len(x["faces"]) // 3)
    return head + np.array(x["vertices"], "<f4").tobytes() + np.array(x["faces"], "<u4").tobytes() + np.array(x["classification"], "u1").tobytes()


def stored(stream: str, x: dict) -> bytes:
    """One record of a stream's file (a value that is an array may be one of NumPy); lidar angles and distances are already fixed-point."""
    if stream == "poses":
        return struct.pack("<Q", x["t_arrival_us"]) + pack_pose(x)
    if stream == "lidar":
        samples = np.array([(s["angle_q6"] & 0xFFFF, s["dist_q2"] & 0xFFFF, s["quality"]) for s in x["samples"]], SAMPLE)
        return LIDAR_HEAD.pack(x["t_arrival_us"], x["rev_id"], len(samples)) + samples.tobytes()
    if stream == "frames":
        return FRAME_HEAD.pack(x["t_arrival_us"], x["t_device_us"], x["width"], x["height"], len(x["jpeg"])) + x["jpeg"]
    payload = pack_depth(x) if stream == "depth" else pack_mesh(x)
    return SIZED_HEAD.pack(x["t_arrival_us"], len(payload)) + payload


def write_files(rows: DataFrame, root: str, name: str, order: tuple[str, ...], size: Column, packed: Callable[[pa.RecordBatch], Iterable[bytes]]) -> int:
    """What `packed` makes of rows(session_id, *order, ...), about `size` bytes of each, in order in root/<session>/<name>; the number of files.

    A task sorts, packs and writes a range of the whole order, of about SEGMENT_BYTES. Where there are several ranges, a
    session's files are root/<session>/<name>.00000 and so on, as of a recorder that rolls its files over. A file is put in
    its place as a whole, so a task that runs again leaves the same.
    """
    parts = max(1, -(-int(rows.agg(F.sum(size.cast("long") + ROW_BYTES)).first()[0] or 0) // SEGMENT_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = ranges.place(root)
        context = TaskContext.get()
        mark = f".{name}.{context.taskAttemptId()}.part"
        final = f"{name}.{context.partitionId():05}" if parts > 1 else name
        session, sink, done = None, None, []

        def close() -> None:
            if sink is not None:
                sink.close()
                system.move(f"{folder}/{session}/{mark}", f"{folder}/{session}/{final}")
                done.append(session)

        for batch in batches:
            for own, found in groupby(zip(batch.column("session_id").to_pylist(), packed(batch), strict=True), itemgetter(0)):
                if own != session:
                    close()
                    session = own
                    system.create_dir(f"{folder}/{own}", recursive=True)
                    sink = system.open_output_stream(f"{folder}/{own}/{mark}")
                sink.write(b"".join(data for _, data in found))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["session_id"])

    columns = ["session_id", *order]
    dealt = rows.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    return dealt.mapInArrow(run, "session_id string").count()


#: Bytes of a stream's row in its file, or nearly.
SIZES = {
    "poses": lambda: F.lit(STORED_POSE.itemsize), "lidar": lambda: LIDAR_HEAD.size + SAMPLE.itemsize * F.size("samples"), "frames": lambda: FRAME_HEAD.size + F.octet_length("jpeg"),
    "depth": lambda: SIZED_HEAD.size + DEPTH_HEAD.size + 3 * F.size("depth_mm"), "mesh": lambda: SIZED_HEAD.size + MESH_HEAD.size + 4 * (F.size("vertices") + F.size("faces")),
}


def _lidar_records(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Records of whole columns of samples; stored() makes the same of one row."""
    lists = batch.column("samples")
    n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    samples = np.empty(len(values), SAMPLE)
    for field, mask in (("angle_q6", 0xFFFF), ("dist_q2", 0xFFFF), ("quality", 0xFF)):
        samples[field] = values.field(field).to_numpy(zero_copy_only=False).astype(np.int64) & mask
    ends = np.cumsum(n)
    for arrival, rev, size, end in zip(batch.column("t_arrival_us").to_pylist(), batch.column("rev_id").to_pylist(), n.tolist(), ends.tolist(), strict=True):
        yield LIDAR_HEAD.pack(arrival, rev, size) + samples[end - size : end].tobytes()


def write_stream(rows: DataFrame, root: str, stream: str) -> int:
    """A stream's table as binary session files, in order of seq; the number of files. Readers number the rows anew."""
    names = [f.split()[0] for f in stream_fields(stream)]
    packed = _lidar_records if stream == "lidar" else lambda batch: (stored(stream, x) for x in batch.to_pandas().to_dict("records"))
    return write_files(rows.select(*names), root, FILES[stream], ("seq",), SIZES[stream](), packed)


def split_messages(blobs: DataFrame) -> DataFrame:
    """seq, k, type, payload: the whole messages of each row of blobs(seq, data)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(s, k, *m) for s, d in zip(part["seq"], part["data"], strict=True) for k, m in enumerate(messages(bytes(d)))]
            yield pd.DataFrame(rows, columns=["seq", "k", "type", "payload"])

    return blobs.select("seq", "data").mapInPandas(run, "seq long, k int, type int, payload binary")


def wire(kind: int, payload: bytes) -> bytes:
    return WIRE_HEAD.pack(len(payload), kind) + payload


def _short_text(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<H", data, at)[0]
    return data[at + 2 : at + 2 + n].decode("utf-8", "replace"), at + 2 + n


def pack_hello(version: int, name: str, os: str, capabilities: int) -> bytes:
    texts = b"".join(struct.pack("<H", len(t)) + t for t in (name.encode(), os.encode()))
    return struct.pack("<H", version) + texts + struct.pack("<I", capabilities)


def hello_payload(x: bytes) -> dict:
    name, at = _short_text(x, 2)
    os, at = _short_text(x, at)
    return {"version": struct.unpack_from("<H", x)[0], "name": name, "os": os, "capabilities": struct.unpack_from("<I", x, at)[0]}


def messages(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of whole messages; a length over the limit ends the stream with an error."""
    at = 0
    while at + WIRE_HEAD.size <= len(data):
        n, kind = WIRE_HEAD.unpack_from(data, at)
        if n > LIMIT:
            raise ValueError(f"message of {n} bytes is over the limit of {LIMIT}")
        at += WIRE_HEAD.size + n
        if at > len(data):
            return
        payload = data[at - n : at]
        if kind == HELLO and struct.unpack_from("<H", payload)[0] != VERSION:
            raise ValueError("unknown protocol version")
        yield kind, payload


def frame_payload(x: bytes) -> dict:
    device, w, h, n = WIRE_FRAME_HEAD.unpack_from(x)
    if len(x) < WIRE_FRAME_HEAD.size + n:
        raise ValueError(f"frame of {n} bytes in a payload of {len(x)}")
    return {"t_device_us": device, "width": w, "height": h, "jpeg": x[WIRE_FRAME_HEAD.size : WIRE_FRAME_HEAD.size + n]}


def pose_payload(x: bytes) -> dict:
    if len(x) != POSE.itemsize:
        raise ValueError(f"pose of {len(x)} bytes instead of {POSE.itemsize}")
    return _pose(np.frombuffer(x, POSE)[0])


def pack_frame(x: dict) -> bytes:
    return WIRE_FRAME_HEAD.pack(x["t_device_us"], x["width"], x["height"], len(x["jpeg"])) + x["jpeg"]


#: By stream: type of its wire messages, and what decodes a payload.
PAYLOADS = {"poses": (POSE_TYPE, pose_payload), "frames": (FRAME_TYPE, frame_payload), "depth": (DEPTH_TYPE, depth_payload), "mesh": (MESH_TYPE, mesh_payload)}


def stream_fields(stream: str, *without: str) -> list[str]:
    """Names and types of a stream's columns, without some of them."""
    return [f for f in (x.strip() for x in re.split(r",(?![^<]*>)", schemas.STREAMS[stream])) if f.split()[0] not in without]


def decoded_messages(raw: DataFrame, stream: str, keep: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """keep, seq and the stream's device columns, from messages(seq, type, payload); other types pass by.

    A payload that can't be decoded is an error, or is left out if not strict.
    """
    kind, reader = PAYLOADS[stream]
    fields = stream_fields(stream, "session_id", "seq", "t_arrival_us")
    held = [f"{c} {raw.schema[c].dataType.simpleString()}" for c in (*keep, "seq")]
    names = [f.split()[0] for f in (*held, *fields)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for *own, payload in part[[*keep, "seq", "payload"]].itertuples(index=False):
                try:
                    found = reader(bytes(payload))
                except (ValueError, struct.error) as e:
                    if strict:
                        raise ValueError(f"could not decode message {own[-1]} of type {kind:#04x}: {e}") from e
                    continue
                rows.append((*own, *(found[n] for n in names[len(own) :])))
            yield pd.DataFrame(rows, columns=names)

    return raw.where(F.col("type") == kind).select(*keep, "seq", "payload").mapInPandas(run, ", ".join([*held, *fields]))


def decode_poses(raw: DataFrame) -> DataFrame:
    """seq and pose columns of messages(seq, type, payload); other types pass by, payloads of another size are dropped."""
    return decoded_messages(raw, "poses", strict=False)


def packets(data: bytes) -> Iterator[tuple[int, bool, float, float, int]]:
    """(end, start of a revolution, degrees, millimetres, quality) of the sensor's five-byte packets; slides a byte where the marks are wrong."""
    at = 0
    while at + 5 <= len(data):
        a, b, c, d, e = data[at : at + 5]
        if (a & 1) == (a >> 1 & 1) or not b & 1:
            at += 1
            continue
        at += 5
        yield at, bool(a & 1), (b >> 1 | c << 7) / 64, (d | e << 8) / 4, a >> 2


def lidar_packets(data: bytes) -> Iterator[tuple[bool, float, float, int]]:
    """(start of a revolution, degrees, millimetres, quality) of the sensor's packets."""
    return (p[1:] for p in packets(data))


def revolutions(samples: DataFrame) -> DataFrame:
    """session_id, rev_id, samples: samples(session_id, seq, start, degrees, mm, quality) split where a revolution starts."""
    from pyspark.sql import Window

    rev = F.sum(F.col("start").cast("long")).over(Window.partitionBy("session_id").orderBy("seq"))
    return samples.withColumn("rev_id", rev).where("rev_id > 0").groupBy("session_id", "rev_id").agg(F.array_sort(F.collect_list(F.struct("seq", "degrees", "mm", "quality"))).alias("samples"))
