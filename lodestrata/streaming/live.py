"""Streaming forms of the operators: decoding, latency envelopes, throttling, newest rows and live figures."""

from __future__ import annotations

import json
import math
import socket
import threading
import time
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import schemas
from ..sources.records import VERSION, WIRE_HEAD, hello_payload, messages, packets
from ..sources.sessions import write_json

#: A row bears the time at which its last byte came, not that of its batch.
WIRE = schemas.MESSAGES + ", t_arrival_us long"
RANGES = "seq long, rev_id long, samples array<struct<angle_q6:int,dist_q2:int,quality:short>>, t_arrival_us long"


class Log:
    """Rows of a live connection in a shared folder, one file for each read, from before they are offered until their batch is committed."""

    def __init__(self, folder: str):
        self.files, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)

    def _held(self) -> list[tuple[int, int, str]]:
        found = self.files.get_file_info(pa.fs.FileSelector(self.folder))
        return sorted((*map(int, f.base_name.removesuffix(".arrow").split("-")), f.path) for f in found if f.base_name.endswith(".arrow"))

    def put(self, first: int, rows: list[tuple], types: pa.Schema) -> None:
        path = f"{self.folder}/{first:020d}-{first + len(rows):020d}.arrow"
        with self.files.open_output_stream(f"{path}.part") as sink, pa.ipc.new_stream(sink, types) as out:
            out.write_batch(pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types))
        self.files.move(f"{path}.part", path)

    def rows(self, start: int, end: int | None = None) -> list[tuple]:
        out = []
        for first, last, path in self._held():
            if last <= start or end is not None and first >= end:
                continue
            with self.files.open_input_stream(path) as source:
                held = pa.ipc.open_stream(source).read_all()
            out += [r for r in zip(*(c.to_pylist() for c in held.columns), strict=True) if r[0] >= start and (end is None or r[0] < end)]
        return out

    def drop(self, end: int) -> None:
        for _, last, path in self._held():
            if last <= end:
                self.files.delete_file(path)


class LinkReader(SimpleDataSourceStreamReader):
    """Rows of one live connection. A thread takes bytes as they come and stamps rows; each read returns what has come.

    An offset counts rows, and those dropped so far, which a listener finds in the query's progress. Without most_waiting
    nothing is dropped: the thread stops taking bytes while max_rows are waiting, and the sender waits. With it, the queue
    keeps so many rows and drops the newest or the oldest beyond.

    With a log folder (a URI that all executors share) rows are written there before they are offered, so a batch that a lost
    driver left unfinished is read again from the log, and rows that it never offered follow. Bytes that no read had taken go
    with the connection, as no sender of this protocol keeps them. Without a log all rows live with the connection, and a new
    driver says that those of an unfinished batch are gone instead of leaving them out.

    A connection that brings nothing for first_s at the start, or for quiet_s later, and one that the sender closes end the
    query with an error, once the rows that came before are read.
    """

    FIRST_S, QUIET_S, DROPS = 5.0, 5.0, "newest"
    TYPES = pa.schema([])

    def __init__(self, options: dict):
        self.host, self.port = options.get("host", "127.0.0.1"), int(options["port"])
        self.quiet = float(options.get("quiet_s", self.QUIET_S))
        self.first = float(options.get("first_s", options.get("quiet_s", self.FIRST_S)))
        self.most, self.wait = int(options.get("max_rows", 4096)), float(options.get("wait_s", 0.2))
        self.waiting = int(options["most_waiting"]) if "most_waiting" in options else None
        self.drops = options.get("drops", self.DROPS)
        self.log = Log(options["log"]) if "log" in options else None
        self.held: dict[int, tuple] = {}
        self.dropped, self.error, self.thread = 0, None, None

    def cut(self, data: bytes) -> tuple[list[tuple], bytes]:
        """Whole rows (without number and time), and the bytes left."""
        raise NotImplementedError

    def initialOffset(self) -> dict:
        return {"message": 0, "dropped": 0}

    def _connect(self) -> None:
        self.ready, self.turn = deque(), threading.Condition()
        link = socket.create_connection((self.host, self.port), self.first)
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        self.thread = threading.Thread(target=self._listen, args=(link,), daemon=True)
        self.thread.start()

    def _listen(self, link: socket.socket) -> None:
        data, limit = b"", self.first
        try:
            with link:
                while True:
                    link.settimeout(limit)
                    part = link.recv(1 << 16)
                    if not part:
                        raise ConnectionError("the sender closed the connection")
                    now, limit = time.time_ns() // 1000, self.quiet
                    rows, data = self.cut(data + part)
                    self._offer([(*r, now) for r in rows])
        except TimeoutError:
            self.error = TimeoutError(f"the stream went quiet: nothing came for {limit:g} s")
        except Exception as e:
            self.error = e
        with self.turn:
            self.turn.notify_all()

    def _offer(self, rows: list[tuple]) -> None:
        with self.turn:
            for row in rows:
                if self.waiting is None:
                    self.turn.wait_for(lambda: len(self.ready) < self.most)
                elif len(self.ready) >= self.waiting:
                    self.dropped += 1
                    if self.drops == "newest":
                        continue
                    self.ready.popleft()
                self.ready.append(row)
                self.turn.notify_all()

    def _arrived(self) -> list[tuple]:
        if self.thread is None:
            self._connect()
        with self.turn:
            self.turn.wait_for(lambda: self.ready or self.error, self.wait)
            if not self.ready and self.error:
                raise self.error
            found = [self.ready.popleft() for _ in range(min(self.most, len(self.ready)))]
            self.turn.notify_all()
        return found

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first = start["message"]
        rows = self.log.rows(first) if self.log and self.thread is None else []  # logged, but in no batch when the driver went
        if not rows:
            rows = [(first + k, *row) for k, row in enumerate(self._arrived())]
            if self.log and rows:
                self.log.put(first, rows, self.TYPES)
        if not self.log:
            self.held |= {r[0]: r for r in rows}
        return iter(rows), {"message": first + len(rows), "dropped": self.dropped if rows else start.get("dropped", 0)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        asked = range(start["message"], end["message"])
        held = {r[0]: r for r in self.log.rows(asked.start, asked.stop)} if self.log else self.held
        if gone := [k for k in asked if k not in held]:
            raise RuntimeError(f"{len(gone)} messages of an unfinished batch went with the connection; start from a fresh checkpoint")
        return iter([held[k] for k in asked])

    def commit(self, end: dict) -> None:
        self.held = {k: r for k, r in self.held.items() if k >= end["message"]}
        if self.log:
            self.log.drop(end["message"])


class WireReader(LinkReader):
    """Messages of a phone: type and payload."""

    TYPES = pa.schema([("seq", pa.int64()), ("type", pa.int32()), ("payload", pa.binary()), ("t_arrival_us", pa.int64())])

    def cut(self, data: bytes) -> tuple[list[tuple], bytes]:
        rows = list(messages(data))
        return rows, data[sum(WIRE_HEAD.size + len(payload) for _, payload in rows) :]


class RangeReader(LinkReader):
    """Revolutions of a range sensor whose serial bytes a bridge sends on. It takes time to spin up, and may drop the oldest."""

    FIRST_S, QUIET_S, DROPS = 8.0, 2.0, "oldest"
    _SAMPLES = pa.list_(pa.struct([("angle_q6", pa.int32()), ("dist_q2", pa.int32()), ("quality", pa.int16())]))
    TYPES = pa.schema([("seq", pa.int64()), ("rev_id", pa.int64()), ("samples", _SAMPLES), ("t_arrival_us", pa.int64())])

    def __init__(self, options: dict):
        super().__init__(options)
        self.revolution: list[dict] = []
        self.turns = 0

    def cut(self, data: bytes) -> tuple[list[tuple], bytes]:
        rows, at = [], 0
        for at, start, degrees, mm, quality in packets(data):
            if start and self.revolution:
                rows.append((self.turns, self.revolution))
                self.revolution, self.turns = [], self.turns + 1
            self.revolution.append({"angle_q6": round(degrees * 64), "dist_q2": round(mm * 4), "quality": quality})
        return rows, data[at:]


class WireSource(DataSource):
    """spark.readStream.format("wire").option("port", ...).load(): seq, type, payload, t_arrival_us."""

    @classmethod
    def name(cls) -> str:
        return "wire"

    def schema(self) -> str:
        return WIRE

    def simpleStreamReader(self, schema) -> WireReader:
        return WireReader(self.options)


class RangeSource(DataSource):
    """spark.readStream.format("ranges").option("port", ...).load(): seq, rev_id, samples, t_arrival_us."""

    @classmethod
    def name(cls) -> str:
        return "ranges"

    def schema(self) -> str:
        return RANGES

    def simpleStreamReader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def dropped_rows(progress: dict | str) -> int:
    """Rows that a query's live sources have dropped so far, from its progress."""
    found = json.loads(progress) if isinstance(progress, str) else progress
    ends = [json.loads(x["endOffset"]) if isinstance(x.get("endOffset"), str) else x.get("endOffset") for x in found["sources"]]
    return sum(e.get("dropped", 0) for e in ends if isinstance(e, dict))


def quiet_keys(rows: DataFrame, key: str, t: str, first_ms: int, quiet_ms: int) -> DataFrame:
    """key, t, waited_ms: a row for each key that brings nothing for quiet_ms (or first_ms after its first row), by the clock of the tasks.

    t is the time of its last row. A key that comes back is watched again from the start.
    """

    def run(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, waited = state.get
            state.remove()
            yield pd.DataFrame([(key_[0], last, waited)], columns=["key", "t", "waited_ms"])
            return
        last, waited = state.get if state.exists else (None, 0)
        rows_ = 0
        for part in parts:
            rows_ += len(part)
            if len(part):
                top = int(part[t].max())
                last = top if last is None else max(last, top)
        waited = quiet_ms if state.exists or rows_ > 1 else first_ms
        state.update((last, waited))
        state.setTimeoutDuration(waited)

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(run, f"key {kind}, t long, waited_ms long", "last long, waited long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def greeting(payload: bytes) -> dict:
    found = hello_payload(payload)
    if found["version"] != VERSION:
        raise ValueError(f"protocol version {found['version']} isn't {VERSION}")
    return found


def dropped_files(spark: SparkSession, folder: str, table_schema: str, files_per_batch: int = 8) -> DataFrame:
    """A table stream from Parquet files as they are dropped into a folder, admitted at a limited rate and never skipped."""
    return spark.readStream.schema(table_schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def envelope_stream(rows: DataFrame, keys: list[str], time: str, delay: str, width: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """keys, start, delay, t: least delay of each window, first by time among equals; windows are aligned to the epoch."""
    least = F.min(F.struct(F.col(delay).alias("delay"), F.col(time).alias("t")))
    return rows.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("w")).agg(least.alias("row")).select(*keys, F.col("w.start").alias("start"), "row.delay", "row.t")


def series_envelope_stream(rows: DataFrame, key: str, time: str, t: str, delay: str, seq: str, width: int, late: str = "5 seconds") -> DataFrame:
    """key, bin, t, delay: the batch envelope's rows. Windows of width begin at the series' first row, which the state holds.

    time is t as a timestamp, for the watermark: a window is sent once the watermark has passed its end; rows that come later
    than that are left out. The state holds the open windows' best rows. The series' first row must not come late.
    """

    def run(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"start": None, "open": {}, "sent": -1}
        past = state.getCurrentWatermarkMs() * 1000
        for part in parts:
            part = part.sort_values(t, kind="stable")
            for now, value, number in zip(part[t].tolist(), part[delay].tolist(), part[seq].tolist(), strict=True):
                if held["start"] is None:
                    held["start"] = now
                k = (now - held["start"]) // width
                best = held["open"].get(str(k))
                if k > held["sent"] and (best is None or (value, number) < (best[1], best[2])):
                    held["open"][str(k)] = [now, value, number]
        done = sorted((int(k) for k in held["open"] if held["start"] + (int(k) + 1) * width <= past))
        found = [(key_[0], k, *held["open"].pop(str(k))[:2]) for k in done]
        held["sent"] = max([held["sent"], *done])
        if held["open"]:
            state.setTimeoutTimestamp(max((held["start"] + (min(map(int, held["open"])) + 1) * width) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        state.update((json.dumps(held),))
        yield pd.DataFrame(found, columns=["key", "bin", "t", "delay"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, t, delay)}
    held = rows.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, f"key {kinds[key]}, bin long, t {kinds[t]}, delay {kinds[delay]}", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return held.withColumnRenamed("key", key)


def mapped_stream(rows: DataFrame, segments: DataFrame, key: str, time: str, t: str, late: str = "5 seconds") -> DataFrame:
    """rows with host_us: device times mapped by the clock segment they lie in, once that is known.

    segments(key, start_us, intercept, slope, and `time`, the start as a timestamp) may come long after the rows, but in order of their starts. A row waits in
    the state until a segment that begins after it is there, or until the watermark of both streams has passed it by `late`:
    then the last segment that begins up to it counts, or the first one for earlier rows, as in the batch operator. A row
    whose key has no segment at all by then is sent without a host time.
    """
    names = rows.columns
    left = rows.select(F.col(key), F.col(time), F.col(t).alias("_t"), F.to_json(F.struct(*names)).alias("_row"), *(F.lit(None).cast(k).alias(n) for n, k in (("_start", "long"), ("_a", "double"), ("_b", "double"))))
    right = segments.select(F.col(key), F.col(time), F.lit(None).cast("long").alias("_t"), F.lit(None).cast("string").alias("_row"), F.col("start_us").alias("_start"), F.col("intercept").cast("double").alias("_a"), F.col("slope").cast("double").alias("_b"))

    def run(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"waiting": [], "segments": []}
        for part in parts:
            is_row = part["_row"].notna()
            held["waiting"] += [[int(a), b] for a, b in zip(part.loc[is_row, "_t"], part.loc[is_row, "_row"], strict=True)]
            held["segments"] += [[int(a), b, c] for a, b, c in zip(part.loc[~is_row, "_start"], part.loc[~is_row, "_a"], part.loc[~is_row, "_b"], strict=True)]
        known, past = sorted(held["segments"]), state.getCurrentWatermarkMs() * 1000
        last = known[-1][0] if known else None
        out, waiting = [], []
        for at, row in held["waiting"]:
            if not (last is not None and at < last or at < past):
                waiting.append([at, row])
                continue
            own = next((s for s in reversed(known) if s[0] <= at), known[0] if known else None)
            out.append((row, None if own is None else math.floor(at + own[1] + own[2] * (at - own[0]) + 0.5)))
        before = [s for s in known if s[0] <= min([past, *(w[0] for w in waiting)])]
        held = {"waiting": waiting, "segments": known[max(0, len(before) - 1) :]}
        if waiting:
            state.setTimeoutTimestamp(max(min(w[0] for w in waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["row", "host_us"]).astype({"host_us": "Int64"})

    both = left.unionByName(right).withWatermark(time, late)
    found = both.groupBy(key).applyInPandasWithState(run, "row string, host_us long", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("row", rows.schema).alias("r"), "host_us").select("r.*", "host_us")


def throttled_stream(rows: DataFrame, key: str, t: str, interval: int) -> DataFrame:
    """Rows of each key that come at least interval after the last one sent; the state is one number for each key."""

    def run(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for part in parts:
            part = part.sort_values(t, kind="stable")
            keep = []
            for now in part[t]:
                keep.append(last is None or now - last >= interval)
                last = int(now) if keep[-1] else last
            yield part[keep]
        if last is not None:
            state.update((last,))

    return rows.groupBy(key).applyInPandasWithState(run, rows.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def segment_stream(rows: DataFrame, key: str, t: str, value: str, jump: float) -> DataFrame:
    """key, t, value, segment: upward jumps counted across batches; the state is the last value and the count."""

    def run(key_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, segment = state.get if state.exists else (None, 0)
        for part in parts:
            part = part.sort_values(t, kind="stable")
            found = []
            for v in part[value]:
                segment += last is not None and v - last > jump
                last = float(v)
                found.append(segment)
            yield part.assign(segment=found)
        if last is not None:
            state.update((last, int(segment)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(key).applyInPandasWithState(run, f"{fields}, segment long", "last double, segment long", "append", GroupStateTimeout.NoTimeout)


#: Runs of one size that are merged into the next size.
MERGED_RUNS = 8


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """First and last batch of each whole run below path."""
    place, files = _files(spark, path)
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place) if f.isDirectory()]
    whole = [n for n in names if n.startswith("run=") and files.exists(_files(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(tuple(map(int, n.removeprefix("run=").split("-"))) for n in whole)


def _outer(runs: list[tuple[int, int]], number: int | None = None) -> list[tuple[int, int]]:
    """Runs up to a batch that lie in no larger one."""
    held = [r for r in runs if number is None or r[1] <= number]
    return [r for r in held if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in held)]


def keep_newest(path: str, keys: list[str], seq: str):
    """For foreachBatch: the newest row of each key, as a log of runs under path.

    A batch writes a run of its own newest rows alone. As soon as MERGED_RUNS runs of one size are there they are merged into
    one of the next size, so a row is written again once for each size, however large the table gets. Runs that lie in a
    merged one go with the batch after. A batch that is run again writes the same run, and changes nothing.
    """

    def newest_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
        rest = [c for c in columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*").select(*columns)

    def merge(batch: DataFrame, number: int) -> None:
        spark, runs = batch.sparkSession, _runs(batch.sparkSession, path)
        write_json(spark, f"{path}/layout.json", {"keys": keys, "seq": seq})
        for first, last in set(runs) - set(_outer(runs)):
            if last < number:
                place, files = _files(spark, f"{path}/run={first}-{last}")
                files.delete(place, True)
        newest_rows(batch, batch.columns).write.mode("overwrite").parquet(f"{path}/run={number}-{number}")
        held, size = [r for r in _outer([*runs, (number, number)]) if r[1] <= number], 1
        while len(tail := [r for r in held if r[1] - r[0] + 1 == size][-MERGED_RUNS:]) == MERGED_RUNS and tail[-1] == held[-1] and tail[-1][1] - tail[0][0] + 1 == size * MERGED_RUNS:
            parts = spark.read.schema(batch.schema).parquet(*(f"{path}/run={a}-{b}" for a, b in tail))
            whole = tail[0][0], tail[-1][1]
            newest_rows(parts, batch.columns).write.mode("overwrite").parquet(f"{path}/run={whole[0]}-{whole[1]}")
            held = [r for r in held if r not in tail] + [whole]
            size *= MERGED_RUNS

    return merge


def newest(spark: SparkSession, path: str, schema, number: int | None = None) -> DataFrame:
    """The newest row of each key, as of a batch or of the last one."""
    layout = json.loads(spark.read.text(f"{path}/layout.json", wholetext=True).first().value)
    rows = spark.read.schema(schema).parquet(*(f"{path}/run={a}-{b}" for a, b in _outer(_runs(spark, path), number)))
    rest = [c for c in rows.columns if c not in layout["keys"]]
    return rows.groupBy(*layout["keys"]).agg(F.max_by(F.struct(*rest), layout["seq"]).alias("_row")).select(*layout["keys"], "_row.*").select(*rows.columns)


def with_live_figures(rows: DataFrame, name: str, t: str) -> DataFrame:
    """rows, with counts and the time span of each batch as observed metrics for a listener."""
    return rows.observe(name, F.count(F.lit(1)).alias("n_rows"), F.min(t).alias("first"), F.max(t).alias("last"))
