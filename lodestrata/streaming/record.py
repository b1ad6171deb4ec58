"""Recording of live streams into the tables of a session.

Each source has a streaming query whose foreachBatch is a recorder's. A batch writes its rows of every stream into a folder
of its own, then a row for each stream into the table of commits. Only committed batches count as recorded, and a batch that
is run again, after a lost driver or task, writes the same folders anew; so each row is there once. Together with a source
that logs rows before it offers them (live.LinkReader), no row is lost or doubled however often the driver goes.

The manifest is written last, when the queries have stopped, and counts what the commits hold: its presence means that the
session is complete.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import CAPABILITIES, bit_names
from ..sources import schemas
from ..sources.records import HELLO, PAYLOADS, decoded_messages, hello_payload, stream_fields
from ..sources.sessions import MAX_STREAMS, write_json

FORMAT_VERSION = 1
COMMITS = "session_id string, source string, batch long, stream string, n_rows long, n_samples long, first_us long, last_us long"


def session_name(at: datetime.datetime | None = None) -> str:
    """A session is named by the local time at which it starts."""
    return (at or datetime.datetime.now()).strftime("%Y-%m-%dT%H-%M-%S")


@dataclass(frozen=True)
class Recorder:
    """out: folder of the tables; skip: streams whose messages are left out."""

    out: str
    session: str
    skip: tuple[str, ...] = ()

    def _put(self, rows: DataFrame, table: str, source: str, number: int) -> DataFrame:
        path = f"{self.out}/{table}/session_id={self.session}/batch={source}-{number}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _commit(self, spark: SparkSession, written: dict[str, DataFrame], source: str, number: int) -> None:
        held = None
        for stream, rows in written.items():
            n_samples = F.coalesce(F.sum(F.size("samples")), F.lit(0)) if stream == "lidar" else F.lit(0)
            one = rows.agg(F.count("*").alias("n_rows"), n_samples.cast("long").alias("n_samples"), F.min("t_arrival_us").alias("first_us"), F.max("t_arrival_us").alias("last_us")).withColumn("stream", F.lit(stream))
            held = one if held is None else held.unionByName(one)
        if held is not None:
            held.coalesce(1).write.mode("overwrite").parquet(f"{self.out}/commits/session_id={self.session}/source={source}/batch={number}")

    def messages(self, source: str = "phone") -> Callable[[DataFrame, int], None]:
        """For foreachBatch on a wire stream: seq, type, payload, t_arrival_us."""

        def batch(raw: DataFrame, number: int) -> None:
            raw = raw.persist()  # decoded once for each stream
            try:
                written = {}
                for stream in PAYLOADS:
                    if stream not in self.skip:
                        written[stream] = self._put(decoded_messages(raw, stream, ("t_arrival_us",)), stream, source, number)
                greetings = [r for r in raw.where(F.col("type") == HELLO).orderBy("seq").collect()]  # one for each connection
                if greetings:
                    write_json(raw.sparkSession, f"{self.out}/devices/{self.session}/{source}-{number:010d}.json", hello_payload(bytes(greetings[-1].payload)))
                self._commit(raw.sparkSession, written, source, number)
            finally:
                raw.unpersist()

        return batch

    def rows(self, stream: str, source: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch on a stream of rows that are decoded already, such as revolutions: seq, t_arrival_us and the stream's columns."""
        names = [f.split()[0] for f in stream_fields(stream, "session_id")]

        def batch(held: DataFrame, number: int) -> None:
            self._commit(held.sparkSession, {stream: self._put(held.select(*names), stream, source, number)}, source, number)

        return batch

    def finish(self, spark: SparkSession, notes: str = "", git_commit: str | None = None) -> dict:
        """Counts the commits and writes the manifest."""
        held = commits(spark, self.out).where(F.col("session_id") == self.session).groupBy("stream").agg(F.sum("n_rows").alias("n"), F.sum("n_samples").alias("samples")).collect()
        counts = {s: 0 for s in MAX_STREAMS} | {r.stream: r.n for r in held} | {"lidar_samples": sum(r.samples for r in held)}
        manifest = {"format_version": FORMAT_VERSION, "notes": notes, "git_commit": git_commit, "counts": counts, "complete": True}
        devices = spark.read.schema("name string, os string, capabilities long").option("recursiveFileLookup", "true").option("multiLine", "true").json(_made(spark, f"{self.out}/devices/{self.session}"))
        last = devices.orderBy(F.col("_metadata.file_path").desc()).limit(1).select("name", "os", bit_names(F.col("capabilities"), CAPABILITIES).alias("capabilities")).first()
        if last:
            manifest["device"] = last.asDict()
        write_json(spark, f"{self.out}/manifests/{self.session}/manifest.json", manifest)
        return manifest


def _made(spark: SparkSession, folder: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return folder


def commits(spark: SparkSession, out: str) -> DataFrame:
    """COMMITS: what each committed batch holds of each stream."""
    return spark.read.schema(COMMITS).parquet(_made(spark, f"{out}/commits"))


def recorded(spark: SparkSession, out: str, stream: str) -> DataFrame:
    """A stream's rows so far, of committed batches alone."""
    names = [f.split()[0] for f in stream_fields(stream)]
    rows = spark.read.schema(f"{schemas.STREAMS[stream]}, batch string").parquet(_made(spark, f"{out}/{stream}"))
    done = commits(spark, out).where(F.col("stream") == stream).select("session_id", F.concat_ws("-", "source", "batch").alias("batch"))
    return rows.join(done, ["session_id", "batch"], "left_semi").select(*names)

