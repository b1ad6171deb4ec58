"""Recorded sessions as Parquet tables, with their manifest, calibration and tape measurements."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .records import read_stream, stream_fields

MAX_STREAMS = ["poses", "lidar", "frames", "depth", "mesh"]


def import_sessions(spark: SparkSession, root: str, out: str) -> None:
    """All binary sessions below root into one Parquet table for each stream, partitioned by session; a session imported again is replaced."""
    for stream in MAX_STREAMS:
        read_stream(spark, root, stream).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{out}/{stream}")


def stream_table(spark: SparkSession, out: str, stream: str) -> DataFrame:
    """A stream's table; only the columns asked for are read, so poses never touch images."""
    return spark.read.schema(schemas.STREAMS[stream]).parquet(f"{out}/{stream}").select(*(f.split()[0] for f in stream_fields(stream)))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file where Spark writes tables, put in its place as a whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    files = place.getFileSystem(conf)
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(place, False)
    if not files.rename(part, place):
        raise OSError(f"{path} couldn't be put in its place")


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, indent=2) + "\n")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row for each session with a manifest; a missing version is an error."""
    raw = spark.read.schema(schemas.MANIFEST).option("multiLine", "true").option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", "true").json(root)
    named = raw.withColumn("session_id", F.element_at(F.split(F.input_file_name(), "/"), -2)).withColumn("complete", F.coalesce("complete", F.lit(True)))
    return named.withColumn("format_version", F.when(F.col("format_version").isNotNull(), F.col("format_version")).otherwise(F.raise_error(F.lit("manifest without format_version")).cast("int")))


def latest_session(spark: SparkSession, root: str) -> str | None:
    return manifests(spark, root).where("complete").agg(F.max("session_id")).first()[0]


def count_mismatches(spark: SparkSession, root: str, out: str) -> DataFrame:
    """session_id, stream, recorded, stored for all five streams where the manifest and the table differ."""
    said = manifests(spark, root).select("session_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, MAX_STREAMS)), F.array(*(F.coalesce(F.col("counts")[s], F.lit(0)) for s in MAX_STREAMS)))).alias("stream", "recorded"))
    held = None
    for stream in MAX_STREAMS:
        rows = stream_table(spark, out, stream).groupBy("session_id").agg(F.count("*").alias("stored")).withColumn("stream", F.lit(stream))
        held = rows if held is None else held.unionByName(rows)
    return said.join(held, ["session_id", "stream"], "left").withColumn("stored", F.coalesce("stored", F.lit(0))).where("recorded <> stored")


def calibration(spark: SparkSession, path: str, fields: str) -> dict:
    """Named fields of a calibration file; others are left alone."""
    return spark.read.schema(fields).option("multiLine", "true").json(path).first().asDict(recursive=True)


TIMING = "lidar_lag_us double, lidar_yaw_sign int"
EXTRINSIC = "rvec_rad array<double>, tvec_m array<double>, residual_dt_us double, yaw_sign int"


def truth(spark: SparkSession, path: str) -> DataFrame:
    """name, tape_m from a JSON object of numbers; keys that start with _ are notes."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "tape")).where(~F.col("name").startswith("_")).select("name", F.col("tape").try_cast("double").alias("tape_m")).where("tape_m is not null")


def merged_records(spark: SparkSession, out: str) -> DataFrame:
    """session_id, t_arrival_us, stream, seq of all streams, one replay order: arrival, stream, place."""
    union = None
    for k, stream in enumerate(MAX_STREAMS):
        rows = stream_table(spark, out, stream).select("session_id", "t_arrival_us", F.lit(k).alias("stream"), "seq")
        union = rows if union is None else union.unionByName(rows)
    return union.orderBy("session_id", "t_arrival_us", "stream", "seq")
