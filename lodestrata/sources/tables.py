"""Table access and tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workers_import(spark: SparkSession) -> None:
    """Let local Python workers import this package when it isn't installed; clusters ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and Spark is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/lodestrata-shared-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session option for the time of a block."""
    held = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


#: Names of the open blocks of stowing(), the innermost last.
_blocks: list[str] = []


def stow(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost executor loses nothing of it.

    The shuffle files of the write are of no more use then, and go at once. The tables of a block of stowing() go at its end,
    others with forget_stowed().
    """
    spark = df.sparkSession
    path = "/".join([_stowed(spark), *_blocks[-1:], uuid.uuid4().hex])
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stowed(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stowed/{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def stowing(spark: SparkSession) -> Iterator[None]:
    """A block whose stowed tables go at its end: what is made in it is to be read or written out by then."""
    _blocks.append(f"block-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _remove(spark, f"{_stowed(spark)}/{_blocks.pop()}")


def forget_stowed(spark: SparkSession) -> None:
    """Removes all tables that this application has stowed."""
    _remove(spark, _stowed(spark))


#: Rows of a key table that may be broadcast; each is a few dozen bytes.
BROADCAST_ROWS = 1_000_000


def checked(keys: DataFrame) -> DataFrame:
    """keys, marked for broadcast if it has few enough rows; beyond that the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
