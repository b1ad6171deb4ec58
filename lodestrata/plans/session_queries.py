"""Queries over sessions that are made from the plain tables: written as binary files or messages, and read back.

Each runs the readers, decoders and session operators on rows that Spark derives from a table, and its SQL derives the same
from the table itself.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import rounded, session_names
from ..operators import fusion, meshes
from ..operators.ranks import matched, parts_of, placed
from ..sources import ranges, records, schemas
from ..sources.sessions import manifests, merged_records
from ..sources.tables import shared_folder, stow, table
from ..streaming import live, record
from . import gates, reports
from .table_queries import events, query

#: Bytes of a range in these queries, so that files of any size are read in several.
RANGE = 1 << 16


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sessions/{uuid.uuid4().hex}"


def _kept(spark: SparkSession, rows: DataFrame, stream: str) -> DataFrame:
    """rows written as binary files and read back in ranges."""
    folder = _folder(spark)
    records.write_stream(rows, folder, stream)
    return records.read_stream(spark, folder, stream, RANGE)


def _floats(names: str, value) -> list:
    return [value.cast("float").alias(n) for n in names.split()]


POSES = "p as (select event_type as session_id, row_number() over (partition by event_type order by event_id) - 1 as seq, epoch_us(ts) as t, event_id, user_id, value from events)"


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses whose seq is the event's number: readers and SQL count places of that order."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("session_id"), F.col("event_id").alias("seq"), (F.col("t") + 1500).alias("t_arrival_us"), F.col("t").alias("t_device_us"), F.col("value").cast("float").alias("px"), (F.col("user_id") / 7).cast("float").alias("py"), (-F.col("value")).cast("float").alias("pz"),
        *_floats("qx qy qz", F.lit(0.0)), F.lit(1.0).cast("float").alias("qw"), *_floats("fx fy", F.lit(60.5)), *_floats("cx cy", F.lit(31.25)), (F.col("event_id") % 3).cast("short").alias("tracking_state"), "event_id",
    )


@query(f"with {POSES} select session_id, seq, t + 1500 as t_arrival_us, t as t_device_us, value::float::double as px, (user_id / 7)::float::double as py, (-value)::float::double as pz, 60.5::double as fx, (event_id % 3)::int as tracking_state from p")
def session_poses(spark, sf_dir):
    rows = _kept(spark, _poses(spark, sf_dir), "poses")
    return rows.select("session_id", "seq", "t_arrival_us", "t_device_us", *(F.col(c).cast("double").alias(c) for c in ("px", "py", "pz", "fx")), F.col("tracking_state").cast("int").alias("tracking_state"))


@query(f"with {POSES} select event_id, t as t_device_us, value::float::double as px, (user_id / 7)::float::double as py, (event_id % 3)::int as tracking_state from p")
def wire_messages(spark, sf_dir):
    """Poses framed as messages among others, split and decoded."""
    fields = records.stream_fields("poses", "session_id", "seq", "t_arrival_us")
    names = [f.split()[0] for f in fields]

    def framed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            data = [records.wire(0x7F, b"of another kind") + records.wire(records.POSE_TYPE, records.pack_pose(x)) + records.wire(records.POSE_TYPE, b"")[:3] for x in part[names].to_dict("records")]
            yield pd.DataFrame({"seq": part["event_id"], "data": data})

    blobs = _poses(spark, sf_dir).mapInPandas(framed, "seq long, data binary")
    found = records.decoded_messages(records.split_messages(blobs), "poses")
    return found.select(F.col("seq").alias("event_id"), "t_device_us", *(F.col(c).cast("double").alias(c) for c in ("px", "py")), F.col("tracking_state").cast("int").alias("tracking_state"))


#: A sample of the range sensor for each line; fifty orders make a revolution.
LINES = """s as (select l_returnflag as session_id, l_orderkey // 50 as rev, l_orderkey, l_linenumber, l_partkey, l_quantity, (l_partkey * 97) % 23040 as angle_q6, (l_quantity * 300)::bigint as dist_q2,
row_number() over (partition by l_returnflag, l_orderkey // 50 order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as k, dense_rank() over (partition by l_returnflag order by l_orderkey // 50) - 1 as seq from lineitem)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("session_id"), F.expr("l_orderkey div 50").alias("rev"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_partkey") * 97 % 23040).cast("int").alias("angle_q6"), (F.col("l_quantity") * 300).cast("int").alias("dist_q2"))


def _revolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revolutions whose seq is in their order; readers number them from 0."""
    row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.struct("angle_q6", "dist_q2", F.col("l_linenumber").cast("short").alias("quality")).alias("s"))
    rows = _lines(spark, sf_dir)
    held = rows.repartition(parts_of(rows), "session_id", "rev").groupBy("session_id", "rev").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["s"]).alias("samples"))
    return stow(held.select("session_id", F.col("rev").alias("seq"), (F.col("rev") * 100_000).alias("t_arrival_us"), F.col("rev").alias("rev_id"), "samples"))


@query(f"with {LINES} select session_id, seq, rev as rev_id, k, angle_q6 / 64.0::double as degrees, dist_q2 / 4.0::double as mm, l_linenumber as quality from s")
def session_lidar(spark, sf_dir):
    rows = _kept(spark, _revolutions(spark, sf_dir), "lidar").select("session_id", "seq", "rev_id", F.posexplode("samples").alias("k", "s"))
    return rows.select("session_id", "seq", "rev_id", F.col("k").cast("long").alias("k"), (F.col("s.angle_q6") / 64.0).alias("degrees"), (F.col("s.dist_q2") / 4.0).alias("mm"), F.col("s.quality").cast("int").alias("quality"))


@query("""select lang as session_id, row_number() over (partition by lang order by doc_id) - 1 as seq, doc_id * 1000 as t_device_us, (n_chars % 4000)::int as width, octet_length(encode(coalesce(text, ''))) as octets, sha256(coalesce(text, '')) as digest from documents""")
def session_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("session_id"), F.col("doc_id").alias("seq"), F.lit(5).cast("long").alias("t_arrival_us"), (F.col("doc_id") * 1000).alias("t_device_us"), (F.col("n_chars") % 4000).cast("int").alias("width"), F.lit(480).alias("height"), F.coalesce("text", F.lit("")).cast("binary").alias("jpeg"))
    return _kept(spark, rows, "frames").select("session_id", "seq", "t_device_us", "width", F.octet_length("jpeg").cast("long").alias("octets"), F.sha2("jpeg", 256).alias("digest"))


VECTORS = """v as (select 's' || label as session_id, row_number() over (partition by label order by vec_id) - 1 as seq, vec_id, label, embedding from embeddings)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    return table(spark, sf_dir, "embeddings").withColumn("session_id", F.concat(F.lit("s"), F.col("label"))).withColumn("seq", seq)


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select(
        "session_id", "seq", (F.col("vec_id") * 1000 + 7).alias("t_arrival_us"), (F.col("vec_id") * 1000).alias("t_device_us"), F.lit(8).alias("width"), F.lit(8).alias("height"), *_floats("fx fy", F.lit(8.0)), *_floats("cx cy", F.lit(3.5)),
        F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 9000).cast("int")).alias("depth_mm"), F.transform("embedding", lambda x, k: (k % 3).cast("short")).alias("confidence"),
    )


@query(f"""with {VECTORS} select session_id, seq, vec_id * 1000 as t_device_us, list_sum(list_transform(embedding, lambda x: floor(abs(x::double) * 9000)))::bigint as depth_mm, len(embedding) as pixels from v""")
def session_depth(spark, sf_dir):
    rows = _kept(spark, _depth(spark, sf_dir), "depth")
    return rows.select("session_id", "seq", "t_device_us", F.expr("aggregate(depth_mm, 0L, (a, x) -> a + x)").alias("depth_mm"), F.size("confidence").cast("long").alias("pixels"))


@query(f"with {VECTORS} select session_id, seq from v where seq < 5")
def first_frames(spark, sf_dir):
    return fusion.first_frames(_depth(spark, sf_dir), 5).select("session_id", "seq")


def _still(rows: DataFrame, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """A path that stays at one place, unturned, over the sessions' time span, and a clock that is the host's."""
    span = rows.groupBy("session_id").agg(F.min(first).alias("a"), F.max(last).alias("b"))
    path = span.select("session_id", F.explode(F.array(F.col("a") - 1_000_000, F.col("b") + 1_000_000)).alias("t_us"), F.lit(0.5).alias("px"), F.lit(1.5).alias("py"), F.lit(-2.0).alias("pz"), *(F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")), F.lit(1.0).alias("qw"))
    clock = span.select("session_id", F.col("a").alias("start_us"), F.lit(0.0).alias("intercept"), F.lit(0.0).alias("pooled"))
    return path, clock


@query(f"""with {VECTORS}, p as (select session_id, seq as frame, unnest(range(64)) as i, unnest(embedding) as e from v), m as (select *, i % 8 as u, i // 8 as w, floor(abs(e::double) * 9000) / 1000.0::double as d from p)
select session_id, frame, round((u - 3.5::double) / 8.0::double * d + 0.5::double, 6) as x, round(-(w - 3.5::double) / 8.0::double * d + 1.5::double, 6) as y, round(-d - 2.0::double, 6) as z from m where u % 2 = 0 and w % 2 = 0 and d between 0.15 and 5.0 and i % 3 >= 1""")
def depth_to_world(spark, sf_dir):
    depth = _depth(spark, sf_dir)
    found = fusion.depth_points(depth, *_still(depth, "t_device_us", "t_device_us"))
    return found.select("session_id", "frame", *(rounded(a, 6).alias(a) for a in "xyz"))


@query(f"""with {LINES}, r as (select distinct session_id, rev, seq, rev * 100000 as t from s), g as (select *, t - lag(t) over (partition by session_id order by t) as period from r), q as (select * from g where period > 20000 and period < 500000),
n as (select s.*, q.t, q.period, count(*) over (partition by s.session_id, s.rev) as n from s join q using (session_id, rev)), a as (select *, radians(angle_q6 / 64.0::double) as a, dist_q2 / 4000.0::double as m, (t - period * (1 - case when n > 1 then k / (n - 1)::double else 0.0 end))::double as stamp from n where dist_q2 / 4000.0::double between 0.2 and 12.0),
f as (select *, count(*) over (partition by session_id, rev) as kept from a)
select session_id, seq as rev, trunc(stamp)::bigint as t_us, round(0.5::double + m * cos(a), 6) as x, 1.5::double as y, round(-2.0::double - m * sin(a), 6) as z from f where kept >= 32""")
def lidar_to_world(spark, sf_dir):
    raw = _revolutions(spark, sf_dir)
    order = placed(raw.select("session_id", "rev_id"), ["session_id"], ["rev_id"], "seq").withColumn("seq", F.col("seq") - 1)
    lidar = matched(raw.drop("seq"), order, ["session_id", "rev_id"])
    path, _ = _still(lidar, "t_arrival_us", "t_arrival_us")
    flat = fusion.lidar_points(stow(fusion.revolution_samples(lidar, 1)), path, (-1.5707963267948966, 0.0, 0.0), (0.0, 0.0, 0.0), 0.0)
    return flat.select("session_id", "rev", "t_us", rounded("x", 6).alias("x"), rounded("y", 6).alias("y"), rounded("z", 6).alias("z"))


@query(f"""with {VECTORS}, n as (select * from v qualify row_number() over (partition by session_id, vec_id % 50 order by seq desc) = 1), c as (select *, list_transform(embedding[1:9], lambda x: x::double) as e from n),
w as (select session_id, vec_id % 50 as anchor, label % 8 as label, e[1] + vec_id % 10 as ax, e[2] as ay, e[3] as az, e[4] + vec_id % 10 as bx, e[5] as by_, e[6] as bz, e[7] + vec_id % 10 as cx, e[8] as cy, e[9] as cz from c),
k as (select *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) as nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as nz from w)
select session_id, lower(lpad(to_hex(anchor), 32, '0')) as anchor_id, round((ax + bx + cx) / 3, 6) as cx, round((ay + by_ + cy) / 3, 6) as cy, round((az + bz + cz) / 3, 6) as cz, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) as area, label from k""")
def session_mesh(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    unit = F.array(*(F.lit(float(k % 5 == 0)) for k in range(12)), (F.col("vec_id") % 10).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    anchor = F.lower(F.lpad(F.hex(F.col("vec_id") % 50), 32, "0"))
    rows = v.select("session_id", "seq", F.lit(3).cast("long").alias("t_arrival_us"), F.lit(2).cast("long").alias("t_device_us"), anchor.alias("anchor_id"), unit.alias("transform"), F.slice("embedding", 1, 9).alias("vertices"), F.array(*(F.lit(k).cast("long") for k in range(3))).alias("faces"), F.array((F.col("label") % 8).cast("short")).alias("classification"))
    found = meshes.faces(_kept(spark, rows, "mesh"))
    return found.select("session_id", "anchor_id", *(rounded(f"c{a}", 6).alias(f"c{a}") for a in "xyz"), rounded("area", 6).alias("area"), F.col("label").cast("int").alias("label"))


@query("""select l_returnflag as session_id, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as seq, l_linenumber = 1 as start, ((l_partkey * 97) % 23040) / 64.0::double as degrees, (l_quantity * 300)::bigint / 4.0::double as mm, l_linenumber as quality from lineitem""")
def serial_samples(spark, sf_dir):
    """Lines as packets of a serial capture, with stray bytes between some of them; split into ranges and read."""
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")

    def packed(batch: pa.RecordBatch) -> Iterator[bytes]:
        for a, d, q in zip(*(batch.column(c).to_pylist() for c in ("angle_q6", "dist_q2", "l_linenumber")), strict=True):
            yield bytes([q << 2 | (1 if q == 1 else 2), (a & 0x7F) << 1 | 1, a >> 7, d & 0xFF, d >> 8]) + b"\x00" * (q == 3)

    folder = _folder(spark)
    rows = _lines(spark, sf_dir).select("session_id", *order, "angle_q6", "dist_q2")
    records.write_files(rows, folder, "lidar.serial", order, F.lit(5), packed)
    return ranges.serial_packets(spark, folder, limit=RANGE)


@query(f"""with {POSES}, r as (select session_id, count(*) as n_rows, count(*) * 1e6::double / (max(t) - min(t)) as hz from (select case when event_id % 2 = 0 then 'even' else 'odd' end as session_id, t // 40000 as t, event_id from p) group by 1)
select session_id, 'poses' as stream, n_rows, round(hz, 6) as hz, 0 as dropped, case when hz < 36 then 'rate below nominal' when hz > 75 then 'arrivals burst' end as why_not from r union all select session_id, 'lidar', n_rows, round(hz, 6), 2, 'rows were dropped' from r""")
def live_check(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("session_id"), F.expr("t div 40000").alias("t_arrival_us"))
    return reports.live_check({"poses": rows, "lidar": rows}, {"lidar": 2}).withColumn("hz", rounded("hz", 6))


@query(f"""with {POSES}, g as (select session_id, seq, t // 100000 as t, t // 100000 - lag(t // 100000) over (partition by session_id order by t // 100000, seq) as gap, lag(t // 100000) over (partition by session_id order by seq) as before from p), m as (select session_id, median(gap) as middle from g group by 1),
a as (select session_id, count(*) as n_rows, 1e6::double / any_value(middle) as hz, max(gap) as worst_gap, avg(case when gap is not null then (gap < 0.1 * middle)::int end) as near_zero, not bool_or(coalesce(t < before, false)) as monotone from g join m using (session_id) group by 1)
select session_id, n_rows, round(hz, 6) as hz, worst_gap, round(near_zero, 6) as near_zero, monotone, case when n_rows < 10 then 'few rows' when not monotone then 'stamps fall' when not hz between 0.6 * 10.0 and 1.4 * 10.0 then 'rate' when near_zero > 0.05 then 'bunched' end as why_not from a""")
def replay_timing(spark, sf_dir):
    rows = _poses(spark, sf_dir).select("session_id", "seq", F.expr("(t_device_us) div 100000").alias("t_arrival_us"))
    return gates.replay_timing(rows, 10.0).select("session_id", "n_rows", rounded("hz", 6).alias("hz"), "worst_gap", rounded("near_zero", 6).alias("near_zero"), "monotone", "why_not")


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    mm = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity") * 75)
    return rows.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("t_us"), (F.col("l_linenumber") == 1).alias("start"), (F.col("l_partkey") * 97 % 23040 / 64.0).alias("degrees"), mm.alias("mm"), F.col("l_linenumber").alias("quality"))


BENCH = "b as (select l_orderkey * 1000 + l_linenumber as t, l_linenumber = 1 as start, ((l_partkey * 97) % 23040) / 64.0::double as degrees, case when l_linenumber = 7 then 0.0::double else l_quantity * 75 end as mm, l_linenumber as quality from lineitem)"


@query(f"""with {BENCH} select count(*) as n, round(100 * avg((mm > 0)::int), 6) as valid_percent, round(count(*) / ((max(t) - min(t)) / 1e6::double), 6) as sample_hz, count(distinct case when mm > 0 then trunc(degrees)::int % 360 end) as bins, min(case when mm > 0 then mm end) as nearest, median(case when mm > 0 then mm end) as middle, max(mm) as farthest,
round(avg(quality), 6) as quality, sum(start::int) / ((max(t) - min(t)) / 1e6::double) >= 2 and count(distinct case when mm > 0 then trunc(degrees)::int % 360 end) >= 180 as passed from b""")
def sensor_bench(spark, sf_dir):
    found = gates.sensor_bench(_bench(spark, sf_dir))
    return found.select("n", rounded("valid_percent", 6).alias("valid_percent"), rounded("sample_hz", 6).alias("sample_hz"), "bins", "nearest", "middle", "farthest", rounded("quality", 6).alias("quality"), "passed")


@query(f"""with {BENCH}, r as (select * from b where mm > 0), f as (select quantile_cont(mm, 0.95) as far from r), c as (select round(36 * (1 + sin(radians(degrees)) * mm / far))::int as column, round(16 * (1 - cos(radians(degrees)) * mm / far))::int as row from r, f)
select "column", "row", count(*) as n from c where "column" between 0 and 72 and "row" between 0 and 32 group by 1, 2""")
def top_down_raster(spark, sf_dir):
    return gates.top_down(_bench(spark, sf_dir))


@query("""select 'p' || p_partkey as session_id, case when p_size * 10 < 200 then 'few revolutions' when p_retailprice / 50 < 15 then 'little motion' when (p_partkey % 10) / 10.0 > 0.5 then 'tilted' when 0.8 + (p_partkey % 7) / 40.0 < 0.85 then 'weak correlation' end as why_not from part""")
def lag_confidence(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("session_id", F.concat(F.lit("p"), F.col("p_partkey")))
    lags = p.select("session_id", (0.8 + F.col("p_partkey") % 7 / 40.0).alias("correlation"))
    facts = p.select("session_id", (F.col("p_size") * 10).alias("n_revs"), (F.col("p_retailprice") / 50).alias("motion"), (F.col("p_partkey") % 10 / 10.0).alias("tilt_ratio"))
    return gates.lag_confidence(lags, facts).select("session_id", "why_not")


@query("""with c as (select p_brand as session_id, avg(p_retailprice) as price, min(p_size) as floor_us from part group by 1)
select count(*) as n_sessions, round((max(price) - min(price)) * 1e-8 * 43 * 1e6, 6) as skew_error_us, (max(floor_us) - min(floor_us))::double as latency_spread_us, count(*) as n_lags, round(max(price) - min(price), 6) as lag_spread_us,
count(*) >= 2 and (max(price) - min(price)) * 1e-8 * 43 * 1e6 <= 3000 and max(floor_us) - min(floor_us) <= 2000 and count(*) >= 3 and max(price) - min(price) <= 10000 as passed from c""")
def clock_agreement(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("session_id")).agg(F.avg("p_retailprice").alias("price"), F.min("p_size").cast("double").alias("intercept"))
    found = gates.clock_agreement(c.select("session_id", (F.col("price") * 1e-8).alias("pooled"), "intercept"), c.select(F.col("price").alias("lag_us")))
    return found.select("n_sessions", rounded("skew_error_us", 6).alias("skew_error_us"), "latency_spread_us", "n_lags", rounded("lag_spread_us", 6).alias("lag_spread_us"), "passed")


@query("select label, round(avg(case when embedding[1] > 0 then embedding[1]::double end), 9) as mean from embeddings group by 1")
def nan_mean(spark, sf_dir):
    x = F.col("embedding")[0].cast("double")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(rounded(reports.nan_mean(F.when(x > 0, x).otherwise(float("nan"))), 9).alias("mean"))


@query("select strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') as session_id, count(*) as n from orders group by 1")
def session_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(session_names(F.col("o_orderdate").cast("timestamp")).alias("session_id")).agg(F.count("*").alias("n"))


@query(f"""with {POSES}, s as (select session_id, min(t) as start_us from p group by 1), m as (select p.*, round(t + 100.25::double + 2e-6::double * (t - start_us))::bigint // 60000000 as t_us from p join s using (session_id))
select session_id, t_us, arg_min(value::float::double, seq) as px, count(*) as n from m group by 1, 2""")
def trajectory_rows(spark, sf_dir):
    poses = _poses(spark, sf_dir)
    clock = poses.groupBy("session_id").agg(F.min("t_device_us").alias("start_us")).select("session_id", "start_us", F.lit(100.25).alias("intercept"), F.lit(2e-6).alias("pooled"))
    hosts = fusion.device_to_host(poses, clock).select("session_id", F.expr("t_us div 60000000").alias("t_device_us"), *(c for c in poses.columns if c not in ("session_id", "t_device_us")))
    still = clock.select("session_id", F.lit(0).cast("long").alias("start_us"), F.lit(0.0).alias("intercept"), F.lit(0.0).alias("pooled"))
    n = hosts.groupBy("session_id", F.col("t_device_us").alias("t_us")).agg(F.count("*").alias("n"))
    return fusion.trajectory(hosts, still).select("session_id", "t_us", "px").join(n, ["session_id", "t_us"])


@query(f"""with {POSES}, h as (select session_id, event_id, value / 10 / 2 as h from p), q as (select *, sin(h) as y, cos(h) as w, lag(sin(h)) over o as ly, lag(cos(h)) over o as lw, event_id - lag(event_id) over o as dt from h window o as (partition by session_id order by event_id))
select session_id, event_id as t_us, round(degrees((lw * y - ly * w) * (2e6::double * case when lw * w + ly * y < 0 then -1 else 1 end / dt)), 3) as rate, 0.0::double as tilt from q where dt is not null""")
def yaw_rates(spark, sf_dir):
    half = F.col("value") / 10 / 2
    path = events(spark, sf_dir).select(F.col("event_type").alias("session_id"), F.col("event_id").alias("t_us"), F.lit(0.0).alias("qx"), F.sin(half).alias("qy"), F.lit(0.0).alias("qz"), F.cos(half).alias("qw"))
    return fusion.yaw_rates(path).select("session_id", "t_us", rounded("rate", 3).alias("rate"), F.abs(rounded("tilt", 3)).alias("tilt"))


@query("""select vec_id, round(embedding[1]::double * 20 - 2 * pi() * floor((embedding[1]::double * 20 + pi()) / (2 * pi())), 6) as wrapped from embeddings""")
def wrapped_angles(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(G.wrap_angle(F.col("embedding")[0].cast("double") * 20), 6).alias("wrapped"))


@query("""select vec_id, round(embedding[3]::double + 1, 6) as x, round(embedding[1]::double - 2, 6) as y, round(embedding[2]::double + 0.5::double, 6) as z from embeddings""")
def rigid_transform(spark, sf_dir):
    """A third of a turn about the diagonal, which moves each axis to the next, and a translation."""
    turn = 2 * math.pi / 3 / math.sqrt(3)
    m = G.rigid_matrix((turn, turn, turn), (1.0, -2.0, 0.5))
    p = [F.col("embedding")[k].cast("double") for k in range(3)]
    moved = [sum((F.lit(m[i][k]) * p[k] for k in range(3)), F.lit(m[i][3])) for i in range(3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *((rounded(c, 6) + 0.0).alias(n) for c, n in zip(moved, "xyz", strict=True)))


FIXES = f"""{POSES}, n as (select session_id, t, value, event_id from p), f as (select session_id, t, sin(event_id) as cx, cos(event_id) as cz, 3.0::double * sin(event_id * 2) as cyaw from n where event_id % 40 < 5),
b as (select n.*, f.t as t0, f.cx as x0, f.cz as z0, f.cyaw as a0 from n asof left join f on n.session_id = f.session_id and n.t >= f.t), w as (select b.*, f.t as t1, f.cx as x1, f.cz as z1, f.cyaw as a1 from b asof left join f on b.session_id = f.session_id and b.t < f.t),
u as (select session_id, t, value, case when t0 is null then 1.0::double when t1 is null then 0.0::double else (t - t0)::double / (t1 - t0) end as u, coalesce(x0, x1) as x0, coalesce(x1, x0) as x1, coalesce(z0, z1) as z0, coalesce(z1, z0) as z1, coalesce(a0, a1) as a0, coalesce(a1, a0) as a1 from w),
c as (select session_id, t, value, x0 + (x1 - x0) * u as cx, z0 + (z1 - z0) * u as cz, a0 + (a1 - a0 - 2 * pi() * floor((a1 - a0 + pi()) / (2 * pi()))) * u as a from u)"""


@query(f"with {FIXES} select session_id, t as t_us, round(cos(a) * value - sin(a) * value / 2 + cx, 6) as px, round(sin(a) * value + cos(a) * value / 2 + cz, 6) as pz, round(sin(-a / 2), 6) + 0.0::double as qy, round(cos(-a / 2), 6) + 0.0::double as qw from c")
def corrected_path(spark, sf_dir):
    """Poses moved by corrections that are interpolated between keyframes, angles the short way."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("session_id"), F.col("t").alias("t_us"), "event_id", "value")
    path = e.select("session_id", "t_us", F.col("value").alias("px"), F.lit(0.0).alias("py"), (F.col("value") / 2).alias("pz"), *(F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")), F.lit(1.0).alias("qw"))
    n = F.col("event_id")
    fixes = e.where(n % 40 < 5).select("session_id", "t_us", F.sin(n).alias("cx"), F.cos(n).alias("cz"), (3.0 * F.sin(n * 2)).alias("cyaw"))
    found = fusion.corrected(path, fixes)
    return found.select("session_id", "t_us", *((rounded(c, 6) + 0.0).alias(c) for c in ("px", "pz", "qy", "qw")))


@query(f"with {POSES} select session_id, 'poses' as stream, count(*) as recorded, count(*) as stored, sum(seq)::bigint as places from p group by 1")
def recorded_counts(spark, sf_dir):
    """Poses recorded in batches, one of them twice as after a lost driver; counts of the manifests beside the tables'."""
    folder = _folder(spark)
    poses = placed(_poses(spark, sf_dir).drop("seq"), ["session_id"], ["event_id"], "seq").withColumn("seq", F.col("seq") - 1)
    sessions_ = [r.session_id for r in poses.select("session_id").distinct().collect()]  # a handful of event types
    for name in sessions_:
        recorder = record.Recorder(folder, name)
        put = recorder.rows("poses", "table")
        for number in (0, 1, 1, 2):
            put(poses.where((F.col("session_id") == name) & (F.col("seq") % 3 == number)), number)
        recorder.finish(spark)
    said = manifests(spark, f"{folder}/manifests").select("session_id", F.col("counts.poses").alias("recorded"))
    held = record.recorded(spark, folder, "poses").groupBy("session_id").agg(F.count("*").alias("stored"), F.sum("seq").alias("places"))
    return said.join(held, "session_id").select("session_id", F.lit("poses").alias("stream"), "recorded", "stored", "places")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def newest_log(spark, sf_dir):
    """The newest event of each user, kept by a log of runs over eleven batches."""
    folder, rows = _folder(spark), events(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    put = live.keep_newest(folder, ["user_id"], "event_id")
    for number in range(11):
        put(rows.where(F.col("event_id") % 11 == number), number)
    return live.newest(spark, folder, rows.schema)


@query("""with u as (select 'a' as session_id, epoch_us(ts) as t_arrival_us, 0 as stream, event_id as seq from events union all select 'a', l_orderkey // 50 * 100000, 1, dense_rank() over (order by l_orderkey // 50) - 1 from (select distinct l_orderkey // 50 as k, min(l_orderkey) as l_orderkey from lineitem group by 1))
select session_id, t_arrival_us, stream, seq, row_number() over (order by t_arrival_us, stream, seq) as place from u""")
def replay_order(spark, sf_dir):
    """One replay order of two stored streams."""
    folder = _folder(spark)
    e = _poses(spark, sf_dir).withColumn("session_id", F.lit("a")).withColumn("seq", F.col("event_id")).withColumn("t_arrival_us", F.col("t_device_us"))
    e.drop("event_id").write.partitionBy("session_id").parquet(f"{folder}/poses")
    revs = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 50").alias("rev")).distinct()
    turns = placed(revs, [], ["rev"], "n").select(F.lit("a").alias("session_id"), (F.col("n") - 1).alias("seq"), (F.col("rev") * 100_000).alias("t_arrival_us"), F.col("rev").alias("rev_id"))
    turns.withColumn("samples", F.lit(None).cast(spark.createDataFrame([], f"s {schemas.STREAMS['lidar'].split('samples ')[1]}").schema["s"].dataType)).write.partitionBy("session_id").parquet(f"{folder}/lidar")
    for other in ("frames", "depth", "mesh"):
        spark.createDataFrame([], schemas.STREAMS[other]).write.parquet(f"{folder}/{other}")
    merged = merged_records(spark, folder)
    return placed(merged, ["session_id"], ["t_arrival_us", "stream", "seq"], "place")
