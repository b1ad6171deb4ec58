"""Queries over the plain tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalars import MESH_LABELS, bit_names, clipped, first_rule, micros, named, on_stride
from ..operators import mapping, measure, robust, signal, spatial, temporal
from ..operators.keyframes import keyframes
from ..operators.planes import plane_counts
from ..sources.tables import table

HOUR = 3_600_000_000
DAY = 24 * HOUR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", micros(F.col("ts"))).drop("ts")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")))


EVENTS = "e as (select event_id, user_id, event_type, value, props, epoch_us(ts) as t from events)"
POINTS = "p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)"


@query("""with u as (select epoch_us(o_orderdate) as t, 0 as stream, o_orderkey as idx from orders union all select epoch_us(ts), 1, event_id from events)
select t, stream, idx, row_number() over (order by t, stream, idx) as position from u""")
def stream_merge_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(micros(F.col("o_orderdate")).alias("t"), F.lit(0).alias("stream"), F.col("o_orderkey").alias("idx"))
    rows = orders.unionByName(events(spark, sf_dir).select("t", F.lit(1).alias("stream"), F.col("event_id").alias("idx")))
    return temporal.global_positions(rows, ["t", "stream", "idx"])


@query(f"""with {EVENTS}, g as (select *, t - lag(t) over (partition by user_id order by t, event_id) as gap from e)
select user_id, count(*) as n_rows, median(gap) as median_gap, max(gap) as worst_gap, round(1e6 / median(gap), 9) as hz from g group by 1""")
def gap_stats(spark, sf_dir):
    return temporal.gap_stats(events(spark, sf_dir), ["user_id"], "t", "event_id").withColumn("hz", F.round("hz", 9))


@query(f"""with {EVENTS}, g as (select *, t - lag(t) over (partition by user_id order by t, event_id) as gap from e), m as (select user_id, median(gap) as middle from g group by 1)
select user_id, round(avg((gap < 0.1 * middle)::int), 6) as near_zero, avg((gap < 0.1 * middle)::int) > 0.05 as bunched from g join m using (user_id) where gap is not null group by 1""")
def burst_check(spark, sf_dir):
    return temporal.bursts(events(spark, sf_dir), ["user_id"], "t", "event_id").withColumn("near_zero", F.round("near_zero", 6))


@query(f"""with {EVENTS}, g as (select *, lag(t) over (partition by user_id order by event_id) as before from e) select user_id, not bool_or(coalesce(t < before, false)) as monotone from g group by 1""")
def stream_in_order(spark, sf_dir):
    return temporal.in_order(events(spark, sf_dir), ["user_id"], "t", "event_id")


@query(f"""with {EVENTS} select event_type, count(*) as n_rows, max(t) - min(t) as elapsed_us, round(count(*) * 1e6 / (max(t) - min(t)), 9) as hz from e group by 1""")
def rate_by_stream(spark, sf_dir):
    return temporal.rates(events(spark, sf_dir), ["event_type"], "t").withColumn("hz", F.round("hz", 9))


ENVELOPE = f"""with {EVENTS}, s as (select *, min(t) over (partition by event_type) as start from e), b as (select *, (t - start) // 21600000000 as bin from s),
v as (select event_type, bin, t, value as delay from b qualify row_number() over (partition by event_type, bin order by value, event_id) = 1)"""


def _envelope(spark, sf_dir):
    return temporal.envelope(events(spark, sf_dir), ["event_type"], "t", "value", "event_id", 6 * HOUR)


@query(ENVELOPE + " select event_type, bin, t, delay from v")
def latency_envelope(spark, sf_dir):
    return _envelope(spark, sf_dir)


CUT = ENVELOPE + ", r as (select *, coalesce((delay - lag(delay) over (partition by event_type order by t) > 5)::int, 0) as rose from v), g as (select *, sum(rose) over (partition by event_type order by t)::bigint as segment from r)"


@query(CUT + " select event_type, bin, t, delay, segment from g")
def resync_segments(spark, sf_dir):
    return temporal.segments(_envelope(spark, sf_dir), ["event_type"], "t", "delay", 5.0)


@query(f"""with {EVENTS}, s as (select *, min(t) over (partition by event_type) as start from e), b as (select *, (t - start) // {DAY} as bin from s),
v as (select event_type, bin::double as x, value as y from b qualify row_number() over (partition by event_type, bin order by value, event_id) = 1),
i as (select *, row_number() over (partition by event_type order by x, y) as i from v),
q as (select a.event_type, quantile_cont((b.y - a.y) / (b.x - a.x), [0.25, 0.5, 0.75]) as q from i a join i b on a.event_type = b.event_type and a.i < b.i group by 1)
select event_type, count(*) as n_points, round(any_value(q)[2], 8) as slope, round((any_value(q)[3] - any_value(q)[1]) / 2 / sqrt(count(*)), 8) as uncertainty, round(median(y - q[2] * x), 8) as intercept from v join q using (event_type) group by 1""")
def theil_sen_slope(spark, sf_dir):
    v = temporal.envelope(events(spark, sf_dir), ["event_type"], "t", "value", "event_id", DAY).select("event_type", F.col("bin").cast("double").alias("x"), F.col("delay").alias("y"))
    return temporal.theil_sen(v, ["event_type"], "x", "y").select("event_type", "n_points", *(F.round(c, 8).alias(c) for c in ("slope", "uncertainty", "intercept")))


def _clock(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("arrival", F.col("t") + F.round(F.col("value") * 1000).cast("long"))
    return temporal.clock_segments(e, ["event_type"], "t", "arrival", "event_id", 6 * HOUR, 5_000.0, 5)


CLOCK = f"""with {EVENTS}, s as (select *, round(value * 1000)::bigint as d, min(t) over (partition by event_type) as start from e), b as (select *, (t - start) // 21600000000 as bin from s),
v as (select event_type, t, d from b qualify row_number() over (partition by event_type, bin order by d, event_id) = 1),
r as (select *, coalesce((d - lag(d) over (partition by event_type order by t) > 5000)::int, 0) as rose from v), g as (select *, sum(rose) over (partition by event_type order by t)::bigint as segment from r),
bounds as (select event_type, segment, min(t) as start_us, max(t) as end_us, count(*) as n, median(d) as middle from g group by 1, 2),
l as (select event_type, segment, (t - start_us)::double as x, d::double as y, row_number() over (partition by event_type, segment order by t, d) as i from g join bounds using (event_type, segment)),
q as (select a.event_type, a.segment, median((b.y - a.y) / (b.x - a.x)) as slope from l a join l b on a.event_type = b.event_type and a.segment = b.segment and a.i < b.i group by 1, 2),
n as (select event_type, segment, median(y - slope * x) as intercept from l join q using (event_type, segment) group by 1, 2),
f as (select *, n >= 5 as good from bounds left join q using (event_type, segment) left join n using (event_type, segment)),
pooled as (select event_type, median(slope) as pooled from f where good group by 1),
c as (select event_type, segment, start_us, end_us, n as n_points, case when good then intercept else middle end as intercept, case when good then slope else 0.0 end as slope, coalesce(pooled, 0.0) as pooled from f left join pooled using (event_type))"""


@query(CLOCK + " select event_type, segment, start_us, end_us, n_points, round(intercept, 4) as intercept, round(slope * 1e6, 6) as slope_ppm, round(pooled * 1e6, 6) as pooled_ppm from c")
def clock_segments(spark, sf_dir):
    c = _clock(spark, sf_dir)
    return c.select("event_type", "segment", "start_us", "end_us", "n_points", F.round("intercept", 4).alias("intercept"), F.round(F.col("slope") * 1e6, 6).alias("slope_ppm"), F.round(F.col("pooled") * 1e6, 6).alias("pooled_ppm"))


@query(CLOCK + """, m as (select e.event_id, e.event_type, e.t, c.start_us, c.intercept, c.pooled from e asof left join c on e.event_type = c.event_type and e.t >= c.start_us),
first_c as (select * from c qualify row_number() over (partition by event_type order by start_us) = 1)
select event_id, round(m.t + coalesce(m.intercept, f.intercept) + coalesce(m.pooled, f.pooled) * (m.t - coalesce(m.start_us, f.start_us)))::bigint as host_us from m join first_c f using (event_type)""")
def clock_map(spark, sf_dir):
    c = _clock(spark, sf_dir).withColumn("seg_start", F.col("start_us"))
    found = temporal.asof_backward(events(spark, sf_dir).select("event_id", "event_type", "t"), c, ["event_type"], "t", "start_us", ["seg_start", "intercept", "pooled"], 7 * DAY, clamp=True)
    return found.select("event_id", F.round(F.col("t") + F.col("intercept") + F.col("pooled") * (F.col("t") - F.col("seg_start"))).cast("long").alias("host_us"))


def _two_streams(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "t"), e.where("event_type = 'click'").select("user_id", F.col("t").alias("click_t"), F.col("value").alias("click_value"))


CLICKS = f"with {EVENTS}, l as (select event_id, user_id, t from e where event_type = 'purchase'), r as (select user_id, t as click_t, value as click_value from e where event_type = 'click')"


@query(CLICKS + " select l.event_id, l.user_id, l.t, r.click_t as click_t_found, r.click_value from l asof left join r on l.user_id = r.user_id and l.t >= r.click_t")
def asof_backward(spark, sf_dir):
    left, right = _two_streams(spark, sf_dir)
    return temporal.asof_backward(left, right, ["user_id"], "t", "click_t", ["click_value"], 2 * DAY)


@query(CLICKS + """, b as (select l.*, r.click_t as t0, r.click_value as v0 from l asof left join r on l.user_id = r.user_id and l.t >= r.click_t), a as (select b.*, r.click_t as t1, r.click_value as v1 from b asof left join r on b.user_id = r.user_id and b.t < r.click_t)
select event_id, user_id, t, round(case when t0 is null then v1 when t1 is null then v0 else v0 + (v1 - v0) * ((t - t0) / (t1 - t0)::double) end, 6) as click_value from a""")
def asof_interpolate(spark, sf_dir):
    left, right = _two_streams(spark, sf_dir)
    return temporal.asof_interpolate(left, right, ["user_id"], "t", "click_t", ["click_value"], 2 * DAY).withColumn("click_value", F.round("click_value", 6))


@query(f"""with {EVENTS}, m as (select event_type, (min(t) + {6 * HOUR} - 1) // {6 * HOUR} as a, max(t) // {6 * HOUR} as b from e group by 1), g as (select event_type, unnest(generate_series(a, b)) * {6 * HOUR} as t from m),
x as (select g.*, e.t as t0, e.value as v0 from g asof left join e on g.event_type = e.event_type and g.t >= e.t), y as (select x.*, e.t as t1, e.value as v1 from x asof left join e on x.event_type = e.event_type and x.t < e.t)
select event_type, t::bigint as t, round(case when t0 is null then v1 when t1 is null then v0 else v0 + (v1 - v0) * ((t - t0) / (t1 - t0)::double) end, 6) as value from y""")
def resample_grid(spark, sf_dir):
    return temporal.resample(events(spark, sf_dir).select("event_type", "t", "value"), ["event_type"], "t", ["value"], 6 * HOUR, 2 * DAY).withColumn("value", F.round("value", 6))


@query("""select l_orderkey, l_linenumber, l_partkey, round(case when count(*) over w0 > 1 then (row_number() over w - 1) / (count(*) over w0 - 1)::double else 0 end, 9) as fraction from lineitem
window w0 as (partition by l_orderkey), w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def deskew_fraction(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return temporal.position_fraction(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("fraction", 9).alias("fraction"))


@query(f"""with {EVENTS}, g as (select event_id, user_id, t - lag(t) over (partition by user_id order by t) as period from e) select event_id, user_id, period from g where period > {HOUR} and period < {12 * HOUR}""")
def period_filter(spark, sf_dir):
    return temporal.plausible_periods(events(spark, sf_dir).select("event_id", "user_id", "t"), ["user_id"], "t", HOUR, 12 * HOUR).select("event_id", "user_id", "period")


@query("""with k as (select * from lineitem where l_quantity between 5 and 40), c as (select *, count(*) over (partition by l_orderkey) as kept from k) select l_orderkey, count(*) as n_lines, round(sum(l_quantity), 2) as quantity from c where kept >= 3 group by 1""")
def min_group_filter(spark, sf_dir):
    from pyspark.sql import Window

    kept = table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(5, 40)).withColumn("kept", F.count("*").over(Window.partitionBy("l_orderkey"))).where("kept >= 3")
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"""with {EVENTS}, k as (select *, row_number() over (partition by event_type order by t) - 1 as k, count(*) over (partition by event_type) as n from e), i as (select unnest(generate_series(0, 99)) as i)
select distinct event_id, event_type from k, i where n <= 100 or k = i * (n - 1) // 99""")
def systematic_subsample(spark, sf_dir):
    return temporal.spread_sample(events(spark, sf_dir).select("event_id", "event_type", "t"), ["event_type"], ["t"], 100).select("event_id", "event_type")


@query(f"""with {EVENTS}, k as (select *, row_number() over (partition by user_id order by t) - 1 as k from e) select event_id, user_id from k where k % 3 = 0""")
def stride_subsample(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("t")) - 1
    return events(spark, sf_dir).withColumn("k", k).where(on_stride(F.col("k"), 3)).select("event_id", "user_id")


def _angled(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "event_type", "user_id", "t", "value", ((F.col("t") % DAY) / (DAY / 360)).alias("degrees"))


ANGLED = f"with {EVENTS}, d as (select *, (t % {DAY}) / ({DAY} / 360) as degrees from e)"


@query(ANGLED + """, m as (select event_type, trunc(degrees / 360.0 * 48)::int % 48 as bin, avg(value) as r from d where value > 0 group by 1, 2), k as (select distinct event_type from e), b as (select unnest(generate_series(0, 47))::int as bin)
select k.event_type, b.bin, round(r, 6) as mean_range from k cross join b left join m on k.event_type = m.event_type and b.bin = m.bin""")
def range_profile_bins(spark, sf_dir):
    return signal.range_profile(_angled(spark, sf_dir), ["event_type"], "degrees", "value", 48).withColumn("mean_range", F.round("mean_range", 6))


@query(ANGLED + """, s as (select *, floor(degrees / 360.0 * 24)::int as sector from d), f as (select event_type, sector, avg((value < 35)::int) as share from s group by 1, 2) select event_id, event_type, value from s join f using (event_type, sector) where share < 0.45""")
def sector_mask(spark, sf_dir):
    return signal.without_near_sectors(_angled(spark, sf_dir), ["event_type"], "degrees", "value", 24, 35.0).select("event_id", "event_type", "value")


@query(f"""with {EVENTS}, h as (select t // {DAY} as day, (t % {DAY}) // {HOUR} as bin, avg(value) as r from e group by 1, 2), k as (select distinct day from h), b as (select unnest(generate_series(0, 23)) as bin),
f as (select k.day, b.bin, r from k cross join b left join h on h.day = k.day and h.bin = b.bin), m as (select day, bin, coalesce(r, avg(r) over (partition by day)) as r from f), c as (select day, bin, r - avg(r) over (partition by day) as r from m),
n as (select day, bin, r / sqrt(sum(r * r) over (partition by day)) as r from c), prev as (select a.day, lag(a.day) over (order by a.day) as before from k a),
x as (select p.day, s.bin as shift, sum(q.r * w.r) as score from prev p cross join b s join n q on q.day = p.before join n w on w.day = p.day and w.bin = (q.bin + s.bin) % 24 where p.before is not null group by 1, 2)
select 1 as series, day::bigint as day, (case when shift > 12 then shift - 24 else shift end) * 15.0::double as step_deg from x qualify row_number() over (partition by day order by round(score, 12) desc, shift) = 1""")
def yaw_delta_xcorr(spark, sf_dir):
    hours = events(spark, sf_dir).groupBy(F.lit(1).alias("series"), F.floor(F.col("t") / DAY).alias("day"), F.floor(F.col("t") % DAY / HOUR).cast("int").alias("bin")).agg(F.avg("value").alias("r"))
    every = hours.select("series", "day").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return signal.yaw_steps(every.join(hours.withColumnRenamed("r", "mean_range"), ["series", "day", "bin"], "left"), ["series"], "day")


@query(f"with {POINTS} select count(distinct (floor(x / 0.1), floor(y / 0.1), floor(z / 0.1))) as n_cells from p")
def voxel_count(spark, sf_dir):
    return spatial.occupied(points(spark, sf_dir), ["x", "y", "z"], 0.1)


@query(f"with {POINTS}, m as (select median(y) as m from p) select count(distinct (floor(x / 0.1), floor(z / 0.1))) as n_cells from p, m where y - m > -0.05 and y - m < 0.1")
def topdown_cells(spark, sf_dir):
    return spatial.topdown_cells(points(spark, sf_dir), "x", "y", "z", 0.1, -0.05, 0.1)


@query(f"""with {POINTS}, c as (select label as target, avg(x) as cx, avg(y) as cy, avg(z) as cz from p group by 1),
d as (select vec_id, target, (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) as d from p, c), b as (select vec_id, target from d where d < 0.2 * 0.2 qualify row_number() over (partition by vec_id order by d, target) = 1)
select p.vec_id, coalesce(b.target, 255) as nearest_label from p left join b using (vec_id)""")
def nn_label(spark, sf_dir):
    p = points(spark, sf_dir)
    centres = p.groupBy(F.col("label").alias("target")).agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    return spatial.nearest(p, "vec_id", ["x", "y", "z"], centres, ["cx", "cy", "cz"], "target", ["target"], 0.2).select("vec_id", F.coalesce("target", F.lit(255)).alias("nearest_label"))


@query(f"""with {POINTS} select a.vec_id as i, b.vec_id as j, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 9) as d2 from p a join p b on a.vec_id < b.vec_id
where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.05 * 0.05 and b.vec_id - a.vec_id >= 6""")
def radius_pairs(spark, sf_dir):
    return spatial.radius_pairs(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 0.05).where("j - i >= 6").withColumn("d2", F.round("d2", 9))


@query(f"with {EVENTS} select user_id, event_id, event_type, value, t from e qualify row_number() over (partition by user_id order by event_id desc) = 1")
def latest_per_key(spark, sf_dir):
    return temporal.latest_per_key(events(spark, sf_dir).drop("props"), ["user_id"], "event_id")


@query("select label, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from embeddings group by 1")
def class_summary(spark, sf_dir):
    return robust.class_shares(table(spark, sf_dir, "embeddings"), "label").withColumn("percent", F.round("percent", 6))


@query("select l_returnflag, round(sum(l_extendedprice) / 100, 2) as area from lineitem group by 1")
def area_by_class(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice") / 100, 2).alias("area"))


HIST = """with b as (select l_returnflag, min(l_extendedprice) as low, greatest(ceil((max(l_extendedprice) - min(l_extendedprice)) / 2000), 1) as bins from lineitem group by 1),
c as (select l_returnflag, least(floor((l_extendedprice - low) / 2000), bins - 1)::bigint as bin, count(*) as n from lineitem join b using (l_returnflag) group by 1, 2),
h as (select l_returnflag, bin, low + bin * 2000 as low, coalesce(n, 0) as n from (select l_returnflag, low, unnest(generate_series(0, bins::bigint - 1)) as bin from b) left join c using (l_returnflag, bin))"""


def _hist(spark, sf_dir):
    return robust.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 2000.0)


@query(HIST + " select l_returnflag, bin, round(low, 6) as low, n from h")
def histogram_1d(spark, sf_dir):
    return _hist(spark, sf_dir).withColumn("low", F.round("low", 6))


@query(HIST + """, m as (select *, max(n) over (partition by l_returnflag) as most from h), r as (select *, bin - row_number() over (partition by l_returnflag order by bin) as run from m where n > 0 and n >= 0.9 * most),
g as (select l_returnflag, min(bin) as first_bin, max(bin) as last_bin, sum(n)::bigint as mass, sum((low + 1000) * n) / sum(n) as centre from r group by l_returnflag, run)
select l_returnflag, first_bin, last_bin, mass, round(centre, 5) as centre, row_number() over (partition by l_returnflag order by first_bin)::int as peak from g""")
def hist_peaks(spark, sf_dir):
    return robust.peaks(_hist(spark, sf_dir), ["l_returnflag"], 2000.0, 0.9).withColumn("centre", F.round("centre", 5))


@query(HIST + " select l_returnflag, round(sum((n * n)::double) / (sum(n)::double * sum(n)::double), 9) as concentration from h group by 1")
def histogram_concentration(spark, sf_dir):
    return robust.concentration(_hist(spark, sf_dir), ["l_returnflag"]).withColumn("concentration", F.round("concentration", 9))


@query(f"""with {POINTS}, b as (select min(x) as x0, max(x) as x1, min(z) as z0, max(z) as z1 from p), c as (select least(floor((x - x0) / ((x1 - x0) / 40)), 39)::bigint as bx, least(floor((z - z0) / ((z1 - z0) / 40)), 39)::bigint as "by", count(*) as n from p, b group by 1, 2)
select bx, "by", n, round(ln(1 + n), 9) as log_n from c""")
def histogram_2d(spark, sf_dir):
    return robust.histogram_2d(points(spark, sf_dir), "x", "z", 40).withColumn("log_n", F.round("log_n", 9))


@query(f"""with {POINTS}, k as (select unnest(generate_series(0, 89)) as k), s as (select k, unnest([{{'axis': 0, 'v': cos(-radians(k * 1.0)) * x - sin(-radians(k * 1.0)) * z}}, {{'axis': 1, 'v': sin(-radians(k * 1.0)) * x + cos(-radians(k * 1.0)) * z}}]) as s from p, k),
u as (select k, s.axis as axis, s.v as v from s), b as (select k, axis, min(v) as low, greatest(ceil((max(v) - min(v)) / 0.02), 1) as bins from u group by 1, 2),
c as (select k, axis, least(floor((v - low) / 0.02), bins - 1) as bin, count(*) as n from u join b using (k, axis) group by 1, 2, 3), t as (select k, axis, sum(n * n)::double / (sum(n)::double * sum(n)::double) as c from c group by 1, 2), f as (select k, sum(c) as score from t group by 1)
select k * 1.0::double as yaw_deg from f qualify row_number() over (order by round(score, 12) desc, k) = 1""")
def manhattan_yaw(spark, sf_dir):
    return measure.manhattan_yaw(points(spark, sf_dir), [], "x", "z", 1.0)


@query("with m as (select l_returnflag, median(l_extendedprice) as middle from lineitem group by 1) select l_returnflag, round(any_value(middle), 4) as middle, round(1.4826 * median(abs(l_extendedprice - middle)), 4) as sigma from lineitem join m using (l_returnflag) group by 1")
def mad_by_group(spark, sf_dir):
    return robust.mad(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", F.round("middle", 4).alias("middle"), F.round("sigma", 4).alias("sigma"))


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 4) as p1, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.95), 4) as p95, round(quantile_cont(l_extendedprice, 0.99), 4) as p99 from lineitem group by 1")
def exact_quantiles(spark, sf_dir):
    found = robust.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("p1", "p50", "p95", "p99")))


@query("select l_returnflag, round(sqrt(avg(l_extendedprice * l_extendedprice)), 4) as rms, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as weighted_mean, max(l_quantity) - min(l_quantity) as spread from lineitem group by 1")
def rms_by_class(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(robust.rms("l_extendedprice"), 4).alias("rms"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("weighted_mean"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"))


PLANES = [(1.0, 0.0, 0.0, 0.05), (0.0, 0.0, 1.0, -0.02), (0.6, 0.0, 0.8, 0.1), (0.8, 0.0, -0.6, 0.0)]


@query(f"with {POINTS}, f as (select * from (values {', '.join(f'({i}, {a}::double, {b}::double, {c}::double, {d}::double)' for i, (a, b, c, d) in enumerate(PLANES))}) f(plane, a, b, c, d)) select plane, count(*) filter (abs(a * x + b * y + c * z - d) < 0.03) as inliers from p, f group by 1")
def plane_inliers(spark, sf_dir):
    return plane_counts(points(spark, sf_dir), PLANES, 0.03)


def _rays(spark, sf_dir):
    return points(spark, sf_dir).select(F.col("vec_id").alias("seq"), *(F.lit(0.0).alias(f"o{a}") for a in "xyz"), *((F.col(a) * 4).alias(f"h{a}") for a in "xyz"))


RAYS = f"""with {POINTS}, r as (select vec_id as seq, x * 4 as hx, y * 4 as hy, z * 4 as hz from p),
b as (select least(min(hx), 0) - 0.3 as x0, least(min(hy), 0) - 0.3 as y0, least(min(hz), 0) - 0.3 as z0, greatest(max(hx), 0) + 0.3 as x1, greatest(max(hy), 0) + 0.3 as y1, greatest(max(hz), 0) + 0.3 as z1 from r),
l as (select r.*, seq // 200 as chunk, greatest(sqrt((hx - 0) ** 2 + (hy - 0) ** 2 + (hz - 0) ** 2), 1e-6) as len from r), k as (select unnest(generate_series(0, 219)) as k),
f as (select chunk, floor((0.0 + hx / len * (k * 0.035) - x0) / 0.05)::bigint as ix, floor((0.0 + hy / len * (k * 0.035) - y0) / 0.05)::bigint as iy, floor((0.0 + hz / len * (k * 0.035) - z0) / 0.05)::bigint as iz, 1 as free, 0 as hit from l, b, k where k * 0.035 < len - 0.035
union all select chunk, floor((hx - x0) / 0.05)::bigint, floor((hy - y0) / 0.05)::bigint, floor((hz - z0) / 0.05)::bigint, 0, 1 from l, b),
c as (select ix, iy, iz, chunk, sum(free)::bigint as n_free, sum(hit)::bigint as n_hit from f group by 1, 2, 3, 4)"""


@query(RAYS + " select ix, iy, iz, chunk, n_free, n_hit from c")
def ray_carve_counts(spark, sf_dir):
    return mapping.evidence(_rays(spark, sf_dir), chunk=200)


def _add(n: str, amount: str, start: str) -> str:
    return f"list_reduce(list_prepend({start}, list_transform(range({n}), lambda i: ({amount})::float)), lambda a, b: (a + b)::float)"


FOLD = RAYS + f""", o as (select *, row_number() over (partition by ix, iy, iz order by chunk) as rn from c),
w as (with recursive w as (select ix, iy, iz, 0::bigint as rn, 0::float as l from (select distinct ix, iy, iz from c) union all
select w.ix, w.iy, w.iz, o.rn, least(6::float, greatest((-4)::float, {_add('o.n_hit', '0.85', _add('o.n_free', '-0.4', 'w.l'))})) from w join o on o.ix = w.ix and o.iy = w.iy and o.iz = w.iz and o.rn = w.rn + 1) select * from w),
e as (select ix, iy, iz, l from w where rn > 0 qualify row_number() over (partition by ix, iy, iz order by rn desc) = 1)"""


def _voxels(spark, sf_dir):
    return mapping.classified(mapping.fold(mapping.evidence(_rays(spark, sf_dir), chunk=200)))


@query(FOLD + " select ix, iy, iz, round(l::double, 4) as logodds, case when l > 0.9::float then 'occupied' when l < (-0.9)::float then 'free' else 'unknown' end as state from e")
def occupancy_state(spark, sf_dir):
    return _voxels(spark, sf_dir).withColumn("logodds", F.round(F.col("logodds").cast("double"), 4))


@query(FOLD + """, n as (select ((ceil((x1 - x0) / 0.05) + 1) * (ceil((y1 - y0) / 0.05) + 1) * (ceil((z1 - z0) / 0.05) + 1))::bigint as total from b), s as (select count(*) filter (l > 0.9::float) as o, count(*) filter (l < (-0.9)::float) as f from e)
select u.state, u.n as n_voxels, round(u.n * (0.05 * 0.05 * 0.05)::double, 6) as volume from (select unnest([{'state': 'occupied', 'n': o}, {'state': 'free', 'n': f}, {'state': 'unknown', 'n': total - o - f}]) as u from s, n)""")
def occupancy_volumes(spark, sf_dir):
    return mapping.volumes(_voxels(spark, sf_dir), mapping.box(_rays(spark, sf_dir))).withColumn("volume", F.round("volume", 6))


def _cells(spark, sf_dir, size=0.1):
    p = points(spark, sf_dir)
    low = F.broadcast(p.agg(*(F.min(F.floor(F.col(a) / size)).alias(f"m{a}") for a in "xyz"), *((F.max(F.floor(F.col(a) / size)) - F.min(F.floor(F.col(a) / size)) + 1).alias(f"n{a}") for a in "xyz")))
    cells = p.crossJoin(low).select(*((F.floor(F.col(a) / size) - F.col(f"m{a}")).alias(f"i{a}") for a in "xyz")).distinct()
    return cells, low.select("nx", "ny", "nz")


CELLS = f"""with recursive {POINTS}, g as (select floor(x / 0.1)::bigint as gx, floor(y / 0.1)::bigint as gy, floor(z / 0.1)::bigint as gz from p), m as (select min(gx) as mx, min(gy) as my, min(gz) as mz, max(gx) - min(gx) + 1 as nx, max(gy) - min(gy) + 1 as ny, max(gz) - min(gz) + 1 as nz from g),
v as (select distinct gx - mx as ix, gy - my as iy, gz - mz as iz from g, m)"""


@query(CELLS + """, o as (select unnest([-1, 0, 1]) as d), b as (select x.d as dx, y.d as dy, z.d as dz from o x, o y, o z where abs(x.d) + abs(y.d) + abs(z.d) <= 1),
t as (select v.ix, v.iy, v.iz, count(*) filter (v.ix + dx >= 0 and v.ix + dx < nx and v.iy + dy >= 0 and v.iy + dy < ny and v.iz + dz >= 0 and v.iz + dz < nz) as inside, count(w.ix) as free from v cross join b cross join m left join v w on w.ix = v.ix + dx and w.iy = v.iy + dy and w.iz = v.iz + dz group by 1, 2, 3)
select ix, iy, iz from t where inside = free""")
def inflate_l1(spark, sf_dir):
    cells, size = _cells(spark, sf_dir)
    return mapping.clear_of_blocked(cells, size, 1)


@query(CELLS + """, s as (select ix, iy, iz from v order by ix, iy, iz limit 1), r as (select ix, iy, iz from s union select v.ix, v.iy, v.iz from r join v on abs(v.ix - r.ix) + abs(v.iy - r.iy) + abs(v.iz - r.iz) = 1) select ix, iy, iz from r""")
def reachable_free(spark, sf_dir):
    cells, _ = _cells(spark, sf_dir)
    return mapping.reachable_voxels(cells, cells.orderBy("ix", "iy", "iz").limit(1))


@query(CELLS + """, r as (select ix, iy, iz, ix as jx, iy as jy, iz as jz from v union select r.ix, r.iy, r.iz, v.ix, v.iy, v.iz from r join v on greatest(abs(v.ix - r.jx), abs(v.iy - r.jy), abs(v.iz - r.jz)) = 1),
l as (select jx as ix, jy as iy, jz as iz, (min({'a': ix, 'b': iy, 'c': iz})) as door from r group by 1, 2, 3), h as (select floor(x / 0.1)::bigint - mx as ix, floor(y / 0.1)::bigint - my as iy, floor(z / 0.1)::bigint - mz as iz, x, y, z from p, m)
select (door.a + mx)::bigint as door_x, (door.b + my)::bigint as door_y, (door.c + mz)::bigint as door_z, count(*) as n_points, round(greatest(max(x) - min(x), max(z) - min(z)), 6) as width, round(max(y) - min(y), 6) as height from h join l using (ix, iy, iz), m group by 1, 2, 3 having count(*) >= 2""")
def door_components(spark, sf_dir):
    return measure.door_sizes(points(spark, sf_dir), 0.1, 2).select(*(F.col(f"door.i{a}").alias(f"door_{a}") for a in "xyz"), "n_points", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


@query("""with p as (select n_name as name, avg(c_acctbal) as value_m from customer join nation on c_nationkey = n_nationkey group by 1), t as (select n_name as name, avg(s_acctbal) as tape_m from supplier join nation on s_nationkey = n_nationkey group by 1)
select name, round(value_m, 4) as value_m, round(tape_m, 4) as tape_m, round(value_m - tape_m, 4) as error, round(case when tape_m <> 0 then 100 * (value_m - tape_m) / tape_m end, 4) as percent from p join t using (name)""")
def truth_compare(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    predicted = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.avg("c_acctbal").alias("value_m"))
    truth = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.avg("s_acctbal").alias("tape_m"))
    return robust.compare(predicted, truth).select("name", *(F.round(c, 4).alias(c) for c in ("value_m", "tape_m", "error", "percent")))


@query(f"""with {EVENTS}, l as (select event_type, user_id::varchar as name, value from e where user_id::varchar not like '%7%' qualify row_number() over (partition by event_type, user_id order by event_id desc) = 1)
select a.name, a.value as value_a, b.value as value_b, round(a.value - b.value, 6) as difference from l a join l b on a.name = b.name and a.event_type = 'click' and b.event_type = 'view'""")
def sensor_agreement(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("name"), F.col("value").alias("value_m"), F.col("event_id").alias("seq"))
    return robust.agreement(rows, "click", "view", without="7").withColumn("difference", F.round("difference", 6))


@query(f"with {EVENTS}, h as (select user_id, event_id, sha256(event_type || ':' || event_id::varchar) as h from e) select user_id, sha256(string_agg(h, '' order by event_id)) as digest from h group by 1")
def ordered_digest(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("text"))
    return robust.ordered_digest(rows, ["user_id"], ["event_id"], "text")


LABELS_SQL = " ".join(f"when {k} then '{v}'" for k, v in MESH_LABELS.items())


@query(f"""select p_partkey, array_to_string(list_filter([case when p_size & 1 > 0 then 'pose' end, case when p_size & 2 > 0 then 'camera_frame' end, case when p_size & 4 > 0 then 'scene_depth' end, case when p_size & 8 > 0 then 'mesh' end], lambda x: x is not null), ',') as names,
case p_size % 10 {LABELS_SQL} else 'unknown(' || (p_size % 10)::varchar || ')' end as label, least(40, greatest(5, p_size)) as clipped from part""")
def code_names(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(bit_names(size, {1: "pose", 2: "camera_frame", 4: "scene_depth", 8: "mesh"}), ",").alias("names"), named(size % 10, MESH_LABELS).alias("label"), clipped(size, 5, 40).alias("clipped"))


@query(f"with {EVENTS} select event_id, (round_even(value * 64, 0)::bigint & 65535) as angle_q6, (round_even(value * 4, 0)::bigint & 65535) as dist_q2, ((round_even(value * 64, 0)::bigint & 65535) / 64.0)::double as degrees from e")
def fixed_point(spark, sf_dir):
    q = lambda k: F.bround(F.col("value") * k).cast("long").bitwiseAND(F.lit(65535))
    return events(spark, sf_dir).select("event_id", q(64).alias("angle_q6"), q(4).alias("dist_q2"), (q(64) / 64.0).alias("degrees"))


@query(f"""with {EVENTS}, g as (select user_id, count(*) as n, max(value) as motion, avg(value) as middle from e group by 1) select user_id, case when n < 60 then 'few rows' when motion < 150 then 'little motion' when middle > 52 then 'tilted' end as why_not from g""")
def confidence_rules(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("motion"), F.avg("value").alias("middle"))
    return g.select("user_id", first_rule((F.col("n") < 60, "few rows"), (F.col("motion") < 150, "little motion"), (F.col("middle") > 52, "tilted")).alias("why_not"))


QUATERNIONS = """with q as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double as w, embedding[5]::double as a, embedding[6]::double as b, embedding[7]::double as c, embedding[8]::double as d from embeddings),
n as (select vec_id, x / sqrt(x*x+y*y+z*z+w*w) as x, y / sqrt(x*x+y*y+z*z+w*w) as y, z / sqrt(x*x+y*y+z*z+w*w) as z, w / sqrt(x*x+y*y+z*z+w*w) as w, a / sqrt(a*a+b*b+c*c+d*d) as a, b / sqrt(a*a+b*b+c*c+d*d) as b, c / sqrt(a*a+b*b+c*c+d*d) as c, d / sqrt(a*a+b*b+c*c+d*d) as d from q)"""


def _quaternions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    part = lambda k: tuple(F.col("embedding")[i].cast("double") for i in range(k, k + 4))
    return e, G.unit_quaternion(part(0)), G.unit_quaternion(part(4))


@query(QUATERNIONS + """, s as (select *, x*a+y*b+z*c+w*d as dt from n), g as (select *, case when dt < 0 then -1.0 else 1.0 end as sg, acos(least(abs(dt), 1.0)) as th from s),
m as (select *, case when th < 1e-6 then 0.7 else sin(0.7 * th) / sin(th) end as wa, case when th < 1e-6 then 0.3 else sin(0.3 * th) / sin(th) end * sg as wb from g), r as (select vec_id, x*wa+a*wb as p, y*wa+b*wb as q, z*wa+c*wb as r, w*wa+d*wb as s from m)
select vec_id, round(p / sqrt(p*p+q*q+r*r+s*s), 6) as qx, round(q / sqrt(p*p+q*q+r*r+s*s), 6) as qy, round(r / sqrt(p*p+q*q+r*r+s*s), 6) as qz, round(s / sqrt(p*p+q*q+r*r+s*s), 6) as qw from r""")
def slerp(spark, sf_dir):
    e, a, b = _quaternions(spark, sf_dir)
    names = ("qx", "qy", "qz", "qw")
    return G.with_slerp(e, a, b, F.lit(0.3), names).select("vec_id", *(F.round(n, 6).alias(n) for n in names))


@query(QUATERNIONS + """ select vec_id, round(atan2(-(2*(x*z+y*w)), -(1-2*(x*x+y*y))), 6) as heading, round((1-2*(y*y+z*z))*1.0 + 2*(x*y-z*w)*2.0 + 2*(x*z+y*w)*3.0, 6) as rx, round(2*(x*y+z*w)*1.0 + (1-2*(x*x+z*z))*2.0 + 2*(y*z-x*w)*3.0, 6) as ry, round(2*(x*z-y*w)*1.0 + 2*(y*z+x*w)*2.0 + (1-2*(x*x+y*y))*3.0, 6) as rz from n""")
def rotate_heading(spark, sf_dir):
    e, q, _ = _quaternions(spark, sf_dir)
    turned = G.rotate(q, (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return e.select("vec_id", F.round(G.heading(q), 6).alias("heading"), *(F.round(c, 6).alias(n) for n, c in zip(("rx", "ry", "rz"), turned, strict=True)))


@query(f"with {POINTS} select vec_id, round(x + cos(z) * 0.5 - sin(z) * 0.25, 6) as cx, round(y + sin(z) * 0.5 + cos(z) * 0.25, 6) as cz, round(z + 0.1, 6) as cyaw, round(-(cos(-z) * x - sin(-z) * y), 6) as ix, round(-(sin(-z) * x + cos(-z) * y), 6) as iz from p")
def plane_motion(spark, sf_dir):
    a = (F.col("x"), F.col("y"), F.col("z"))
    c, i = G.compose(a, (F.lit(0.5), F.lit(0.25), F.lit(0.1))), G.inverse(a)
    return points(spark, sf_dir).select("vec_id", *(F.round(v, 6).alias(n) for n, v in zip(("cx", "cz", "cyaw", "ix", "iz"), (*c, *i[:2]), strict=True)))


@query("select vec_id, round((u - 31.5) / 60.0 * d, 6) as px, round(-((label * 4) - 23.5) / 55.0 * d, 6) as py, round(-d, 6) as pz from (select vec_id, label, (vec_id % 64)::double as u, embedding[1]::double + 2 as d from embeddings)")
def unproject(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p = G.unproject((F.col("vec_id") % 64).cast("double"), F.col("label") * 4, F.col("embedding")[0].cast("double") + 2, *(F.lit(v) for v in (60.0, 55.0, 31.5, 23.5)))
    return e.select("vec_id", *(F.round(c, 6).alias(n) for n, c in zip(("px", "py", "pz"), p, strict=True)))


@query("select distinct c_nationkey as nationkey from customer where c_acctbal > 9000 and c_nationkey in (select s_nationkey from supplier) and c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def set_membership(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")).distinct()
    supplied = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    barred = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("nationkey"))
    return rich.join(supplied, "nationkey", "left_semi").join(F.broadcast(barred), "nationkey", "left_anti")


@query(f"with {EVENTS} select event_id, json_extract(props, '$.k')::int as k from e where json_extract(props, '$.k')::int > 50")
def json_fields(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k > 50")


@query(f"""with recursive {EVENTS}, o as (select user_id, event_id, t, value, row_number() over (partition by user_id order by t) as rn from e),
w as (select user_id, event_id, rn, t as last_t, value as last_v, true as kept from o where rn = 1 union all
select o.user_id, o.event_id, o.rn, case when o.t - w.last_t >= {DAY} or abs(o.value - w.last_v) >= 60 then o.t else w.last_t end, case when o.t - w.last_t >= {DAY} or abs(o.value - w.last_v) >= 60 then o.value else w.last_v end, o.t - w.last_t >= {DAY} or abs(o.value - w.last_v) >= 60 from w join o on o.user_id = w.user_id and o.rn = w.rn + 1)
select user_id, event_id from w where kept""")
def keyframe_greedy(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "t", F.col("value").alias("x"), F.lit(0.0).alias("z"))
    return keyframes(rows, ["user_id"], "t", 60.0, DAY).where("keyframe").select("user_id", "event_id")


@query(f"""with recursive {EVENTS}, o as (select user_id, event_id, t, row_number() over (partition by user_id order by t) as rn from e), w as (select user_id, event_id, rn, t as last_t, true as kept from o where rn = 1 union all
select o.user_id, o.event_id, o.rn, case when o.t - w.last_t >= {12 * HOUR} then o.t else w.last_t end, o.t - w.last_t >= {12 * HOUR} from w join o on o.user_id = w.user_id and o.rn = w.rn + 1) select user_id, event_id, t from (select w.*, o.t from w join o using (user_id, event_id)) where kept""")
def throttle(spark, sf_dir):
    return signal.kept_every(events(spark, sf_dir).select("user_id", "event_id", "t"), ["user_id"], "t", 12 * HOUR)


@query("""with recursive l as (select c_nationkey as a, min(s_nationkey) as b from customer join supplier on c_custkey % 50 = s_suppkey % 50 where c_nationkey < s_nationkey group by 1), d as (select a, b from l union select b, a from l), r as (select a as node, a as seen from d union select r.node, d.b from r join d on d.a = r.seen)
select node, min(seen) as label from r group by 1""")
def link_components(spark, sf_dir):
    from ..operators.graph import components

    # nations of a remainder meet once, however many customers and suppliers they have
    buyers = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("r"), "c_nationkey").distinct()
    sellers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("r"), "s_nationkey").distinct()
    c = buyers.join(sellers, "r").where("c_nationkey < s_nationkey")
    return components(c.groupBy(F.col("c_nationkey").alias("a")).agg(F.min("s_nationkey").alias("b")))


from . import session_queries  # noqa: E402, F401  (registers its queries)
