"""Free, occupied and unknown space from rays.

Evidence is per sample of a ray, added in 32-bit floats and clipped after each chunk of hits, so it is folded in chunk
order; voxels without a sample stay implicit. Keys are (ix, iy, iz).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import reachable

VOXEL, STEP, SAMPLES = 0.05, 0.035, 220
HIT, MISS, LOW, HIGH, DECIDED = 0.85, -0.4, -4.0, 6.0, 0.9
CHUNK, PAD = 40_000, 0.3
KEY = ["ix", "iy", "iz"]


def box(rays: DataFrame, voxel: float = VOXEL, pad: float = PAD) -> DataFrame:
    """One row: x0, y0, z0 (least corner) and nx, ny, nz, around all origins and hits."""
    ends = {a: (F.least(F.min(f"o{a}"), F.min(f"h{a}")) - pad, F.greatest(F.max(f"o{a}"), F.max(f"h{a}")) + pad) for a in "xyz"}
    out = rays.agg(*(c.alias(f"{a}{i}") for a, pair in ends.items() for i, c in enumerate(pair)))
    return out.select(*(f"{a}0" for a in "xyz"), *((F.ceil((F.col(f"{a}1") - F.col(f"{a}0")) / voxel) + 1).alias(f"n{a}") for a in "xyz"))


def evidence(rays: DataFrame, voxel: float = VOXEL, step: float = STEP, samples: int = SAMPLES, chunk: int = CHUNK) -> DataFrame:
    """ix, iy, iz, chunk, n_free, n_hit from rays(seq, ox..oz, hx..hz): samples before the hit, and the hits.

    Counts are combined on the map side before anything is shuffled.
    """
    length = F.sqrt(sum(((F.col(f"h{a}") - F.col(f"o{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    inside = rays.crossJoin(F.broadcast(box(rays, voxel))).withColumn("chunk", F.floor(F.col("seq") / chunk)).withColumn("_len", F.greatest(length, F.lit(1e-6)))
    room = F.least(F.ceil((F.col("_len") - step) / step), F.lit(samples)).cast("int")  # k * step < length - step
    place = lambda k: [F.floor((F.col(f"o{a}") + (F.col(f"h{a}") - F.col(f"o{a}")) / F.col("_len") * k - F.col(f"{a}0")) / voxel).alias(f"i{a}") for a in "xyz"]
    steps = inside.where(room > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), room - 1)))
    free = steps.where(F.col("_k") * step < F.col("_len") - step).select("chunk", "nx", "ny", "nz", *place(F.col("_k") * step), F.lit(1).alias("free"), F.lit(0).alias("hit"))
    hits = inside.select("chunk", "nx", "ny", "nz", *(F.floor((F.col(f"h{a}") - F.col(f"{a}0")) / voxel).alias(f"i{a}") for a in "xyz"), F.lit(0).alias("free"), F.lit(1).alias("hit"))
    held = free.unionByName(hits)
    for a in "xyz":
        held = held.where((F.col(f"i{a}") >= 0) & (F.col(f"i{a}") < F.col(f"n{a}")))
    return held.groupBy(*KEY, "chunk").agg(F.sum("free").alias("n_free"), F.sum("hit").alias("n_hit"))


def _added(start: Column, times: Column, amount: float) -> Column:
    """start + amount, `times` times, each sum rounded to 32 bits."""
    return F.when(times > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(times, F.lit(1))), start, lambda s, _: (s + F.lit(amount).cast("float")).cast("float"))).otherwise(start)


def fold(counts: DataFrame) -> DataFrame:
    """ix, iy, iz, logodds: chunks in order, free samples before hits, clipped after each chunk.

    Sums that end well beyond a limit are clipped without adding one by one.
    """

    def add(state: Column, row: Column) -> Column:
        rough = state.cast("double") + MISS * row["n_free"] + HIT * row["n_hit"]
        exact = _added(_added(state, row["n_free"], MISS), row["n_hit"], HIT)
        low, high = F.lit(LOW).cast("float"), F.lit(HIGH).cast("float")
        return F.when(rough < LOW - 1, low).when(rough > HIGH + 1, high).otherwise(F.greatest(low, F.least(high, exact)))

    rows = F.array_sort(F.collect_list(F.struct("chunk", "n_free", "n_hit")))
    return counts.groupBy(*KEY).agg(rows.alias("rows")).select(*KEY, F.aggregate("rows", F.lit(0.0).cast("float"), add).alias("logodds"))


def classified(voxels: DataFrame) -> DataFrame:
    """Adds state: occupied, free or unknown."""
    limit = F.lit(DECIDED).cast("float")
    return voxels.withColumn("state", F.when(F.col("logodds") > limit, "occupied").when(F.col("logodds") < -limit, "free").otherwise("unknown"))


def volumes(states: DataFrame, size: DataFrame, voxel: float = VOXEL) -> DataFrame:
    """state, n_voxels, volume: voxels that were never seen count as unknown."""
    seen = states.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("occupied", "free"))).crossJoin(size)
    total = F.col("nx") * F.col("ny") * F.col("nz")
    rows = F.array(*(F.struct(F.lit(s).alias("state"), n.alias("n_voxels")) for s, n in (("occupied", F.col("occupied")), ("free", F.col("free")), ("unknown", total - F.col("occupied") - F.col("free")))))
    return seen.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.n_voxels") * voxel**3).alias("volume"))


def ball(steps: int) -> list[tuple[int, ...]]:
    return [o for o in product(range(-steps, steps + 1), repeat=3) if sum(map(abs, o)) <= steps]


def clear_of_blocked(free: DataFrame, size: DataFrame, steps: int) -> DataFrame:
    """Free voxels that are more than `steps` face steps from anything not free; outside the grid nothing blocks.

    Unknown space is implicit, so instead of spreading it, each free voxel counts its free neighbours and compares them
    with how many places around it lie in the grid.
    """
    offsets = F.array(*(F.struct(*(F.lit(c).alias(f"d{a}") for a, c in zip("xyz", o, strict=True))) for o in ball(steps)))
    around = free.select(*KEY).withColumn("o", F.explode(offsets)).select(*((F.col(f"i{a}") + F.col("o")[f"d{a}"]).alias(f"i{a}") for a in "xyz"))
    counted = around.groupBy(*KEY).agg(F.count("*").alias("n_free"))
    within = F.size(F.filter(offsets, lambda o: sum((((F.col(f"i{a}") + o[f"d{a}"] >= 0) & (F.col(f"i{a}") + o[f"d{a}"] < F.col(f"n{a}"))).cast("int") for a in "xyz"), F.lit(0)) == 3))
    return free.select(*KEY).join(counted, KEY).crossJoin(F.broadcast(size)).where(F.col("n_free") == within).select(*KEY)


def face_links(voxels: DataFrame) -> DataFrame:
    """a, b: neighbouring voxels, as structs."""
    ahead = F.explode(F.array(*(F.struct(*(F.lit(int(i == j)).alias(f"d{a}") for j, a in enumerate("xyz"))) for i in range(3))))
    there = voxels.select(*KEY).withColumn("o", ahead).select(F.struct(*KEY).alias("a"), *((F.col(f"i{a}") + F.col("o")[f"d{a}"]).alias(f"i{a}") for a in "xyz"))
    return there.join(voxels.select(*KEY), KEY).select("a", F.struct(*KEY).alias("b"))


def reachable_voxels(voxels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Voxels connected through faces to one of the seeds."""
    return reachable(voxels.select(F.struct(*KEY).alias("node")), face_links(voxels), seeds.select(F.struct(*KEY).alias("node"))).select("node.*")
