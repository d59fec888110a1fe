"""The voxel queries by name, each with SQL that must give the same rows.

The volumes come from line items (sources.voxels); their number grows with
the table.  The SQL states each operator another way than the plan does:
self-joins for windows, recursion for labelling and for search.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.config import FeatureConfig
from voxtide.functions.columns import AXES, CELL, linear_index, mean_of_finite
from voxtide.functions.tables import stored
from voxtide.jobs import features
from voxtide.operators import chords, connectivity, counts, diffusion, surface
from voxtide.sources import planes
from voxtide.sources import voxels as source

PHASES, DIRECTIONS, SIZE, SIGMA, FACTOR = (1, 2, 3), (1, 2, 3), 0.5, 1.0, 2.0
MIN_CHORD, DIGITS = 1.25, 6
CONFIG = FeatureConfig(voxel_size=SIZE, rays=200, min_chord=MIN_CHORD, rtol=1e-12)
N = source.SIDE


def _vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(source.from_lineitem(spark, sf_dir), "voxels")


def _sizes(vox: DataFrame) -> DataFrame:
    return source.dims(vox).drop("n")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.pack(source.from_lineitem(spark, sf_dir))


def _masks(of_planes: DataFrame) -> DataFrame:
    return connectivity.percolating(of_planes, PHASES, DIRECTIONS)


def _through(of_planes: DataFrame) -> DataFrame:
    return stored(connectivity.mask_voxels(_masks(of_planes)), "through")


def vox_scan(spark, sf_dir):
    return source.from_lineitem(spark, sf_dir)


def vox_dims(spark, sf_dir):
    return source.dims(source.from_lineitem(spark, sf_dir))


def positive_phases(spark, sf_dir):
    return counts.positive_phases(source.from_lineitem(spark, sf_dir))


def phase_masks(spark, sf_dir):
    return counts.phase_masks(source.from_lineitem(spark, sf_dir), PHASES)


def phase_mask_counts(spark, sf_dir):
    return counts.phase_counts(source.from_lineitem(spark, sf_dir), PHASES)


def volume_fraction(spark, sf_dir):
    return _rounded(counts.volume_fraction(source.from_lineitem(spark, sf_dir), PHASES))


def gaussian_smooth(spark, sf_dir):
    return _rounded(surface.smooth(_planes(spark, sf_dir), PHASES, SIGMA))


def gradient_magnitude(spark, sf_dir):
    g = surface.gradient(_planes(spark, sf_dir), PHASES, SIZE, SIGMA)
    return _rounded(g.select("sample", "phase", *AXES, F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2).alias("g")))


def surface_area(spark, sf_dir):
    return _rounded(surface.surface_area(_planes(spark, sf_dir), PHASES, SIZE, SIGMA))


def tpb_edges_by_axis(spark, sf_dir):
    return counts.tpb_edges(_planes(spark, sf_dir)).drop("total")


def tpb_density(spark, sf_dir):
    return _rounded(counts.tpb_density(_planes(spark, sf_dir), SIZE))


def boundary_reachable(spark, sf_dir):
    return connectivity.reachable(_planes(spark, sf_dir), PHASES, 1, far=False)


def percolation_mask(spark, sf_dir):
    return connectivity.mask_voxels(_masks(_planes(spark, sf_dir)))


def percolation_fraction(spark, sf_dir):
    vox = _planes(spark, sf_dir)
    return _rounded(connectivity.percolating_fraction(counts.plane_counts(vox, PHASES), _masks(vox), DIRECTIONS))


def _atpb(vox: DataFrame) -> DataFrame:
    return counts.active_tpb_density(stored(connectivity.connected(vox, (1, 2)), "connected"), DIRECTIONS, SIZE)


def atpb_density(spark, sf_dir):
    return _rounded(_atpb(_planes(spark, sf_dir)))


def geodesic_distance(spark, sf_dir):
    return connectivity.mask_voxels(connectivity.geodesic_distance(_masks(_planes(spark, sf_dir))), "steps")


def geometric_tortuosity(spark, sf_dir):
    vox = _planes(spark, sf_dir)
    distance = connectivity.geodesic_distance(_masks(vox))
    return _rounded(connectivity.geometric_tortuosity(counts.plane_counts(vox, PHASES), distance, DIRECTIONS))


def tortuosity_mean_skip_inf(spark, sf_dir):
    return _rounded(geometric_tortuosity(spark, sf_dir).groupBy("sample", "phase").agg(mean_of_finite(F.col("value")).alias("value")))


def _rays(vox: DataFrame) -> DataFrame:
    """Rays along x through every voxel of the first face, and sixteen slanted ones."""
    spark = vox.sparkSession
    straight = spark.range(N * N).select(F.col("id").alias("ray_id"), F.lit(0.0).alias("px"), (F.col("id") % N + 0.5).alias("py"), (F.floor(F.col("id") / N) + 0.5).alias("pz"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    i = F.col("id").cast("double")
    slanted = spark.range(16).select((F.col("id") + N * N).alias("ray_id"), (0.25 + 0.4 * i).alias("px"), F.lit(0.15).alias("py"), (0.35 + 0.3 * i).alias("pz"), (0.2 + 0.05 * i).alias("a"), (1.0 - 0.03 * i).alias("b"), (0.1 * i - 0.75).alias("c"))
    length = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2 + F.col("c") ** 2)
    slanted = slanted.select("ray_id", "px", "py", "pz", (F.col("a") / length).alias("dx"), (F.col("b") / length).alias("dy"), (F.col("c") / length).alias("dz"))
    return vox.select("sample").distinct().join(F.broadcast(straight.unionByName(slanted)))  # 80 rays


def ray_segments(spark, sf_dir):
    vox = _vox(spark, sf_dir)
    return _rounded(chords.segments(_rays(vox), _sizes(vox)))


def chord_runs(spark, sf_dir):
    vox = _planes(spark, sf_dir)
    return _rounded(chords.chords(chords.segments(_rays(vox), planes.sizes(vox)), vox).withColumn("phase", F.col("phase").cast("int")))


def mean_chord_length(spark, sf_dir):
    vox = _planes(spark, sf_dir)
    runs = chords.chords(chords.segments(_rays(vox), planes.sizes(vox)), vox)
    return _rounded(chords.mean_chord_length(runs, counts.plane_counts(vox, PHASES), MIN_CHORD, SIZE))


def diffusion_system(spark, sf_dir):
    vox = _planes(spark, sf_dir)
    return _rounded(diffusion.system(_through(vox), planes.sizes(vox), FACTOR))


def operator_apply(spark, sf_dir):
    vox = _planes(spark, sf_dir)
    through = _through(vox)
    rows = diffusion.system(through, planes.sizes(vox), FACTOR)
    return _rounded(diffusion.apply_operator(rows, through, "x0").select("sample", "phase", "dir", *AXES, "applied"))


def cell_numbers(spark, sf_dir):
    vox = _vox(spark, sf_dir)
    return vox.join(_sizes(vox), "sample").select(*CELL, linear_index(F.col("nx"), F.col("ny")).cast("long").alias("number"))


def percolation_mean(spark, sf_dir):
    """Plain mean over the directions, zeros included."""
    vox = _planes(spark, sf_dir)
    each = connectivity.percolating_fraction(counts.plane_counts(vox, PHASES), _masks(vox), DIRECTIONS)
    return _rounded(each.groupBy("sample", "phase").agg(F.avg("value").alias("value")))


def atpb_mean(spark, sf_dir):
    return _rounded(_atpb(_planes(spark, sf_dir)).groupBy("sample").agg(F.avg("value").alias("value")))


def initial_residual(spark, sf_dir):
    """Squared norms of the right side and of the residual at the start, and the start's outlet sum, of every system."""
    vox = _planes(spark, sf_dir)
    through = _through(vox)
    rows = diffusion.apply_operator(diffusion.system(through, planes.sizes(vox), FACTOR), through, "x0")
    r = F.col("rhs") - F.col("applied")
    return _rounded(rows.groupBy("sample", "phase", "dir").agg(F.sum(F.col("rhs") * F.col("rhs")).alias("bb"), F.sum(r * r).alias("rr"), F.coalesce(F.sum(F.when(F.col("outlet"), F.col("x0"))), F.lit(0.0)).alias("outlet")))


def feature_columns(spark, sf_dir):
    """The feature row without the columns that need random rays or an iterative solve."""
    kept = [c for c in features.columns(CONFIG) if not c.startswith(("cld", "pt"))]
    return _rounded(features.extract_features(_vox(spark, sf_dir), CONFIG).select("sample", *kept))


def physical_tortuosity(spark, sf_dir):
    vox = _planes(spark, sf_dir)
    tau = diffusion.physical_tortuosity(counts.plane_counts(vox, PHASES), _masks(vox), DIRECTIONS, FACTOR, 1e-12)
    return _rounded(tau.select("sample", "phase", "dir", "value"))


def static_phase_verify(spark, sf_dir):
    return features.changed_static(source.from_lineitem(spark, sf_dir), 2)


def feature_row(spark, sf_dir):
    return _rounded(features.extract_features(_vox(spark, sf_dir), CONFIG))


SERIES = FeatureConfig(**{**CONFIG.__dict__, "recalculate_static": False, "verify_static": False})


def static_phase_reuse(spark, sf_dir):
    return _rounded(features.extract_series(_vox(spark, sf_dir), SERIES))


def static_phase_columns(spark, sf_dir):
    """static_phase_reuse without the columns that need random rays or an iterative solve."""
    kept = [c for c in features.columns(SERIES) if not c.startswith(("cld", "pt"))]
    return _rounded(features.extract_series(_vox(spark, sf_dir), SERIES).select("sample", *kept))


ALL = (
    vox_scan, vox_dims, positive_phases, phase_masks, phase_mask_counts, volume_fraction, gaussian_smooth, gradient_magnitude, surface_area, tpb_edges_by_axis,
    tpb_density, boundary_reachable, percolation_mask, percolation_fraction, atpb_density, geodesic_distance, geometric_tortuosity,
    tortuosity_mean_skip_inf, ray_segments, chord_runs, mean_chord_length, diffusion_system, operator_apply, physical_tortuosity, cell_numbers, percolation_mean, atpb_mean, initial_residual, feature_columns,
    static_phase_verify, feature_row, static_phase_reuse, static_phase_columns,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}

# The oracles: common table expressions, and what each query selects from them.

_VOX = f"""
cells as (select cast(l_orderkey // {source.ORDERS_PER_SAMPLE} as varchar) as sample, cast(l_orderkey % {N} + 1 as int) as x, cast(l_partkey % {N} + 1 as int) as y,
  cast(cast(l_quantity as bigint) % {N} + 1 as int) as z, cast(sum(l_linenumber * 7 + cast(l_quantity as bigint)) as bigint) % 20 as v from lineitem group by all),
side as (select cast(unnest(range(1, {N + 1})) as int) as i),
vox as (select g.sample, g.x, g.y, g.z, cast(case when v is null then 0 when v < 8 then 1 when v < 14 then 2 when v < 19 then 3 else 0 end as int) as phase
  from (select s.sample, a.i as x, b.i as y, c.i as z from (select distinct sample from cells) s, side a, side b, side c) g left join cells using (sample, x, y, z)),
phases as (select cast(unnest([1, 2, 3]) as int) as phase), dirs as (select cast(unnest([1, 2, 3]) as int) as dir),
samples as (select distinct sample from vox),
moves as (select unnest([1, -1, 0, 0, 0, 0]) as mx, unnest([0, 0, 1, -1, 0, 0]) as my, unnest([0, 0, 0, 0, 1, -1]) as mz)"""
_HALF = 2 * math.ceil(SIGMA)


def _pass(before: str, after: str, axis: str) -> str:
    rest = " and ".join(f"b.{c} = a.{c}" for c in ("sample", "phase", *(c for c in AXES if c != axis)))
    return f"""{after} as (select a.sample, a.phase, a.x, a.y, a.z, sum(w.w * b.v) as v from {before} a, weights w, {before} b
  where {rest} and b.{axis} = greatest(1, least({N}, a.{axis} + w.k)) group by all)"""


_SMOOTH = f"""weights as (select k, exp(-k * k / (2 * {SIGMA}::double * {SIGMA})) / sum(exp(-k * k / (2 * {SIGMA}::double * {SIGMA}))) over () as w from (select unnest(range(-{_HALF}, {_HALF + 1})) as k)),
s0 as (select sample, p.phase, x, y, z, cast(vox.phase = p.phase as double) as v from vox, phases p),
{_pass("s0", "s1", "x")}, {_pass("s1", "s2", "y")}, {_pass("s2", "s3", "z")}"""


def _slope(axis: str) -> str:
    rest = " and ".join(f"{{0}}.{c} = a.{c}" for c in ("sample", "phase", *(c for c in AXES if c != axis)))
    return f"""d{axis} as (select a.sample, a.phase, a.x, a.y, a.z, (h.v - l.v) / ((h.{axis} - l.{axis}) * {SIZE}) as g from s3 a
  join s3 h on {rest.format("h")} and h.{axis} = least({N}, a.{axis} + 1) join s3 l on {rest.format("l")} and l.{axis} = greatest(1, a.{axis} - 1))"""


_GRADIENT = f"""{_SMOOTH}, {_slope("x")}, {_slope("y")}, {_slope("z")},
grad as (select sample, phase, x, y, z, sqrt(dx.g * dx.g + dy.g * dy.g + dz.g * dz.g) as g from dx join dy using (sample, phase, x, y, z) join dz using (sample, phase, x, y, z))"""
_FACES = "case dir when 1 then {0}x when 2 then {0}y else {0}z end"
_REACH = f"""reach as (select sample, phase, dir, far, x, y, z from vox, dirs, (select unnest([false, true]) as far)
  where phase between 1 and 3 and {_FACES.format("")} = case when far then {N} else 1 end
  union select r.sample, r.phase, r.dir, r.far, v.x, v.y, v.z from reach r, moves m, vox v
  where v.sample = r.sample and v.phase = r.phase and v.x = r.x + m.mx and v.y = r.y + m.my and v.z = r.z + m.mz)"""
_THROUGH = f"""{_REACH}, through as (select sample, phase, dir, x, y, z from reach where not far intersect select sample, phase, dir, x, y, z from reach where far)"""
_WALK = f"""{_THROUGH}, walk as (select sample, phase, dir, x, y, z, 0 as d from through where {_FACES.format("")} = {N}
  union select t.sample, t.phase, t.dir, t.x, t.y, t.z, w.d + 1 from walk w, moves m, through t where t.sample = w.sample and t.phase = w.phase and t.dir = w.dir
  and t.x = w.x + m.mx and t.y = w.y + m.my and t.z = w.z + m.mz and w.d < {N**3 // 2}),
dist as (select sample, phase, dir, x, y, z, cast(min(d) as int) as d from walk group by all)"""
_GT = f"""{_WALK}, gt as (select s.sample, p.phase, r.dir, coalesce(avg(d.d) / {N - 1}, 'inf'::double) as value from samples s cross join phases p cross join dirs r
  left join dist d on d.sample = s.sample and d.phase = p.phase and d.dir = r.dir and {_FACES.format("d.").replace("dir", "r.dir", 1)} = 1 group by all)"""


def _edges(table: str, keys: str) -> str:
    """Edges along each axis: the four voxels around, by self-joins."""
    out = []
    on = " and ".join(f"{{0}}.{k} = a.{k}" for k in keys.split(", "))
    for axis, (u, w) in {"x": "yz", "y": "xz", "z": "xy"}.items():
        at = lambda n, i, j, u=u, w=w, axis=axis: f"join {table} {n} on {on.format(n)} and {n}.{axis} = a.{axis} and {n}.{u} = a.{u} + {i} and {n}.{w} = a.{w} + {j}"
        out.append(f"select {', '.join('a.' + k for k in keys.split(', '))}, '{axis}' as axis, list_contains(q, 1) and list_contains(q, 2) and list_contains(q, 3) as hit from (select a.*, [a.phase, b.phase, c.phase, d.phase] as q from {table} a {at('b', 1, 0)} {at('c', 0, 1)} {at('d', 1, 1)}) a")
    return " union all ".join(out)


_RAYS = f"""rays as (select sample, r.* from samples, (
  select i as ray_id, 0.0::double as px, i % {N} + 0.5::double as py, i // {N} + 0.5::double as pz, 1.0::double as dx, 0.0::double as dy, 0.0::double as dz from (select unnest(range(0, {N * N})) as i)
  union all select i + {N * N}, 0.25::double + 0.4::double * i, 0.15::double, 0.35::double + 0.3::double * i, a / sqrt(a * a + b * b + c * c), b / sqrt(a * a + b * b + c * c), c / sqrt(a * a + b * b + c * c)
  from (select i, 0.2::double + 0.05::double * i as a, 1.0::double - 0.03::double * i as b, 0.1::double * i - 0.75::double as c from (select unnest(range(0, 16)) as i))) r),
plane as (select unnest(range(0, {N + 1})) as k),
box as (select sample, ray_id, px, py, pz, dx, dy, dz, max(low) as t0, min(high) as t1 from (
  select r.*, least((0 - px) / dx, ({N} - px) / dx) as low, greatest((0 - px) / dx, ({N} - px) / dx) as high from rays r where dx <> 0
  union all select r.*, least((0 - py) / dy, ({N} - py) / dy), greatest((0 - py) / dy, ({N} - py) / dy) from rays r where dy <> 0
  union all select r.*, least((0 - pz) / dz, ({N} - pz) / dz), greatest((0 - pz) / dz, ({N} - pz) / dz) from rays r where dz <> 0) group by all having max(low) < min(high)),
cuts as (select *, t0 as t from box union all select *, t1 from box union all select box.*, (k - px) / dx from box, plane where dx <> 0 and (k - px) / dx > t0 and (k - px) / dx < t1
  union all select box.*, (k - py) / dy from box, plane where dy <> 0 and (k - py) / dy > t0 and (k - py) / dy < t1
  union all select box.*, (k - pz) / dz from box, plane where dz <> 0 and (k - pz) / dz > t0 and (k - pz) / dz < t1),
spans as (select *, lead(t) over (partition by sample, ray_id order by t) as u from cuts),
seg as (select sample, ray_id, t, u - t as length, cast(floor(px + (t + u) / 2 * dx) + 1 as int) as x, cast(floor(py + (t + u) / 2 * dy) + 1 as int) as y, cast(floor(pz + (t + u) / 2 * dz) + 1 as int) as z from spans where u - t > 1e-10),
met as (select seg.*, phase, row_number() over (partition by sample, ray_id order by t) - row_number() over (partition by sample, ray_id, phase order by t) as island from seg join vox using (sample, x, y, z)),
runs as (select sample, ray_id, phase, min(t) as start, sum(length) as length from met group by sample, ray_id, phase, island)"""
_SYSTEM = f"""{_THROUGH}, sys as (select t.*, (select count(*) from through o, moves m where o.sample = t.sample and o.phase = t.phase and o.dir = t.dir and o.x = t.x + m.mx and o.y = t.y + m.my and o.z = t.z + m.mz)
  + {FACTOR} * (cast({_FACES.format("")} = 1 as int) + cast({_FACES.format("")} = {N} as int)) as diagonal, {FACTOR} * cast({_FACES.format("")} = 1 as int) as rhs,
  1 - ({_FACES.format("")} - 0.5::double) / {N} as x0, {_FACES.format("")} = {N} as outlet from through t)"""


def _sql(select: str, *ctes: str) -> str:
    return f"with recursive {', '.join([_VOX, *ctes])} {select}"


_R = lambda column, name=None: f"round({column}, {DIGITS}) as {name or column}"
ORACLES: dict[str, str] = {
    "vox_scan": _sql("select * from vox"),
    "vox_dims": _sql("select sample, max(x) as nx, max(y) as ny, max(z) as nz, count(*) as n from vox group by all"),
    "positive_phases": _sql("select distinct sample, phase from vox where phase > 0"),
    "phase_masks": _sql("select sample, phase, x, y, z from vox where phase in (1, 2, 3)"),
    "phase_mask_counts": _sql("select s.sample, p.phase, count(*) filter (s.phase = p.phase) as voxels, count(*) as total from vox s, phases p group by all"),
    "volume_fraction": _sql(f"select s.sample, p.phase, {_R('avg(cast(s.phase = p.phase as double))', 'value')} from vox s, phases p group by all"),
    "gaussian_smooth": _sql(f"select sample, phase, x, y, z, {_R('v')} from s3", _SMOOTH),
    "gradient_magnitude": _sql(f"select sample, phase, x, y, z, {_R('g')} from grad", _GRADIENT),
    "surface_area": _sql(f"select sample, phase, {_R('avg(g)', 'value')} from grad group by all", _GRADIENT),
    "tpb_edges_by_axis": _sql(f"select sample, axis, count(*) filter (hit) as edges from ({_edges('vox', 'sample')}) group by all"),
    "tpb_density": _sql(f"select sample, {_R(f'count(*) filter (hit) / ({N**3} * {SIZE**2})', 'value')} from ({_edges('vox', 'sample')}) group by all"),
    "boundary_reachable": _sql("select sample, phase, x, y, z from reach where dir = 1 and not far", _REACH),
    "percolation_mask": _sql("select * from through", _THROUGH),
    "percolation_fraction": _sql(f"select s.sample, p.phase, r.dir, {_R('coalesce((select count(*) from through t where t.sample = s.sample and t.phase = p.phase and t.dir = r.dir) / nullif((select count(*) from vox v where v.sample = s.sample and v.phase = p.phase), 0), 0)', 'value')} from samples s, phases p, dirs r", _THROUGH),
    "atpb_density": _sql(f"select sample, dir, {_R(f'count(*) filter (hit) / ({N**3} * {SIZE**2})', 'value')} from ({_edges('blocked', 'sample, dir')}) group by all", f"{_THROUGH}, blocked as (select v.sample, r.dir, v.x, v.y, v.z, case when v.phase in (1, 2) and t.x is null then 0 else v.phase end as phase from vox v cross join dirs r left join through t on t.sample = v.sample and t.phase = v.phase and t.dir = r.dir and t.x = v.x and t.y = v.y and t.z = v.z)"),
    "geodesic_distance": _sql("select * from dist", _WALK),
    "geometric_tortuosity": _sql(f"select sample, phase, dir, {_R('value')} from gt", _GT),
    "tortuosity_mean_skip_inf": _sql(f"select sample, phase, {_R(f'coalesce(avg({_R('value').split(' as ')[0]}) filter (isfinite(value)), ' + chr(39) + 'inf' + chr(39) + '::double)', 'value')} from gt group by all", _GT),
    "ray_segments": _sql(f"select sample, ray_id, {_R('t')}, {_R('length')}, x, y, z from seg", _RAYS),
    "chord_runs": _sql(f"select sample, ray_id, phase, {_R('start')}, {_R('length')} from runs", _RAYS),
    "mean_chord_length": _sql(f"select s.sample, p.phase, {_R(f'coalesce(avg(length) * {SIZE}, ' + chr(39) + 'nan' + chr(39) + '::double)', 'value')} from samples s cross join phases p left join runs r on r.sample = s.sample and r.phase = p.phase and r.length >= {MIN_CHORD} group by all", _RAYS),
    "diffusion_system": _sql(f"select sample, phase, dir, x, y, z, {_R('diagonal')}, {_R('rhs')}, {_R('x0')}, outlet from sys", _SYSTEM),
    "operator_apply": _sql(f"select s.sample, s.phase, s.dir, s.x, s.y, s.z, {_R('diagonal * x0 - coalesce((select sum(o.x0) from sys o, moves m where o.sample = s.sample and o.phase = s.phase and o.dir = s.dir and o.x = s.x + m.mx and o.y = s.y + m.my and o.z = s.z + m.mz), 0)', 'applied')} from sys s", _SYSTEM),
    "static_phase_verify": _sql("select s.sample, cast((select count(*) from vox a join vox b using (x, y, z) where a.sample = s.sample and b.sample = (select min(sample) from vox) and (a.phase = 2) <> (b.phase = 2)) as bigint) as changed from samples s"),
    "cell_numbers": _sql(f"select sample, x, y, z, cast(row_number() over (partition by sample order by z, y, x) as bigint) as number from vox"),
}
_PERC = """coalesce((select count(*) from through t where t.sample = s.sample and t.phase = p.phase and t.dir = r.dir)
  / nullif((select count(*) from vox v where v.sample = s.sample and v.phase = p.phase), 0), 0)"""
_BLOCKED = f"""{_THROUGH}, blocked as (
  select v.sample, r.dir, v.x, v.y, v.z, case when v.phase in (1, 2) and t.x is null then 0 else v.phase end as phase
  from vox v cross join dirs r
  left join through t on t.sample = v.sample and t.phase = v.phase and t.dir = r.dir and t.x = v.x and t.y = v.y and t.z = v.z)"""
_APPLIED = f"""{_SYSTEM}, applied as (
  select s.*, diagonal * x0 - coalesce((
    select sum(o.x0) from sys o, moves m
    where o.sample = s.sample and o.phase = s.phase and o.dir = s.dir and o.x = s.x + m.mx and o.y = s.y + m.my and o.z = s.z + m.mz), 0) as ax
  from sys s)"""
_FEATURES = f"""{_GT}, {_GRADIENT}, {_BLOCKED.split(", blocked as (", 1)[1].join([", blocked as (", ""])[2:]},
long as (
  select s.sample, 'vf' || p.phase as feature, avg(cast(s.phase = p.phase as double)) as value from vox s, phases p group by s.sample, p.phase
  union all select sample, 'sa' || phase, avg(g) from grad group by sample, phase
  union all select sample, 'gt' || phase, coalesce(avg(value) filter (isfinite(value)), 'inf'::double) from gt group by sample, phase
  union all select sample, 'perc' || phase, avg(value) from (select s.sample, p.phase, {_PERC} as value from samples s, phases p, dirs r) group by sample, phase
  union all select sample, 'tpb', count(*) filter (hit) / ({N**3} * {SIZE**2}) from ({_edges("vox", "sample")}) group by sample
  union all select sample, 'atpb', count(*) filter (hit) / ({N**3} * {SIZE**2} * 3) from ({_edges("blocked", "sample, dir")}) group by sample)"""
# a series: phase 2 of the first sample serves all, its features and its percolating voxels
_SERIES = _FEATURES.replace("t.sample = v.sample and t.phase = v.phase", "t.sample = case when v.phase = 2 then (select min(sample) from vox) else v.sample end and t.phase = v.phase")
_KEPT = [c for c in features.columns(CONFIG) if not c.startswith(("cld", "pt"))]
#: Steps of plain relaxation that bring the slowest of these systems to ten digits.
_STEPS = 20_000
_TAU = f"""{_SYSTEM}, numbered as materialized (
  select *, row_number() over (order by sample, phase, dir, z, y, x) as id from sys),
links as materialized (
  select a.id as i, b.id as j, a.rhs, a.diagonal from numbered a, moves m, numbered b
  where b.sample = a.sample and b.phase = a.phase and b.dir = a.dir and b.x = a.x + m.mx and b.y = a.y + m.my and b.z = a.z + m.mz),
relax as (
  select 0 as step, id, cast(x0 as double) as c from numbered
  union all
  select max(r.step) + 1, l.i, (max(l.rhs) + sum(r.c)) / max(l.diagonal) from relax r join links l on l.j = r.id group by l.i having max(r.step) < {_STEPS}),
flux as (
  select n.sample, n.phase, n.dir, {FACTOR} * sum(c) * {N} / {N * N} as deff
  from relax r join numbered n using (id) where r.step = {_STEPS} and n.outlet group by n.sample, n.phase, n.dir),
shares as (select s.sample, p.phase, avg(cast(s.phase = p.phase as double)) as share from vox s, phases p group by s.sample, p.phase)"""
ORACLES |= {
    "physical_tortuosity": _sql(
        f"select s.sample, s.phase, d.dir, round(case when deff > 0 then share / deff else 'inf'::double end, {DIGITS}) as value from shares s cross join dirs d left join flux f on f.sample = s.sample and f.phase = s.phase and f.dir = d.dir",
        _TAU,
    ),
    "percolation_mean": _sql(f"select sample, phase, round(avg(value), {DIGITS}) as value from (select s.sample, p.phase, {_PERC} as value from samples s, phases p, dirs r) group by sample, phase", _THROUGH),
    "atpb_mean": _sql(f"select sample, round(count(*) filter (hit) / ({N**3} * {SIZE**2} * 3), {DIGITS}) as value from ({_edges('blocked', 'sample, dir')}) group by sample", _BLOCKED),
    "initial_residual": _sql(
        f"select sample, phase, dir, round(sum(cast(rhs * rhs as double)), {DIGITS}) as bb, round(sum((rhs - ax) * (rhs - ax)), {DIGITS}) as rr, round(cast(coalesce(sum(x0) filter (outlet), 0) as double), {DIGITS}) as outlet from applied group by sample, phase, dir",
        _APPLIED,
    ),
    "static_phase_columns": _sql(
        "select sample, "
        + ", ".join(f"round(max(value) filter (feature = '{c}'), {DIGITS}) as {c}" for c in _KEPT)
        + """ from (
  select sample, feature, value from long where feature not in ('vf2', 'sa2', 'gt2', 'perc2')
  union all select s.sample, feature, value from samples s, long f where feature in ('vf2', 'sa2', 'gt2', 'perc2') and f.sample = (select min(sample) from vox)) group by sample""",
        _SERIES,
    ),
    "feature_columns": _sql("select sample, " + ", ".join(f"round(max(value) filter (feature = '{c}'), {DIGITS}) as {c}" for c in _KEPT) + " from long group by sample", _FEATURES),
}
