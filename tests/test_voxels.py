"""Voxel operators on shapes with known answers."""

import math
import os
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voxtide.config import FeatureConfig
from voxtide.functions.columns import along, mean_of_finite
from voxtide.jobs import batch, features
from voxtide.operators import chords, connectivity, counts, diffusion, surface
from voxtide.sources import csv_sink, mat, planes
from voxtide.sources import voxels as source
from voxtide.streaming import arrivals

CONFIG = FeatureConfig(voxel_size=1.0, rays=60, min_chord=0.0, use_all_directions=False, direction=1, rtol=1e-10)


def volume(shape, value=0, **parts):
    labels = np.full(shape, value, np.int8)
    for at in parts.get("cells", ()):
        labels[tuple(i - 1 for i in at)] = 1
    return labels


def channel():
    labels = volume((7, 5, 5))
    labels[:, 2, 2] = 1
    return labels


DETOUR = volume((5, 5, 1), cells=[(1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 2, 1), (3, 3, 1), (4, 3, 1), (5, 3, 1)])
DIAGONAL = volume((5, 5, 1), cells=[(i, i, 1) for i in range(1, 6)])
TWO_WAYS = volume((7, 5, 1), cells=[*((i, 1, 1) for i in range(1, 8)), (1, 3, 1), (2, 3, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 4, 1), (6, 4, 1), (6, 3, 1), (7, 3, 1)])


def blocked():
    labels = channel()
    labels[3, 2, 2] = 0
    return labels


def island():
    labels = channel()
    labels[1:3, 4, 2] = 1
    return labels


def frames(spark, **volumes):
    out = None
    for name, labels in volumes.items():
        df = source.from_array(spark, name, labels)
        out = df if out is None else out.unionByName(df)
    return out


@pytest.fixture(scope="module")
def shapes(spark):
    vox = frames(spark, channel=channel(), island=island(), blocked=blocked(), diagonal=DIAGONAL, detour=DETOUR, two=TWO_WAYS, empty=volume((7, 5, 5))).cache()
    of_planes = planes.pack(vox)
    return vox, of_planes, counts.phase_counts(vox, [1]), connectivity.percolating(of_planes, [1], [1, 2])


def values(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["value"] for r in df.collect()}


def test_percolation(shapes):
    vox, _, by_phase, through = shapes
    got = values(connectivity.percolating_fraction(by_phase, through, [1, 2]), "sample", "dir")
    assert got["channel", 1] == 1.0 and got["channel", 2] == 0.0 and got["island", 1] == pytest.approx(7 / 9)
    assert got["diagonal", 1] == got["blocked", 1] == got["empty", 1] == 0.0
    assert connectivity.mask_voxels(through).where("sample = 'island' and dir = 1").count() == 7
    with pytest.raises(ValueError):
        along(4)


def rows_of(df):
    rounded = [F.round(c, 10).alias(c) if kind == "double" else F.col(c) for c, kind in sorted(df.dtypes)]
    return sorted(map(tuple, df.select(*rounded).collect()), key=str)


def test_slabs_agree_with_one_piece(spark):
    """Labels, distances, surfaces and boundary edges are the same for any number of slabs, in tasks of their own or along lines."""
    labels = np.random.default_rng(1).choice([1, 2, 3], (9, 8, 12), p=[0.5, 0.3, 0.2]).astype(np.int8)
    vox = planes.pack(frames(spark, a=labels, b=labels[::-1, :, ::-1]))
    one = connectivity.stored(connectivity.connected(vox, [1, 2, 3]), "one")
    for of in (
        lambda **k: connectivity.connected(vox, [1, 2, 3], **k), lambda **k: connectivity.reachable(vox, [1, 2], 3, True, **k), lambda **k: surface.surface_area(vox, [1, 2], 0.5, **k),
        lambda **k: surface.gradient(vox, [1], 0.5, **k), lambda **k: counts.tpb_edges(vox, **k), lambda **k: counts.active_tpb_density(one, [1, 3], **k),
    ):
        assert rows_of(of(slab_voxels=200)) == rows_of(of())
    masks = connectivity.percolating(vox, [1, 2], [1, 2, 3])
    alone = rows_of(connectivity.mask_voxels(connectivity.geodesic_distance(masks), "steps"))
    for slabs in (2, 20):
        assert rows_of(connectivity.mask_voxels(connectivity.geodesic_distance(masks, 0, slabs), "steps")) == alone


def serpentine(n):
    """A channel that goes back and forth across x between walls, so the way crosses every slab many times."""
    labels = np.ones((n, n, 2), np.int8)
    for k, y in enumerate(range(1, n, 2)):
        labels[slice(None, -1) if k % 2 == 0 else slice(1, None), y] = 0
    return labels


def test_lines_of_tasks_follow_long_ways(spark):
    n = 13
    vox = planes.pack(frames(spark, s=serpentine(n)))
    masks = connectivity.percolating(vox, [1], [2])
    alone = rows_of(connectivity.mask_voxels(connectivity.geodesic_distance(masks), "steps"))
    assert max(r[0] for r in alone) > 80
    for slabs in (1, 7):
        assert rows_of(connectivity.mask_voxels(connectivity.geodesic_distance(masks, 0, slabs), "steps")) == alone


@pytest.mark.parametrize("slabs", [1, 2, 4])
def test_solves_in_lines(spark, slabs):
    """Equal tortuosity for any number of slabs, along each axis, also where a job ends and the next goes on from stored iterates; empty slabs."""
    walls = staggered(12)
    thin = volume((12, 4, 4))
    thin[3:6, 1:3] = 1
    thin[:, 2, 1] = 1
    vox = planes.pack(frames(spark, walls=walls, thin=thin, cross=thin.transpose(1, 0, 2)))
    by_phase = counts.plane_counts(vox, [1])
    masks = connectivity.percolating(vox, [1], [1, 2, 3])
    alone = {(r["sample"], r["dir"]): r for r in diffusion.physical_tortuosity(by_phase, masks, [1, 2, 3], rtol=1e-12).collect()}
    for steps in (25, 2000):
        got = diffusion.physical_tortuosity(by_phase, masks, [1, 2, 3], rtol=1e-12, task_cells=0, slabs=slabs, steps=steps).collect()
        for r in got:
            assert r.value == pytest.approx(alone[r["sample"], r["dir"]].value, rel=1e-10)
            assert abs(r.iterations - alone[r["sample"], r["dir"]].iterations) <= 1
    assert sum(math.isfinite(r.value) for r in got) == 7  # walls along all three, thin and cross along two each


def staggered(n):
    labels = np.ones((n, n, n), np.int8)
    for k, x in enumerate((n // 4, n // 2, 3 * n // 4)):
        half = slice(n // 2, None) if k % 2 == 0 else slice(None, n // 2)
        labels[x, half, :] = 0
    return labels


def test_physical_tortuosity(spark, shapes):
    _, _, by_phase, through = shapes
    got = values(diffusion.physical_tortuosity(by_phase, through, [1], rtol=1e-12), "sample")
    assert got["channel"] == pytest.approx(1, abs=1e-10) and got["detour"] == pytest.approx(1.96, abs=1e-9)
    assert got["blocked"] == got["empty"] == got["diagonal"] == math.inf
    scaled = values(diffusion.physical_tortuosity(by_phase, through, [1], rtol=1e-12, diffusivity=3.5, voxel_size=0.25), "sample")
    assert scaled == pytest.approx(got, abs=1e-9)
    full = frames(spark, full=volume((8, 9, 10), 1), walls=staggered(20))
    through = connectivity.percolating(planes.pack(full), [1], [1, 2, 3])
    got = values(diffusion.physical_tortuosity(counts.phase_counts(full, [1]), through, [1, 2, 3], rtol=1e-12), "sample", "dir")
    assert [got["full", d] for d in (1, 2, 3)] == pytest.approx([1, 1, 1], abs=1e-10)
    assert got["walls", 1] == pytest.approx(3.457139067908, abs=1e-8)
    for bad in ({"rtol": 0}, {"max_iterations": 0}, {"diffusivity": 0}, {"voxel_size": 0}, {"boundary_factor": 0}):
        with pytest.raises(ValueError):
            diffusion.physical_tortuosity(by_phase, through, [1], **bad)
    with pytest.raises(diffusion.NotConverged):
        diffusion.solve(staggered(8) == 1, 0, 2.0, 1e-12, 2)


def test_system_rows_solve_to_the_same(spark):
    vox = frames(spark, walls=staggered(8))
    sizes = source.dims(vox).drop("n")
    masks = connectivity.percolating(planes.pack(vox), [1], [1])
    through = connectivity.mask_voxels(masks)
    rows = diffusion.system(through, sizes).orderBy("z", "y", "x").collect()
    number = {(r.x, r.y, r.z): i for i, r in enumerate(rows)}
    a, b = np.diag([r.diagonal for r in rows]).astype(float), np.array([r.rhs for r in rows])
    for r in diffusion.edges(through).collect():
        a[number[r.x, r.y, r.z], number[r.ox, r.oy, r.oz]] = -1
    c = np.linalg.solve(a, b)
    flux = 2.0 * sum(v for v, r in zip(c, rows, strict=True) if r.outlet)
    tau = len(rows) / 512 / (flux * 8 / 64)
    got = diffusion.physical_tortuosity(counts.phase_counts(vox, [1]), masks, [1], rtol=1e-12).first()
    assert got.value == pytest.approx(tau, rel=1e-9) and got.iterations > 0
    x = diffusion.apply_operator(diffusion.system(through, sizes), through, "x0").orderBy("z", "y", "x").collect()
    assert [r.applied for r in x] == pytest.approx((a @ [r.x0 for r in rows]).tolist())


def test_chords(spark):
    labels = volume((30, 10, 10), 1)
    labels[10:15] = 2
    vox = frames(spark, slabs=labels)
    sizes = source.dims(vox).drop("n")
    ray = [("slabs", j * 10 + k, 0.0, j + 0.5, k + 0.5, 1.0, 0.0, 0.0) for j in range(10) for k in range(10)]
    runs = chords.chords(chords.segments(spark.createDataFrame(ray, "sample string, " + chords.RAY), sizes), planes.pack(vox))
    wanted = counts.phase_counts(vox, [1, 2])
    assert values(chords.mean_chord_length(runs, wanted, 0, 1.0), "phase") == pytest.approx({1: 12.5, 2: 5.0}, abs=1e-8)
    long = values(chords.mean_chord_length(runs, wanted, 11, 1.0), "phase")
    assert long[1] == pytest.approx(15.0) and math.isnan(long[2])
    random = chords.random_rays(spark, sizes, 500, 1)
    again = chords.random_rays(spark, sizes, 500, 1)
    assert sorted(map(tuple, random.collect())) == sorted(map(tuple, again.collect()))
    total = chords.segments(random, sizes).groupBy("ray_id").agg(F.sum("length").alias("l")).agg(F.avg("l")).first()[0]
    assert 5 < total < 20
    miss = spark.createDataFrame([("slabs", 1, 0.0, 11.0, 1.0, 1.0, 0.0, 0.0)], "sample string, " + chords.RAY)
    assert chords.segments(miss, sizes).count() == 0


def test_surface(spark):
    cube = volume((20, 20, 20))
    cube[5:15, 5:15, 5:15] = 1
    many = volume((20, 20, 20))
    g = np.indices((20, 20, 20))
    many[((g + 1 - 9.5) ** 2).sum(0) <= 49] = 1
    got = values(surface.surface_area(planes.pack(frames(spark, cube=cube, ball=many)), [1], 1.0, 1.0), "sample")
    assert got["cube"] == pytest.approx(0.06321800, abs=1e-7)
    assert got["cube"] == pytest.approx(0.06547, rel=0.1)
    assert sum(surface.kernel(1.3)) == pytest.approx(1) and len(surface.kernel(1.3)) == 9


def test_tpb(spark):
    z = volume((2, 2, 1), 3)
    z[0, 0], z[1, 0] = 1, 2
    y = volume((2, 1, 2), 3)
    y[0, :, 0], y[1, :, 0] = 1, 2
    x = volume((1, 2, 2), 3)
    x[:, 0, 0], x[:, 1, 0] = 1, 2
    active = volume((4, 2, 2), 3)
    active[:, 0, 0], active[:, 1, 0] = 1, 2
    vox = planes.pack(frames(spark, none=volume((3, 3, 3), 1), z=z, y=y, x=x, z3=np.repeat(z, 3, 2), active=active))
    got = {r["sample"]: r["n"] for r in counts.tpb_edges(vox).groupBy("sample").agg(F.sum("edges").alias("n")).collect()}
    assert got == {"none": 0, "z": 1, "y": 1, "x": 1, "z3": 3, "active": 4}
    assert values(counts.tpb_density(vox, 0.5), "sample")["z"] == pytest.approx(0.5 / (4 * 0.125))
    act = values(counts.active_tpb_density(connectivity.connected(vox, [1, 2]), [1, 2], 1.0), "sample", "dir")
    assert act["active", 1] == pytest.approx(4 / 16) and act["active", 2] == 0 and act["z", 1] == 0
    with pytest.raises(ValueError):
        counts.tpb_density(vox, 0)


def series():
    first = volume((12, 8, 6), 1)
    first[4:8], first[8:] = 2, 3
    second = first.copy()
    second[:2], second[10:] = 3, 1
    return first, second


def test_static_phase_reuse(spark):
    first, second = series()
    vox = frames(spark, a=first, b=second)
    full = {r["sample"]: r for r in features.extract_series(vox, CONFIG).collect()}
    static = FeatureConfig(**{**CONFIG.__dict__, "recalculate_static": False})
    reused = {r["sample"]: r for r in features.extract_series(vox, static).collect()}
    for name in "ab":
        assert list(reused[name])[1:] == pytest.approx(list(full[name])[1:], rel=1e-10, nan_ok=True)
    bad = second.copy()
    bad[0, 0, 0] = 2
    with pytest.raises(ValueError, match="phase 2 of b"):
        features.extract_series(frames(spark, a=first, b=bad), static)
    with pytest.raises(ValueError, match="one size"):
        features.extract_series(frames(spark, a=first, b=second[:10]), static)
    absent = features.extract_series(frames(spark, a=volume((4, 4, 4), 1)), CONFIG).first()
    assert (absent.vf3, absent.sa3, absent.gt3, absent.pt3, absent.perc3) == (0, 0, math.inf, math.inf, 0) and math.isnan(absent.cld3)
    with pytest.raises(ValueError, match="dense"):
        features.extract_series(frames(spark, a=volume((4, 4, 1), 1)), CONFIG)


def test_mean_of_finite(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.inf), ("a", math.nan), ("b", math.inf)], "k string, v double")
    assert {r.k: r.m for r in df.groupBy("k").agg(mean_of_finite(F.col("v")).alias("m")).collect()} == {"a": 1.0, "b": math.inf}


def test_static_cache_serves_later_samples(spark):
    first = np.ones((6, 4, 4), np.int8)
    first[2:4], first[4:] = 2, 3
    later = first.copy()
    later[0, 0, 0] = 3
    static = FeatureConfig(**{**CONFIG.__dict__, "recalculate_static": False})
    cache = features.stored(features.static_cache(frames(spark, a=first), static), "cache")
    alone = features.extract_series(frames(spark, b=later), static, cache).collect()
    together = [r for r in features.extract_series(frames(spark, a=first, b=later), static).collect() if r["sample"] == "b"]
    assert len(alone) == 1 and repr(alone) == repr(together)
    changed = later.copy()
    changed[1, 1, 1] = 2
    with pytest.raises(ValueError, match="phase 2 of c differs from that of a in 1 voxels"):
        features.extract_series(frames(spark, c=changed), static, cache)
    with pytest.raises(ValueError, match="one size"):
        features.extract_series(frames(spark, c=later[:5]), static, cache)


def test_dense_check_sees_every_fault(spark):
    good = frames(spark, a=np.ones((2, 2, 2), np.int8))
    planes.check_axes(planes.pack(good))
    swapped = good.where("not (x = 1 and y = 1 and z = 1)").unionAll(good.where("x = 2 and y = 2 and z = 2"))
    for bad in (swapped, good.withColumn("x", F.col("x") - 1), good.where("x = 1"), good.unionAll(good)):
        with pytest.raises(ValueError, match="not dense"):
            planes.check_axes(planes.pack(bad))


@pytest.mark.parametrize("bad", [{"voxel_size": 0}, {"rays": 0}, {"min_chord": -1}, {"phases": ()}, {"phases": (1, 1)}, {"phases": (0,)}, {"direction": 4}, {"boundary_factor": 0}, {"rtol": 0}, {"max_iterations": 0}, {"recalculate_static": False, "static_phase": 9}])
def test_config(bad):
    with pytest.raises(ValueError):
        FeatureConfig(**bad)
    assert FeatureConfig(phases=(3, 1)).phases == (1, 3)


def test_batch(spark, tmp_path):
    first, second = series()
    for name, labels in (("t2.mat", first), ("t10.MAT", second.astype(np.float64)), ("note.txt", None)):
        pathlib.Path(tmp_path, name).write_bytes(b"x" if labels is None else mat.write_array(labels))
    out = batch.run_batch(spark, str(tmp_path), str(tmp_path / "out.csv"), CONFIG, solves=str(tmp_path / "solves.csv"))
    solves = [x.split(",") for x in pathlib.Path(tmp_path, "solves.csv").read_text().splitlines()]
    assert solves[0] == ["sample", "phase", "dir", "value", "iterations", "residual"] and [x[:3] for x in solves[1:]] == [[s, str(p), "1"] for s in ("t10", "t2") for p in (1, 2, 3)]
    lines = pathlib.Path(out).read_text().splitlines()
    assert lines[0] == ",".join(["sample", *features.columns(CONFIG)]) and [x.split(",")[0] for x in lines[1:]] == ["t10", "t2"]
    one = batch.run_batch(spark, str(tmp_path), str(tmp_path / "out.csv"), CONFIG, max_files=1)
    assert one.endswith("out_first1.csv") and len(pathlib.Path(one).read_text().splitlines()) == 2
    assert batch.run_sample(spark, str(tmp_path / "t2.mat"), str(tmp_path), CONFIG).endswith("t2_features.csv")
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.mat").write_bytes(mat.write_array(np.full((3, 3, 3), 0.5)))
    with pytest.raises(Exception, match="must hold integers"):
        batch.run_batch(spark, str(bad), str(bad / "out.csv"), CONFIG)
    assert os.listdir(bad) == ["a.mat"]
    with pytest.raises(ValueError):
        mat.list_files(spark, str(tmp_path / "bad"), 0)
    for data, message in ((mat.write_array(np.zeros((2, 2), np.int16)), "three dimensions"), (mat.write_array(first, "D", False), "no array C"), (b"\x89HDF\r\n\x1a\n", "7.3")):
        with pytest.raises(ValueError, match=message):
            mat.read_array(data)
    assert [csv_sink.csv_value(v) for v in (None, "a", math.nan, -math.inf, 1e-7, 3)] == ["", "a", "NaN", "Inf", "1e-07", "3"]


def test_stream(spark, tmp_path):
    first, _ = series()
    source.from_array(spark, "a", first).write.parquet(str(tmp_path / "in"))
    query = arrivals.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), CONFIG)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_mat_source(spark, tmp_path, monkeypatch):
    """Blocks and partitions of layers give the array, compressed or not, of every type; long labels stay long."""
    monkeypatch.setattr(mat, "BLOCK", 200)
    monkeypatch.setattr(mat, "PARTITION", 300)
    rng = np.random.default_rng(2)
    arrays = {f"{kind}{int(zipped)}": rng.integers(-3, 100, (5, 6, 7)).astype(kind) for kind in ("int8", "int16", "int32", "int64", "float64") for zipped in (True, False)}
    arrays["int641"][0, 0, 0] = 2**40
    for name, labels in arrays.items():
        data = mat.write_array(labels, compress=name.endswith("1"))
        (tmp_path / f"{name}.mat").write_bytes(data)
        assert (mat.read_array(data) == labels).all()
    assert len(mat.MatReader({"path": str(tmp_path / "int320.mat")}).partitions()) > 1
    mat.register(spark)
    rows = spark.read.format("mat").load(str(tmp_path)).collect()
    assert len(rows) == len(arrays) * 210 and all(arrays[r["sample"]][r.x - 1, r.y - 1, r.z - 1] == r.phase for r in rows)
    got = mat.read_planes(spark, [f"file:{tmp_path}/{name}.mat" for name in arrays]).collect()
    assert len(got) == len(arrays) * 5
    for r in got:
        assert (planes.unpacked(r.labels, r.ny * r.nz).reshape(r.ny, r.nz) == arrays[r["sample"]][r.x - 1]).all()
    (tmp_path / "short.mat").write_bytes(mat.write_array(arrays["int80"], compress=False)[:-50])
    with pytest.raises(Exception, match="short.mat: C ends early"):
        spark.read.format("mat").load(str(tmp_path / "short.mat")).collect()


def test_files_arrive_with_a_restart_between(spark, tmp_path):
    """The first file makes the cache; a query started again goes on after it and uses the cache."""
    first, second = series()
    third = second.copy()
    third[2:4] = 3
    static = FeatureConfig(**{**CONFIG.__dict__, "recalculate_static": False})
    folder, out, state = (tmp_path / n for n in ("in", "out", "state"))
    folder.mkdir()
    rows = {}
    for k, (name, labels) in enumerate((("t1", first), ("t2", second), ("t3", third))):
        (folder / f"{name}.mat").write_bytes(mat.write_array(labels))
        arrivals.watch_mat(spark, str(folder), str(out), str(state), static).awaitTermination()
        got = spark.read.parquet(str(out)).collect()
        assert sorted(r["sample"] for r in got) == [f"t{j + 1}" for j in range(k + 1)]
        rows |= {r["sample"]: list(r)[1:-1] for r in got}
        cached = {f: (state / "static-cache" / f).stat().st_mtime_ns for f in os.listdir(state / "static-cache")}
        assert k == 0 or cached == before  # made once
        before = cached
    whole = {r["sample"]: list(r)[1:] for r in features.extract_series(frames(spark, t1=first, t2=second, t3=third), static).collect()}
    for name, values_ in whole.items():
        assert rows[name] == pytest.approx(values_, nan_ok=True)
    bad = first.copy()
    bad[0, 0, 0] = 2
    (folder / "t4.mat").write_bytes(mat.write_array(bad))
    with pytest.raises(Exception, match="phase 2 of t4 differs"):
        arrivals.watch_mat(spark, str(folder), str(out), str(state), static).awaitTermination()


def test_golden_values(spark):
    year = (F.year("l_shipdate") - 1995).cast("string")
    vox = source.from_lineitem(spark, "/root/testdata/sf0.01", year).cache()
    of_planes = planes.pack(vox)
    assert {r["sample"]: r["n"] for r in counts.tpb_edges(of_planes).groupBy("sample").agg(F.sum("edges").alias("n")).collect()} == {"0": 488, "1": 439, "2": 405, "3": 432, "4": 441, "5": 411, "6": 471}
    through = connectivity.percolating(of_planes, [1, 2, 3], [1])
    assert {(r["sample"], r.phase): r["n"] for r in through.groupBy("sample", "phase").agg(F.sum("cells").alias("n")).collect()} == {("0", 1): 109, ("1", 1): 126, ("2", 1): 172, ("3", 1): 114, ("3", 2): 69, ("4", 1): 56, ("5", 1): 166, ("6", 1): 167}
    by_phase = counts.phase_counts(vox, [1, 2, 3])
    gt = values(connectivity.geometric_tortuosity(by_phase, connectivity.geodesic_distance(through), [1]), "sample", "phase")
    assert gt["0", 1] == pytest.approx(1.642857, abs=1e-6) and gt["3", 2] == pytest.approx(1.904762, abs=1e-6) and gt["4", 3] == math.inf
    pt = values(diffusion.physical_tortuosity(by_phase, through, [1], rtol=1e-12), "sample", "phase")
    assert pt["0", 1] == pytest.approx(10.972020323, abs=1e-8) and pt["3", 2] == pytest.approx(12.767340294, abs=1e-8)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
