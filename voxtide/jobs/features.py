"""One row of features per volume, and series that reuse a phase that does not change.

Volumes are packed into planes once; every feature works on those.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.config import FeatureConfig
from voxtide.functions.columns import mean_of_finite, union
from voxtide.functions.tables import stored
from voxtide.operators import chords, connectivity, counts, diffusion, surface
from voxtide.sources import planes as source
from voxtide.sources.planes import unpacked

#: Names of a phase's features, in the order of the columns.
PREFIXES = ("vf", "cld", "sa", "gt", "pt", "perc")
#: Columns of a static cache.
CACHE = "kind string, feature string, value double, phase int, x int, nx int, ny int, nz int, mask binary, faces binary"


def required_phases(config: FeatureConfig, phases, cached=()) -> list[int]:
    """Phases whose parts must be found: those asked for and the two that make active boundaries, less those whose parts a cache has."""
    return sorted({*phases, 1, 2} - {*cached})


def connected_planes(planes: DataFrame, phases, cache: DataFrame | None = None) -> DataFrame:
    """Stored connected planes; a cached phase's parts are taken from the cache's planes, not found again."""
    own = connectivity.connected(planes, phases)
    if cache is not None:
        own = _with_cached_faces(own, cache)
    return stored(own, "connected")


def _with_cached_faces(connected: DataFrame, cache: DataFrame) -> DataFrame:
    """Voxels of the cached phase get the faces that the cache has there."""
    known = cache.where("kind = 'plane'").select("x", "phase", F.col("faces").alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(len(batch)):
                faces, cached = (np.frombuffer(batch.column(c)[k].as_py(), np.uint8) for c in ("faces", "known"))
                of_phase = unpacked(batch.column("labels")[k].as_py(), len(faces)) == batch.column("phase")[k].as_py()
                out.append(np.where(of_phase, cached, faces).tobytes())
            kept = [batch.column(c) for c in ("sample", "x", "nx", "ny", "nz", "labels")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], names=["sample", "x", "nx", "ny", "nz", "labels", "faces"])

    return connected.join(known, "x").mapInArrow(run, connectivity.CONNECTED)


class Extraction(NamedTuple):
    """Features as rows sample, feature, value, and the solves behind the tortuosities: sample, phase, dir, value, iterations, residual."""

    features: DataFrame
    solves: DataFrame


def long_features(planes: DataFrame, config: FeatureConfig, phases=None, cache: DataFrame | None = None, connected: DataFrame | None = None) -> Extraction:
    """The features of the phases asked for (all configured ones unless given), and of the boundaries.

    cache: a static cache, whose phase's parts serve the boundaries;
    connected: the planes with these phases' parts, if they are at hand.
    """
    phases = config.phases if phases is None else tuple(phases)
    sizes = source.sizes(planes)
    wanted = stored(counts.plane_counts(planes, phases), "counts")
    if connected is None:
        connected = connected_planes(planes, required_phases(config, phases, () if cache is None else (config.static_phase,)), cache)
    own = stored(connectivity.mask_planes(connected, phases, config.directions), "percolating")
    rays = chords.random_rays(planes.sparkSession, sizes, config.rays, config.seed)
    runs = chords.chords(chords.segments(rays, sizes), planes)
    gt = connectivity.geometric_tortuosity(wanted, connectivity.geodesic_distance(own), config.directions)
    pt = diffusion.physical_tortuosity(wanted, own, config.directions, config.boundary_factor, config.rtol, config.max_iterations, config.diffusivity, config.voxel_size)
    named = lambda df, prefix: df.select("sample", F.concat(F.lit(prefix), "phase").alias("feature"), "value")
    over = lambda df, how: df.groupBy("sample", "phase").agg(how(F.col("value")).alias("value"))
    features = union([
        named(wanted.select("sample", "phase", (F.col("voxels") / F.col("total")).alias("value")), "vf"),
        named(chords.mean_chord_length(runs, wanted, config.min_chord, config.voxel_size), "cld"),
        named(surface.surface_area(planes, phases, config.voxel_size, config.surface_sigma), "sa"),
        named(over(gt, mean_of_finite), "gt"),
        named(over(pt, mean_of_finite), "pt"),
        named(over(connectivity.percolating_fraction(wanted, own, config.directions), F.avg), "perc"),
        counts.tpb_density(planes, config.voxel_size).select("sample", F.lit("tpb").alias("feature"), "value"),
        counts.active_tpb_density(connected, config.directions, config.voxel_size).groupBy("sample").agg(F.avg("value").alias("value")).select("sample", F.lit("atpb").alias("feature"), "value"),
    ])
    return Extraction(features, pt)


def columns(config: FeatureConfig) -> list[str]:
    return [f"{prefix}{p}" for prefix in PREFIXES for p in config.phases] + ["tpb", "atpb"]


def wide(long: DataFrame, config: FeatureConfig) -> DataFrame:
    return long.groupBy("sample").pivot("feature", columns(config)).agg(F.first("value"))


def extraction_of_planes(planes: DataFrame, config: FeatureConfig = FeatureConfig()) -> Extraction:
    """One feature row per sample, and the solves; ValueError for an axis of one voxel."""
    source.check_axes(planes)
    long, solves = long_features(planes, config)
    return Extraction(wide(long, config), solves)


def features_of_planes(planes: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One row per sample: vf, cld, sa, gt, pt, perc of each phase, tpb, atpb; ValueError for an axis of one voxel."""
    return extraction_of_planes(planes, config).features


def extract_features(voxels: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """features_of_planes of voxels; ValueError if a volume is not dense."""
    return features_of_planes(source.pack(voxels), config)


def changed_static(voxels: DataFrame, phase: int) -> DataFrame:
    """sample, changed: voxels in which a sample's mask of the phase differs from the first sample's, either way."""
    first = voxels.agg(F.min("sample").alias("first"))
    reference = voxels.where(F.col("phase") == phase).join(F.broadcast(first), F.col("sample") == F.col("first")).select("x", "y", "z", F.lit(1).alias("r"))
    own = voxels.where(F.col("phase") == phase).select("sample", "x", "y", "z")
    met = own.join(reference, ["x", "y", "z"], "left").groupBy("sample").agg(F.count("*").alias("own"), F.count("r").alias("same"))
    rows = voxels.select("sample").distinct().join(met, "sample", "left").join(F.broadcast(reference.groupBy().agg(F.count("*").alias("all"))))
    return rows.select("sample", (F.coalesce("own", F.lit(0)) + F.col("all") - 2 * F.coalesce("same", F.lit(0))).alias("changed"))


def static_cache(voxels: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """static_cache_of_planes of voxels."""
    return static_cache_of_planes(source.pack(voxels), config)


def static_cache_of_planes(planes: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """What later samples reuse of the first one's static phase, to be stored as a table (CACHE).

    Rows of kind ``feature`` are the phase's features, of kind ``plane`` its
    planes: mask, a bit a voxel, and faces, the faces of the volume that each
    voxel's part touches, from which its percolation along every direction
    follows.  The first plane's feature is the sample's name.
    """
    first = planes.agg(F.min("sample")).first()[0]
    own = planes.where(F.col("sample") == first)
    phase = config.static_phase
    connected = connected_planes(own, required_phases(config, [phase]))
    names = [f"{prefix}{phase}" for prefix in PREFIXES]
    values = long_features(own, config, [phase], connected=connected).features.where(F.col("feature").isin(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, faces = [], []
            for k in range(len(batch)):
                ny, nz, data, touched = (batch.column(c)[k].as_py() for c in ("ny", "nz", "labels", "faces"))
                mask = unpacked(data, ny * nz) == phase
                masks.append(np.packbits(mask).tobytes())
                faces.append(np.where(mask, np.frombuffer(touched, np.uint8), 0).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sample", "x", "nx", "ny", "nz")), pa.array(masks, pa.binary()), pa.array(faces, pa.binary())], names=["sample", "x", "nx", "ny", "nz", "mask", "faces"])

    of_plane = connected.mapInArrow(run, "sample string, x int, nx int, ny int, nz int, mask binary, faces binary")
    rows = of_plane.select(F.lit("plane").alias("kind"), F.col("sample").alias("feature"), F.lit(phase).alias("phase"), "x", "nx", "ny", "nz", "mask", "faces")
    told = values.select(F.lit("feature").alias("kind"), "feature", "value", F.lit(phase).alias("phase"))
    names = [f.split()[0] for f in CACHE.split(", ")]
    return rows.unionByName(told, allowMissingColumns=True).select(*names)


def changed_from(planes: DataFrame, cache: DataFrame) -> DataFrame:
    """sample, changed: voxels in which a sample's mask of the cache's phase differs from the cache's, either way; volumes of one size."""
    known = cache.where("kind = 'plane'").select("x", "phase", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for k in range(len(batch)):
                cells, data, phase, mask = (batch.column(c)[k].as_py() for c in ("cells", "labels", "phase", "mask"))
                n.append(int(((unpacked(data, cells) == phase) != np.unpackbits(np.frombuffer(mask, np.uint8), count=cells).astype(bool)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("sample"), pa.array(n, pa.int64())], names=["sample", "changed"])

    met = planes.select("sample", "x", (F.col("ny") * F.col("nz")).alias("cells"), "labels").join(known, "x")
    return met.mapInArrow(run, "sample string, changed long").groupBy("sample").agg(F.sum("changed").alias("changed"))


def extract_series(voxels: DataFrame, config: FeatureConfig = FeatureConfig(), cache: DataFrame | None = None) -> DataFrame:
    """series_of_planes of voxels; ValueError if a volume is not dense."""
    return series_of_planes(source.pack(voxels), config, cache)


def series_of_planes(planes: DataFrame, config: FeatureConfig = FeatureConfig(), cache: DataFrame | None = None) -> DataFrame:
    """The rows of series_extraction."""
    return series_extraction(planes, config, cache).features


def series_extraction(planes: DataFrame, config: FeatureConfig = FeatureConfig(), cache: DataFrame | None = None) -> Extraction:
    """As extraction_of_planes, but the static phase of one sample serves all when config says so: that of cache, a table of ``static_cache``, or else the first sample's.

    The static phase's features, solves and parts are not computed again.  Raises
    ValueError if volumes differ in size, if the cache is of another phase, or
    if a sample's static phase differs and config.verify_static is set.
    """
    if config.recalculate_static:
        return extraction_of_planes(planes, config)
    source.check_axes(planes)
    if cache is None:
        cache = stored(static_cache_of_planes(planes, config), "static")
    known = cache.where("kind = 'plane'")
    size = known.select("feature", "phase", "nx", "ny", "nz").first()
    if size is None or size["phase"] != config.static_phase:
        raise ValueError(f"the cache has no planes of phase {config.static_phase}")
    if not planes.where(F.struct("nx", "ny", "nz") != F.struct(*(F.lit(size[c]).alias(c) for c in source.SIZE))).isEmpty():
        raise ValueError("the volumes of a series with a static phase must have one size")
    if config.verify_static:
        bad = changed_from(planes, cache).where("changed > 0").orderBy("sample").first()
        if bad is not None:
            raise ValueError(f"phase {config.static_phase} of {bad['sample']} differs from that of {size['feature']} in {bad['changed']} voxels")
    others = [p for p in config.phases if p != config.static_phase]
    reference = cache.where("kind = 'feature'").select("feature", "value")
    copied = planes.select("sample").distinct().join(F.broadcast(reference)).select("sample", "feature", "value")  # six rows
    long, solves = long_features(planes, config, others, cache)
    return Extraction(wide(long.unionByName(copied), config), solves)
