"""Features of volumes as their files arrive: each micro-batch is a batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxtide.config import FeatureConfig
from voxtide.functions.tables import stored
from voxtide.jobs.features import extract_series, series_of_planes, static_cache_of_planes
from voxtide.sources import mat


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, config: FeatureConfig = FeatureConfig(), cache: DataFrame | None = None, schema: str = "sample string, x int, y int, z int, phase int"):
    """A query from Parquet voxel files in folder (a file holds whole volumes) to feature rows in out, one subfolder a batch, so that a batch done twice is written once; cache is a stored table of ``static_cache`` for series with a static phase."""
    arriving = spark.readStream.schema(schema).parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            extract_series(stored(batch, "arrived"), config, cache).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def watch_mat(spark: SparkSession, folder: str, out: str, checkpoint: str, config: FeatureConfig = FeatureConfig(), key: str = "C", available_now: bool = True) -> StreamingQuery:
    """A query from MAT files as they arrive in folder to feature rows in out, one subfolder a batch.

    With a static phase, the first sample of the first batch makes the cache,
    a table below checkpoint; later batches use it, also those of a query that
    is started again with the same checkpoint.  A batch that fails before its
    rows are written is done again and finds the cache whole or not at all.
    """
    mat.register(spark)
    cache_at = f"{checkpoint}/static-cache"
    arriving = spark.readStream.format("mat").option("rows", "strips").option("key", key).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        strips = stored(batch, "arrived")
        if strips.isEmpty():
            return
        planes, cache = mat.planes_of_strips(strips), None
        if not config.recalculate_static:
            if not _there(spark, cache_at):
                static_cache_of_planes(planes, config).write.mode("overwrite").parquet(cache_at)
            cache = spark.read.parquet(cache_at)
        series_of_planes(planes, config, cache).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = arriving.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream")
    return (query.trigger(availableNow=True) if available_now else query).start()
