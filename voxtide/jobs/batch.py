"""From a folder of MAT files to a CSV of features."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from voxtide.config import FeatureConfig
from voxtide.jobs.features import series_extraction, series_of_planes
from voxtide.sources import csv_sink, mat


def trial_name(path: str, max_files: int | None) -> str:
    """out.csv, or out_first2.csv for the first two files."""
    stem, end = os.path.splitext(path)
    return f"{stem}_first{max_files}{end}" if max_files else path


def run_batch(spark: SparkSession, folder: str, out: str, config: FeatureConfig = FeatureConfig(), max_files: int | None = None, key: str = "C", solves: str | None = None) -> str:
    """All samples in one job; any failure leaves no CSV. solves: where to write every solve's tortuosity, iterations and residual, a second CSV."""
    planes = mat.read_planes(spark, mat.list_files(spark, folder, max_files), key)  # every file is parsed once
    found = series_extraction(planes, config)
    path = csv_sink.write_features(ordered(found.features), trial_name(out, max_files))
    if solves:
        csv_sink.write_features(found.solves, trial_name(solves, max_files), ("sample", "phase", "dir"))
    return path


def run_sample(spark: SparkSession, path: str, folder: str, config: FeatureConfig = FeatureConfig(), key: str = "C") -> str:
    """One file to <sample>_features.csv in folder."""
    features = series_of_planes(mat.read_planes(spark, [path], key), config)
    return csv_sink.write_features(ordered(features), os.path.join(folder, f"{mat.sample_name(path)}_features.csv"))


def ordered(features: DataFrame) -> DataFrame:
    return features.orderBy("sample")
