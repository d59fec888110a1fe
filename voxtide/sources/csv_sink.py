"""Feature rows to one CSV file, replaced whole or not at all."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame


def csv_value(value) -> str:
    """Nothing for null, NaN, Inf for either infinity, else the shortest form that reads back."""
    if value is None:
        return ""
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else "Inf" if math.isinf(value) else repr(value)
    return str(value)


def write_features(features: DataFrame, path: str, order: tuple[str, ...] = ("sample",)) -> str:
    """Rows in order of sample, unless another is given; a feature table has one row a volume, streamed to the driver a partition at a time."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder, suffix=".part")
    rows = 0
    try:
        with os.fdopen(handle, "w") as out:
            out.write(",".join(features.columns) + "\n")
            for row in features.orderBy(*order).toLocalIterator():
                out.write(",".join(map(csv_value, row)) + "\n")
                rows += 1
        if not rows:
            raise ValueError("there are no feature rows to write")
        os.replace(part, path)
    except BaseException:
        os.path.exists(part) and os.remove(part)
        raise
    return path
