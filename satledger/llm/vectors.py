"""Arrow views of vector columns."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_length(rows: DataFrame, column: str) -> int:
    """The commonest length of the vectors (the longest of several); 0 without vectors."""
    size = F.size(column)
    found = (rows.where(size > 0).groupBy(size.alias("length")).agg(F.count(F.lit(1)).alias("n"))
             .agg(F.max(F.struct("n", "length")).alias("top")).first()["top"])
    return found["length"] if found else 0


def matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column hold ``length`` finite entries, and those rows as doubles."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    good = sizes == length
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    if not good.all():
        starts = np.cumsum(sizes) - sizes
        values = values[(starts[good][:, None] + np.arange(length)).ravel()]
    values = values.reshape(-1, length)
    finite = np.isfinite(values).all(axis=1)
    if not finite.all():
        good[np.flatnonzero(good)[~finite]] = False
        values = values[finite]
    return good, values
