"""Vectors of a table as integer matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(table: DataFrame, *others: str) -> tuple[DataFrame, int]:
    """(vec_id, others, embedding) of the rows whose vector has finite entries only, and the vectors' length.

    Null vectors and vectors with null or non-finite entries are left out. So are vectors that aren't as long as that of
    the smallest vec_id that has one (empty ones too), since nothing could be computed of both. Other columns don't matter.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = table.select("vec_id", *others, "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    first = rows.agg(F.coalesce(F.min_by(F.size("embedding"), "vec_id"), F.min(F.size("embedding")))).first()[0]
    width = first or 0
    return rows.filter(F.size("embedding") == width), width


def floors(column: pa.Array, width: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) of all entries, a row for each vector; entries beyond `most` count as `most`."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(values * scale), -most, most).astype(np.int64).reshape(-1, width)
