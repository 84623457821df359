"""Exact ranks and running values without putting a whole group into one task.

A plain window over a hot key sorts that key in one task. Here the rows of a key are cut into buckets
whose order agrees with the wanted order; counts per bucket give offsets, and only a bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 65_536


def bucketed_rank(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str = "rank") -> DataFrame:
    """Add the 1-based rank of every row within its keys.

    ``bucket`` must not decrease along ``order``; at most a bounded number of rows should share one.
    """
    bucketed = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        bucketed.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
    )


def number_bucket(column: str, width: int = BUCKET_WIDTH) -> Column:
    """Bucket of a unique whole number such as an input row number: never more than ``width`` rows."""
    return F.floor(F.col(column) / F.lit(width))


def hex_bucket(column: str, rows: int) -> Column:
    """Bucket of a hexadecimal digest of ``rows`` rows: as many digits as keep a bucket near ``BUCKET_WIDTH`` rows."""
    digits = 1
    while rows > BUCKET_WIDTH * 16**digits and digits < 12:
        digits += 1
    return F.conv(F.substring(column, 1, digits), 16, 10).cast("long")


def side_by_side(frames: list[DataFrame]) -> DataFrame:
    """Single-row frames with distinct columns as one row, without a cross join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
