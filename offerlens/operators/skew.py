"""Windows that survive a hot key.

A plain window sends a whole key to one task. These forms split a key by a sub-bucket (a stretch of
time, a slice of hash values), work inside the buckets, and carry a small summary per bucket across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _null_safe_join(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Join one row per key to all rows, those with a null key too."""
    renamed = side.select(*[F.col(k).alias(f"_side_{i}") for i, k in enumerate(keys)], *[c for c in side.columns if c not in keys])
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition = condition & rows[key].eqNullSafe(renamed[f"_side_{i}"])
    return rows.join(renamed, condition)


def bucketed_neighbour(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], columns: list[str], following: bool = False
) -> DataFrame:
    """Add `previous_<column>` (or `next_<column>`): the values of the neighbouring row over `keys` in `order`.

    `bucket` must be a non-decreasing function of `order`. Inside a bucket `lag` does the work; the
    first row of a bucket takes the last row of the bucket before, found among one summary row per bucket.
    """
    step, edge, name = (F.lead, F.min_by, "next") if following else (F.lag, F.max_by, "previous")
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    value = F.struct(*columns)
    rows = rows.withColumn("_near", step(value).over(inside))
    edges = rows.groupBy(*keys, "_bucket").agg(edge(value, F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = edges.select(*keys, "_bucket", step("_edge").over(across).alias("_carried"))
    joined = _null_safe_join(rows, carried, [*keys, "_bucket"])
    near = F.coalesce("_near", "_carried")
    return joined.select(*df.columns, *[near[c].alias(f"{name}_{c}") for c in columns])


def bucketed_rank(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Add the exact row number over `keys` in `order`, and `group_size`.

    `bucket` must be a non-decreasing function of the first order column, such as a prefix of a hash.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("group_size"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = _null_safe_join(rows.withColumn("_inside", F.row_number().over(inside)), sizes, [*keys, "_bucket"])
    return ranked.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name), "group_size")


def hash_slice(digest: Column, characters: int = 3) -> Column:
    """Leading hex digits: 16**characters slices of equal expected size, in hash order."""
    return F.substring(digest, 1, characters)


def first_by(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """One row per key, the first in `order`, as an aggregate with map-side combine instead of a window."""
    pick = F.max_by if descending else F.min_by
    row = pick(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")
