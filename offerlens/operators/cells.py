"""Stored counters of a dataset's metrics, kept up from one dataset to the next by what changed.

Every counter of a cell is a sum over offers. The cells of a new dataset are therefore those of the one before, minus
the cells of the offers that left or changed as they were, plus the cells of the offers that came or changed as they
are: only these offers are spread over the dimensions again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import metrics as M
from offerlens.sources.tables import write_partitions

KEYS = ("dimensions", *M.DIMENSIONS)
#: What a cell may depend on; two members that agree here count alike.
COUNTED = (
    "junior_metric_version",
    "status",
    "claims_junior",
    "minimum_experience_months",
    "beginner_friendly",
    "contradictory_junior",
    "junior_observation_status",
    "junior_observation_contradictory",
    "salary_transparent",
    *(c for c in M.DIMENSIONS if c not in M.ARRAYS),
    *M.ARRAYS.values(),
)


def _digest(rows: DataFrame) -> Column:
    own = [F.array_sort(F.array_distinct(c)).alias(c) if c in M.ARRAYS.values() else F.col(c) for c in COUNTED if c in rows.columns]
    return F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)


def changed_members(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members as they were, members as they are) of the offers that came, left or count in another way.

    Both sides hold one row per offer, so the join on the offer has no heavy key.
    """
    old, new = before.withColumn("_digest", _digest(before)), after.withColumn("_digest", _digest(after))
    same = ["offer_id", "_digest"]
    gone = old.join(new.select(*same), same, "left_anti").drop("_digest")
    come = new.join(old.select(*same), same, "left_anti").drop("_digest")
    return gone, come


def _full(found: DataFrame) -> DataFrame:
    """All dimension columns, absent ones null."""
    return found.select(
        "dataset_id", "junior_metric_version", "dimensions",
        *[F.col(d) if d in found.columns else F.lit(None).cast("string").alias(d) for d in M.DIMENSIONS], *M.CELL_COUNTERS, "offers",
    )


def next_cells(stored: DataFrame, before: DataFrame, after: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """The cells of the dataset `after`, from the stored cells of the dataset `before` and the members that differ.

    `before` and `after` are the members of one dataset each; the sets must be those that were stored. Cells
    without offers vanish. With no stored cells of `before` the result is only right if `before` is empty, too.
    """
    gone, come = changed_members(before, after)
    base = _full(stored.filter(F.col("dataset_id") == before.agg(F.min("dataset_id")).scalar()))
    minus = _full(M.cells(gone, sets))
    minus = minus.select(*[(-F.col(c)).alias(c) if c in (*M.CELL_COUNTERS, "offers") else F.col(c) for c in minus.columns])
    moved = base.unionByName(minus).unionByName(_full(M.cells(come, sets)))
    summed = moved.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in (*M.CELL_COUNTERS, "offers")]).filter("offers > 0")
    named = after.agg(F.min("dataset_id").alias("dataset_id"), F.min("junior_metric_version").alias("junior_metric_version"))
    return _full(summed.withColumns({c: named.select(c).scalar() for c in named.columns}))


def store_cells(found: DataFrame, path: str) -> None:
    """Write the cells of a dataset under its id; writing them again replaces them."""
    write_partitions(_full(found), path, "dataset_id")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).withColumn("dataset_id", F.col("dataset_id").cast("string"))


def rates(found: DataFrame) -> DataFrame:
    """The rates of stored cells, with the names of their dimensions."""
    return M.rates_of_cells(_full(found), ["dimensions", *M.DIMENSIONS])
