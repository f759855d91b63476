"""Reclassification of all snapshots by a new version of the rules, in ranges that are done one after the other.

Snapshots are dealt to a fixed number of ranges by a hash of their id. A range is done when its folder is complete; the
folders are the progress table. A job that is aborted goes on with the ranges that are not done, so nothing is
classified twice and nothing is left out, and its result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators import classify as C
from offerlens.sources import tables as T

RANGES = 64


def range_of(key: str = "snapshot_id", ranges: int = RANGES) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")


def done_ranges(spark: SparkSession, path: str) -> list[int]:
    return T.numbered_folders(spark, path)


def backfill(snapshots: DataFrame, classifications: DataFrame, path: str, version: str = C.CLASSIFIER_VERSION, ranges: int = RANGES, at_once: int = 8, most: int | None = None) -> list[int]:
    """Classify the snapshots that lack this version, range by range, into folders below `path`; the ranges done now.

    `at_once` ranges share one pass over the snapshots. `most` ends the call after so many ranges, as a job with a time
    limit does; the next call goes on. Snapshots that are already stored with this version are not classified, and
    a range that is done is not looked at again, so `path` belongs to one version and one set of snapshots.
    """
    spark, done = snapshots.sparkSession, []
    open_ranges = sorted(set(range(ranges)) - set(done_ranges(spark, path)))[:most]
    for start in range(0, len(open_ranges), at_once):
        wave = open_ranges[start : start + at_once]
        rows = snapshots.withColumn("_range", range_of(ranges=ranges)).filter(F.col("_range").isin(wave))
        results, staged = C.reclassify_backfill(rows, classifications, version), T.scratch_path(spark, "backfill")
        results.write.partitionBy("_range").parquet(staged)
        found = spark.read.schema(results.schema).parquet(staged)
        for number in wave:  # a folder each, complete or absent; of the staged rows only its own are read
            found.filter(F.col("_range") == number).drop("_range").write.mode("overwrite").parquet(f"{path}/{number}")
            done.append(number)
    return done


def backfilled(spark: SparkSession, path: str) -> DataFrame:
    """The results of all ranges that are done."""
    return spark.read.parquet(*[f"{path}/{n}" for n in done_ranges(spark, path)])


def coverage(snapshots: DataFrame, classifications: DataFrame, results: DataFrame, version: str = C.CLASSIFIER_VERSION) -> DataFrame:
    """`snapshots, classified, missing, repeated` of a version: nothing may be missing or repeated."""
    stored = classifications.filter(F.col("classifier_version") == version).select("snapshot_id")
    each = stored.unionByName(results.filter(F.col("classifier_version") == version).select("snapshot_id")).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    met = snapshots.select("snapshot_id").distinct().join(each, "snapshot_id", "left")
    return met.agg(
        F.count(F.lit(1)).alias("snapshots"), F.count("n").alias("classified"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated")
    )
