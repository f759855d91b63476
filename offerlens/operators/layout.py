"""Members stored in the order of the explorer, so that a keyset page reads the few files it lies in.

One layout serves both directions of a sort column. Rows are dealt by ranges of (value missing, value, offer) and sorted
in them; beside the files stands one row per file with its first and last position. A page takes the next files after
its position from these rows, and more of them only while its filters leave it short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators.explorer import DEFAULT_LIMIT, SORTS, explorer_page


def write_layout(rows: DataFrame, path: str, column: str, files: int) -> None:
    """Store rows for the sorts over `column`; a file holds about the same number of rows as any other."""
    order = [F.col(column).isNull(), F.col(column), F.col("offer_id")]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows")
    place = F.struct(F.col(column).alias("value"), "offer_id")
    parts = stored.select(F.input_file_name().alias("file"), F.col(column).isNull().alias("missing"), place.alias("place"))
    # a file may hold the last values and the first rows without one: two parts
    found = parts.groupBy("file", "missing").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
    found.coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")


def _parts_after(spark: SparkSession, path: str, descending: bool, after) -> DataFrame:
    """Parts that hold rows after a position, in the order of the sort; parts without values come last both ways."""
    parts = spark.read.parquet(f"{path}/parts")
    if after is not None:
        value, offer_id = after
        edge = parts["first"] if descending else parts["last"]
        beyond = (lambda a, b: a < b) if descending else (lambda a, b: a > b)
        if value is None:
            parts = parts.filter(F.col("missing") & beyond(edge["offer_id"], F.lit(offer_id)))
        else:
            later = beyond(edge["value"], F.lit(value)) | ((edge["value"] == F.lit(value)) & beyond(edge["offer_id"], F.lit(offer_id)))
            parts = parts.filter(F.col("missing") | later)
    return parts.orderBy("missing", F.desc("last") if descending else F.asc("first"))


def layout_page(
    spark: SparkSession, path: str, sort: str = "published_desc", limit: int = DEFAULT_LIMIT, after=None, narrowed: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, list[str]]:
    """(the rows of `explorer_page`, the files read for it). `narrowed` filters rows; it must not move them.

    `after` is (value, offer_id) of the last row seen, the value as a Python value. The number of files doubles while
    the page stays short, so a filter that few rows pass reads at most twice the files it needs.
    """
    _, descending = SORTS[sort]
    column, taken, stored = SORTS[sort][0], 2, spark.read.parquet(f"{path}/rows").schema
    while True:
        parts = _parts_after(spark, path, descending, after).select("file", "missing").limit(taken).collect()
        files = list(dict.fromkeys(p["file"] for p in parts))
        rows = spark.read.schema(stored).parquet(*files) if files else spark.createDataFrame([], stored)
        if not any(p["missing"] for p in parts):
            rows = rows.filter(F.col(column).isNotNull())  # rows without a value come after parts not read yet
        page = explorer_page(narrowed(rows) if narrowed else rows, sort, limit, after)
        if len(parts) < taken or page.count() > limit:
            return page, files
        taken *= 2
