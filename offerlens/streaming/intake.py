"""Streaming intake: new page files are committed once, however often they are replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerlens.sources.pages import PAGE_SCHEMA
from offerlens.sources.tables import append_new

PAGE_KEY = ["query_key", "range_start"]


def commit_pages(spark: SparkSession, landing: str, committed: str, progress: str, files_per_batch: int | None = None) -> None:
    """Read all page files not seen yet and append the pages whose key is new.

    The page key makes a commit repeatable: within a batch duplicates are dropped, against the committed
    table an anti join on the two key columns decides, so a batch run again after a failure adds nothing. Pages are
    stored by query, and a batch reads the keys of its own queries only.
    """
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def commit(batch: DataFrame, _: int) -> None:
        append_new(batch, committed, PAGE_KEY, "query_key")

    query = reader.json(landing).writeStream.foreachBatch(commit)
    query.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
