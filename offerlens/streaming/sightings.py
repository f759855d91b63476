"""Offer state kept from a stream of sightings and closings.

A batch is reduced to one row per offer. Such rows can be put together in the order of their batches: first and last
sighting are a minimum and a maximum, so a late sighting never moves the last one back; a sighting after a closing
opens the offer again and counts as a reopening, also if the two lie in different batches.

Every few batches the rows since the last snapshot are merged with it into the next one. Offers closed for long leave
the snapshot for the archive, so what a batch and a snapshot read and write is bounded by the open offers and the
batches in between, not by the offers ever seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.operators.skew import bucketed_neighbour
from offerlens.sources.tables import numbered_folders, remove

COLUMNS = ("offer_id", "observed_at", "event_id", "content_hash")
#: `kind` is "seen" or "closed"; files without the column hold sightings.
SCHEMA = "offer_id string, observed_at timestamp, event_id long, content_hash string, kind string"
STATE = ("first_seen_at", "last_seen_at", "sightings", "open_hash", "last_event", "starts_seen", "closed_at", "reopened_count")
SNAPSHOT_EVERY = 8
ARCHIVED_AFTER_DAYS = 30


def partial_state(batch: DataFrame) -> DataFrame:
    """One row per offer of a batch, whose rows follow each other by time and event."""
    rows = batch.withColumn("kind", F.coalesce("kind", F.lit("seen")))
    order = F.struct("observed_at", "event_id")
    # an offer seen very often stays split by hour
    near = bucketed_neighbour(rows, ["offer_id"], F.date_trunc("hour", "observed_at"), ["observed_at", "event_id"], ["kind"])
    seen, closed, before = F.col("kind") == "seen", F.col("kind") == "closed", F.col("previous_kind")
    closings = F.max(F.when(closed & ~before.eqNullSafe(F.lit("closed")), F.col("observed_at")))
    return near.groupBy("offer_id").agg(
        F.min(F.when(seen, F.col("observed_at"))).alias("first_seen_at"),
        F.max(F.when(seen, F.col("observed_at"))).alias("last_seen_at"),
        F.count_if(seen).alias("sightings"),
        F.max_by("content_hash", F.when(seen, order)).alias("open_hash"),
        F.max_by("event_id", F.when(seen, order)).alias("last_event"),
        (F.min_by("kind", order) == "seen").alias("starts_seen"),
        F.when(F.max_by("kind", order) == "closed", closings).alias("closed_at"),
        F.count_if(seen & (before == "closed")).alias("reopened_count"),
    )


def _then(before: Column, after: Column) -> Column:
    """State of two consecutive stretches of one offer."""
    newer = F.when(before["sightings"] == 0, True).when(after["sightings"] == 0, False)
    later = F.struct(after["last_seen_at"], after["last_event"]) > F.struct(before["last_seen_at"], before["last_event"])
    last = F.coalesce(newer, later)
    reopened = F.when(before["closed_at"].isNotNull() & after["starts_seen"], 1).otherwise(0)
    return F.struct(
        F.least(before["first_seen_at"], after["first_seen_at"]).alias("first_seen_at"),
        F.greatest(before["last_seen_at"], after["last_seen_at"]).alias("last_seen_at"),
        (before["sightings"] + after["sightings"]).alias("sightings"),
        F.when(last, after["open_hash"]).otherwise(before["open_hash"]).alias("open_hash"),
        F.when(last, after["last_event"]).otherwise(before["last_event"]).alias("last_event"),
        before["starts_seen"].alias("starts_seen"),
        F.when(after["sightings"] == 0, F.coalesce(before["closed_at"], after["closed_at"])).otherwise(after["closed_at"]).alias("closed_at"),
        (before["reopened_count"] + after["reopened_count"] + reopened).alias("reopened_count"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """One row per offer from rows of consecutive batches: at most one row per offer and batch, so lists are short."""
    row = F.struct("batch", F.struct(*STATE).alias("state"))
    listed = F.array_sort(F.collect_list(row))
    states = F.transform(listed, lambda r: r["state"])
    folded = F.aggregate(F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0))), states[0], _then)
    return rows.groupBy("offer_id").agg(F.max("batch").alias("batch"), folded.alias("state")).select("offer_id", "batch", "state.*")


def _read(spark: SparkSession, state: str, kind: str, numbers: list[int]) -> DataFrame:
    """Rows of folders named by batch, with the batch; a snapshot's rows carry their own."""
    names = ", ".join(["offer_id string", "first_seen_at timestamp", "last_seen_at timestamp", "sightings long", "open_hash string", "last_event long", "starts_seen boolean", "closed_at timestamp", "reopened_count long", "batch int"])
    if not numbers:
        return spark.createDataFrame([], names)
    return spark.read.schema(names).parquet(*[f"{state}/{kind}/{n}" for n in numbers])


def _live(spark: SparkSession, state: str, before: int | None = None) -> tuple[DataFrame, list[int]]:
    """Rows of the last snapshot and of the batches since, up to `before`, and the numbers of these batches."""
    upto = lambda kind: [n for n in numbered_folders(spark, f"{state}/{kind}") if before is None or n <= before]
    snapshots = upto("snapshot")[-1:]
    batches = [n for n in upto("batch") if not snapshots or n > snapshots[0]]
    return _read(spark, state, "snapshot", snapshots).unionByName(_read(spark, state, "batch", batches)), batches


def _take_snapshot(spark: SparkSession, state: str, number: int, archived_after_days: int) -> None:
    """Merge everything live up to a batch; run again it writes the same folders."""
    rows, _ = _live(spark, state, number - 1)
    now = merged(rows.unionByName(_read(spark, state, "batch", [number])))
    latest = now.agg(F.max(F.greatest("last_seen_at", "closed_at")).alias("latest"))
    limit = latest.select(F.col("latest") - F.make_dt_interval(F.lit(archived_after_days))).scalar()
    gone = F.coalesce(F.col("closed_at") < limit, F.lit(False))
    now.filter(gone).write.mode("overwrite").parquet(f"{state}/archive/{number}")
    now.filter(~gone).write.mode("overwrite").parquet(f"{state}/snapshot/{number}")


def _forget(spark: SparkSession, state: str, number: int) -> None:
    """Remove what a snapshot before `number` made needless; the batch of that snapshot is committed by now."""
    snapshots = [n for n in numbered_folders(spark, f"{state}/snapshot") if n < number]
    if snapshots:
        for kind, old in (("snapshot", snapshots[:-1]), ("batch", [n for n in numbered_folders(spark, f"{state}/batch") if n <= snapshots[-1]])):
            for n in old:
                remove(spark, f"{state}/{kind}/{n}")


def keep_state(
    spark: SparkSession, landing: str, state: str, progress: str, files_per_batch: int = 1, snapshot_every: int = SNAPSHOT_EVERY, archived_after_days: int = ARCHIVED_AFTER_DAYS
) -> None:
    """Reduce each batch to one row per offer and store it under its number; take a snapshot every few batches.

    A batch writes only folders of its own number, so running it again after a failure replaces the same rows.
    """

    def fold(batch: DataFrame, number: int) -> None:
        _forget(spark, state, number)
        partial_state(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{state}/batch/{number}")
        if (number + 1) % snapshot_every == 0:
            _take_snapshot(spark, state, number, archived_after_days)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", progress)
    query.trigger(availableNow=True).start().awaitTermination()


def current_state(spark: SparkSession, state: str) -> DataFrame:
    """State of every offer ever seen: the live rows and the archive."""
    live, _ = _live(spark, state)
    every = live.unionByName(_read(spark, state, "archive", numbered_folders(spark, f"{state}/archive")))
    return merged(every).drop("batch", "starts_seen")


def open_state(spark: SparkSession, state: str) -> DataFrame:
    """State of the offers that are open now; the archive is read only for offers that came back."""
    live, _ = _live(spark, state)
    archive = _read(spark, state, "archive", numbered_folders(spark, f"{state}/archive"))
    earlier = archive.join(live.select("offer_id").distinct(), "offer_id", "left_semi")
    return merged(live.unionByName(earlier)).filter("closed_at is null").drop("batch", "starts_seen")
