"""History of offers: sightings, matches, state and snapshot intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def record_sightings(observations: DataFrame) -> DataFrame:
    """One row per run, query and offer: the latest observation, the flags or-ed."""
    return observations.groupBy("run_id", "query_id", "offer_id").agg(
        F.max("observed_at").alias("observed_at"),
        F.bool_or("offer_created").alias("offer_created"),
        F.bool_or("snapshot_created").alias("snapshot_created"),
    )


def record_matches(observations: DataFrame) -> DataFrame:
    """One row per offer and query: first match kept, last match and families replaced; empty families are an error."""
    families = F.when(F.size("job_families") > 0, F.col("job_families")).otherwise(
        F.raise_error(F.lit("a match must hold a job family")).cast("array<string>")
    )
    return (
        observations.withColumn("job_families", families)
        .groupBy("offer_id", "query_id")
        .agg(
            F.min("observed_at").alias("first_matched_at"),
            F.max("observed_at").alias("last_matched_at"),
            F.max_by("job_families", F.struct("observed_at", "event_id")).alias("job_families"),
        )
    )


def merge_matches(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch of matches to the stored ones."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return both.groupBy("offer_id", "query_id").agg(
        F.min("first_matched_at").alias("first_matched_at"),
        F.max("last_matched_at").alias("last_matched_at"),
        F.max_by("job_families", F.struct("_new", "last_matched_at")).alias("job_families"),
    )


def _day(column: str) -> Column:
    return F.to_date(column)


def snapshot_intervals(observations: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Snapshots with their validity: equal neighbours collapse, a change closes the open row, A-B-A gives three.

    Observations are shuffled once, by offer and bucket (a day, or a non-decreasing function of the order), so an
    offer seen very often stays split. Inside a bucket all but the first and the last change are final. Each bucket
    gives one run-length summary (first and last change, time of the second), and these, one row a bucket, are put
    in order by offer to settle the changes at the borders. Nothing is joined.
    """
    rows = observations.select("offer_id", "observed_at", "event_id", "content_hash").withColumn("_bucket", _day("observed_at") if bucket is None else bucket)
    inside = Window.partitionBy("offer_id", "_bucket").orderBy("observed_at", "event_id")
    seen = rows.withColumns({"_place": F.row_number().over(inside), "_before": F.lag("content_hash").over(inside)})
    changes = seen.filter((F.col("_place") == 1) | ~F.col("content_hash").eqNullSafe(F.col("_before")))
    changes = changes.withColumn("valid_to", F.lead("observed_at").over(inside))
    settled = changes.filter((F.col("_place") > 1) & F.col("valid_to").isNotNull())

    order, change = F.struct("observed_at", "event_id"), F.struct("content_hash", "observed_at", "valid_to")
    borders = changes.groupBy("offer_id", "_bucket").agg(
        F.min_by(change, order).alias("first"), F.max_by(change, order).alias("last"), F.count(F.lit(1)).alias("n")
    )
    forward = Window.partitionBy("offer_id").orderBy("_bucket")
    backward = Window.partitionBy("offer_id").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lag("last").over(forward)["content_hash"].eqNullSafe(F.col("first.content_hash")) & (F.row_number().over(forward) > 1)
    borders = borders.withColumn("opens", ~same)
    # when the offer changes next after an earlier bucket
    entered = F.when(F.col("opens"), F.col("first.observed_at")).otherwise(F.col("first.valid_to"))
    borders = borders.withColumn("entered", entered).withColumn("next", F.last("entered", ignorenulls=True).over(backward))

    def interval(border: str, valid_to: Column) -> Column:
        return F.struct(F.col(f"{border}.content_hash").alias("content_hash"), F.col(f"{border}.observed_at").alias("valid_from"), valid_to.alias("valid_to"))

    ends = F.array(
        F.when(F.col("opens"), interval("first", F.coalesce("first.valid_to", "next"))),
        F.when(F.col("n") > 1, interval("last", F.col("next"))),
    )
    return settled.select("offer_id", "content_hash", F.col("observed_at").alias("valid_from"), "valid_to").unionByName(
        borders.select("offer_id", F.inline(F.array_compact(ends)))
    )


def apply_snapshots(snapshots: DataFrame, batch: DataFrame) -> DataFrame:
    """Add one observation per offer to stored snapshots: the open one is closed where the hash changed.

    Closed snapshots are carried over untouched, only open ones meet the batch.
    """
    open_rows = snapshots.filter(F.col("valid_to").isNull())
    fresh = batch.select("offer_id", F.col("content_hash").alias("new_hash"), "observed_at")
    met = open_rows.join(fresh, "offer_id", "full_outer")
    changed = F.col("new_hash").isNotNull() & ~F.col("new_hash").eqNullSafe(F.col("content_hash"))
    entries = F.array_compact(
        F.array(
            F.when(
                F.col("content_hash").isNotNull(),
                F.struct(
                    F.col("content_hash").alias("content_hash"),
                    F.col("valid_from").alias("valid_from"),
                    F.when(changed, F.col("observed_at")).alias("valid_to"),
                ),
            ),
            F.when(
                changed,
                F.struct(
                    F.col("new_hash").alias("content_hash"),
                    F.col("observed_at").alias("valid_from"),
                    F.lit(None).cast("timestamp").alias("valid_to"),
                ),
            ),
        )
    )
    current = met.select("offer_id", F.inline(entries))
    return snapshots.filter(F.col("valid_to").isNotNull()).select(*current.columns).unionByName(current)


def upsert_offers(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Offer state after a batch: first seen kept, last seen never moves back, missing and closed cleared.

    A closed offer that is seen again counts one more reopening. `batch` may hold many rows per offer;
    they are reduced before the join.
    """
    seen = batch.groupBy("offer_id").agg(F.min("observed_at").alias("_first"), F.max("observed_at").alias("_last"))
    joined = state.join(seen, "offer_id", "full_outer")
    again = F.col("_last").isNotNull()
    return joined.select(
        "offer_id",
        F.coalesce("first_seen_at", "_first").alias("first_seen_at"),
        F.greatest("last_seen_at", "_last").alias("last_seen_at"),
        F.when(~again, F.col("missing_since")).alias("missing_since"),
        F.when(~again, F.col("closed_at")).alias("closed_at"),
        (F.coalesce("reopened_count", F.lit(0)) + F.when(again & F.col("closed_at").isNotNull(), 1).otherwise(0))
        .cast("int")
        .alias("reopened_count"),
    )


# ---------------------------------------------------------------- absences


def previous_run(runs: DataFrame) -> DataFrame:
    """Each run with the one just before of the same source and query set, whatever its status."""
    return _previous(runs, F.lit(True))


def previous_complete_run(runs: DataFrame) -> DataFrame:
    """Each run with the last one before it that succeeded or ended partial."""
    return _previous(runs, F.col("status").isin("succeeded", "partial"))


def _previous(runs: DataFrame, eligible: Column) -> DataFrame:
    # One row per run of a source and query set: small whatever the size of the facts.
    before = (
        Window.partitionBy("source_id", "query_set_version")
        .orderBy("created_at", "run_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    candidate = F.when(eligible & (F.col("mode") == "full"), F.col("run_id"))
    return runs.withColumn("previous_run_id", F.last(candidate, ignorenulls=True).over(before))


def complete_runs(runs: DataFrame, run_queries: DataFrame) -> DataFrame:
    """Runs that may age offers: succeeded, eligible for closure, with every query succeeded."""
    queries = run_queries.groupBy("run_id").agg(F.bool_and(F.col("status") == "succeeded").alias("all_succeeded"))
    return runs.join(queries, "run_id").filter(
        (F.col("status") == "succeeded") & F.col("closure_eligible") & F.col("all_succeeded")
    )


def seen_in(sightings: DataFrame, run_id: str) -> DataFrame:
    """Offers of a run, reduced to one row each before they meet a join."""
    return sightings.filter(F.col("run_id") == run_id).select("offer_id").distinct()


def current_absences(scope: DataFrame, sightings: DataFrame, run_id: str) -> DataFrame:
    return scope.join(seen_in(sightings, run_id), "offer_id", "left_anti")


def double_absences(absences: DataFrame, sightings: DataFrame, previous_run_id: str) -> DataFrame:
    return absences.join(seen_in(sightings, previous_run_id), "offer_id", "left_anti")


def apply_absences(
    offers: DataFrame, scope: DataFrame, sightings: DataFrame, runs: DataFrame, run_queries: DataFrame, run_id: str, applied_at: Column
) -> DataFrame:
    """Offer state after a run: absent offers are marked missing, offers absent twice in a row are closed.

    The gate is the run itself and the one just before: both complete and eligible, else nothing ages.
    The gate is one small row; sightings are read once for both runs.
    """
    complete = complete_runs(runs, run_queries).select("run_id")
    gate = previous_run(runs).filter(F.col("run_id") == run_id).select("run_id", "previous_run_id")
    gate = gate.join(complete, "run_id", "left_semi").join(
        complete.select(F.col("run_id").alias("previous_run_id")), "previous_run_id", "left_semi"
    )
    seen = (
        sightings.join(F.broadcast(gate.select(F.explode(F.array("run_id", "previous_run_id")).alias("run_id"))), "run_id", "left_semi")
        .groupBy("offer_id")
        .agg(F.bool_or(F.col("run_id") == run_id).alias("seen_now"))
    )
    open_scope = scope.select("offer_id").distinct().withColumn("in_scope", F.lit(True))
    gated = gate.agg(F.count(F.lit(1)) > 0).scalar()
    state = offers.join(open_scope, "offer_id", "left").join(seen, "offer_id", "left").withColumn("gated", gated)
    absent = (
        F.col("gated")
        & F.coalesce("in_scope", F.lit(False))
        & F.col("closed_at").isNull()
        & ~F.coalesce("seen_now", F.lit(False))
    )
    twice = absent & F.col("seen_now").isNull()
    return state.select(
        *[c for c in offers.columns if c not in ("missing_since", "closed_at")],
        F.when(absent, F.coalesce("missing_since", applied_at)).otherwise(F.col("missing_since")).alias("missing_since"),
        F.when(twice, applied_at).otherwise(F.col("closed_at")).alias("closed_at"),
    )


def query_match_semi(offers: DataFrame, matches: DataFrame, queries: DataFrame, query_set: str) -> DataFrame:
    """Offers with a match in an enabled, still valid query of the query set."""
    active = queries.filter((F.col("query_set_version") == query_set) & F.col("enabled") & F.col("valid_to").isNull())
    matched = matches.join(active.select("query_id"), "query_id", "left_semi").select("offer_id").distinct()
    return offers.join(matched, "offer_id", "left_semi")
