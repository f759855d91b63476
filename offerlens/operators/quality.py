"""Run quality: page totals, completeness of queries, facts, decision, operational changes, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.operators.history import previous_complete_run
from offerlens.operators.skew import first_by

# Thresholds and reason codes of the quality policy.
SOURCE_CAP = 3150
PUBLISH_RATE = 0.98
PARTIAL_RATE = 0.95
VOLUME_CHANGE = 0.40
PARTITION_CHANGE_PERCENT = 60
MINIMUM_BLOCKING_CHANGE = 5
FRESH_HOURS, STALE_HOURS = 30, 72


def page_totals(pages: DataFrame) -> DataFrame:
    """Totals per query of a run, with the place where the next page would start."""
    return pages.groupBy("run_id", "query_id").agg(
        F.count(F.lit(1)).alias("pages"),
        *[F.sum(f"{c}_count").alias(c) for c in ("received", "valid", "quarantined", "in_perimeter", "warning")],
        F.max_by("next_range_start", "range_start").alias("next_range_start"),
        F.max("source_total").alias("source_total"),
    )


def run_totals(totals: DataFrame) -> DataFrame:
    columns = ("pages", "received", "valid", "quarantined", "in_perimeter", "warning")
    return totals.groupBy("run_id").agg(F.count(F.lit(1)).alias("queries"), *[F.sum(c).alias(c) for c in columns])


def page_chain_check(pages: DataFrame) -> DataFrame:
    """Pages that are not the last one and whose next page is missing."""
    starts = pages.select("run_id", "query_id", F.col("range_start").alias("next_range_start")).distinct()
    return pages.filter(~F.col("is_terminal")).join(starts, ["run_id", "query_id", "next_range_start"], "left_anti")


def query_completeness(pages: DataFrame) -> DataFrame:
    """Whether each query is complete, and the reason when it is not."""
    facts = pages.groupBy("run_id", "query_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("is_terminal").alias("terminal"),
        F.min("range_start").alias("first_range"),
        F.min("source_total").alias("minimum_total"),
        F.max("source_total").alias("maximum_total"),
        F.sum("received_count").alias("received"),
    )
    broken = page_chain_check(pages).groupBy("run_id", "query_id").agg(F.count(F.lit(1)).alias("broken"))
    facts = facts.join(broken, ["run_id", "query_id"], "left").withColumn("broken", F.coalesce("broken", F.lit(0)))
    complete = (
        (F.col("pages") >= 1)
        & (F.col("terminal") == 1)
        & (F.col("first_range") == 0)
        & (F.col("minimum_total") == F.col("maximum_total"))
        & (F.col("received") == F.col("maximum_total"))
        & (F.col("broken") == 0)
    )
    return facts.withColumn("complete", complete).withColumn(
        "reason",
        F.when(complete, None)
        .when(F.col("minimum_total") != F.col("maximum_total"), "source_total_changed")
        .otherwise("incomplete"),
    )


def sighting_flags(sightings: DataFrame) -> DataFrame:
    """Per run and offer: was it created, did its content change, in any of the queries."""
    return sightings.groupBy("run_id", "offer_id").agg(
        F.bool_or("offer_created").alias("offer_created"), F.bool_or("snapshot_created").alias("snapshot_created")
    )


def new_and_updated(flags: DataFrame) -> DataFrame:
    return flags.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("unique_offers"),
        F.count_if("offer_created").alias("offers_new"),
        F.count_if(~F.col("offer_created") & F.col("snapshot_created")).alias("offers_updated"),
    )


def query_volumes(sightings: DataFrame, run_queries: DataFrame) -> DataFrame:
    """Distinct offers of every query of a run, 0 for a query without a sighting; pairs are reduced before they are counted."""
    counted = sightings.select("run_id", "query_id", "offer_id").distinct().groupBy("run_id", "query_id").agg(F.count(F.lit(1)).alias("current"))
    queries = run_queries.select("run_id", "query_id").distinct()
    return queries.join(counted, ["run_id", "query_id"], "left").withColumn("current", F.coalesce("current", F.lit(0)))


def previous_query_counts(sightings: DataFrame, runs: DataFrame, run_queries: DataFrame) -> DataFrame:
    """Per run and query of the run before: its offers, and how many the whole current run no longer has."""
    follows = previous_complete_run(runs).filter(F.col("previous_run_id").isNotNull())
    follows = follows.select(F.col("run_id").alias("current_run_id"), F.col("previous_run_id").alias("run_id"))
    before = sightings.select("run_id", "query_id", "offer_id").distinct().join(follows, "run_id")
    now = sightings.select(F.col("run_id").alias("current_run_id"), "offer_id").distinct().withColumn("seen", F.lit(True))
    counted = before.join(now, ["current_run_id", "offer_id"], "left").groupBy("current_run_id", "query_id").agg(
        F.count(F.lit(1)).alias("previous"), F.count_if(F.col("seen").isNull()).alias("missing_from_run")
    )
    queries = run_queries.select("run_id", "query_id").distinct().join(follows, "run_id").select("current_run_id", "query_id")
    filled = queries.join(counted, ["current_run_id", "query_id"], "left").fillna(0, ["previous", "missing_from_run"])
    return filled.withColumnRenamed("current_run_id", "run_id")


def partition_volumes(sightings: DataFrame, runs: DataFrame, run_queries: DataFrame) -> DataFrame:
    """Volumes of the queries that a run and the run before both have."""
    return query_volumes(sightings, run_queries).join(previous_query_counts(sightings, runs, run_queries), ["run_id", "query_id"])


def partition_volume_policy(volumes: DataFrame) -> DataFrame:
    """Each partition is fine, a warning or a blocker: only a real loss of five offers or more blocks."""
    change = F.col("current") - F.col("previous")
    small = (F.col("previous") == 0) | (F.abs(change) * 100 <= F.col("previous") * PARTITION_CHANGE_PERCENT)
    missing = F.coalesce("missing_from_run", F.abs(change))
    harmless = (change > 0) | (F.abs(change) < MINIMUM_BLOCKING_CHANGE) | (missing < MINIMUM_BLOCKING_CHANGE)
    return volumes.withColumn("verdict", F.when(small, "ok").when(harmless, "warning").otherwise("block"))


def positive_classification() -> Column:
    resolved = ("minimum_experience_months", "beginner_friendly", "contradictory_junior")
    found = F.coalesce("claims_junior", F.lit(False)) | (F.col("status") == "ambiguous")
    for column in resolved:
        found = found | F.col(column).isNotNull()
    return found


def run_quality_facts(
    runs: DataFrame,
    run_queries: DataFrame,
    pages: DataFrame,
    sightings: DataFrame,
    snapshots: DataFrame,
    classifications: DataFrame,
    evidence: DataFrame,
    classifier_version: str,
) -> DataFrame:
    """All facts the decision needs, one row per run. Facts are aggregated before runs are joined.

    An offer counts with the classification of its open snapshot by the given version, and evidence with the
    classification it proves.
    """
    queries = run_queries.groupBy("run_id").agg(F.bool_and(F.col("status") == "succeeded").alias("pagination_complete"))
    capped = pages.groupBy("run_id").agg(F.bool_or(F.col("source_total") > SOURCE_CAP).alias("source_cap_reached"))
    flags = sighting_flags(sightings)
    proven = evidence.select("classification_id").distinct().withColumn("proven", F.lit(True))
    ours = classifications.filter((F.col("classifier_version") == classifier_version) & positive_classification())
    open_snapshots = snapshots.filter(F.col("valid_to").isNull()).select("snapshot_id", "offer_id")
    positive = ours.select("classification_id", "snapshot_id").join(open_snapshots, "snapshot_id").join(proven, "classification_id", "left").select("offer_id", "proven")
    counted = (
        flags.join(positive.withColumn("positive", F.lit(True)), "offer_id", "left")
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("unique_offers"),
            F.count_if("offer_created").alias("offers_new"),
            F.count_if(~F.col("offer_created") & F.col("snapshot_created")).alias("offers_updated"),
            F.count_if("positive").alias("positives"),
            F.count_if(F.col("positive") & F.coalesce("proven", F.lit(False))).alias("positives_with_evidence"),
        )
    )
    volumes = partition_volume_policy(partition_volumes(sightings, runs, run_queries)).groupBy("run_id").agg(
        F.bool_or(F.col("verdict") == "block").alias("partition_blocks"),
        F.count_if(F.col("verdict") == "warning").alias("volume_warnings"),
    )
    facts = (
        previous_complete_run(runs.drop("offers_new", "offers_updated"))
        .join(queries, "run_id", "left")
        .join(capped, "run_id", "left")
        .join(counted, "run_id", "left")
        .join(volumes, "run_id", "left")
    )
    before = counted.select(F.col("run_id").alias("previous_run_id"), F.col("unique_offers").alias("previous_offers"))
    counts = ["unique_offers", "offers_new", "offers_updated", "positives", "positives_with_evidence", "volume_warnings"]
    facts = facts.join(before, "previous_run_id", "left").fillna(0, counts)
    moved = F.try_divide(F.abs(F.col("unique_offers") - F.col("previous_offers")), F.col("previous_offers"))
    anomaly = F.coalesce((F.col("previous_offers") > 0) & (moved > VOLUME_CHANGE), F.lit(False))
    return (
        facts.withColumn("pagination_complete", F.coalesce("pagination_complete", F.lit(False)))
        .withColumn("source_cap_reached", F.coalesce("source_cap_reached", F.lit(False)))
        .withColumn("volume_anomaly", anomaly | F.coalesce("partition_blocks", F.lit(False)))
    )


def quality_decision(facts: DataFrame) -> DataFrame:
    """publish, publish_partial or block, with the reasons in order."""
    received, valid = F.col("offers_received"), F.col("offers_valid")
    consistent = (valid + F.col("offers_quarantined") == received) & (F.col("positives_with_evidence") <= F.col("positives"))
    rate = F.when(consistent, F.try_divide(valid, received)).otherwise(
        F.raise_error(F.lit("the counts of a run do not add up")).cast("double")
    )
    facts = facts.withColumn("validation_rate", rate).withColumn(
        "evidence_coverage", F.try_divide(F.col("positives_with_evidence"), F.col("positives"))
    )
    rate = F.col("validation_rate")
    blockers = [
        F.when(~F.col("pagination_complete"), "pagination_incomplete"),
        F.when(F.col("source_cap_reached"), "source_cap_reached"),
        F.when(F.col("positives_with_evidence") < F.col("positives"), "positive_classification_missing_evidence"),
        F.when(F.col("volume_anomaly"), "volume_anomaly_detected"),
        F.when(rate.isNull(), "validation_rate_unavailable").when(rate < PARTIAL_RATE, "validation_rate_below_minimum"),
    ]
    below = F.when((rate >= PARTIAL_RATE) & (rate < PUBLISH_RATE), "validation_rate_below_publish_threshold")
    blocked = F.size(F.array_compact(F.array(*blockers))) > 0
    decision = F.when(blocked, "block").when(rate >= PUBLISH_RATE, "publish").otherwise("publish_partial")
    return (
        facts.withColumn("decision", decision)
        .withColumn("reasons", F.array_compact(F.array(*blockers, below)))
        .withColumn("closure_eligible", F.col("decision") == "publish")
    )


# ---------------------------------------------------------------- operational changes and health


def comparable_samples(datasets: DataFrame, runs: DataFrame, counts: DataFrame) -> DataFrame:
    """For each published dataset: itself and the latest publication of each of the seven days before.

    Every dataset looks up its eight days, so the join grows with the datasets and not with their square.
    """
    done = runs.filter((F.col("status") == "succeeded") & F.col("started_at").isNotNull() & F.col("finished_at").isNotNull())
    duration = F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000).cast("long").alias("duration_ms")
    published = datasets.filter(F.col("status") == "published").join(done.select("run_id", duration), "run_id")
    same = ["source_id", "query_set_version", "classifier_version"]
    day = F.explode(F.sequence(F.date_sub("business_date", 7), F.col("business_date")))
    current = published.select(*same, F.col("dataset_id").alias("current_id"), F.col("business_date").alias("current_date"), day.alias("business_date"))
    prior = published.select(*same, "dataset_id", "business_date", "published_at", "duration_ms")
    pairs = current.join(prior, [*same, "business_date"]).filter((F.col("business_date") < F.col("current_date")) | (F.col("dataset_id") == F.col("current_id")))
    latest = first_by(pairs, ["current_id", "business_date"], ["published_at", "dataset_id"], descending=True)
    samples = latest.join(counts, "dataset_id", "left")
    return samples.select(
        "current_id", "dataset_id", "business_date", "duration_ms",
        F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("ambiguous", F.lit(0)).alias("ambiguous"),
    )


def operational_changes(samples: DataFrame) -> DataFrame:
    """Reasons to look at a dataset: a drop of members, doubled ambiguity, a long run. At most eight rows per dataset."""
    value = F.struct("business_date", "members", "ambiguous", "duration_ms")
    grouped = samples.groupBy("current_id").agg(
        F.max(F.when(F.col("dataset_id") == F.col("current_id"), value)).alias("now"),
        F.sort_array(F.collect_list(F.when(F.col("dataset_id") != F.col("current_id"), value)), asc=False).alias("before"),
    )
    now, before = F.col("now"), F.col("before")
    prior = F.get("before", F.lit(0))
    durations = F.array_sort(F.transform(F.slice("before", 1, 7), lambda b: b["duration_ms"]))
    median = F.get(durations, F.lit(3))
    reasons = F.array_compact(
        F.array(
            F.when((prior["members"] > 0) & (now["members"] * 100 < prior["members"] * 60), "VOLUME_DROP_OVER_40_PERCENT"),
            F.when(
                (prior["members"] > 0)
                & (prior["ambiguous"] > 0)
                & (now["members"] > 0)
                & (now["ambiguous"] * prior["members"] > 2 * prior["ambiguous"] * now["members"]),
                "AMBIGUITY_MORE_THAN_DOUBLED",
            ),
            F.when(
                (F.size(before) >= 7) & (median > 0) & (now["duration_ms"] > 2 * median), "DURATION_OVER_TWICE_SEVEN_DAY_MEDIAN"
            ),
        )
    )
    return grouped.select("current_id", F.size(before).alias("prior_days"), reasons.alias("reasons"))


def production_health(status: DataFrame, now: Column) -> DataFrame:
    """Reasons why a status answer is not healthy; a time more than a minute ahead is not believed."""
    minute, hour = 60_000, 3_600_000

    def old(column: str, limit: int) -> Column:
        age = F.unix_millis(now) - F.unix_millis(column)
        return F.col(column).isNull() | (age < -minute) | (age > limit)

    rate = F.try_divide(F.col("valid"), F.col("received"))
    counts = F.coalesce((F.col("received") > 0) & F.col("valid").between(0, F.col("received")) & (rate >= PUBLISH_RATE), F.lit(False))
    reasons = (
        (~F.col("status").eqNullSafe("operational"), "STATUS_NOT_OPERATIONAL"),
        (~F.col("freshness").eqNullSafe("fresh"), "DATA_NOT_FRESH"),
        (~F.col("run_status").eqNullSafe("succeeded"), "LAST_RUN_NOT_SUCCEEDED"),
        (old("data_as_of", 30 * hour), "DATA_OLDER_THAN_30H"),
        (old("last_success_at", 30 * hour), "NO_SUCCESS_WITHIN_30H"),
        (old("generated_at", 10 * minute), "STATUS_RESPONSE_STALE"),
        (~F.col("partial_queries").eqNullSafe(0), "INCOMPLETE_QUERIES"),
        (~counts, "VALIDATION_BELOW_98_PERCENT"),
    )
    return status.withColumn("reasons", F.array_compact(F.array(*[F.when(c, r) for c, r in reasons])))


def latest_run(runs: DataFrame) -> DataFrame:
    """The last finished full run of each source."""
    done = runs.filter((F.col("mode") == "full") & F.col("status").isin("succeeded", "partial", "failed"))
    dated = done.withColumn("_at", F.coalesce("finished_at", "created_at"))
    return first_by(dated, ["source_id"], ["_at", "run_id"], descending=True).drop("_at")


def incident_list(events: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """Public events of thirty days, open ones first, newest first."""
    recent = events.filter(F.col("is_public") & (F.col("created_at") >= now - F.make_dt_interval(F.lit(30))))
    state = (
        F.when(F.col("resolved_at").isNotNull(), "resolved")
        .when(F.col("severity").isin("info", "warning"), "monitoring")
        .otherwise("identified")
    )
    ordered = recent.withColumn("state", state).orderBy(F.desc(F.col("resolved_at").isNull()), F.desc("created_at"), "event_id")
    return ordered.limit(limit)


def ambiguous_rate(rows: DataFrame, *keys: str) -> DataFrame:
    counted = rows.groupBy(*keys).agg(F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count(F.lit(1)).alias("members"))
    return counted.withColumn("ambiguous_rate", F.when(F.col("members") == 0, 0.0).otherwise(F.col("ambiguous") / F.col("members")))


def freshness(cutoff: Column, now: Column) -> Column:
    hours = F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(cutoff)) / 3_600_000)
    return F.when(hours <= FRESH_HOURS, "fresh").when(hours <= STALE_HOURS, "delayed").otherwise("stale")


RUN_COUNTERS = (
    "requests_count", "offers_received", "offers_valid", "offers_new", "offers_updated", "offers_quarantined", "offers_marked_missing", "offers_closed",
)


def data_status(dataset: DataFrame, runs: DataFrame, run_queries: DataFrame, rows: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """The status answer of the current dataset, one row: judgement, warnings, last run with its counters, incidents.

    Incidents are those of the dataset and those of none; the list is as long as `incident_list` allows.
    """
    queries = run_queries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("status") != "succeeded").alias("partial_queries")
    )
    run = latest_run(runs).join(queries, "run_id", "left")
    last = run.select("source_id", F.col("status").alias("run_status"), "started_at", "finished_at", *RUN_COUNTERS, "queries", "partial_queries")
    here = dataset.select(F.col("dataset_id").alias("_here"))
    own = events.join(here, events.dataset_id == F.col("_here"), "left_semi").unionByName(events.filter(F.col("dataset_id").isNull()))
    listed = incident_list(own, now).agg(
        F.array_sort(F.collect_list(F.struct(F.col("resolved_at").isNotNull().alias("resolved"), (-F.unix_micros("created_at")).alias("newest"), "event_id", "state"))).alias("incidents")
    )
    joined = (
        dataset.join(last, "source_id", "left")
        .join(ambiguous_rate(rows, "dataset_id"), "dataset_id", "left")
        .join(listed, F.lit(True), "left")
        .withColumn("open_incidents", F.size(F.filter("incidents", lambda i: ~i["resolved"])))
        .withColumn("freshness", freshness(F.col("source_cutoff_at"), now))
    )
    stale, partial = F.col("freshness") != "fresh", F.col("run_status") == "partial"
    degraded = stale | F.coalesce(F.col("run_status").isin("partial", "failed"), F.lit(False)) | (F.col("open_incidents") > 0)

    def warning(code: str, severity) -> Column:
        return F.struct(F.lit(code).alias("code"), severity.alias("severity"))

    warnings = F.array_compact(
        F.array(
            F.when(stale, warning("STALE_DATA", F.when(F.col("freshness") == "stale", "critical").otherwise("warning"))),
            F.when(partial, warning("PARTIAL_COLLECTION", F.lit("warning"))),
        )
    )
    success = (F.col("run_status") == "succeeded") & F.col("finished_at").isNotNull()
    return (
        joined.withColumn("service", F.when(degraded, "degraded").otherwise("operational"))
        .withColumn(
            "quality", F.when(degraded, F.when(F.col("freshness") == "stale", "stale").otherwise("limited")).otherwise("normal")
        )
        .withColumn("warnings", warnings)
        .withColumn("incidents", F.transform("incidents", lambda i: F.struct(i["event_id"].alias("event_id"), i["state"].alias("state"))))
        .withColumn("last_success_at", F.when(success, F.col("finished_at")).otherwise(F.col("published_at")))
        .withColumn("duration_ms", F.greatest(F.lit(0), F.unix_millis("finished_at") - F.unix_millis("started_at")))
    )


MONITOR = "MONITOR_"


def reconcile_incidents(events: DataFrame, desired: DataFrame, now: Column) -> DataFrame:
    """Events after a check: open monitor events no longer wanted are resolved, missing ones opened, the rest kept."""
    wanted = desired.select("scope", F.concat(F.lit(MONITOR), "reason").alias("event_code")).distinct()
    open_monitor = F.col("resolved_at").isNull() & F.col("event_code").startswith(MONITOR)
    marked = events.join(wanted.withColumn("wanted", F.lit(True)), ["scope", "event_code"], "left")
    kept = marked.withColumn("resolved_at", F.when(open_monitor & F.col("wanted").isNull(), now).otherwise(F.col("resolved_at")))
    present = events.filter(F.col("resolved_at").isNull()).select("scope", "event_code")
    opened = wanted.join(present, ["scope", "event_code"], "left_anti").select(
        "scope", "event_code", F.lit("warning").alias("severity"),
        (F.col("event_code") != f"{MONITOR}DURATION_OVER_TWICE_SEVEN_DAY_MEDIAN").alias("is_public"),
        now.alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    return kept.select(*opened.columns).unionByName(opened)


#: Fields that nearly every offer has; one that vanishes from a day to the next points at the source.
COMMON_FIELDS = ("source_published_at", "contract_kind", "minimum_experience_months")
INVALID_PERCENT = 2


def quality_profile(rows: DataFrame, day: str = "business_date", fields: tuple[str, ...] = COMMON_FIELDS, text: str | None = None) -> DataFrame:
    """Daily profile of the classified rows and the sudden changes from one day to the next.

    `lost_fields` are the fields absent from every row of a day and from less than half of the day before;
    `contract_mix` lists each contract kind with its share; `empty_text_rate` needs the name of the text column.
    """
    share = lambda condition: F.avg(condition.cast("int"))
    profile = rows.groupBy(day).agg(
        F.count(F.lit(1)).alias("members"),
        share(F.coalesce("claims_junior", F.lit(False))).alias("junior_rate"),
        share(F.col("minimum_experience_months").isNotNull()).alias("known_experience_rate"),
        share(F.col("status") == "ambiguous").alias("ambiguous_rate"),
        (share(F.trim(F.coalesce(F.col(text), F.lit(""))) == "") if text else F.lit(None).cast("double")).alias("empty_text_rate"),
        *[share(F.col(f).isNull()).alias(f"_missing_{f}") for f in fields],
    )
    kinds = rows.groupBy(day, F.coalesce("contract_kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    mixed = kinds.groupBy(day).agg(F.sum("n").alias("total"), F.collect_list(F.struct("kind", "n")).alias("mix"))
    mix = F.transform(F.array_sort("mix"), lambda k: F.struct(k["kind"].alias("kind"), (k["n"] / F.col("total")).alias("share")))
    profile = profile.join(mixed.select(day, mix.alias("contract_mix")), day)
    # One row per day from here on.
    order = Window.orderBy(day)
    moved = F.abs(F.col("junior_rate") - F.lag("junior_rate").over(order)) * 100
    doubled = F.col("ambiguous_rate") > 2 * F.lag("ambiguous_rate").over(order)
    gone = [F.when((F.col(f"_missing_{f}") == 1.0) & (F.lag(f"_missing_{f}").over(order) < 0.5), F.lit(f)) for f in fields]
    return (
        profile.withColumn("junior_jump", F.coalesce(moved > 15, F.lit(False)))
        .withColumn("ambiguity_doubled", F.coalesce(doubled, F.lit(False)))
        .withColumn("lost_fields", F.array_compact(F.array(*gone)))
        .drop(*[f"_missing_{f}" for f in fields])
    )


def run_anomalies(runs: DataFrame) -> DataFrame:
    """Finished runs of which more than two percent of the received items were invalid."""
    invalid = F.col("offers_quarantined") * 100 > F.col("offers_received") * INVALID_PERCENT
    return runs.filter(invalid).select("run_id", "offers_received", "offers_quarantined")


def run_report(runs: DataFrame, run_queries: DataFrame, pages: DataFrame, sightings: DataFrame, datasets: DataFrame, members: DataFrame) -> DataFrame:
    """One row per run: its queries by status, pages, offers and the dataset made from it."""
    queries = run_queries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.count_if(F.col("status") == s).alias(f"queries_{s}") for s in ("succeeded", "running", "failed")],
    )
    paged = pages.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"))
    offers = sightings.select("run_id", "offer_id").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("unique_offers"))
    counted = members.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("members"))
    latest = first_by(datasets, ["run_id"], ["published_at", "dataset_id"], descending=True)
    published = latest.join(counted, "dataset_id", "left").select(
        "run_id", "dataset_version", F.col("status").alias("dataset_status"), F.coalesce("members", F.lit(0)).alias("members")
    )
    report = runs.select("run_id", "status")
    for part in (queries, paged, offers, published):
        report = report.join(part, "run_id", "left")
    return report
