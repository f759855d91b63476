"""Immutable datasets: freezing the membership, validation, publication, rollback, insights, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import rates as R
from offerlens.operators.history import query_match_semi
from offerlens.operators.skew import first_by

PUBLISHABLE = ("publish", "publish_partial")
MAIN_METRICS = (R.CONTRADICTION, R.BEGINNER, R.SALARY)


def active_scope(offers: DataFrame, matches: DataFrame, queries: DataFrame, query_set: str) -> DataFrame:
    """Open offers matched by an active query of the query set."""
    return query_match_semi(offers.filter(F.col("closed_at").isNull()), matches, queries, query_set)


def offer_families(matches: DataFrame, queries: DataFrame, query_set: str) -> DataFrame:
    """Sorted distinct families per offer; a match without families takes those of its query.

    Pairs of offer and family are reduced before they are collected, so an array never exceeds the
    handful of families that exist.
    """
    active = queries.filter((F.col("query_set_version") == query_set) & F.col("enabled") & F.col("valid_to").isNull())
    active = active.select("query_id", F.col("job_families").alias("query_families"))
    joined = matches.join(active, "query_id")
    families = joined.select("offer_id", F.explode(F.coalesce("job_families", "query_families")).alias("family")).distinct()
    return families.groupBy("offer_id").agg(F.array_sort(F.collect_set("family")).alias("job_families"))


def freeze_membership(
    dataset_id: str,
    query_set: str,
    classifier: str,
    offers: DataFrame,
    snapshots: DataFrame,
    classifications: DataFrame,
    matches: DataFrame,
    queries: DataFrame,
) -> DataFrame:
    """Pin snapshot, classification and families of every open offer in scope. Written once per dataset."""
    scope = active_scope(offers, matches, queries, query_set).select("offer_id")
    open_snapshots = snapshots.filter(F.col("valid_to").isNull()).select("snapshot_id", "offer_id")
    version = classifications.filter(F.col("classifier_version") == classifier).select("snapshot_id", "classification_id")
    pinned = first_by(
        scope.join(open_snapshots, "offer_id").join(version, "snapshot_id"), ["offer_id"], ["classification_id"]
    )
    families = offer_families(matches, queries, query_set)
    return pinned.join(families, "offer_id").select(
        F.lit(dataset_id).alias("dataset_id"), "offer_id", "snapshot_id", "classification_id", "job_families"
    )


def source_cutoff(pages: DataFrame) -> DataFrame:
    """The last page commit of each run, which is not the end of the run."""
    return pages.groupBy("run_id").agg(F.max("committed_at").alias("source_cutoff_at"))


def validate_dataset(
    dataset: DataFrame, members: DataFrame, scope: DataFrame, classified: DataFrame, metrics: DataFrame, evidence: DataFrame
) -> DataFrame:
    """The six invariants of a dataset, one row per dataset.

    `scope` holds (dataset_id, offer_id) of the open offers in scope, `classified` those of them with a
    classification of the dataset's version together with their observation columns.
    """
    counted = members.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("members"))
    done = classified.select("dataset_id", "offer_id").withColumn("done", F.lit(True))
    scoped = scope.join(done, ["dataset_id", "offer_id"], "left").groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("scope_count"), F.count_if(F.col("done").isNull()).alias("missing_classifications")
    )
    measured = metrics.filter(F.col("metric_key").isin(*MAIN_METRICS)).select("dataset_id", "metric_key").distinct()
    measured = measured.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("metrics"))
    text = F.length(F.trim("excerpt")) > 0
    proofs = evidence.groupBy("classification_id").agg(
        F.bool_or((F.col("kind") == "junior_claim") & text).alias("claim_proof"),
        F.bool_or((F.col("kind") == "required_experience") & text).alias("duration_proof"),
    )
    resolved = F.col("junior_observation_status") == "resolved"
    no = lambda c: ~F.coalesce(c, F.lit(False))
    gap = (
        F.col("junior_observation_status").isNull()
        | (resolved & no("claim_proof"))
        | (F.coalesce("junior_observation_contradictory", F.lit(False)) & no("duration_proof"))
    )
    gaps = (
        members.select("dataset_id", "offer_id", "classification_id")
        .join(classified.drop("offer_id", "dataset_id"), "classification_id")
        .join(proofs, "classification_id", "left")
        .groupBy("dataset_id")
        .agg(F.count_if(gap).alias("evidence_gaps"))
    )
    facts = dataset.join(counted, "dataset_id", "left").join(scoped, "dataset_id", "left")
    facts = facts.join(measured, "dataset_id", "left").join(gaps, "dataset_id", "left")
    facts = facts.fillna(0, ["members", "scope_count", "missing_classifications", "metrics", "evidence_gaps"])
    checks = {
        "publish_decision": F.col("decision").isin(*PUBLISHABLE),
        "has_members": F.col("members") > 0,
        "membership_matches_scope": F.col("members") == F.col("scope_count"),
        "classifications_complete": F.col("missing_classifications") == 0,
        "metric_present": F.col("metrics") == len(MAIN_METRICS),
        "evidence_complete": (F.col("junior_metric_version") != R.CONTRADICTION_V2) | (F.col("evidence_gaps") == 0),
    }
    all_hold = F.lit(True)
    for check in checks.values():
        all_hold = all_hold & check
    valid = F.col("status").isin("validated", "published") | ((F.col("status") == "draft") & all_hold)
    return facts.select("dataset_id", *[c.alias(n) for n, c in checks.items()], valid.alias("validated"))


def publication_log(datasets: DataFrame, members: DataFrame, metrics: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """Status of every dataset after all publications and rollbacks, with the current one flagged.

    Only decided datasets with members and the main metric can be current. A rollback withdraws what was
    current at that instant and brings its target back; the last action of a source decides.
    """
    ready = datasets.filter(F.col("decision").isin(*PUBLISHABLE) & F.col("status").isin("validated", "published", "withdrawn"))
    ready = ready.join(members.select("dataset_id").distinct(), "dataset_id", "left_semi")
    ready = ready.join(metrics.filter(F.col("metric_key") == R.CONTRADICTION).select("dataset_id").distinct(), "dataset_id", "left_semi")
    published = ready.filter(F.col("published_at").isNotNull()).select("source_id", "dataset_id", F.col("published_at").alias("at"))
    restored = rollbacks.drop("source_id").join(ready.select("source_id", "dataset_id"), "dataset_id").select(
        "source_id", "dataset_id", F.col("rolled_back_at").alias("at")
    )
    current = first_by(published.unionByName(restored), ["source_id"], ["at", "dataset_id"], descending=True)
    withdrawn = withdrawals(published.unionByName(restored), rollbacks).join(current.select("dataset_id"), "dataset_id", "left_anti").select("dataset_id").withColumn("withdrawn", F.lit(True))
    flagged = (
        datasets.join(current.select("dataset_id", F.lit(True).alias("chosen")), "dataset_id", "left")
        .join(withdrawn.distinct(), "dataset_id", "left")
        .withColumn("is_current", F.coalesce("chosen", F.lit(False)))
    )
    status = F.when(F.col("is_current"), "published").when(F.col("withdrawn"), "withdrawn").otherwise(F.col("status"))
    return flagged.withColumn("status", status).drop("chosen", "withdrawn")


def withdrawals(published: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """What each rollback withdrew: the last publication or restore before it, unless that is the target itself."""
    before = rollbacks.select(F.col("dataset_id").alias("target_id"), "source_id", "rolled_back_at").join(published, "source_id")
    before = before.filter(F.col("at") < F.col("rolled_back_at"))
    last = first_by(before, ["source_id", "rolled_back_at"], ["at", "dataset_id"], descending=True)
    return last.filter(F.col("dataset_id") != F.col("target_id"))


def current_dataset(datasets: DataFrame, members: DataFrame) -> DataFrame:
    """The one current published dataset with its member count; none or several is an error."""
    current = datasets.filter(F.col("is_current") & (F.col("status") == "published") & F.col("published_at").isNotNull())
    counted = members.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("member_count"))
    joined = current.join(counted, "dataset_id", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0)))
    row = joined.agg(F.count(F.lit(1)).alias("found"), F.first(F.struct("*")).alias("row"))
    checked = F.when(F.col("found") == 1, F.col("row")).otherwise(
        F.raise_error(F.concat(F.lit("expected one current dataset, found "), F.col("found").cast("string")))
    )
    return row.select(F.col("row").alias("_r"), checked.cast(joined.schema).alias("row")).select("row.*")


def answer_meta(current: DataFrame) -> DataFrame:
    """What stands beside every answer: date and versions of the data, sample size, quality and warnings."""
    partial = F.col("decision") == "publish_partial"
    return current.select(
        F.col("source_cutoff_at").alias("data_as_of"),
        "dataset_version",
        "classifier_version",
        "query_set_version",
        F.col("member_count").alias("sample_size"),
        F.when(partial, "partial").otherwise("normal").alias("quality"),
        F.when(partial, F.array(F.lit("PARTIAL_COLLECTION"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


# ---------------------------------------------------------------- invariants


def metric_invariants(metrics: DataFrame) -> DataFrame:
    """Stored metrics that break a rule, with its code; must be empty."""
    num, den, pop = F.col("numerator"), F.col("denominator"), F.col("population_count")
    insufficient = F.col("sample_quality") == "insufficient"
    checks = {
        "counts_out_of_order": (num < 0) | (num > den) | (den > pop),
        "population_does_not_add_up": pop != den + F.col("unknown_count") + F.col("ambiguous_count"),
        "value_presence": F.col("value").isNull() != insufficient,
        "value_out_of_range": ~F.col("value").between(0, 1),
        "coverage_presence": F.col("coverage").isNull() != (pop == 0),
        "coverage_out_of_range": ~F.col("coverage").between(0, 1),
    }
    return _violations(metrics, checks)


def classification_invariants(rows: DataFrame) -> DataFrame:
    """Classifications whose answers contradict each other, with the code; must be empty."""
    axis, contradictory = F.col("junior_observation_status"), F.col("junior_observation_contradictory")
    months = F.col("minimum_experience_months")
    answers = F.coalesce(*[F.col(c).cast("string") for c in ("claims_junior", "beginner_friendly", "contradictory_junior")], months.cast("string"))
    checks = {
        "observation_not_consistent": (axis == "resolved") != contradictory.isNotNull(),
        "observation_without_claim": (axis == "resolved") & ~F.coalesce("claims_junior", F.lit(False)),
        "unclassified_with_answers": (F.col("status") == "unclassified") & answers.isNotNull(),
        "ambiguous_with_derived": (F.col("status") == "ambiguous")
        & (F.col("beginner_friendly").isNotNull() | F.col("contradictory_junior").isNotNull()),
        "contradictory_without_months": F.coalesce("contradictory_junior", F.lit(False))
        & ~F.coalesce((months >= R.CONTRADICTION_MONTHS) & F.col("claims_junior"), F.lit(False)),
        "negative_months": months < 0,
    }
    return _violations(rows, checks)


def _violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(check, F.lit(code)) for code, check in checks.items()]))
    return rows.withColumn("code", F.explode(codes))


# ---------------------------------------------------------------- retention, insights, incidents


def purge_payloads(snapshots: DataFrame, now: Column) -> DataFrame:
    """Raw payloads past their expiry become null; everything published from them stays."""
    expired = F.col("raw_payload").isNotNull() & (F.col("raw_payload_expires_at") <= now)
    kept = lambda c: F.when(~F.coalesce(expired, F.lit(False)), F.col(c)).alias(c)
    return snapshots.select(
        *[kept(c) if c in ("raw_payload", "raw_payload_expires_at") else F.col(c) for c in snapshots.columns]
    )


def expired_quarantine(quarantine: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Quarantine rows older than thirty days of finished runs."""
    finished = runs.filter(F.col("status").isin("succeeded", "partial", "failed", "cancelled")).select("run_id")
    old = quarantine.filter(F.col("created_at") < now - F.make_dt_interval(F.lit(30)))
    return old.join(finished, "run_id", "left_semi")


def retention(snapshots: DataFrame, quarantine: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Counts of one retention pass, for its audit row."""
    expired = F.col("raw_payload").isNotNull() & (F.col("raw_payload_expires_at") <= now)
    errors = expired_quarantine(quarantine, runs, now).agg(F.count(F.lit(1)))
    raw = snapshots.agg(F.count_if(expired).alias("raw_payloads"))
    return raw.withColumn("validation_errors", errors.scalar())


def purge_quarantine(quarantine: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """The quarantine without the rows older than thirty days of finished runs."""
    finished = runs.filter(F.col("status").isin("succeeded", "partial", "failed", "cancelled")).select("run_id").distinct().withColumn("_finished", F.lit(True))
    old = F.col("_finished") & (F.col("created_at") < now - F.make_dt_interval(F.lit(30)))
    return quarantine.join(finished, "run_id", "left").filter(~F.coalesce(old, F.lit(False))).drop("_finished")


def retention_event(counts: DataFrame, now: Column) -> DataFrame:
    """The audit row of a retention pass; none when it removed nothing."""
    done = counts.filter(F.col("raw_payloads") + F.col("validation_errors") > 0)
    details = F.to_json(F.struct(F.col("raw_payloads").alias("rawPayloads"), F.col("validation_errors").alias("validationErrors")))
    return done.select(
        F.lit("info").alias("severity"), F.lit("RETENTION_PURGED").alias("event_code"), F.lit("maintenance").alias("scope"), details.alias("details"),
        F.lit(False).alias("is_public"), now.alias("created_at"), now.alias("resolved_at"),
    )


# Published wording of the insights.
INSIGHT_SLUGS = {
    R.CONTRADICTION: "junior-et-deux-ans-france-",
    R.BEGINNER: "debutants-explicitement-acceptes-france-",
    R.SALARY: "transparence-salariale-france-",
}
INSIGHT_TITLES = {
    R.CONTRADICTION: " des offres junior classables demandent au moins deux ans d’expérience",
    R.BEGINNER: " des offres classables sont explicitement accessibles aux débutants",
    R.SALARY: " des offres publient une rémunération exploitable",
}


# Fixed value: French pages group digits and set off the percent sign with a narrow no-break space.
_NARROW = "\u202f"


def _french_number(value: Column, decimals: int = 0) -> Column:
    return F.translate(F.format_number(value, decimals), ",.", _NARROW + ",")


def _french_percent(value: Column) -> Column:
    """Percent with at most one decimal."""
    number = F.regexp_replace(_french_number(F.round(value * 100, 1), 1), ",0$", "")
    return F.concat(number, F.lit(_NARROW + "%"))


def insight_drafts(metrics: DataFrame, current: DataFrame) -> DataFrame:
    """Insight rows of the current dataset from its overall metrics; an insufficient sample is an error."""
    rows = metrics.join(F.broadcast(current.select("dataset_id")), "dataset_id", "left_semi")
    rows = rows.filter(F.col("metric_key").isin(*MAIN_METRICS))
    value = F.when(F.col("sample_quality") != "insufficient", F.col("value").cast("double")).otherwise(
        F.raise_error(F.concat(F.lit("no publishable sample: "), F.col("metric_key"))).cast("double")
    )
    pick = lambda texts: F.try_element_at(F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), F.lit(v))]), F.col("metric_key"))
    fraction = F.concat_ws(" sur ", *[_french_number(F.col(c)) for c in ("numerator", "denominator")])
    return rows.select(
        F.concat(pick(INSIGHT_SLUGS), F.col("period_end").cast("string")).alias("slug"),
        F.concat(_french_percent(value), pick(INSIGHT_TITLES)).alias("title"),
        F.concat(fraction, F.lit(" offres")).alias("fraction"),
        "dataset_id",
        "metric_key",
        "metric_version",
        "numerator",
        "denominator",
    )


def publish_insights(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """Drafts to insert. A stored insight of the same slug must be the same snapshot, else it is an error."""
    same = ["dataset_id", "metric_key", "metric_version", "numerator", "denominator"]
    old = stored.filter(F.col("status").isin("published", "corrected")).select("slug", F.struct(*same).alias("stored"))
    joined = drafts.join(old, "slug", "left")
    differs = F.col("stored").isNotNull() & (F.col("stored") != F.struct(*same))
    checked = F.when(differs, F.raise_error(F.concat(F.lit("insight exists with another snapshot: "), F.col("slug")))).otherwise(F.col("slug"))
    return joined.withColumn("slug", checked.cast("string")).filter(F.col("stored").isNull()).drop("stored")


def insight_list(insights: DataFrame, limit: int = 12) -> DataFrame:
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1..50")
    shown = insights.filter(F.col("status").isin("published", "corrected") & F.col("published_at").isNotNull())
    return shown.orderBy(F.desc("published_at"), "slug").limit(limit)


def recovered_incidents(datasets: DataFrame, events: DataFrame) -> DataFrame:
    """An event per withdrawn dataset and its first rollback audit, unless it is recorded already."""
    audits = events.filter(F.col("event_code") == "DATASET_ROLLBACK").select("dataset_id", F.col("created_at").alias("resolved_at"))
    withdrawn = datasets.filter((F.col("status") == "withdrawn") & F.col("published_at").isNotNull())
    pairs = withdrawn.select("dataset_id", F.col("published_at").alias("created_at")).join(audits, "dataset_id")
    first = first_by(pairs.filter(F.col("resolved_at") >= F.col("created_at")), ["dataset_id"], ["resolved_at"])
    known = events.filter(F.col("event_code") == "PUBLICATION_CONTRACT_RECOVERED").select("dataset_id")
    return first.join(known, "dataset_id", "left_anti").select(
        "dataset_id", F.lit("warning").alias("severity"), F.lit("PUBLICATION_CONTRACT_RECOVERED").alias("event_code"),
        F.lit(True).alias("is_public"), "created_at", "resolved_at",
    )


def republish_method(current: DataFrame, members: DataFrame, classifications: DataFrame, version: str, classifier: str, metric_version: str) -> tuple[DataFrame, DataFrame]:
    """A new dataset over the same members under a new method: same cutoff, new classifications, no new intake.

    Returns the dataset row and its membership; members without a classification of the new version
    keep a null there, which validation refuses.
    """
    dataset = (
        current.withColumn("dataset_id", F.lit(version))
        .withColumn("dataset_version", F.lit(version))
        .withColumn("classifier_version", F.lit(classifier))
        .withColumn("junior_metric_version", F.lit(metric_version))
        .withColumn("status", F.lit("draft"))
        .withColumn("is_current", F.lit(False))
        .withColumn("published_at", F.lit(None).cast("timestamp"))
    )
    fresh = classifications.filter(F.col("classifier_version") == classifier).select("snapshot_id", F.col("classification_id").alias("_new"))
    fresh = first_by(fresh, ["snapshot_id"], ["_new"])
    kept = members.join(F.broadcast(current.select("dataset_id")), "dataset_id", "left_semi").join(fresh, "snapshot_id", "left")
    return dataset, kept.select(F.lit(version).alias("dataset_id"), "offer_id", "snapshot_id", F.col("_new").alias("classification_id"), "job_families")
