"""The daily collection: landed pages become one published dataset, step by step.

Every step reads tables and writes one folder named by table and run, so a step that runs again replaces exactly its
own rows. A run becomes visible by its last folder, the one row of `runs`: readers and later runs only know runs that
have it. A job that dies at any step leaves the dataset before it current, and run again it goes on where it stopped.

    store = Store(spark, "/data/observatory")
    collect_daily(store, Run("R2024-01-30", started_at, "queries-3", landing), queries, groups)
    metrics.overview(dataset_rows(store, current_run(store)), mentions(store, current_run(store)))
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerlens.functions import offers as O
from offerlens.functions import rates as R
from offerlens.operators import classify as C
from offerlens.operators import history as H
from offerlens.operators import metrics as M
from offerlens.operators import normalize as N
from offerlens.operators import publish as Pu
from offerlens.operators import quality as Q
from offerlens.operators.skew import first_by
from offerlens.sources import pages as S
from offerlens.sources import tables as T

METRIC_VERSION = R.CONTRADICTION_V2


@dataclass(frozen=True)
class Run:
    """A collection: its pages lie in `landing`, with query, range start and payload."""

    run_id: str
    started_at: dt.datetime
    query_set: str
    landing: str
    source_id: str = "source-1"
    classifier: str = C.CLASSIFIER_VERSION
    #: The run whose state this one goes on from, and all up to it, found when the run starts.
    before: str | None = None
    earlier: tuple[str, ...] = ()

    @property
    def instant(self) -> Column:
        return F.lit(self.started_at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")

    @property
    def day(self) -> Column:
        return O.business_date(self.instant)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    #: Columns of the tables written by this object, which need not be read from their files again.
    known: dict[str, StructType] = field(default_factory=dict, compare=False, repr=False)

    def folder(self, table: str, run_id: str) -> str:
        return f"{self.path}/{table}/{run_id}"

    def write(self, table: str, run: Run, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(self.folder(table, run.run_id))
        self.known[table] = rows.schema

    def has(self, table: str, run_id: str | None) -> bool:
        return run_id is not None and T.is_complete(self.spark, self.folder(table, run_id))

    def read(self, table: str, *run_ids: str | None) -> DataFrame:
        """The rows that some runs wrote; a run that is not there (None) has none."""
        found = [self.folder(table, r) for r in run_ids if self.has(table, r)]
        if not found:
            raise FileNotFoundError(f"no run has written {table}")
        reader = self.spark.read.schema(self.known[table]) if table in self.known else self.spark.read
        return reader.parquet(*found)

    def runs(self) -> list[str]:
        """Finished runs, the oldest first. They are as many as there are days."""
        names = T.folder_names(self.spark, f"{self.path}/runs")
        done = [n for n in names if self.has("runs", n)]
        if not done:
            return []
        return [r.run_id for r in self.read("runs", *done).orderBy("started_at", "run_id").select("run_id").collect()]

def _so_far(store: Store, run: Run, table: str, own: bool = True) -> DataFrame:
    """What the runs before, and this one, added to a table."""
    return store.read(table, *run.earlier, *([run.run_id] if own else []))


# ---------------------------------------------------------------- steps


def land(store: Store, run: Run, queries: DataFrame, groups: list[dict]) -> None:
    """Pages once per key, their items judged one by one. A page is parsed once and a text normalized once."""
    pages = S.parsed_pages(S.read_pages(store.spark, run.landing).dropDuplicates(["query_key", "range_start"]))
    store.write("judged_items", run, S.validate_contract(S.read_enveloped_pages(pages)))
    judged = store.read("judged_items", run.run_id)
    checked = judged.filter(F.col("item_ordinal").isNotNull()).drop(*S.ENVELOPE)
    keys, page = ["query_key", "range_start", "item_ordinal"], ["query_key", "range_start"]
    store.write("quarantine", run, S.quarantined_items(checked).select(*keys, F.to_json("raw").alias("raw"), "issues"))
    store.write("items", run, N.with_content_hash(N.normalize_offers(S.valid_items(checked))))
    normalized = store.read("items", run.run_id)
    admitted = N.title_perimeter(normalized, groups) if groups else normalized.withColumn("job_families", F.lit(None).cast("array<string>"))
    store.write("observations", run, admitted.select("query_key", F.col("external_id").alias("offer_id"), "range_start", "item_ordinal", "content_hash", "job_families"))
    inside = store.read("observations", run.run_id).groupBy(*page).agg(F.count(F.lit(1)).alias("in_perimeter_count"))
    enveloped = judged.groupBy(*page).agg(*[F.any_value(c).alias(c) for c in S.ENVELOPE])
    status = S.page_status(enveloped, checked, S.unknown_field_report(checked)).join(inside, page, "left")
    last = status.groupBy("query_key").agg(F.max("range_start").alias("last_start"), F.sum("received").alias("source_total"))
    facts = status.join(last, "query_key").select(
        F.lit(run.run_id).alias("run_id"), F.col("query_key").alias("query_id"), "range_start", "status", "root_issue",
        F.when(F.col("range_start") < F.col("last_start"), F.col("range_start") + F.col("received")).alias("next_range_start"),
        (F.col("range_start") == F.col("last_start")).alias("is_terminal"),
        F.col("received").alias("received_count"), (F.col("received") - F.col("quarantined")).alias("valid_count"),
        F.col("quarantined").alias("quarantined_count"), F.coalesce("in_perimeter_count", F.lit(0)).alias("in_perimeter_count"),
        F.col("warnings").alias("warning_count"), "source_total", run.instant.alias("committed_at"),
    )
    store.write("pages", run, facts)


def remember(store: Store, run: Run, queries: DataFrame, groups: list[dict]) -> None:
    """Offer state, snapshots and sightings after the run. The content of a snapshot is stored once, when it is new."""
    seen = store.read("observations", run.run_id).withColumn("observed_at", run.instant)
    latest = first_by(seen, ["offer_id"], ["query_key", "range_start", "item_ordinal"])
    if run.before:
        state, snapshots = store.read("offers", run.before), store.read("snapshots", run.before)
    else:
        state = store.spark.createDataFrame([], "offer_id string, first_seen_at timestamp, last_seen_at timestamp, missing_since timestamp, closed_at timestamp, reopened_count int")
        snapshots = store.spark.createDataFrame([], "snapshot_id string, offer_id string, content_hash string, valid_from timestamp, valid_to timestamp")
    applied = H.apply_snapshots(snapshots.drop("snapshot_id"), latest.select("offer_id", "content_hash", "observed_at"))
    named = F.sha2(F.concat_ws("|", "offer_id", "content_hash", F.unix_micros("valid_from").cast("string")), 256)
    store.write("snapshots_all", run, applied.withColumn("snapshot_id", named))
    every = store.read("snapshots_all", run.run_id)
    store.write("snapshots_closed", run, every.filter(F.col("valid_to").isNotNull()))
    store.write("snapshots", run, every.filter(F.col("valid_to").isNull()))

    opened = store.read("snapshots", run.run_id)
    fresh = opened.join(snapshots.select("snapshot_id"), "snapshot_id", "left_anti").select("snapshot_id", "offer_id")
    place = latest.select("offer_id", "query_key", "range_start", "item_ordinal")
    content = store.read("items", run.run_id).join(place, ["query_key", "range_start", "item_ordinal"]).drop("query_key", "range_start", "item_ordinal", "external_id")
    store.write("contents", run, content.join(fresh, "offer_id"))

    known = state.select("offer_id", F.lit(True).alias("known"))
    found = seen.groupBy("offer_id", F.col("query_key").alias("query_id")).agg(
        F.max("observed_at").alias("observed_at"), F.min_by("job_families", F.struct("range_start", "item_ordinal")).alias("job_families"),
        F.lit(0).cast("long").alias("event_id"),
    )
    flagged = found.join(known, "offer_id", "left").join(fresh.select("offer_id", F.lit(True).alias("fresh")), "offer_id", "left")
    store.write("sightings", run, flagged.select(
        F.lit(run.run_id).alias("run_id"), "query_id", "offer_id", "observed_at", F.col("known").isNull().alias("offer_created"),
        F.coalesce("fresh", F.lit(False)).alias("snapshot_created"), "job_families",
    ))
    batch = H.record_matches(found.join(queries.select("query_id", F.col("job_families").alias("of_query")), "query_id").withColumn("job_families", F.coalesce("job_families", "of_query")))
    store.write("matches", run, H.merge_matches(store.read("matches", run.before), batch) if run.before else batch)
    store.write("offers_seen", run, H.upsert_offers(state, store.read("sightings", run.run_id)))


def judge(store: Store, run: Run, queries: DataFrame, groups: list[dict]) -> None:
    """Classify the open snapshots that this version of the rules has not seen, with evidence and mentions."""
    opened = store.read("snapshots", run.run_id).select("snapshot_id")
    contents = _so_far(store, run, "contents").join(opened, "snapshot_id", "left_semi")
    texts = contents.select(
        "snapshot_id", "title", "description_text", F.col("structured_experience.required").alias("experience_required"),
        F.col("structured_experience.label").alias("experience_label"), F.col("salary.label").alias("salary_label"),
    )
    done = store.spark.createDataFrame([], "snapshot_id string, classifier_version string")
    if run.before:
        done = _so_far(store, run, "classifications", own=False).select("snapshot_id", "classifier_version")
    results = C.reclassify_backfill(texts, done, run.classifier).drop("title", "description_text", "experience_required", "experience_label", "salary_label")
    store.write("classifications", run, results.withColumn("classification_id", F.sha2(F.concat_ws("|", "snapshot_id", "classifier_version"), 256)))
    proofs = C.evidence_table(store.read("classifications", run.run_id))
    store.write("evidence", run, proofs)
    store.write("mentions", run, C.technology_mentions(store.read("evidence", run.run_id)))


def _run_rows(store: Store, run: Run) -> DataFrame:
    """This run and the one before it, as the quality rules read them."""
    counts = store.read("pages", run.run_id).agg(*[F.coalesce(F.sum(f"{c}_count"), F.lit(0)).alias(f"offers_{c}") for c in ("received", "valid", "quarantined")])
    own = counts.select(
        F.lit(run.run_id).alias("run_id"), F.lit(run.source_id).alias("source_id"), F.lit("full").alias("mode"), F.lit(run.query_set).alias("query_set_version"), run.day.alias("business_date"),
        run.instant.alias("created_at"), run.instant.alias("started_at"), F.lit("succeeded").alias("status"), F.lit(True).alias("closure_eligible"),
        "offers_received", "offers_valid", "offers_quarantined", F.lit(0).cast("long").alias("offers_new"), F.lit(0).cast("long").alias("offers_updated"),
    )
    return own.unionByName(store.read("runs", run.before).select(*own.columns)) if run.before else own


def decide(store: Store, run: Run, queries: DataFrame, groups: list[dict]) -> None:
    """The facts of the run and whether it may be published."""
    both = [run.before, run.run_id]
    complete = Q.query_completeness(store.read("pages", run.run_id))
    known = queries.filter("enabled and valid_to is null").select(F.lit(run.run_id).alias("run_id"), "query_id").distinct()
    status = known.join(complete.select("run_id", "query_id", "complete"), ["run_id", "query_id"], "left")
    store.write("run_queries", run, status.select("run_id", "query_id", F.when(F.col("complete"), "succeeded").otherwise("failed").alias("status")))
    facts = Q.run_quality_facts(
        _run_rows(store, run), store.read("run_queries", *both), store.read("pages", *both), store.read("sightings", *both),
        store.read("snapshots", run.run_id), _so_far(store, run, "classifications"), _so_far(store, run, "evidence"), run.classifier,
    )
    store.write("decisions", run, Q.quality_decision(facts.filter(F.col("run_id") == run.run_id)))


def age(store: Store, run: Run, queries: DataFrame, groups: list[dict]) -> None:
    """Offers that the run no longer has are marked missing, after two eligible runs closed."""
    offers, both = store.read("offers_seen", run.run_id), [run.before, run.run_id]
    eligible = store.read("decisions", run.run_id).select("run_id", F.col("closure_eligible").alias("may_close"))
    runs = _run_rows(store, run).join(eligible, "run_id", "left").withColumn("closure_eligible", F.coalesce("may_close", "closure_eligible")).drop("may_close")
    scope = Pu.active_scope(offers, store.read("matches", run.run_id), queries, run.query_set)
    after = H.apply_absences(offers, scope, store.read("sightings", *both), runs, store.read("run_queries", *both), run.run_id, run.instant)
    store.write("offers", run, after)


def freeze(store: Store, run: Run, queries: DataFrame, groups: list[dict]) -> None:
    """The members of the dataset, pinned, and its metrics."""
    members = Pu.freeze_membership(
        run.run_id, run.query_set, run.classifier, store.read("offers", run.run_id), store.read("snapshots", run.run_id),
        _so_far(store, run, "classifications"), store.read("matches", run.run_id), queries,
    )
    store.write("members", run, members)
    answers = _so_far(store, run, "classifications").drop("snapshot_id", "classifier_version", "evidence", "warnings", "rule_ids")
    rows = store.read("members", run.run_id).join(answers, "classification_id").withColumn("junior_metric_version", F.lit(METRIC_VERSION))
    store.write("metrics", run, M.daily_metrics(rows, run.day))


def finish(store: Store, run: Run, queries: DataFrame, groups: list[dict]) -> None:
    """Validate, and close the run with its one row. Only a valid dataset is published."""
    decision = store.read("decisions", run.run_id)
    members = store.read("members", run.run_id)
    scope = Pu.active_scope(store.read("offers", run.run_id), store.read("matches", run.run_id), queries, run.query_set)
    scope = scope.select(F.lit(run.run_id).alias("dataset_id"), "offer_id")
    answers = _so_far(store, run, "classifications").filter(F.col("classifier_version") == run.classifier)
    opened = store.read("snapshots", run.run_id).select("snapshot_id", "offer_id")
    classified = answers.join(opened, "snapshot_id").withColumn("dataset_id", F.lit(run.run_id))
    draft = decision.select(
        F.lit(run.run_id).alias("dataset_id"), "decision", F.lit("draft").alias("status"), F.lit(METRIC_VERSION).alias("junior_metric_version")
    )
    valid = Pu.validate_dataset(draft, members, scope, classified, store.read("metrics", run.run_id), _so_far(store, run, "evidence"))
    state = store.read("offers", run.run_id).agg(
        F.count_if(F.col("missing_since") == run.instant).alias("offers_marked_missing"), F.count_if(F.col("closed_at") == run.instant).alias("offers_closed")
    )
    facts = store.read("pages", run.run_id).agg(F.max("committed_at").alias("source_cutoff_at"), F.sum("in_perimeter_count").alias("in_perimeter"))
    counted = members.agg(F.count(F.lit(1)).alias("members"))
    row = decision.join(valid.select(F.col("dataset_id").alias("run_id"), "validated"), "run_id")
    for part in (state, facts, counted):
        row = row.withColumns({c: part.select(c).scalar() for c in part.columns})
    published = F.col("validated") & F.col("decision").isin(*Pu.PUBLISHABLE)
    version = O.dataset_version(F.col("started_at"), F.lit(run.classifier), F.lit(run.query_set), F.lit(METRIC_VERSION))
    store.write("runs", run, row.select(
        "run_id", "source_id", "mode", "query_set_version", "business_date", "created_at", "started_at",
        F.when(F.col("decision") == "block", "failed").when(F.col("decision") == "publish_partial", "partial").otherwise("succeeded").alias("status"),
        "closure_eligible", "decision", "reasons", "offers_received", "offers_valid", "offers_quarantined", "in_perimeter", "unique_offers", "offers_new",
        "offers_updated", "offers_marked_missing", "offers_closed", "members", "source_cutoff_at", published.alias("is_published"),
        F.when(published, F.col("run_id")).alias("dataset_id"), F.when(published, version).alias("dataset_version"),
        F.lit(run.classifier).alias("classifier_version"), F.lit(METRIC_VERSION).alias("junior_metric_version"), F.lit(run.before).cast("string").alias("previous_run_id"),
    ).coalesce(1))


#: The steps in order with the last table that each writes.
STEPS: list[tuple[str, Callable]] = [("pages", land), ("offers_seen", remember), ("mentions", judge), ("decisions", decide), ("offers", age), ("metrics", freeze), ("runs", finish)]


def collect_daily(store: Store, run: Run, queries: DataFrame, groups: list[dict]) -> None:
    """Take a run through all steps, from the first that is not done.

    `queries` has query_id, query_set_version, enabled, valid_to and job_families; `groups` is the title perimeter,
    an empty list admits every title. A finished run is left as it is.
    """
    T.check_name(run.run_id)
    done = store.runs()
    if run.run_id in done:
        return
    run = replace(run, before=done[-1] if done else None, earlier=tuple(done))
    for table, step in STEPS:
        if not store.has(table, run.run_id):
            step(store, run, queries, groups)


# ---------------------------------------------------------------- reading


def current_run(store: Store) -> str | None:
    """The run whose dataset is current: the last published one."""
    done = store.runs()
    if not done:
        return None
    last = store.read("runs", *done).filter("is_published").orderBy(F.desc("started_at"), F.desc("run_id")).select("run_id").first()
    return last and last.run_id


def dataset_rows(store: Store, *run_ids: str) -> DataFrame:
    """Members of datasets with content, answers and dataset, as the read models expect them."""
    runs = store.read("runs", *run_ids).filter("is_published").select(
        "run_id", "dataset_id", "dataset_version", "source_cutoff_at", "junior_metric_version", "decision", "query_set_version", "classifier_version",
        F.lit("published").alias("dataset_status"), F.col("started_at").alias("published_at"),
    )
    earlier = store.runs()
    answers = store.read("classifications", *earlier).drop("snapshot_id", "classifier_version", "evidence", "warnings", "rule_ids")
    contents = store.read("contents", *earlier).drop("offer_id", "content_hash", "job_families")
    content = contents.select(
        "snapshot_id", "title", "company_name", "source_published_at", F.col("location.commune_code").alias("commune_code"),
        F.col("location.region_code").alias("region_code"), F.col("location.department_code").alias("department_code"), F.col("contract.normalized").alias("contract_kind"), "source_url",
    )
    return store.read("members", *run_ids).join(runs.drop("run_id"), "dataset_id").join(answers, "classification_id").join(content, "snapshot_id")


def mentions(store: Store) -> DataFrame:
    return store.read("mentions", *store.runs())
