"""The shared scope of all read models: job family, technologies, area, contracts, remote mode, period."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.offers import CONTRACT_KINDS, REMOTE_MODES

# Job families, area kinds and periods a scope may name.
JOB_FAMILIES = (
    "frontend", "backend", "fullstack", "mobile", "software", "data", "ai-ml", "devops-cloud", "cybersecurity", "qa-test",
)
AREAS = {"region": "region_code", "department": "department_code", "commune": "commune_code"}
PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90, "current": None}
MAX_TECHNOLOGIES = 3


def split_list(values: str | Iterable[str] | None) -> tuple[str, ...]:
    """Trimmed, distinct, sorted, without empty items."""
    items = values.split(",") if isinstance(values, str) else values or ()
    return tuple(sorted({item.strip() for item in items} - {""}))


def normalized_list(value: Column) -> Column:
    """The same normal form for a column of comma lists, as one comma list."""
    items = F.transform(F.split(value, ","), lambda item: F.trim(item))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(items, lambda i: i != ""))), ",")


@dataclass(frozen=True)
class Scope:
    job: str | None = None
    technologies: str | Iterable[str] | None = field(default=())
    area: str = "france"
    contracts: str | Iterable[str] | None = field(default=())
    remote: str | None = None
    period: str = "30d"

    def __post_init__(self):
        object.__setattr__(self, "technologies", split_list(self.technologies))
        object.__setattr__(self, "contracts", split_list(self.contracts))
        unknown = [
            self.job is not None and self.job not in JOB_FAMILIES,
            len(self.technologies) > MAX_TECHNOLOGIES,
            self.area != "france" and self.area.partition(":")[0] not in AREAS,
            not set(self.contracts) <= set(CONTRACT_KINDS),
            self.remote is not None and self.remote not in REMOTE_MODES,
            self.period not in PERIOD_DAYS,
        ]
        if any(unknown):
            raise ValueError(f"unknown value in scope: {self}")


def with_all_technologies(rows: DataFrame, mentions: DataFrame, slugs: Iterable[str]) -> DataFrame:
    """Rows whose classification mentions every requested technology.

    One partial aggregate over the requested slugs alone, then a semi join: the bridge table is cut to
    the few requested slugs at the scan and one boolean per slug is combined before the shuffle.
    """
    slugs = list(slugs)
    if not slugs:
        return rows
    found = [F.bool_or(F.col("slug") == slug).alias(f"has_{i}") for i, slug in enumerate(slugs)]
    complete = mentions.filter(F.col("slug").isin(slugs)).groupBy("classification_id").agg(*found)
    for i in range(len(slugs)):
        complete = complete.filter(F.col(f"has_{i}"))
    return rows.join(complete.select("classification_id"), "classification_id", "left_semi")


def scope_filter(rows: DataFrame, scope: Scope, mentions: DataFrame | None = None) -> DataFrame:
    """Rows of the scope; only filters that are set reach the plan. A period drops offers without a date."""
    if scope.job is not None:
        rows = rows.filter(F.array_contains("job_families", scope.job))
    if scope.area != "france":
        kind, _, code = scope.area.partition(":")
        rows = rows.filter(F.col(AREAS[kind]) == code)
    if scope.contracts:
        rows = rows.filter(F.col("contract_kind").isin(*scope.contracts))
    if scope.remote is not None:
        rows = rows.filter(F.col("remote_mode") == scope.remote)
    days = PERIOD_DAYS[scope.period]
    if days is not None:
        rows = rows.filter(F.col("source_published_at") >= F.col("source_cutoff_at") - F.make_dt_interval(F.lit(days)))
    if scope.technologies:
        rows = with_all_technologies(rows, mentions, scope.technologies)
    return rows


def membership_rows(datasets: DataFrame, memberships: DataFrame, snapshots: DataFrame, classifications: DataFrame) -> DataFrame:
    """Dataset x membership x snapshot x classification. Datasets are few; the rest joins on its keys."""
    facts = memberships.join(datasets, "dataset_id")
    facts = facts.join(snapshots.drop("offer_id"), "snapshot_id")
    return facts.join(classifications.drop("snapshot_id", "classifier_version"), "classification_id")
