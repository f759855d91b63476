"""Column expressions of one offer: contract, experience, salary, labels, ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.text import trimmed_or_null

# Vocabularies of the published contract.
CONTRACT_KINDS = ("cdi", "cdd", "interim", "alternance", "internship", "freelance", "public", "other", "unknown")
REMOTE_MODES = ("remote", "hybrid", "onsite", "unknown")
EXPERIENCE_BUCKETS = ("none", "1_12", "13_23", "24_35", "36_59", "60_plus", "unknown", "ambiguous")
SEGMENTS = (
    "contradictory",
    "beginner_friendly",
    "junior_unresolved",
    "other_junior",
    "not_explicitly_junior",
    "ambiguous",
    "unknown",
)


def contract_kind(alternance: Column, code: Column) -> Column:
    """The apprenticeship flag wins over the contract code."""
    return (
        F.when(alternance, "alternance")
        .when(code == "CDI", "cdi")
        .when(code == "CDD", "cdd")
        .when(code == "MIS", "interim")
        .when(code == "SAI", "other")
        .otherwise("unknown")
    )


def structured_experience(code: Column) -> Column:
    """E is required; D (beginner) and S (wished) are not; anything else is not known."""
    return F.when(code == "E", True).when(code.isin("D", "S"), False)


def salary_label(*parts: Column) -> Column:
    """The non-empty parts joined by a middle dot; null when nothing is left."""
    return F.nullif(F.concat_ws(" · ", *[trimmed_or_null(p) for p in parts]), F.lit(""))


def segment_label(observation_metric: Column) -> Column:
    """The seven publication segments, in strict order of precedence."""
    classified = F.col("status") == "classified"
    junior = F.col("claims_junior")
    beginner = F.col("beginner_friendly")
    contradictory = F.col("contradictory_junior")
    return (
        F.when(
            observation_metric
            & (F.col("junior_observation_status") == "resolved")
            & F.col("junior_observation_contradictory"),
            "contradictory",
        )
        .when(F.col("status") == "ambiguous", "ambiguous")
        .when(F.col("status") == "unclassified", "unknown")
        .when(classified & contradictory, "contradictory")
        .when(classified & beginner, "beginner_friendly")
        .when(classified & junior & (beginner.isNull() | contradictory.isNull()), "junior_unresolved")
        .when(classified & junior & ~beginner & ~contradictory, "other_junior")
        .when(classified & ~junior, "not_explicitly_junior")
        .otherwise("unknown")
    )


def experience_bucket(status: Column, months: Column) -> Column:
    """Bucket of the resolved minimum; ambiguity is tested before the missing value."""
    return (
        F.when(status == "ambiguous", "ambiguous")
        .when(months.isNull(), "unknown")
        .when(months == 0, "none")
        .when(months <= 12, "1_12")
        .when(months <= 23, "13_23")
        .when(months <= 35, "24_35")
        .when(months <= 59, "36_59")
        .otherwise("60_plus")
    )


def availability(closed_at: Column, missing_since: Column) -> Column:
    return F.when(closed_at.isNotNull(), "closed").when(missing_since.isNotNull(), "not_seen").otherwise("active")


def visible_when_open(closed_at: Column, value: Column) -> Column:
    """Company, place and link are hidden once an offer is closed."""
    return F.when(closed_at.isNull(), value)


# Public length limits.
CLIP = {"title": 250, "company_name": 250, "location_label": 250, "contract_label": 150, "excerpt": 700, "warning": 120, "source_label": 100}


def clipped(value: Column, field: str) -> Column:
    return F.substring(value, 1, CLIP[field])


def business_date(instant: Column) -> Column:
    """Calendar day in Paris of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, "Europe/Paris"))


def content_hash(*columns: str) -> Column:
    """Hash over the content columns; null fields are kept so that null differs from absent text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


# What counts as content of an offer. Dates and the raw payload do not.
CONTENT_COLUMNS = (
    "title",
    "description_text",
    "company_name",
    "location",
    "contract",
    "structured_experience",
    "salary",
    "application_url",
    "source_url",
)


def dataset_version(started_at: Column, classifier: Column, query_set: Column, metric_version: Column) -> Column:
    """Version of a published dataset; a length outside 1..100 is an error."""
    label = F.regexp_replace(metric_version, "^junior-contradiction-", "kpi-")
    instant = F.date_format(started_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    version = F.concat_ws("__", instant, classifier, query_set, label, F.lit("source-pages-1"))
    return F.when(F.length(version).between(1, 100), version).otherwise(
        F.raise_error(F.lit("dataset version must have 1 to 100 characters"))
    )


def _base64url(value: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(value), "+/", "-_"), "[=\r\n]+", "")


def public_offer_id(uuid: Column) -> Column:
    return F.concat(F.lit("offer_"), _base64url(F.unhex(F.replace(uuid, F.lit("-"), F.lit("")))))


def public_incident_id(event_id: Column) -> Column:
    digest = F.unhex(F.sha2(event_id, 256))
    return F.concat(F.lit("incident_"), F.substring(_base64url(digest), 1, 16))


def filter_fingerprint(filters: Column) -> Column:
    """Hash of the filters of a page, which ties a page token to its query."""
    return F.sha2(F.to_json(filters, {"ignoreNullFields": "false"}), 256)
