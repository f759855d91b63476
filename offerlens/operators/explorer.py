"""The offer explorer: filters, keyset pages with nulls last, and details of the page rows only."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import offers as O
from offerlens.functions import rates as R
from offerlens.functions.text import safe_url
from offerlens.operators.scope import Scope, scope_filter

# Sorts and page limits.
SORTS = {
    "published_desc": ("source_published_at", True),
    "published_asc": ("source_published_at", False),
    "experience_desc": ("minimum_experience_months", True),
    "experience_asc": ("minimum_experience_months", False),
}
DEFAULT_LIMIT = 25
MAX_LIMIT = 50


def explorer_rows(rows: DataFrame) -> DataFrame:
    observation = F.col("junior_metric_version") == R.CONTRADICTION_V2
    return rows.withColumn("segment", O.segment_label(observation)).withColumn(
        "bucket", O.experience_bucket(F.col("status"), F.col("minimum_experience_months"))
    )


def explorer_filter(
    rows: DataFrame,
    scope: Scope,
    mentions: DataFrame | None = None,
    segment: str | None = None,
    salary_published: bool | None = None,
    buckets: tuple[str, ...] = (),
) -> DataFrame:
    rows = explorer_rows(scope_filter(rows, scope, mentions))
    if segment is not None:
        rows = rows.filter(F.col("segment") == segment)
    if salary_published is not None:
        rows = rows.filter(F.col("salary_transparent") == salary_published)
    if buckets:
        rows = rows.filter(F.col("bucket").isin(*buckets))
    return rows


def sort_order(sort: str) -> list[Column]:
    """Nulls come last both ways; ties follow the offer id in the direction of the sort."""
    column, descending = SORTS[sort]
    if descending:
        return [F.desc_nulls_last(column), F.desc("offer_id")]
    return [F.asc_nulls_last(column), F.asc("offer_id")]


def keyset_after(sort: str, primary, offer_id: str) -> Column:
    """Rows strictly after a position; a null position lies in the null tail."""
    name, descending = SORTS[sort]
    column, identity = F.col(name), F.col("offer_id")
    beyond_id = identity < offer_id if descending else identity > offer_id
    if primary is None:
        return column.isNull() & beyond_id
    value = F.lit(primary)
    beyond = column < value if descending else column > value
    return beyond | column.isNull() | ((column == value) & beyond_id)


def explorer_page(filtered: DataFrame, sort: str = "published_desc", limit: int = DEFAULT_LIMIT, after=None) -> DataFrame:
    """One page plus the look-ahead row that tells whether a next page exists (`position` = limit + 1).

    `limit` over a sort is a top-k per task; only the k rows kept so far leave a task.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1..{MAX_LIMIT}")
    if after is not None:
        filtered = filtered.filter(keyset_after(sort, *after))
    return filtered.orderBy(*sort_order(sort)).limit(limit + 1)


def offer_details(page: DataFrame, evidence: DataFrame, mentions: DataFrame) -> DataFrame:
    """Evidence and technologies of the page rows. Both tables are cut to the page before they are collected."""
    ids = page.select("classification_id")
    proofs = (
        evidence.join(ids, "classification_id", "left_semi")
        .groupBy("classification_id")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "rule_id", "field", "excerpt", "normalized_value"))).alias("evidence"))
    )
    slugs = (
        mentions.join(ids, "classification_id", "left_semi")
        .groupBy("classification_id")
        .agg(F.array_sort(F.collect_set("slug")).alias("technologies"))
    )
    joined = page.join(proofs, "classification_id", "left").join(slugs, "classification_id", "left")
    return joined.withColumn("technologies", F.coalesce("technologies", F.array().cast("array<string>")))


def public_offer(rows: DataFrame) -> DataFrame:
    """Public columns: clipped texts, availability, and closed offers without company and link."""
    closed = F.col("closed_at")
    return (
        rows.withColumn("title", O.clipped(F.col("title"), "title"))
        .withColumn("company_name", O.visible_when_open(closed, O.clipped(F.col("company_name"), "company_name")))
        .withColumn("offer_url", O.visible_when_open(closed, safe_url(F.col("source_url"))))
        .withColumn("availability", O.availability(closed, F.col("missing_since")))
    )


