"""Daily trends over all published datasets, their annotations and the segments of the drawn line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.functions import rates as R
from offerlens.functions.offers import business_date
from offerlens.operators.scope import Scope, scope_filter
from offerlens.operators.skew import first_by

MAX_POINTS = 366
DATASET_KEYS = [
    "dataset_id", "dataset_version", "classifier_version", "query_set_version", "junior_metric_version", "decision",
    "source_cutoff_at", "published_at",
]


def latest_per_day(datasets: DataFrame) -> DataFrame:
    """One dataset per calendar day: the latest publication, then the higher version."""
    return first_by(datasets, ["date"], ["published_at", "dataset_version"], descending=True)


def trend_counts(rows: DataFrame, metric: str) -> DataFrame:
    conditions = {
        R.CONTRADICTION: R.contradiction_versioned(F.col("junior_metric_version")),
        R.BEGINNER: R.beginner_rate(),
        R.SALARY: R.salary_rate(),
    }[metric]
    counted = rows.groupBy(*DATASET_KEYS).agg(F.count(F.lit(1)).alias("sample_size"), *R.counted(conditions))
    return counted.withColumn("date", business_date(F.col("source_cutoff_at")))


def trend_annotations(points: DataFrame, metric: str = R.CONTRADICTION) -> DataFrame:
    """What changed since the point before. One row per day, so one ordered window is small."""
    order = Window.orderBy("date")
    previous = {c: F.lag(c).over(order) for c in ("query_set_version", "classifier_version", "junior_metric_version")}
    metric_changed = (
        previous["junior_metric_version"] != F.col("junior_metric_version") if metric == R.CONTRADICTION else F.lit(False)
    )
    return points.withColumn(
        "annotation",
        F.when(F.col("decision") == "publish_partial", "partial_day")
        .when(previous["query_set_version"] != F.col("query_set_version"), "source_change")
        .when(metric_changed, "methodology_change")
        .when(previous["classifier_version"] != F.col("classifier_version"), "classifier_change"),
    )


def trends(
    rows: DataFrame, scope: Scope, metric: str = R.CONTRADICTION, mentions: DataFrame | None = None, start=None, end=None
) -> DataFrame:
    """One point per Paris day of the published datasets, the period being relative to each dataset's cutoff."""
    rows = rows.filter((F.col("dataset_status") == "published") & F.col("published_at").isNotNull())
    day = business_date(F.col("source_cutoff_at"))
    if start is not None:
        rows = rows.filter(day >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(day <= F.lit(end).cast("date"))
    daily = latest_per_day(trend_counts(scope_filter(rows, scope, mentions), metric))
    tail = daily.orderBy(F.desc("date")).limit(MAX_POINTS)
    return trend_annotations(R.rate_from_counts(tail), metric).orderBy("date")


def trend_segments(points: DataFrame) -> DataFrame:
    """Number the unbroken stretches of the line; days without a value are not drawn."""
    order = Window.orderBy("date")
    before = {c: F.lag(c).over(order) for c in ("date", "value", "annotation")}
    breaks = (
        before["date"].isNull()
        | before["value"].isNull()
        | F.col("annotation").isNotNull()
        | F.coalesce(before["annotation"] == "partial_day", F.lit(False))
        | (F.datediff("date", before["date"]) > 1)
    )
    marked = points.withColumn("break_before", breaks).filter(F.col("value").isNotNull())
    return marked.withColumn("segment", F.sum(F.col("break_before").cast("int")).over(order))


def moving_average_7d(points: DataFrame) -> DataFrame:
    """Mean of the last seven calendar days; partial days keep their flag."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    week = Window.orderBy(day).rangeBetween(-6, 0)
    return points.withColumn("average_7d", F.avg("value").over(week)).withColumn(
        "partial_days", F.count_if(F.col("decision") == "publish_partial").over(week)
    )
