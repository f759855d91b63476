"""Rates with explicit numerator, denominator, unknown and ambiguous counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric keys, versions and publication thresholds.
CONTRADICTION = "junior_contradiction_rate"
BEGINNER = "beginner_friendly_rate"
SALARY = "salary_transparency_rate"
CONTRADICTION_V1 = "junior-contradiction-1.0.0"
CONTRADICTION_V2 = "junior-contradiction-2.0.0"
BEGINNER_V1 = "beginner-friendly-1.0.0"
SALARY_V1 = "salary-transparency-1.0.0"
INSUFFICIENT_BELOW = 20
CAUTION_BELOW = 50
CONTRADICTION_MONTHS = 24

COUNTS = ("numerator", "denominator", "unknown_count", "ambiguous_count")


def sample_quality(denominator: Column) -> Column:
    return (
        F.when(denominator < INSUFFICIENT_BELOW, "insufficient")
        .when(denominator < CAUTION_BELOW, "caution")
        .otherwise("normal")
    )


def rate_from_counts(df: DataFrame) -> DataFrame:
    """Add population, value, coverage and sample quality to the four counts of each row."""
    numerator = F.when(F.col("numerator") <= F.col("denominator"), F.col("numerator")).otherwise(
        F.raise_error(F.lit("a numerator cannot exceed its denominator")).cast("long")
    )
    population = F.col("denominator") + F.col("unknown_count") + F.col("ambiguous_count")
    return (
        df.withColumn("numerator", numerator)
        .withColumn("population_count", population)
        .withColumn("sample_quality", sample_quality(F.col("denominator")))
        .withColumn(
            "value",
            F.when(F.col("denominator") >= INSUFFICIENT_BELOW, F.col("numerator") / F.col("denominator")),
        )
        .withColumn(
            "coverage",
            F.when(F.col("population_count") > 0, F.try_divide(F.col("denominator"), F.col("population_count"))),
        )
    )


def contradiction_v1() -> dict[str, Column]:
    """Conditions over offers that claim to be junior, on the resolved minimum."""
    junior = F.col("claims_junior")
    classified = F.col("status") == "classified"
    months = F.col("minimum_experience_months")
    return {
        "numerator": junior & classified & (months >= CONTRADICTION_MONTHS),
        "denominator": junior & classified & months.isNotNull(),
        "unknown_count": junior & classified & months.isNull(),
        "ambiguous_count": junior & (F.col("status") == "ambiguous"),
    }


def contradiction_v2() -> dict[str, Column]:
    """The same question on the separate observation axis."""
    junior = F.col("claims_junior")
    status = F.col("junior_observation_status")
    return {
        "numerator": junior & (status == "resolved") & F.col("junior_observation_contradictory"),
        "denominator": junior & (status == "resolved"),
        "unknown_count": junior & (status == "unknown"),
        "ambiguous_count": junior & (status == "ambiguous"),
    }


def contradiction_versioned(version: Column) -> dict[str, Column]:
    """The version of the metric is a property of each dataset, so it is chosen per row."""
    first, second = contradiction_v1(), contradiction_v2()
    return {name: F.when(version == CONTRADICTION_V2, second[name]).otherwise(first[name]) for name in COUNTS}


def beginner_rate() -> dict[str, Column]:
    friendly = F.col("beginner_friendly")
    classified = F.col("status") == "classified"
    ambiguous = F.col("status") == "ambiguous"
    return {
        "numerator": classified & friendly,
        "denominator": classified & friendly.isNotNull(),
        "unknown_count": ~ambiguous & friendly.isNull(),
        "ambiguous_count": ambiguous,
    }


def salary_rate() -> dict[str, Column]:
    return {
        "numerator": F.col("salary_transparent"),
        "denominator": F.lit(True),
        "unknown_count": F.lit(False),
        "ambiguous_count": F.lit(False),
    }


def counted(conditions: dict[str, Column], prefix: str = "") -> list[Column]:
    """One `count_if` per condition."""
    return [F.count_if(condition).alias(prefix + name) for name, condition in conditions.items()]


def rates(df: DataFrame, conditions: dict[str, Column], *keys: str) -> DataFrame:
    """The rate of each group, or of the whole table when there is no key."""
    return rate_from_counts(df.groupBy(*keys).agg(*counted(conditions)))
