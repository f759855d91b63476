"""Aggregates over a scope: rates, distributions, the home answer, stored daily metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import offers as O
from offerlens.functions import rates as R

OVERALL = "{}"
DIMENSIONS = ("job_family", "technology_slug", "region_code", "department_code", "commune_code", "contract_kind", "remote_mode")
MAX_COMBINED_DIMENSIONS = 3


def overview_metrics(scoped: DataFrame) -> DataFrame:
    """All counters of a scope in one pass."""
    return scoped.agg(
        F.count(F.lit(1)).alias("sample_size"),
        *R.counted(R.contradiction_versioned(F.col("junior_metric_version")), "contradiction_"),
        *R.counted(R.beginner_rate(), "beginner_"),
        F.count_if("salary_transparent").alias("salary_numerator"),
    )


def fixed_keys(spark: SparkSession, keys: tuple[str, ...], name: str = "key") -> DataFrame:
    """A fixed vocabulary with its order, for zero fill; a local relation that the planner knows the size of."""
    return literal_rows(spark, [(k, i) for i, k in enumerate(keys)], f"{name}, position")


def literal_rows(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A handful of constant rows as VALUES, without a job over Python data."""
    shown = [", ".join("'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v) for v in row) for row in rows]
    return spark.sql(f"select * from values {', '.join(f'({row})' for row in shown)} as t({names})")


def zero_filled(counts: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Every key of the vocabulary, absent ones with 0."""
    return keys.join(counts, key, "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def with_share(counts: DataFrame, scoped: DataFrame) -> DataFrame:
    """Share of the scope; its size is a scalar subquery."""
    population = scoped.agg(F.count(F.lit(1))).scalar()
    sized = counts.withColumn("population", population)
    share = F.when(F.col("population") > 0, F.try_divide(F.col("count"), F.col("population")))
    return sized.withColumn("share", share).drop("population")


def experience_distribution(scoped: DataFrame) -> DataFrame:
    counts = scoped.groupBy(
        O.experience_bucket(F.col("status"), F.col("minimum_experience_months")).alias("key")
    ).count()
    return zero_filled(counts, fixed_keys(scoped.sparkSession, O.EXPERIENCE_BUCKETS))


def contract_distribution(scoped: DataFrame) -> DataFrame:
    counts = scoped.groupBy(F.col("contract_kind").alias("key")).count()
    return with_share(counts, scoped).orderBy(F.desc("count"), "key")


def remote_distribution(scoped: DataFrame) -> DataFrame:
    counts = scoped.groupBy(F.col("remote_mode").alias("key")).count()
    return with_share(zero_filled(counts, fixed_keys(scoped.sparkSession, O.REMOTE_MODES)), scoped)


def technology_counts(scoped: DataFrame, mentions: DataFrame) -> DataFrame:
    """Distinct offers per technology. Pairs are reduced first, so a slug in every offer stays spread out."""
    pairs = (
        mentions.select("classification_id", F.col("slug").alias("key"))
        .join(scoped.select("classification_id", "offer_id"), "classification_id")
        .select("key", "offer_id")
        .distinct()
    )
    return pairs.groupBy("key").count()


def technology_top(scoped: DataFrame, mentions: DataFrame, limit: int = 10) -> DataFrame:
    counts = technology_counts(scoped, mentions).orderBy(F.desc("count"), "key").limit(limit)
    return with_share(counts, scoped)


def family_counts(rows: DataFrame) -> DataFrame:
    """Distinct offers per job family; a family is counted once per offer before the exchange."""
    pairs = rows.select("offer_id", F.explode(F.array_distinct("job_families")).alias("key")).distinct()
    return pairs.groupBy("key").count()


def popular_areas(rows: DataFrame, limit: int = 12) -> DataFrame:
    counts = rows.filter(F.col("region_code").isNotNull()).groupBy(F.col("region_code").alias("key")).count()
    return counts.orderBy(F.desc("count"), "key").limit(limit)


def _tags(observation_version: Column) -> Column:
    """What one offer contributes to the home answer, as (section, key) pairs."""
    def tag(section: str, key, condition: Column | None = None) -> Column:
        pair = F.struct(F.lit(section).alias("section"), (F.lit(key) if isinstance(key, str) else key).alias("key"))
        return pair if condition is None else F.when(condition, pair)

    rate_tags = [
        tag(section, name, condition)
        for section, conditions in (
            (R.CONTRADICTION, R.contradiction_versioned(observation_version)),
            (R.BEGINNER, R.beginner_rate()),
            (R.SALARY, R.salary_rate()),
        )
        for name, condition in conditions.items()
    ]
    return F.array_compact(
        F.array(
            *rate_tags,
            tag("sample", "size"),
            tag("experience", O.experience_bucket(F.col("status"), F.col("minimum_experience_months"))),
            tag("contract", F.col("contract_kind")),
            tag("remote", F.col("remote_mode")),
        )
    )


def overview(scoped: DataFrame, mentions: DataFrame, technologies: int = 10) -> DataFrame:
    """The whole home answer as rows (section, key, count, share).

    Each offer gives its (section, key) pairs and one partial aggregate counts them, so the scope is
    read once for all counters and distributions and some hundred rows cross the network.
    """
    spark = scoped.sparkSession
    counted = (
        scoped.select(F.explode(_tags(F.col("junior_metric_version"))).alias("tag"))
        .groupBy("tag.section", "tag.key")
        .count()
    )
    technology = technology_counts(scoped, mentions).orderBy(F.desc("count"), "key").limit(technologies)
    counted = counted.unionByName(technology.select(F.lit("technology").alias("section"), "key", "count"))
    fixed = [("sample", "size")]
    fixed += [(m, c) for m in (R.CONTRADICTION, R.BEGINNER, R.SALARY) for c in R.COUNTS]
    fixed += [("experience", k) for k in O.EXPERIENCE_BUCKETS] + [("remote", k) for k in O.REMOTE_MODES]
    zeros = literal_rows(spark, list(fixed), "section, key").withColumn("count", F.lit(0).cast("long"))
    counted = counted.unionByName(zeros).groupBy("section", "key").agg(F.sum("count").alias("count"))
    # From here on the frame holds some hundred rows.
    counts_of = F.collect_list(F.struct("section", "key", "count"))
    packed = counted.agg(F.map_from_entries(F.transform(counts_of, lambda t: F.struct(F.concat_ws("/", t["section"], t["key"]), t["count"]))).alias("m"))
    entries = packed.select("m", F.explode("m").alias("path", "count"))
    section, key = F.substring_index("path", "/", 1), F.expr("substring(path, instr(path, '/') + 1)")
    size = F.try_element_at("m", F.lit("sample/size"))
    share = F.when(section.isin("contract", "remote", "technology") & (size > 0), F.try_divide(F.col("count"), size))
    plain = entries.select(section.alias("section"), key.alias("key"), "count", share.alias("share"))
    rate_counts = [
        F.struct(F.lit(m).alias("section"), *[F.try_element_at("m", F.lit(f"{m}/{c}")).alias(c) for c in R.COUNTS])
        for m in (R.CONTRADICTION, R.BEGINNER, R.SALARY)
    ]
    rated = R.rate_from_counts(packed.select(F.inline(F.array(*rate_counts))))
    derived = rated.select(
        "section",
        F.inline(
            F.array(
                F.struct(F.lit("population_count").alias("key"), F.col("population_count").alias("count"), F.lit(None).cast("double").alias("share")),
                F.struct(F.lit("value").alias("key"), F.lit(None).cast("long").alias("count"), F.col("value").alias("share")),
                F.struct(F.lit("coverage").alias("key"), F.lit(None).cast("long").alias("count"), F.col("coverage").alias("share")),
            )
        ),
    )
    return plain.unionByName(derived)


def taxonomy_counts(rows: DataFrame, mentions: DataFrame, technologies: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Available offers per entry of every taxonomy, with zero for entries without offers."""
    spark = rows.sparkSession
    parts = [
        ("job", zero_filled(family_counts(rows), fixed_keys(spark, families))),
        ("technology", zero_filled(technology_counts(rows, mentions), technologies)),
        ("area", popular_areas(rows)),
        ("contract", zero_filled(rows.groupBy(F.col("contract_kind").alias("key")).count(), fixed_keys(spark, O.CONTRACT_KINDS))),
        ("remote", zero_filled(rows.groupBy(F.col("remote_mode").alias("key")).count(), fixed_keys(spark, O.REMOTE_MODES))),
    ]
    frames = [df.select(F.lit(kind).alias("kind"), "key", "count") for kind, df in parts]
    return reduce(DataFrame.unionByName, frames)


def _metric_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The three published rates per group, from one aggregate of twelve counters."""
    named = (
        (R.CONTRADICTION, R.contradiction_versioned(F.col("junior_metric_version"))),
        (R.BEGINNER, R.beginner_rate()),
        (R.SALARY, R.salary_rate()),
    )
    counters = [c for metric, conditions in named for c in R.counted(conditions, f"{metric}__")]
    wide = rows.groupBy(*keys).agg(*counters)
    return _unfold(wide, keys)


def _unfold(wide: DataFrame, keys: list[str]) -> DataFrame:
    version = {R.CONTRADICTION: F.col("junior_metric_version"), R.BEGINNER: F.lit(R.BEGINNER_V1), R.SALARY: F.lit(R.SALARY_V1)}
    per_metric = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric_key"),
                version[metric].alias("metric_version"),
                *[F.col(f"{metric}__{c}").alias(c) for c in R.COUNTS],
            )
            for metric in version
        ]
    )
    return R.rate_from_counts(wide.select(*keys, F.inline(per_metric)))


def daily_metrics(rows: DataFrame, period: Column) -> DataFrame:
    """The stored overall rates of each dataset, with the decimals of the stored table."""
    keyed = rows.withColumn("period_start", period)
    stored = _metric_rows(keyed, ["dataset_id", "junior_metric_version", "period_start"]).drop("junior_metric_version")
    return (
        stored.withColumn("period_end", F.col("period_start"))
        .withColumn("value", F.col("value").cast("decimal(12,8)"))
        .withColumn("coverage", F.col("coverage").cast("decimal(12,8)"))
        .withColumn("dimension_hash", F.sha2(F.lit(OVERALL), 256))
    )


def store_daily_metrics(stored: DataFrame, computed: DataFrame, draft_datasets: DataFrame) -> DataFrame:
    """Upsert by key: new values replace stored ones only while the dataset is a draft."""
    key = ["dataset_id", "metric_key", "metric_version", "period_start", "period_end", "dimension_hash"]
    open_rows = computed.join(draft_datasets.select("dataset_id"), "dataset_id", "left_semi")
    fresh = computed.join(stored, key, "left_anti").join(draft_datasets.select("dataset_id"), "dataset_id", "left_anti")
    kept = stored.join(open_rows, key, "left_anti")
    return kept.unionByName(open_rows).unionByName(fresh)


#: The dimensions that an offer may have several values of, and the array column that holds them.
ARRAYS = {"job_family": "job_families", "technology_slug": "technologies"}


def metrics_by_dimension(rows: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """The same rates by up to three combined dimensions, by grouping sets."""
    used = [d for d in DIMENSIONS if any(d in s for s in sets)]
    return rates_of_cells(cells(rows, sets).drop("dimensions", "offers"), used)


def cells(rows: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """The counters of every combination of dimension values: `dataset_id, junior_metric_version`, a column for each
    used dimension, `dimensions` (the names of the set), the counters of the three rates, and `offers`.

    `rows` holds one row per offer. Arrays are exploded for the sets that name their dimension and for no other,
    so an offer counts once in each of its families and technologies and once everywhere else.
    """
    if any(len(s) > MAX_COMBINED_DIMENSIONS for s in sets):
        raise ValueError("at most three dimensions may be combined")
    used = [d for d in DIMENSIONS if any(d in s for s in sets)]
    by_arrays: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for dimensions in sets:
        by_arrays.setdefault(tuple(d for d in ARRAYS if d in dimensions), []).append(dimensions)
    found = []
    for arrays, own in by_arrays.items():
        spread = rows
        for dimension in arrays:
            spread = spread.withColumn(dimension, F.explode(F.array_distinct(ARRAYS[dimension])))
        part = _cells_by_sets(spread, own)
        found.append(part.select(*[c if c in part.columns else F.lit(None).cast("string").alias(c) for c in used], *[c for c in part.columns if c not in used]))
    return reduce(DataFrame.unionByName, found)


#: The counters of a cell, which are sums over its offers.
CELL_COUNTERS = tuple(f"{metric}__{count}" for metric in (R.CONTRADICTION, R.BEGINNER, R.SALARY) for count in R.COUNTS)


def rates_of_cells(found: DataFrame, used: list[str]) -> DataFrame:
    """The three rates of each cell."""
    return _unfold(found, ["dataset_id", "junior_metric_version", *used])


def _cells_by_sets(rows: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    used = [d for d in DIMENSIONS if any(d in s for s in sets)]
    named = (
        (R.CONTRADICTION, R.contradiction_versioned(F.col("junior_metric_version"))),
        (R.BEGINNER, R.beginner_rate()),
        (R.SALARY, R.salary_rate()),
    )
    counters = [c for metric, conditions in named for c in R.counted(conditions, f"{metric}__")]
    base = ["dataset_id", "junior_metric_version"]
    # An offer without a value in a dimension has no cell there.
    wide = rows.groupingSets([[F.col(c) for c in (*base, *s)] for s in sets], *base, *used).agg(
        *counters, F.count(F.lit(1)).alias("offers"), F.grouping_id().alias("level")
    )
    absent = {d: F.col("level").bitwiseAND(1 << (len(used) - 1 - i)) != 0 for i, d in enumerate(used)}
    present = reduce(lambda a, b: a & b, [F.col(d).isNotNull() | absent[d] for d in used], F.lit(True))
    names = F.concat_ws(",", *[F.when(~absent[d], F.lit(d)) for d in used]) if used else F.lit("")
    return wide.filter(present).withColumn("dimensions", names).drop("level")


def percent_point_change(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Difference in points of the rates of two sides, where comparing them is allowed at all."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in ("metric_version", "value", "sample_quality", "period_days")])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("metric_version", "value", "sample_quality", "period_days")])
    joined = left.join(right, keys)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("metric_version_a") != F.col("metric_version_b"), "method_differs"),
            F.when(F.col("period_days_a") != F.col("period_days_b"), "period_differs"),
            F.when((F.col("sample_quality_a") == "insufficient") | (F.col("sample_quality_b") == "insufficient"), "sample_insufficient"),
        )
    )
    return joined.withColumn("refused", F.array_join(reasons, ",")).withColumn(
        "points", F.when(F.size(reasons) == 0, F.round((F.col("value_b") - F.col("value_a")) * 100, 8))
    )
