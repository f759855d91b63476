"""Versioned technology taxonomy as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.rules import technology_rules

RULE_SCHEMA = """slug string, label string, aliases array<string>, context_aliases array<string>, exact_case_aliases array<string>,
  exclusions array<string>"""


def rule_frame(spark: SparkSession) -> DataFrame:
    """The built-in vocabulary as a table of rules."""
    fields = ("slug", "label", "aliases", "context_aliases", "exact_case_aliases", "exclusions")
    rows = [tuple(rule.get(f, []) if f not in ("slug", "label") else rule[f] for f in fields) for rule in technology_rules()["technologies"]]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def technologies(rules: DataFrame, version: str) -> DataFrame:
    """One row per slug and version."""
    rows = rules.groupBy("slug").agg(F.max("label").alias("label"))
    return rows.select("slug", "label", F.lit("uncategorized").alias("category"), F.lit(version).alias("version"), F.lit(True).alias("enabled"))


def technology_aliases(rules: DataFrame) -> DataFrame:
    """One row per slug, alias and kind of match; the exclusions of the last load stand."""
    kinds = (("aliases", "word"), ("context_aliases", "regex"), ("exact_case_aliases", "case_sensitive"))
    none = F.array().cast("array<string>")

    def listed(column: str, kind: str):
        return F.transform(F.coalesce(column, none), lambda a: F.struct(a.alias("alias"), F.lit(kind).alias("match_kind")))

    pairs = F.concat(*[listed(column, kind) for column, kind in kinds])
    rows = rules.select("slug", F.col("exclusions").alias("negative_patterns"), F.inline(pairs))
    return rows.groupBy("slug", "alias", "match_kind").agg(F.max("negative_patterns").alias("negative_patterns"))


def merge_taxonomy(stored: DataFrame, loaded: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: a loaded row replaces the stored one of the same key."""
    return stored.join(loaded, keys, "left_anti").unionByName(loaded)
