"""Valid raw offers to the normalized model, the title perimeter and the expansion of query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import offers as O
from offerlens.functions.text import fold_phrase, folded_phrase, html_to_text, safe_url, trimmed_or_null
from offerlens.sources.tables import computed_once


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("raw", f"$.{path}", kind)


def normalize_offers(valid: DataFrame) -> DataFrame:
    """Project raw offers to the normalized model; dates that do not parse become null."""
    text = lambda path: trimmed_or_null(_get(path))
    salary = O.salary_label(*[_get(f"salaire.{p}") for p in ("libelle", "commentaire", "complement1", "complement2")])
    return valid.select(
        "query_key",
        "range_start",
        "item_ordinal",
        _get("id").alias("external_id"),
        html_to_text(_get("intitule")).alias("title"),
        html_to_text(_get("description")).alias("description_text"),
        text("entreprise.nom").alias("company_name"),
        F.try_to_timestamp(_get("dateCreation")).alias("source_published_at"),
        F.try_to_timestamp(_get("dateActualisation")).alias("source_updated_at"),
        F.struct(
            text("lieuTravail.libelle").alias("label"),
            text("lieuTravail.commune").alias("commune_code"),
            F.lit(None).cast("string").alias("department_code"),
            F.lit(None).cast("string").alias("region_code"),
            _get("lieuTravail.latitude", "double").alias("latitude"),
            _get("lieuTravail.longitude", "double").alias("longitude"),
        ).alias("location"),
        F.struct(
            text("typeContrat").alias("source_code"),
            O.contract_kind(_get("alternance", "boolean"), _get("typeContrat")).alias("normalized"),
            text("typeContratLibelle").alias("label"),
        ).alias("contract"),
        F.struct(
            O.structured_experience(_get("experienceExige")).alias("required"), text("experienceLibelle").alias("label")
        ).alias("structured_experience"),
        F.when(salary.isNotNull(), F.struct(salary.alias("label"), F.lit("salary_not_yet_parsed").alias("warning"))).alias("salary"),
        F.lit(None).cast("string").alias("application_url"),
        safe_url(_get("origineOffre.urlOrigine")).alias("source_url"),
    )


def with_content_hash(offers: DataFrame) -> DataFrame:
    return offers.withColumn("content_hash", O.content_hash(*O.CONTENT_COLUMNS))


def title_perimeter(offers: DataFrame, groups: list[dict], title: str = "title") -> DataFrame:
    """Offers with the groups whose title phrases they hold as a whole phrase, and the families these give.

    The phrases are a small vocabulary, so they are one array literal: no join, no shuffle. An empty
    phrase list admits nothing.
    """
    texts = lambda values: F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
    table = F.array(
        *[
            F.struct(
                F.lit(g["id"]).alias("group_id"),
                texts(g["job_families"]).alias("families"),
                texts([folded_phrase(p) for p in g["title_phrases"]]).alias("phrases"),
            )
            for g in groups
        ]
    )
    folded = offers.withColumn("_folded", fold_phrase(F.col(title)))
    admitted = F.filter(table, lambda g: F.exists(g["phrases"], lambda p: F.contains(F.col("_folded"), p)))
    joined = computed_once(folded, "_admitted", admitted).filter(F.size("_admitted") > 0)
    return joined.select(
        *offers.columns,
        F.array_sort(F.transform("_admitted", lambda g: g["group_id"])).alias("group_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_admitted", lambda g: g["families"])))).alias("job_families"),
    )


def expand_query_set(groups: DataFrame) -> DataFrame:
    """Atomic queries of the enabled groups: each occupation, each keyword, each pair.

    Equal pairs of several groups are one query whose memberships are merged and sorted. `groups` has
    group_id, enabled, occupations and keywords (arrays).
    """
    nothing = F.array(F.lit(None).cast("string"))
    enabled = groups.filter("enabled")
    pairs = enabled.select(
        "group_id", F.explode(F.concat("occupations", nothing)).alias("occupation"), F.concat("keywords", nothing).alias("keywords")
    ).select("group_id", "occupation", F.explode("keywords").alias("keyword"))
    pairs = pairs.filter(F.col("occupation").isNotNull() | F.col("keyword").isNotNull()).distinct()
    merged = pairs.groupBy("occupation", "keyword").agg(F.array_sort(F.collect_set("group_id")).alias("group_ids"))
    encoded = lambda c: F.replace(F.url_encode(F.coalesce(c, F.lit("-"))), F.lit("+"), F.lit("%20"))
    kind = (
        F.when(F.col("occupation").isNotNull() & F.col("keyword").isNotNull(), "overlap")
        .when(F.col("occupation").isNotNull(), "occupation-only")
        .otherwise("keyword-only")
    )
    key = F.concat(F.lit("rome="), encoded("occupation"), F.lit("&keyword="), encoded("keyword"))
    return merged.select(key.alias("query_key"), kind.alias("kind"), "occupation", "keyword", "group_ids")
