"""The daily job over pages made of the documents: three days, on which offers go, change and come back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.operators import daily as Da
from offerlens.operators import metrics as M
from offerlens.operators import trends as H
from offerlens.operators.scope import Scope
from offerlens.plans.registry import query
from offerlens.sources.tables import scratch_path, written

DAYS = (dt.datetime(2024, 1, 10, 5), dt.datetime(2024, 1, 11, 5), dt.datetime(2024, 1, 12, 5))
GROUPS = [
    {"id": "software", "title_phrases": ["développeur", "développeuse"], "job_families": ["software"]},
    {"id": "data", "title_phrases": ["data engineer"], "job_families": ["data"]},
]
PAGE = 20
#: The source lists 3,150 items of a query and no more, so a query has 150 full pages and further documents have further queries.
QUERY_PAGES = 150
#: An offer is gone for good, gone for the second day, or changed from the second day on.
GONE = ("false", "doc_id % 9 = 4 or doc_id % 11 = 5", "doc_id % 9 = 4")


def _series() -> Column:
    """Number of the three queries that list a document: one more for every 150 pages of each."""
    return F.greatest(F.floor(F.col("doc_id") / (3 * PAGE * QUERY_PAGES)), F.lit(0))


def _query_key(query_no: Column, series: Column) -> Column:
    return F.concat(F.lit("q"), query_no, F.when(series > 0, F.concat(F.lit("-"), series)).otherwise(""))


def landed(t, day: int, path: str) -> str:
    """Pages of one day, queries with twenty items a page; offers that are gone leave their place to one outside the perimeter."""
    gone, d = F.expr(GONE[day]), F.col("doc_id")
    item = F.to_json(
        F.struct(
            F.when(gone, F.concat(F.lit("other-"), "offer_id")).when(d % 97 != 3, F.col("offer_id")).alias("id"),
            F.when(gone, "Boulanger").otherwise(F.col("title")).alias("intitule"),
            F.concat("description_text", F.when((d % 7 == 2) & F.lit(day > 0), " Nouveau.").otherwise("")).alias("description"),
            F.col("contract_code").alias("typeContrat"),
            F.col("experience_code").alias("experienceExige"),
            F.coalesce("experience_label", F.when(F.col("experience_code").isin("D", "S"), "Débutant accepté")).alias("experienceLibelle"),
            F.struct(F.col("commune_code").alias("commune")).alias("lieuTravail"),
            F.struct(F.col("salary_label").alias("libelle")).alias("salaire"),
        )
    )
    page = F.floor(d / (3 * PAGE))
    grouped = t.offer_rows.groupBy((d % 3).alias("query_no"), _series().alias("series"), page.alias("page_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda s: s["item"]).alias("items")
    )
    pages = grouped.select(
        _query_key(F.col("query_no"), F.col("series")).alias("query_key"), ((F.col("page_no") - QUERY_PAGES * F.col("series")) * PAGE).alias("range_start"),
        F.concat(F.lit('{"resultats":['), F.array_join("items", ","), F.lit("]}")).alias("payload"),
    )
    landing = f"{path}/landing/{day}"
    pages.write.mode("overwrite").json(landing, compression="snappy")
    return landing


def source_queries(t) -> DataFrame:
    """Three queries, and those of further documents."""
    first = t.spark.range(3).select(_query_key(F.col("id"), F.lit(0)).alias("query_id"))
    more = t.offer_rows.filter(_series() > 0).select(_query_key(F.col("doc_id") % 3, _series()).alias("query_id")).distinct()
    return first.unionByName(more).select(
        "query_id", F.lit("queries-3").alias("query_set_version"), F.lit(True).alias("enabled"), F.lit(None).cast("timestamp").alias("valid_to"),
        F.array(F.lit("software")).alias("job_families"),
    )


def collected(t, days: int = 3) -> Da.Store:
    store = Da.Store(t.spark, scratch_path(t.spark, "observatory"))
    queries = written(source_queries(t), "source-queries")
    for day in range(days):
        run = Da.Run(f"R{DAYS[day]:%Y-%m-%d}", DAYS[day], "queries-3", landed(t, day, store.path))
        Da.collect_daily(store, run, queries, GROUPS)
    return store


_OFFERS = "doc_id % 10 in (0, 1, 3, 4, 5, 8) and doc_id % 97 <> 3"
_DAY_SQL = " union all ".join(
    f"""select 'R{day:%Y-%m-%d}' as run_id, count(*) as offers_received, count(*) filter (doc_id % 97 = 3 and not ({GONE[i]})) as offers_quarantined,
      count(*) filter ({_OFFERS} and not ({GONE[i]})) as in_perimeter, {f"count(*) filter ({_OFFERS})" if i == 0 else "0"} as offers_new,
      {"0" if i == 0 else f"count(*) filter ({_OFFERS} and doc_id % 7 = 2 and not ({GONE[i]}) {'' if i == 1 else f'and ({GONE[1]})'})"} as offers_updated,
      {f"count(*) filter ({_OFFERS} and ({GONE[1]}))" if i == 1 else "0"} as offers_marked_missing,
      {f"count(*) filter ({_OFFERS} and ({GONE[2]}))" if i == 2 else "0"} as offers_closed,
      count(*) filter ({_OFFERS} {f"and not ({GONE[2]})" if i == 2 else ""}) as members, 'publish' as decision, true as is_published,
      count(*) filter ({_OFFERS} {f"and not ({GONE[2]})" if i == 2 else ""} and doc_id % 6 in (0, 1)) as with_salary
    from {{offer_rows}}"""
    for i, day in enumerate(DAYS)
)


@query("daily_collection", _DAY_SQL)
def _daily_collection(t):
    """Facts of three runs of the whole job, and a stored metric of each dataset."""
    store = collected(t)
    done = store.runs()
    salary = store.read("metrics", *done).filter("metric_key = 'salary_transparency_rate'").select(F.col("dataset_id").alias("run_id"), F.col("numerator").alias("with_salary"))
    return store.read("runs", *done).join(salary, "run_id").select(
        "run_id", "offers_received", "offers_quarantined", "in_perimeter", "offers_new", "offers_updated", "offers_marked_missing", "offers_closed", "members",
        "decision", "is_published", "with_salary",
    )


@query(
    "daily_read_models",
    f"""select 'contract' as answer, contract_kind as key, count(*) as count from (
          select case contract_code when 'CDI' then 'cdi' when 'CDD' then 'cdd' when 'MIS' then 'interim' when 'SAI' then 'other' else 'unknown' end as contract_kind
          from {{offer_rows}} where {_OFFERS}) c group by 2
        union all select 'sample', 'size', count(*) from {{offer_rows}} where {_OFFERS}
        union all select 'trend', '2024-01-10', count(*) from {{offer_rows}} where {_OFFERS}""",
)
def _daily_read_models(t):
    """The home answer and the trend over what the first day published."""
    store = collected(t, days=1)
    home = M.overview(Da.dataset_rows(store, Da.current_run(store)), Da.mentions(store)).filter("section in ('contract', 'sample') and count is not null")
    points = H.trends(Da.dataset_rows(store, *store.runs()), Scope(period="current"))
    return home.select(F.col("section").alias("answer"), "key", "count").unionByName(
        points.select(F.lit("trend").alias("answer"), F.col("date").cast("string").alias("key"), F.col("sample_size").alias("count"))
    )
