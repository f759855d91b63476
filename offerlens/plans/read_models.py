"""Read models: scope, rates, distributions, explorer, trends."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.functions import offers as O
from offerlens.functions import rates as R
from offerlens.operators import cells as Ce
from offerlens.operators import explorer as X
from offerlens.operators import layout as L
from offerlens.operators import metrics as M
from offerlens.operators import trends as H
from offerlens.operators.scope import (
    JOB_FAMILIES,
    Scope,
    membership_rows,
    normalized_list,
    scope_filter,
    with_all_technologies,
)
from offerlens.operators.skew import first_by
from offerlens.plans.registry import query
from offerlens.sources.tables import scratch_path

HOME = Scope(period="90d")
NARROW = Scope(job="software", technologies="sql,java", area="region:src1", period="90d")

V1 = {
    "numerator": "claims_junior and status = 'classified' and minimum_experience_months >= 24",
    "denominator": "claims_junior and status = 'classified' and minimum_experience_months is not null",
    "unknown_count": "claims_junior and status = 'classified' and minimum_experience_months is null",
    "ambiguous_count": "claims_junior and status = 'ambiguous'",
}
V2 = {
    "numerator": "claims_junior and junior_observation_status = 'resolved' and junior_observation_contradictory",
    "denominator": "claims_junior and junior_observation_status = 'resolved'",
    "unknown_count": "claims_junior and junior_observation_status = 'unknown'",
    "ambiguous_count": "claims_junior and junior_observation_status = 'ambiguous'",
}
_IS_V2 = "junior_metric_version = 'junior-contradiction-2.0.0'"
BY_VERSION = {k: f"case when {_IS_V2} then ({V2[k]}) else ({V1[k]}) end" for k in V1}
BEGINNER = {
    "numerator": "status = 'classified' and beginner_friendly",
    "denominator": "status = 'classified' and beginner_friendly is not null",
    "unknown_count": "status <> 'ambiguous' and beginner_friendly is null",
    "ambiguous_count": "status = 'ambiguous'",
}
SALARY = {"numerator": "salary_transparent", "denominator": "true", "unknown_count": "false", "ambiguous_count": "false"}


def counts_sql(conditions: dict[str, str], prefix: str = "") -> str:
    return ", ".join(f"count(*) filter (where {c}) as {prefix}{n}" for n, c in conditions.items())


def rate_sql(counts: str) -> str:
    """The rate columns over a SELECT that gives the four counts."""
    return f"""
      select *, case when denominator >= 20 then numerator::double / denominator end as value,
        case when population_count > 0 then denominator::double / population_count end as coverage,
        case when denominator < 20 then 'insufficient' when denominator < 50 then 'caution' else 'normal' end as sample_quality
      from (select *, denominator + unknown_count + ambiguous_count as population_count from ({counts}) counted) populated"""


def scope_sql(scope: Scope, table: str = "{dataset_rows}") -> str:
    where = ["true"]
    if scope.job:
        where.append(f"list_contains(job_families, '{scope.job}')")
    if scope.area != "france":
        kind, _, code = scope.area.partition(":")
        where.append(f"{kind}_code = '{code}'")
    if scope.contracts:
        where.append("contract_kind in (" + ", ".join(f"'{c}'" for c in scope.contracts) + ")")
    if scope.remote:
        where.append(f"remote_mode = '{scope.remote}'")
    if scope.period != "current":
        where.append(f"source_published_at >= source_cutoff_at - interval '{scope.period[:-1]}' day")
    for slug in scope.technologies:
        where.append(
            f"exists (select 1 from {{mentions}} m where m.classification_id = r.classification_id and m.slug = '{slug}')"
        )
    return f"select * from {table} r where " + " and ".join(where)


def _rows(t):
    """Published rows of the current dataset, with the names the operators use."""
    return t.dataset_rows.withColumnRenamed("published_at", "source_published_at")


ROWS = "(select *, published_at as source_published_at from {dataset_rows})"


def _home(t, scope=HOME):
    return scope_filter(_rows(t), scope, t.mentions)


def home_sql(scope: Scope = HOME) -> str:
    return scope_sql(scope, ROWS)


# ------------------------------------------------------------------ joins and scope


@query(
    "membership_join",
    """select d.dataset_version, m.offer_id, s.snapshot_id, c.classification_id, s.contract_kind, c.status, c.claims_junior
       from {current_datasets} d join {memberships} m on m.dataset_id = d.dataset_id
       join {snapshots} s on s.snapshot_id = m.snapshot_id
       join {classifications} c on c.classification_id = m.classification_id""",
)
def _membership_join(t):
    rows = membership_rows(t.current_datasets.drop("status"), t.memberships, t.snapshots, t.classifications)
    return rows.select(
        "dataset_version", "offer_id", "snapshot_id", "classification_id", "contract_kind", "status", "claims_junior"
    )


@query("scope_filter", f"select offer_id, contract_kind, remote_mode, region_code from ({home_sql(NARROW)}) s")
def _scope_filter(t):
    return scope_filter(_rows(t), NARROW, t.mentions).select("offer_id", "contract_kind", "remote_mode", "region_code")


@query(
    "all_technologies",
    """select offer_id, title from {dataset_rows} r where not exists (
         select 1 from (values ('python'), ('sql')) requested(slug) where not exists (
           select 1 from {mentions} m where m.classification_id = r.classification_id and m.slug = requested.slug))""",
)
def _all_technologies(t):
    return with_all_technologies(t.dataset_rows, t.mentions, ["python", "sql"]).select("offer_id", "title")


_LISTS = "region_code || ' , ' || contract_kind || ',, ' || department_code || ',' || region_code"


@query(
    "normalize_scope",
    f"""select offer_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
          string_split({_LISTS}, ','), lambda x: trim(x)), lambda x: x <> ''))), ',') as normalized from {{offer_rows}}""",
)
def _normalize_scope(t):
    return t.offer_rows.select("offer_id", normalized_list(F.expr(_LISTS)).alias("normalized"))


_SEGMENT = f"""case when {_IS_V2} and junior_observation_status = 'resolved' and junior_observation_contradictory then 'contradictory'
   when status = 'ambiguous' then 'ambiguous' when status = 'unclassified' then 'unknown'
   when contradictory_junior then 'contradictory' when beginner_friendly then 'beginner_friendly'
   when claims_junior and (beginner_friendly is null or contradictory_junior is null) then 'junior_unresolved'
   when claims_junior and not beginner_friendly and not contradictory_junior then 'other_junior'
   when claims_junior = false then 'not_explicitly_junior' else 'unknown' end"""
_BUCKET = """case when status = 'ambiguous' then 'ambiguous' when minimum_experience_months is null then 'unknown'
   when minimum_experience_months = 0 then 'none' when minimum_experience_months <= 12 then '1_12'
   when minimum_experience_months <= 23 then '13_23' when minimum_experience_months <= 35 then '24_35'
   when minimum_experience_months <= 59 then '36_59' else '60_plus' end"""


@query("segment_label", f"select offer_id, {_SEGMENT} as segment from {{dataset_rows}}")
def _segment_label(t):
    return X.explorer_rows(t.dataset_rows).select("offer_id", "segment")


@query("experience_bucket", f"select offer_id, {_BUCKET} as bucket from {{dataset_rows}}")
def _experience_bucket(t):
    return X.explorer_rows(t.dataset_rows).select("offer_id", "bucket")


_SAFE = "case when regexp_matches(source_url, '^https?://') then source_url end"


@query(
    "availability",
    f"""select offer_id, case when closed_at is not null then 'closed' when missing_since is not null then 'not_seen'
         else 'active' end as availability, case when closed_at is null then company_name end as company_name,
       case when closed_at is null then {_SAFE} end as offer_url from {{offer_rows}}""",
)
def _availability(t):
    return X.public_offer(t.offer_rows).select("offer_id", "availability", "company_name", "offer_url")


@query("safe_url", f"select offer_id, {_SAFE} as safe_url from {{offer_rows}}")
def _safe_url(t):
    return t.offer_rows.select("offer_id", X.safe_url(F.col("source_url")).alias("safe_url"))


@query(
    "clip_public_fields",
    """select offer_id, substring(title, 1, 250) as title, substring(description_text, 1, 700) as excerpt,
         substring(salary_label, 1, 250) as salary_label, substring(experience_label, 1, 150) as contract_label from {offer_rows}""",
)
def _clip(t):
    return t.offer_rows.select(
        "offer_id",
        O.clipped(F.col("title"), "title").alias("title"),
        O.clipped(F.col("description_text"), "excerpt").alias("excerpt"),
        O.clipped(F.col("salary_label"), "company_name").alias("salary_label"),
        O.clipped(F.col("experience_label"), "contract_label").alias("contract_label"),
    )


@query(
    "business_date",
    """select cast(timezone('Europe/Paris', timezone('UTC', ts)) as date) as business_date, count(*) as events
       from {events} group by 1""",
)
def _business_date(t):
    return t.events.groupBy(O.business_date(F.col("ts")).alias("business_date")).agg(F.count(F.lit(1)).alias("events"))


# ------------------------------------------------------------------ rates


@query(
    "rate_from_counts",
    rate_sql(
        """select event_type, count(*) filter (where value > 50) as numerator, count(*) filter (where value > 20) as denominator,
             count(*) filter (where value <= 5) as unknown_count, count(*) filter (where value > 5 and value <= 20) as ambiguous_count
           from {events} group by event_type"""
    ),
)
def _rate_from_counts(t):
    value = F.col("value")
    conditions = {
        "numerator": value > 50,
        "denominator": value > 20,
        "unknown_count": value <= 5,
        "ambiguous_count": (value > 5) & (value <= 20),
    }
    return R.rates(t.events, conditions, "event_type")


@query("contradiction_rate_v1", rate_sql(f"select lang, {counts_sql(V1)} from {{dataset_rows}} group by lang"))
def _v1(t):
    return R.rates(t.dataset_rows, R.contradiction_v1(), "lang")


@query("contradiction_rate_v2", rate_sql(f"select lang, {counts_sql(V2)} from {{dataset_rows}} group by lang"))
def _v2(t):
    return R.rates(t.dataset_rows, R.contradiction_v2(), "lang")


@query(
    "versioned_rate_switch",
    rate_sql(
        f"""select dataset_id, junior_metric_version, {counts_sql(BY_VERSION)} from {{day_members}}
            group by dataset_id, junior_metric_version"""
    ),
)
def _switch(t):
    return R.rates(
        t.day_members, R.contradiction_versioned(F.col("junior_metric_version")), "dataset_id", "junior_metric_version"
    )


@query("beginner_rate", rate_sql(f"select region_code, {counts_sql(BEGINNER)} from {{dataset_rows}} group by region_code"))
def _beginner(t):
    return R.rates(t.dataset_rows, R.beginner_rate(), "region_code")


@query("salary_rate", rate_sql(f"select contract_kind, {counts_sql(SALARY)} from {{dataset_rows}} group by contract_kind"))
def _salary(t):
    return R.rates(t.dataset_rows, R.salary_rate(), "contract_kind")


@query(
    "overview_metrics",
    f"""select count(*) as sample_size, {counts_sql(BY_VERSION, 'contradiction_')}, {counts_sql(BEGINNER, 'beginner_')},
          count(*) filter (where salary_transparent) as salary_numerator from ({home_sql()}) s""",
)
def _overview_metrics(t):
    return M.overview_metrics(_home(t))


def _fixed_sql(keys) -> str:
    return "(values " + ", ".join(f"('{k}', {i})" for i, k in enumerate(keys)) + ") keys(key, position)"


@query(
    "experience_distribution",
    f"""select keys.key, keys.position, coalesce(n, 0) as count from {_fixed_sql(O.EXPERIENCE_BUCKETS)}
        left join (select {_BUCKET} as key, count(*) as n from ({home_sql()}) s group by 1) c on c.key = keys.key""",
)
def _experience(t):
    return M.experience_distribution(_home(t))


@query(
    "contract_distribution",
    f"""select contract_kind as key, count(*) as count, count(*)::double / sum(count(*)) over () as share
        from ({home_sql()}) s group by contract_kind""",
)
def _contracts(t):
    return M.contract_distribution(_home(t))


@query(
    "remote_distribution",
    f"""with scoped as ({home_sql()}) select keys.key, keys.position, coalesce(n, 0) as count,
          coalesce(n, 0)::double / (select count(*) from scoped) as share from {_fixed_sql(O.REMOTE_MODES)}
        left join (select remote_mode as key, count(*) as n from scoped group by 1) c on c.key = keys.key""",
)
def _remote(t):
    return M.remote_distribution(_home(t))


_TOP = """select m.slug as key, count(distinct s.offer_id) as count, count(distinct s.offer_id)::double / (select count(*) from scoped) as share
          from scoped s join {mentions} m on m.classification_id = s.classification_id
          group by m.slug order by 2 desc, 1 limit 10"""


@query("technology_top", f"with scoped as ({home_sql()}) {_TOP}")
def _technology_top(t):
    return M.technology_top(_home(t), t.mentions)


def _overview_sql(scope: Scope) -> str:
    rate_parts = []
    for metric, conditions in ((R.CONTRADICTION, BY_VERSION), (R.BEGINNER, BEGINNER), (R.SALARY, SALARY)):
        rate_parts.append(f"select '{metric}' as section, * from ({rate_sql(f'select {counts_sql(conditions)} from scoped')}) r")
    items = [
        f"select section, '{c}' as key, {c} as count, null::double as share from rates" for c in (*R.COUNTS, "population_count")
    ]
    items += [f"select section, '{c}', null, {c} from rates" for c in ("value", "coverage")]
    size = "(select count(*) from scoped)"
    return f"""with scoped as ({home_sql(scope)}), rates as ({' union all '.join(rate_parts)})
      {' union all '.join(items)}
      union all select 'sample', 'size', {size}, null
      union all select 'experience', keys.key, coalesce(n, 0), null from {_fixed_sql(O.EXPERIENCE_BUCKETS)}
        left join (select {_BUCKET} as key, count(*) as n from scoped group by 1) c on c.key = keys.key
      union all select 'remote', keys.key, coalesce(n, 0), coalesce(n, 0)::double / {size} from {_fixed_sql(O.REMOTE_MODES)}
        left join (select remote_mode as key, count(*) as n from scoped group by 1) c on c.key = keys.key
      union all select 'contract', contract_kind, count(*), count(*)::double / {size} from scoped group by contract_kind
      union all select 'technology', key, count, share from ({_TOP}) top"""


@query("overview", _overview_sql(HOME))
def _overview(t):
    return M.overview(_home(t), t.mentions)


@query(
    "single_row_cross",
    f"""with scoped as ({home_sql()})
        select (select count(*) from scoped) as sample_size,
          (select string_agg(k || '=' || n, ',' order by k) from (select contract_kind as k, count(*) as n from scoped group by 1) a) as contracts,
          (select string_agg(k || '=' || n, ',' order by k) from (select remote_mode as k, count(*) as n from scoped group by 1) b) as remote_modes""",
)
def _single_row(t):
    """One-row aggregates side by side: partial counts of both groupings, folded into a single row."""
    counts = _home(t).groupingSets([["contract_kind"], ["remote_mode"]], "contract_kind", "remote_mode").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("remote_mode").alias("is_contract")
    )
    def listed(key, flag):
        pairs = F.collect_list(F.when(F.col("is_contract") == flag, F.concat_ws("=", key, F.col("n"))))
        return F.array_join(F.array_sort(pairs), ",")

    return counts.agg(
        F.sum(F.when(F.col("is_contract") == 1, F.col("n"))).alias("sample_size"),
        listed("contract_kind", 1).alias("contracts"),
        listed("remote_mode", 0).alias("remote_modes"),
    )


@query(
    "family_counts",
    """select key, count(distinct offer_id) as count from (select offer_id, unnest(job_families) as key from {memberships}) f group by key""",
)
def _family_counts(t):
    return M.family_counts(t.memberships)


@query(
    "popular_areas",
    """select region_code as key, count(*) as count from {dataset_rows} where region_code is not null
       group by region_code order by count desc, key limit 12""",
)
def _popular_areas(t):
    return M.popular_areas(t.dataset_rows)


_SLUGS = ("docker", "elixir", "git", "go", "java", "kotlin", "php", "python", "react", "redis", "rust", "sql", "swift")


@query(
    "zero_filled_counts",
    f"""select keys.key, keys.position, coalesce(n, 0) as count from {_fixed_sql(_SLUGS)}
        left join (select slug as key, count(distinct m.classification_id) as n from {{mentions}} m group by slug) c on c.key = keys.key""",
)
def _zero_filled(t):
    return M.zero_filled(
        M.technology_counts(t.dataset_rows, t.mentions), M.fixed_keys(t.spark, _SLUGS)
    )


@query(
    "taxonomy_counts",
    f"""select 'job' as kind, keys.key, coalesce(n, 0) as count from {_fixed_sql(JOB_FAMILIES)}
          left join (select key, count(distinct offer_id) as n from (select offer_id, unnest(job_families) as key from {{memberships}}) f group by key) c on c.key = keys.key
        union all select 'technology', keys.key, coalesce(n, 0) from {_fixed_sql(_SLUGS)}
          left join (select slug as key, count(distinct classification_id) as n from {{mentions}} group by slug) c on c.key = keys.key
        union all select 'contract', keys.key, coalesce(n, 0) from {_fixed_sql(O.CONTRACT_KINDS)}
          left join (select contract_kind as key, count(*) as n from {{dataset_rows}} group by 1) c on c.key = keys.key
        union all select 'remote', keys.key, coalesce(n, 0) from {_fixed_sql(O.REMOTE_MODES)}
          left join (select remote_mode as key, count(*) as n from {{dataset_rows}} group by 1) c on c.key = keys.key
        union all select * from (select 'area', region_code, count(*) as n from {{dataset_rows}} group by region_code order by n desc, region_code limit 12) a""",
)
def _taxonomy_counts(t):
    return M.taxonomy_counts(t.dataset_rows, t.mentions, M.fixed_keys(t.spark, _SLUGS), JOB_FAMILIES)


@query("offer_volume", "select dataset_id, count(distinct offer_id) as offers from {memberships} group by dataset_id")
def _offer_volume(t):
    """Membership is unique per dataset and offer, which a distinct keeps true on any input."""
    return t.memberships.select("dataset_id", "offer_id").distinct().groupBy("dataset_id").agg(F.count(F.lit(1)).alias("offers"))


def _all_rates_sql(table: str, keys: str) -> str:
    parts = [
        rate_sql(f"select {keys}, '{m}' as metric_key, {v} as metric_version, {counts_sql(c)} from {table} group by {keys}, {v}")
        for m, v, c in (
            (R.CONTRADICTION, "junior_metric_version", BY_VERSION),
            (R.BEGINNER, f"'{R.BEGINNER_V1}'", BEGINNER),
            (R.SALARY, f"'{R.SALARY_V1}'", SALARY),
        )
    ]
    return " union all ".join(f"select * from ({p}) x" for p in parts)


@query(
    "daily_metrics",
    f"""select dataset_id, metric_key, metric_version, cast(business_date as varchar) as period_start, numerator, denominator,
          unknown_count, ambiguous_count, population_count, sample_quality, round(value, 8) as value, round(coverage, 8) as coverage
        from ({_all_rates_sql('{day_members}', 'dataset_id, business_date')}) m""",
)
def _daily_metrics(t):
    stored = M.daily_metrics(t.day_members, F.col("business_date"))
    return stored.select(
        "dataset_id", "metric_key", "metric_version", F.col("period_start").cast("string").alias("period_start"), *R.COUNTS,
        "population_count", "sample_quality", F.col("value").cast("double").alias("value"),
        F.col("coverage").cast("double").alias("coverage"),
    )


_SETS = [
    (), ("region_code",), ("contract_kind",), ("region_code", "contract_kind", "remote_mode"), ("department_code", "commune_code"),
    ("job_family",), ("technology_slug",), ("job_family", "technology_slug", "remote_mode"),
]


def _dimension_sql() -> str:
    parts = []
    for dims in _SETS:
        source = "{dataset_rows}"
        if "job_family" in dims:
            source = f"(select *, unnest(list_distinct(job_families)) as job_family from {source})"
        if "technology_slug" in dims:
            source = f"(select r.*, m.slug as technology_slug from {source} r join {{mentions}} m on m.classification_id = r.classification_id)"
        columns = ", ".join((d if d in dims else "null::varchar") + f" as k_{d}" for d in M.DIMENSIONS)
        present = " and ".join(f"{d} is not null" for d in dims) or "true"
        inner = f"select *, {columns} from {source} s where {present}"
        keys = "dataset_id, " + ", ".join(f"k_{d}" for d in M.DIMENSIONS)
        parts.append(f"select * from ({_all_rates_sql(f'({inner}) d', keys)}) u")
    return " union all ".join(parts)


@query(
    "metrics_by_dimension",
    f"""select {", ".join(f"k_{d} as {d}" for d in M.DIMENSIONS)}, metric_key,
          numerator, denominator, unknown_count, ambiguous_count, population_count, value, sample_quality from ({_dimension_sql()}) m""",
)
def _metrics_by_dimension(t):
    named = t.mentions.groupBy("classification_id").agg(F.collect_set("slug").alias("technologies"))
    rows = M.metrics_by_dimension(t.dataset_rows.join(named, "classification_id", "left"), _SETS)
    return rows.select(*M.DIMENSIONS, "metric_key", *R.COUNTS, "population_count", "value", "sample_quality")


# Three days in a row; each day some offers come, go, change their remote mode or their families, or are reclassified.
_DAYS = ("2024-01-13", "2024-01-14", "2024-01-15")
_CHANGING = """select d.* from (
     select dataset_id, junior_metric_version, cast(business_date as string) as day, offer_id, status, claims_junior, minimum_experience_months, beginner_friendly,
       contradictory_junior, junior_observation_status, junior_observation_contradictory,
       case when (user_id + dayofyear(business_date)) % 9 = 0 then not salary_transparent else salary_transparent end as salary_transparent,
       case when (user_id + dayofyear(business_date)) % 7 = 0 then 'remote' else remote_mode end as remote_mode, contract_kind,
       case when (user_id + dayofyear(business_date)) % 8 = 0 then arr('data') else job_families end as job_families
     from {day_members}) d"""
_CELL_SETS = [(), ("contract_kind",), ("remote_mode",), ("job_family",), ("job_family", "remote_mode")]


def _cells_sql() -> str:
    parts = []
    for dims in _CELL_SETS:
        source = f"(select * from ({_CHANGING}) c where day = '{_DAYS[2]}')"
        if "job_family" in dims:
            source = f"(select *, unnest(list_distinct(job_families)) as job_family from {source} e)"
        columns = ", ".join((d if d in dims else "null::varchar") + f" as k_{d}" for d in ("job_family", "contract_kind", "remote_mode"))
        present = " and ".join(f"{d} is not null" for d in dims) or "true"
        keys = "dataset_id, k_job_family, k_contract_kind, k_remote_mode"
        parts.append(f"select '{','.join(dims)}' as dimensions, u.* from ({_all_rates_sql(f'(select *, {columns} from {source} s where {present}) d', keys)}) u")
    return " union all ".join(parts)


@query(
    "stored_cells",
    f"""select dataset_id, dimensions, k_job_family as job_family, k_contract_kind as contract_kind, k_remote_mode as remote_mode, metric_key, numerator, denominator,
          unknown_count, ambiguous_count, population_count, value from ({_cells_sql()}) m""",
)
def _stored_cells(t):
    """The first day is counted whole, the others by what changed; the oracle counts the last day whole."""
    path, days = scratch_path(t.spark, "cells"), [t.sql(_CHANGING).filter(F.col("day") == day).drop("day") for day in _DAYS]
    Ce.store_cells(M.cells(days[0], _CELL_SETS), path)
    for before, after in zip(days, days[1:]):
        Ce.store_cells(Ce.next_cells(Ce.read_cells(t.spark, path), before, after, _CELL_SETS), path)
    last = days[2].select("dataset_id").distinct()
    rows = Ce.rates(Ce.read_cells(t.spark, path).join(last, "dataset_id", "left_semi"))
    return rows.select("dataset_id", "dimensions", "job_family", "contract_kind", "remote_mode", "metric_key", *R.COUNTS, "population_count", "value")


@query(
    "store_daily_metrics",
    f"""with fresh as (select * from ({_all_rates_sql('{day_members}', 'dataset_id, business_date')}) m)
        select dataset_id, metric_key, case when dayofyear(business_date) % 4 = 1 and dayofyear(business_date) % 3 <> 0 then 1 else numerator end as numerator,
          population_count from fresh""",
)
def _store_daily_metrics(t):
    """Every fourth day is stored already with another numerator; of these only the drafts, every third day, are replaced."""
    computed = M.daily_metrics(t.day_members, F.col("business_date"))
    day = F.dayofyear("period_start")
    stored = computed.filter(day % 4 == 1).withColumn("numerator", F.lit(1).cast("long"))
    drafts = t.datasets.filter(F.dayofyear("business_date") % 3 == 0).select("dataset_id")
    return M.store_daily_metrics(stored, computed, drafts).select("dataset_id", "metric_key", "numerator", "population_count")


@query(
    "percent_point_change",
    f"""with rates as materialized (
          select * from ({_all_rates_sql("(select * from {day_members} d where not ends_with(dataset_id, 'b'))", 'dataset_id, business_date')}) a
        ), following as (
          select *, lead(business_date) over w as next_date, lead(metric_version) over w as next_version, lead(sample_quality) over w as next_quality, lead(value) over w as next_value
          from rates window w as (partition by metric_key order by business_date)
        )
        select metric_key, cast(business_date as varchar) as date_a,
          concat_ws(',', case when metric_version <> next_version then 'method_differs' end,
            case when sample_quality = 'insufficient' or next_quality = 'insufficient' then 'sample_insufficient' end) as refused,
          case when metric_version = next_version and sample_quality <> 'insufficient' and next_quality <> 'insufficient' then round((next_value - value) * 100, 8) end as points
        from following where next_date = business_date + 1""",
)
def _percent_point_change(t):
    rows = M.daily_metrics(t.day_members, F.col("business_date")).filter(~F.col("dataset_id").endswith("b"))
    rows = rows.withColumn("period_days", F.lit(1)).withColumn("value", F.try_divide("numerator", "denominator"))
    next_day = rows.withColumn("period_start", F.date_sub("period_start", 1))
    changes = M.percent_point_change(rows, next_day, ["metric_key", "period_start"])
    return changes.select("metric_key", F.col("period_start").cast("string").alias("date_a"), "refused", "points")


# ------------------------------------------------------------------ explorer

_SORT_SQL = {
    "published_desc": "source_published_at desc nulls last, offer_id desc",
    "published_asc": "source_published_at asc nulls last, offer_id asc",
    "experience_desc": "minimum_experience_months desc nulls last, offer_id desc",
    "experience_asc": "minimum_experience_months asc nulls last, offer_id asc",
}


@query(
    "explorer_page",
    " union all ".join(
        f"select * from (select '{s}' as sort, offer_id, cast(source_published_at as varchar) as published, minimum_experience_months as months from {ROWS} r order by {o} limit 26) p"
        for s, o in _SORT_SQL.items()
    ),
)
def _explorer_page(t):
    pages = [
        X.explorer_page(_rows(t), sort).select(
            F.lit(sort).alias("sort"), "offer_id", F.date_format("source_published_at", "yyyy-MM-dd HH:mm:ss").alias("published"),
            F.col("minimum_experience_months").alias("months"),
        )
        for sort in X.SORTS
    ]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


_AFTER = ("2024-01-10 00:00:00", "000000000500")


@query(
    "keyset_after",
    f"""select 'published_desc' as sort, offer_id from {ROWS} r where source_published_at < timestamp '{_AFTER[0]}'
          or source_published_at is null or (source_published_at = timestamp '{_AFTER[0]}' and offer_id < '{_AFTER[1]}')
        union all select 'published_null_tail', offer_id from {ROWS} r where source_published_at is null and offer_id < '{_AFTER[1]}'
        union all select 'experience_asc', offer_id from {ROWS} r where minimum_experience_months > 12
          or minimum_experience_months is null or (minimum_experience_months = 12 and offer_id > '{_AFTER[1]}')""",
)
def _keyset_after(t):
    rows = _rows(t)
    instant = F.lit(_AFTER[0]).cast("timestamp")
    parts = [
        ("published_desc", X.keyset_after("published_desc", instant, _AFTER[1])),
        ("published_null_tail", X.keyset_after("published_desc", None, _AFTER[1])),
        ("experience_asc", X.keyset_after("experience_asc", 12, _AFTER[1])),
    ]
    tags = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in parts])))
    return rows.select(tags.alias("sort"), "offer_id")


@query(
    "explorer_layout",
    f"""select 'first' as page, offer_id from (select offer_id from {ROWS} r order by source_published_at desc nulls last, offer_id desc limit 26) a
        union all select 'after', offer_id from (select offer_id from {ROWS} r where source_published_at > timestamp '{_AFTER[0]}' or source_published_at is null
          or (source_published_at = timestamp '{_AFTER[0]}' and offer_id > '{_AFTER[1]}') order by source_published_at nulls last, offer_id limit 26) b
        union all select 'rare', offer_id from (select offer_id from {ROWS} r where remote_mode = 'onsite' and salary_transparent
          order by source_published_at desc nulls last, offer_id desc limit 26) c""",
)
def _explorer_layout(t):
    """Pages from members stored in the order of the explorer."""
    path, size = scratch_path(t.spark, "layout"), 500
    rows = _rows(t).select("offer_id", "source_published_at", "remote_mode", "salary_transparent")
    L.write_layout(rows, path, "source_published_at", max(2, t.documents.count() // size))
    instant = dt.datetime.fromisoformat(_AFTER[0])
    pages = {
        "first": L.layout_page(t.spark, path),
        "after": L.layout_page(t.spark, path, "published_asc", after=(instant, _AFTER[1])),
        "rare": L.layout_page(t.spark, path, narrowed=lambda r: r.filter("remote_mode = 'onsite' and salary_transparent")),
    }
    return reduce(DataFrame.unionByName, [page.select(F.lit(name).alias("page"), "offer_id") for name, (page, _) in pages.items()])


_EXPLORER = Scope(period="90d", contracts="cdi,cdd,interim")


def _explorer(t):
    return X.explorer_filter(
        _rows(t), _EXPLORER, t.mentions, segment="contradictory", salary_published=True, buckets=("24_35", "60_plus")
    )


_EXPLORER_SQL = f"""select *, {_SEGMENT} as segment, {_BUCKET} as bucket from ({home_sql(_EXPLORER)}) s
   where ({_SEGMENT}) = 'contradictory' and salary_transparent and ({_BUCKET}) in ('24_35', '60_plus')"""


@query("filtered_total", f"select count(*) as total from ({_EXPLORER_SQL}) e")
def _filtered_total(t):
    return _explorer(t).agg(F.count(F.lit(1)).alias("total"))


@query(
    "explorer",
    f"""select offer_id, segment, bucket, title, availability, company_name, technologies, proofs from (
          select e.offer_id, segment, bucket, title, source_published_at,
            case when closed_at is not null then 'closed' when missing_since is not null then 'not_seen' else 'active' end as availability,
            case when closed_at is null then company_name end as company_name,
            coalesce((select string_agg(distinct slug, ',' order by slug) from {{mentions}} m where m.classification_id = e.classification_id), '') as technologies,
            (select count(*) from {{mentions}} m where m.classification_id = e.classification_id) as proofs
          from ({_EXPLORER_SQL}) e order by source_published_at desc nulls last, e.offer_id desc limit 26) page""",
)
def _explorer_query(t):
    page = X.explorer_page(_explorer(t))
    details = X.public_offer(X.offer_details(page, _evidence(t), t.mentions))
    return details.select(
        "offer_id", "segment", "bucket", "title", "availability", "company_name",
        F.array_join("technologies", ",").alias("technologies"), F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("proofs"),
    )


def _evidence(t):
    """Evidence rows of the technology mentions, enough for the detail join."""
    return t.mentions.select(
        "classification_id", F.lit(0).alias("ordinal"), F.lit("technology").alias("kind"), F.lit("TECHNOLOGY_ALIAS_MENTION").alias("rule_id"),
        F.lit("description").alias("field"), F.col("slug").alias("excerpt"), F.col("slug").alias("normalized_value"),
    )


@query(
    "offer_details",
    f"""select p.offer_id, coalesce((select string_agg(distinct slug, ',' order by slug) from {{mentions}} m where m.classification_id = p.classification_id), '') as technologies,
          (select count(*) from {{mentions}} m where m.classification_id = p.classification_id) as proofs
        from (select * from {ROWS} r order by {_SORT_SQL['published_desc']} limit 26) p""",
)
def _offer_details(t):
    details = X.offer_details(X.explorer_page(_rows(t)), _evidence(t), t.mentions)
    return details.select(
        "offer_id", F.array_join("technologies", ",").alias("technologies"), F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("proofs")
    )


@query(
    "filter_fingerprint",
    """select offer_id, sha256('{"job":"' || job_families[1] || '","contract":"' || contract_kind || '","remote":' || coalesce('"' || remote_mode || '"', 'null') || '}') as fingerprint
       from {dataset_rows}""",
)
def _filter_fingerprint(t):
    filters = F.struct(F.col("job_families")[0].alias("job"), F.col("contract_kind").alias("contract"), F.col("remote_mode").alias("remote"))
    return t.dataset_rows.select("offer_id", O.filter_fingerprint(filters).alias("fingerprint"))


@query(
    "public_id",
    """select doc_id, 'offer_' || replace(replace(replace(base64(unhex(md5(text))), '+', '-'), '/', '_'), '=', '') as public_id,
         'incident_' || substring(replace(replace(base64(unhex(sha256(offer_id))), '+', '-'), '/', '_'), 1, 16) as incident_id
       from (select d.doc_id, d.text, o.offer_id from {documents} d join {offer_rows} o on o.doc_id = d.doc_id) x""",
)
def _public_id(t):
    rows = t.sql("select d.doc_id, d.text, lpad(cast(d.doc_id as string), 12, '0') as offer_id from {documents} d")
    uuid = F.regexp_replace(F.md5("text"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return rows.select(
        "doc_id", O.public_offer_id(uuid).alias("public_id"), O.public_incident_id(F.col("offer_id")).alias("incident_id")
    )


# ------------------------------------------------------------------ trends

TREND_SCOPE = Scope(period="30d")
_PUBLISHED = "(select * from {day_members} where dataset_status = 'published' and published_at is not null)"


def _daily_sql(scope: Scope, conditions: dict[str, str], where: str = "true") -> str:
    keys = ", ".join(H.DATASET_KEYS)
    day = "cast(timezone('Europe/Paris', timezone('UTC', source_cutoff_at)) as date)"
    counted = f"""select {keys}, {day} as date, count(*) as sample_size, {counts_sql(conditions)}
       from ({scope_sql(scope, _PUBLISHED)}) s group by {keys}"""
    ranked = f"select *, row_number() over (partition by date order by published_at desc, dataset_version desc) as rn from ({counted}) c"
    return f"select * exclude (rn) from ({ranked}) r where rn = 1 and {where} order by date desc limit 366"


def _trend_sql(scope: Scope, conditions: dict[str, str], where: str = "true") -> str:
    change = lambda c: f"lag({c}) over (order by date) <> {c}"
    return f"""select *, case when decision = 'publish_partial' then 'partial_day'
        when {change('query_set_version')} then 'source_change' when {change('junior_metric_version')} then 'methodology_change'
        when {change('classifier_version')} then 'classifier_change' end as annotation
      from ({rate_sql(_daily_sql(scope, conditions, where))}) points"""


@query(
    "latest_dataset_per_day",
    """select cast(date as varchar) as date, dataset_version from (
         select *, row_number() over (partition by date order by published_at desc, dataset_version desc) as rn
         from (select *, cast(timezone('Europe/Paris', timezone('UTC', source_cutoff_at)) as date) as date from {datasets}) d) r where rn = 1""",
)
def _latest_per_day(t):
    dated = t.datasets.withColumn("date", O.business_date(F.col("source_cutoff_at")))
    return H.latest_per_day(dated).select(F.col("date").cast("string").alias("date"), "dataset_version")


@query(
    "latest_publication_per_business_date",
    """select cast(business_date as varchar) as business_date, dataset_id from (
         select *, row_number() over (partition by business_date order by published_at desc, dataset_id desc) as rn from {datasets} where status = 'published') r
       where rn = 1""",
)
def _latest_publication(t):
    published = t.datasets.filter(F.col("status") == "published")
    latest = first_by(published, ["business_date"], ["published_at", "dataset_id"], descending=True)
    return latest.select(F.col("business_date").cast("string").alias("business_date"), "dataset_id")


_POINT = ["dataset_version", *R.COUNTS, "population_count", "value", "coverage", "sample_quality", "sample_size", "annotation"]


@query("trends", f"select cast(date as varchar) as date, {', '.join(_POINT)} from ({_trend_sql(TREND_SCOPE, BY_VERSION)}) t")
def _trends(t):
    return H.trends(t.day_members, TREND_SCOPE).select(F.col("date").cast("string").alias("date"), *_POINT)


@query(
    "trend_tail",
    f"""select cast(date as varchar) as date, {', '.join(_POINT)} from (
        {_trend_sql(Scope(period='current', job='backend'), BEGINNER, "date >= date '2024-01-05' and date <= date '2024-01-20'")
           .replace("when lag(junior_metric_version) over (order by date) <> junior_metric_version then 'methodology_change'", "")}) t""",
)
def _trend_tail(t):
    points = H.trends(
        t.day_members, Scope(period="current", job="backend"), R.BEGINNER, start="2024-01-05", end="2024-01-20"
    )
    return points.select(F.col("date").cast("string").alias("date"), *_POINT)


@query(
    "trend_annotations",
    f"select cast(date as varchar) as date, annotation from ({_trend_sql(Scope(period='current'), V1)}) t where annotation is not null",
)
def _trend_annotations(t):
    daily = H.latest_per_day(H.trend_counts(t.day_members.filter("dataset_status = 'published'"), R.CONTRADICTION))
    return H.trend_annotations(daily).filter("annotation is not null").select(F.col("date").cast("string").alias("date"), "annotation")


@query(
    "trend_segments",
    f"""with points as ({_trend_sql(Scope(period='current'), BY_VERSION)}),
        marked as (select *, lag(date) over w is null or lag(value) over w is null or annotation is not null
            or coalesce(lag(annotation) over w = 'partial_day', false) or date - lag(date) over w > 1 as break_before
          from points window w as (order by date))
        select cast(date as varchar) as date, round(value, 8) as value, break_before, sum(break_before::int) over (order by date)::bigint as segment
        from marked where value is not null""",
)
def _trend_segments(t):
    segments = H.trend_segments(H.trends(t.day_members, Scope(period="current")))
    return segments.select(F.col("date").cast("string").alias("date"), F.round("value", 8).alias("value"), "break_before", "segment")


@query(
    "moving_average_7d",
    f"""with points as ({_trend_sql(Scope(period='current'), BY_VERSION)})
        select cast(date as varchar) as date, round(avg(value) over w, 8) as average_7d,
          count(*) filter (where decision = 'publish_partial') over w as partial_days
        from points window w as (order by date range between interval 6 days preceding and current row)""",
)
def _moving_average(t):
    points = H.moving_average_7d(H.trends(t.day_members, Scope(period="current")))
    return points.select(F.col("date").cast("string").alias("date"), F.round("average_7d", 8).alias("average_7d"), "partial_days")


@query(
    "freeze_distinct_on",
    """select region_code, offer_id, classification_id from (select *, row_number() over (partition by region_code order by classification_id) as rn
       from {dataset_rows}) r where rn = 1""",
)
def _freeze_distinct_on(t):
    """The first classification per key, as a map-side aggregate."""
    rows = t.dataset_rows.select("region_code", "offer_id", "classification_id")
    return first_by(rows, ["region_code"], ["classification_id"])
