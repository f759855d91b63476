"""Observatory tables derived from the supplied ones.

Each table is one SELECT in the common part of Spark SQL and the oracle's SQL, written once: offers
come from `documents` (phrases planted by the remainder of the id), runs, sightings and datasets from
`events`. `frames` evaluates them on Spark; `oracle` turns a query into a statement with the same
selects as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.session import prepare

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cases(key: str, values: list[str], default: str = "''") -> str:
    """`case <key> when 0 then .. when 1 then ..` over SQL literals; the last branch is the default."""
    whens = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"(case {key} {whens} else {default} end)"


def _text(*values: str) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


_ROLES = _text(
    "Développeur Java",
    "Développeuse Python",
    "Ingénieur DevOps",
    "Data engineer",
    "Développeur front-end React",
    "Développeur full stack",
    "Testeur logiciel",
    "Analyste cybersécurité",
    "Développeur mobile Flutter",
    "Comptable général",
)
_LEVELS = _text("", " junior", " débutant", " senior", " senior ou junior", " profil non junior", " lead")
_REQUIREMENTS = _text(
    "",
    " Une expérience d'au moins 2 ans est exigée.",
    " Expérience de 1 à 2 ans demandée.",
    " 6 mois d'expérience minimum.",
    " Idéalement 5 ans d'expérience.",
    " Notre entreprise, créée il y a 30 ans, recrute.",
    " Elle propose une formation de 3 ans.",
    " Vous disposez de 18 mois d'expérience.",
    " Aucune expérience requise.",
    " Cinq ans d'expérience exigée.",
    " Minimum 1 an d'expérience requis. Puis 3 ans d’expérience exigés.",
)
_REMOTE = _text(
    " Poste en full remote.",
    " Télétravail possible.",
    " Mode hybride.",
    " Présence obligatoire.",
    " Full remote, mode hybride.",
    " 2 jours de télétravail.",
    "",
    " Aucun télétravail.",
)
_TECHNOLOGY = _text(
    " Stack: React Native, TypeScript.",
    " Java et Spring Boot.",
    " Python, Django, SQL.",
    " Go, langage backend.",
    " CI/CD, Docker, k8s.",
    " C# et .NET.",
    " Digital et Git.",
    " JS, React.js, Node.js.",
    "",
)
_SALARY = _text("Mensuel de 2500 à 3000 €", "35000 € par an", "selon profil", "à négocier", "12 EUR / h", "")
_FAMILIES = [
    "arr('software')",
    "arr('software','backend')",
    "arr('devops-cloud')",
    "arr('data')",
    "arr('frontend')",
    "arr('fullstack','backend','frontend')",
    "arr('qa-test')",
    "arr('cybersecurity')",
    "arr('mobile')",
]
_KINDS = _text("cdi", "cdd", "interim", "alternance", "internship", "freelance", "public", "other", "unknown")


def _classified(source: str, key: str) -> str:
    """Add the classification columns of an id by plain CASE, crossing every kind of row."""
    months = _cases(f"{key} % 11", ["null", "24", "12", "6", "null", "0", "13", "18", "36", "60", "23"], "null")
    return f"""
      select *,
        case when status = 'classified' and minimum_experience_months is not null
          then minimum_experience_months <= 12 end as beginner_friendly,
        case when status = 'classified' and claims_junior is not null then
          case when not claims_junior then false
               when minimum_experience_months is null then null
               else minimum_experience_months >= 24 end end as contradictory_junior,
        case when claims_junior is not true then 'unknown'
             when status = 'ambiguous' and {key} % 2 = 0 then 'ambiguous'
             when minimum_experience_months is null then 'unknown' else 'resolved' end as junior_observation_status,
        case when claims_junior is not true or minimum_experience_months is null
               or (status = 'ambiguous' and {key} % 2 = 0) then null
             else minimum_experience_months >= 24 end as junior_observation_contradictory
      from (
        select *,
          case when {key} % 17 = 3 then 'ambiguous' when {key} % 19 = 4 then 'unclassified' else 'classified' end as status,
          case when {key} % 17 <> 3 and {key} % 19 = 4 then null
               when {key} % 7 in (1, 2, 4) then true when {key} % 7 in (3, 6) then false end as claims_junior,
          case when {key} % 17 <> 3 and {key} % 19 = 4 then null
               else cast({months} as int) end as minimum_experience_months,
          {key} % 6 in (0, 1) as salary_transparent,
          {_cases(f"{key} % 8", _text("remote", "remote", "hybrid", "hybrid", "hybrid", "onsite"), "'unknown'")} as remote_mode
        from ({source}) base_rows
      ) statused"""


_DAY = "cast(ts as date)"
_V = "dayofyear(day)"

TABLES: dict[str, str] = {
    # ------------------------------------------------------------ offers from documents
    "offer_rows": f"""
      select doc_id, lang,
        lpad(cast(doc_id as string), 12, '0') as offer_id,
        'S' || lpad(cast(doc_id as string), 12, '0') as snapshot_id,
        'C' || lpad(cast(doc_id as string), 12, '0') as classification_id,
        {_cases("doc_id % 10", _ROLES)} || {_cases("doc_id % 7", _LEVELS)} as title,
        text || {_cases("doc_id % 11", _REQUIREMENTS)} || {_cases("doc_id % 8", _REMOTE)}
             || {_cases("doc_id % 9", _TECHNOLOGY)} as description_text,
        {_cases("doc_id % 5", _text("E", "D", "S"), "null")} as experience_code,
        {_cases("doc_id % 6", _text("2 An(s)", "Débutant accepté", "Expérience souhaitée de 1 An(s)"), "null")} as experience_label,
        {_cases("doc_id % 9", _text("CDI", "CDD", "MIS", "SAI", "CDI", "CDD", "FRA"), "null")} as contract_code,
        doc_id % 14 = 5 as alternance,
        nullif({_cases("doc_id % 6", _SALARY)}, '') as salary_label,
        {_cases("doc_id % 9", _KINDS)} as contract_kind,
        source as region_code,
        'D' || cast(doc_id % 23 as string) as department_code,
        'V' || cast(doc_id % 37 as string) as commune_code,
        case when doc_id % 4 = 0 then null else 'Company ' || cast(doc_id % 50 as string) end as company_name,
        case when doc_id % 13 = 0 then null
             else timestamp '2024-01-30 00:00:00' - (doc_id % 120) * interval '1' day end as published_at,
        case when doc_id % 12 = 0 then 'http://jobs.example.org/o/' || cast(doc_id as string)
             when doc_id % 12 = 1 then 'ftp://jobs.example.org/o' when doc_id % 12 = 2 then 'not a url'
             when doc_id % 12 = 3 then null
             else 'https://jobs.example.org/o/' || cast(doc_id as string) end as source_url,
        case when doc_id % 16 = 1 then timestamp '2024-01-28 00:00:00' end as closed_at,
        case when doc_id % 16 in (1, 2) then timestamp '2024-01-27 00:00:00' end as missing_since,
        timestamp '2024-01-29 00:00:00' + (doc_id % 24) * interval '1' hour as last_seen_at,
        {_cases("doc_id % 10", _FAMILIES, "arr('software','data')")} as job_families
      from {{documents}}""",
    "classified_offers": _classified("select * from {offer_rows}", "doc_id"),
    "snapshots": """
      select snapshot_id, offer_id, title, description_text, company_name, contract_kind, region_code, department_code,
        commune_code, published_at as source_published_at, experience_code, experience_label, salary_label, source_url
      from {offer_rows}""",
    "classifications": """
      select classification_id, snapshot_id, 'rules-2' as classifier_version, status, claims_junior,
        minimum_experience_months, beginner_friendly, contradictory_junior, junior_observation_status,
        junior_observation_contradictory, salary_transparent, remote_mode
      from {classified_offers}""",
    "memberships": """
      select 'current' as dataset_id, offer_id, snapshot_id, classification_id, job_families from {offer_rows}""",
    "mentions": """
      select classification_id, slug from (
        select classification_id, explode(arr(
          case when doc_id % 3 = 0 then 'python' end, case when doc_id % 4 = 1 then 'java' end,
          case when doc_id % 5 = 2 then 'react' end, case when doc_id % 7 = 3 then 'docker' end,
          case when doc_id % 2 = 1 then 'sql' end, case when doc_id % 9 = 4 then 'go' end,
          case when doc_id % 11 = 6 then 'rust' end, case when doc_id % 13 = 7 then 'php' end,
          case when doc_id % 17 = 1 then 'kotlin' end, case when doc_id % 19 = 2 then 'swift' end,
          case when doc_id % 23 = 5 then 'redis' end, case when doc_id % 6 = 1 then 'git' end)) as slug
        from {offer_rows}) all_mentions
      where slug is not null""",
    "current_datasets": """
      select 'current' as dataset_id, '2024-01-30__rules-2__queries-3' as dataset_version,
        timestamp '2024-01-30 00:00:00' as source_cutoff_at, 'published' as status,
        timestamp '2024-01-30 06:00:00' as published_at, true as is_current,
        'junior-contradiction-2.0.0' as junior_metric_version, 'rules-2' as classifier_version,
        'queries-3' as query_set_version, count(*) as source_rows, 'publish' as decision
      from {documents}""",
    "dataset_rows": """
      select c.*, m.dataset_id, d.dataset_version, d.source_cutoff_at, d.junior_metric_version
      from {memberships} m
      join {current_datasets} d on d.dataset_id = m.dataset_id
      join {classified_offers} c on c.classification_id = m.classification_id""",
    # ------------------------------------------------------------ runs, sightings, datasets from events
    "sightings": f"""
      select 'R' || cast({_DAY} as string) as run_id, event_type as query_id,
        lpad(cast(user_id as string), 8, '0') as offer_id, user_id, ts as observed_at, event_id,
        {_DAY} as day, 'v' || cast(cast(floor(value / 20) as bigint) % 3 as string) as content_hash,
        event_id % 29 = 0 as offer_created, event_id % 7 = 0 as snapshot_created
      from {{events}}""",
    # Hour of the day as a further query spreads the volumes, so that all verdicts of the policy occur.
    "hourly_sightings": """
      select run_id, query_id || '/' || cast(hour(observed_at) as string) as query_id, offer_id, observed_at, event_id
      from {sightings}""",
    # A query without a sighting on one day and a run without any on another: both must show as lost.
    "quality_sightings": """
      select * from {sightings} where not (dayofyear(day) = 14 and query_id = 'error') and dayofyear(day) <> 27""",
    "hourly_queries": """
      select r.run_id, q.query_id from {runs} r join (select distinct query_id from {hourly_sightings}) q on true""",
    "runs": f"""
      select 'R' || cast(day as string) as run_id, 'source-1' as source_id, day as business_date, 'full' as mode,
        case when {_V} < 16 then 'queries-2' else 'queries-3' end as query_set_version,
        case when {_V} = 12 then 'partial' when {_V} = 19 then 'failed' else 'succeeded' end as status,
        {_V} not in (12, 19) as closure_eligible,
        first_at as created_at, first_at as started_at, last_at as finished_at, received as offers_received,
        received - invalid as offers_valid, invalid as offers_quarantined, received + 7 as requests_count,
        invalid * 2 as offers_new, invalid * 3 as offers_updated, invalid * 4 as offers_marked_missing, invalid * 5 as offers_closed
      from (select {_DAY} as day, min(ts) as first_at, max(ts) as last_at, count(*) as received,
              cast(sum(case when event_id % 41 = 0 then 1 else 0 end) as bigint) as invalid
            from {{events}} group by {_DAY}) days""",
    "run_queries": f"""
      select 'R' || cast(day as string) as run_id, query_id,
        case when {_V} = 12 and query_id = 'view' then 'failed' else 'succeeded' end as status
      from (select distinct {_DAY} as day, event_type as query_id from {{events}}) pairs""",
    "page_facts": f"""
      select run_id, query_id, page, range_start,
        case when {_V} = 9 and query_id = 'click' and page = 1 then range_start + 1
             when page = last_page then null else range_start + received end as next_range_start,
        page = last_page or ({_V} = 7 and query_id = 'error' and page = 0) as is_terminal,
        received as received_count, received - invalid as valid_count, invalid as quarantined_count,
        cast(received - invalid - outside as bigint) as in_perimeter_count, outside as warning_count,
        case when {_V} = 11 and query_id = 'signup' and page = 0 then total + 1 else total end as source_total,
        committed_at, day
      from (
        select *, 'R' || cast(day as string) as run_id,
          cast(coalesce(sum(received) over (partition by day, query_id order by page
            rows between unbounded preceding and 1 preceding), 0) as bigint) as range_start,
          max(page) over (partition by day, query_id) as last_page,
          cast(sum(received) over (partition by day, query_id) as bigint) as total
        from (
          select {_DAY} as day, event_type as query_id, cast(floor(hour(ts) / 6) as int) as page, count(*) as received,
            cast(sum(case when event_id % 41 = 0 then 1 else 0 end) as bigint) as invalid,
            cast(sum(case when event_id % 41 <> 0 and event_id % 5 = 0 then 1 else 0 end) as bigint) as outside,
            max(ts) as committed_at
          from {{events}} group by {_DAY}, event_type, cast(floor(hour(ts) / 6) as int)) counted
      ) paged
      where not ({_V} = 5 and query_id = 'view' and page = 2)""",
    "datasets": f"""
      select 'D' || cast(business_date as string) || suffix as dataset_id,
        cast(business_date as string) || suffix || '__' || query_set_version as dataset_version, run_id, source_id,
        business_date, finished_at as source_cutoff_at, query_set_version,
        case when dayofyear(business_date) < 11 then 'rules-1' else 'rules-2' end as classifier_version,
        case when dayofyear(business_date) < 21 then 'junior-contradiction-1.0.0'
             else 'junior-contradiction-2.0.0' end as junior_metric_version,
        case when dayofyear(business_date) = 25 then 'withdrawn' else 'published' end as status,
        case when dayofyear(business_date) = 12 then 'publish_partial' else 'publish' end as decision,
        finished_at + (case when suffix = '' then 1 else 2 end) * interval '1' hour as published_at
      from (select *, '' as suffix from {{runs}}
            union all select *, 'b' as suffix from {{runs}} where dayofyear(business_date) = 8) versions
      where status <> 'failed'""",
    "day_members": _classified(
        """select s.user_id, s.offer_id, d.dataset_id, d.dataset_version, d.source_cutoff_at, d.published_at,
             d.status as dataset_status, d.decision, d.classifier_version, d.query_set_version, d.junior_metric_version,
             d.business_date, """
        + _cases("s.user_id % 10", _FAMILIES, "arr('software','data')")
        + """ as job_families,
             """
        + _cases("s.user_id % 9", _KINDS)
        + """ as contract_kind,
             case when s.user_id % 13 = 0 then null
               else timestamp '2024-01-20 00:00:00' - (s.user_id % 60) * interval '1' day end as source_published_at
           from (select distinct run_id, user_id, offer_id from {sightings}) s join {datasets} d on d.run_id = s.run_id""",
        "user_id",
    ),
    "source_queries": """
      select event_type as query_id, 'queries-3' as query_set_version, event_type <> 'error' as enabled,
        cast(case when event_type = 'signup' then timestamp '2024-01-20 00:00:00' end as timestamp) as valid_to,
        case when event_type = 'view' then arr('software','backend') else arr('data') end as job_families, seen
      from (select event_type, count(*) as seen from {events} group by event_type) types""",
    "matches": f"""
      select offer_id, query_id, max(user_id) as user_id, min(observed_at) as first_matched_at, max(observed_at) as last_matched_at,
        case when max(user_id) % 3 = 0 then null else {_cases("max(user_id) % 10", _FAMILIES, "arr('software','data')")} end as job_families
      from {{sightings}} group by offer_id, query_id""",
    "offer_state": """
      select lpad(cast(user_id as string), 8, '0') as offer_id, user_id, min(ts) as first_seen_at, max(ts) as last_seen_at,
        cast(case when user_id % 9 = 4 then timestamp '2024-01-25 00:00:00' end as timestamp) as closed_at,
        cast(case when user_id % 9 in (4, 5) then timestamp '2024-01-24 00:00:00' end as timestamp) as missing_since,
        cast(user_id % 2 as int) as reopened_count
      from {events} where ts < timestamp '2024-01-20 00:00:00' group by user_id""",
    "offer_snapshots": """
      select 'S' || offer_id as snapshot_id, offer_id, user_id, cast(null as timestamp) as valid_to from {offer_state}""",
    "user_classifications": _classified(
        """select 'C' || offer_id as classification_id, 'S' || offer_id as snapshot_id, offer_id, user_id,
             case when user_id % 31 = 0 then 'rules-1' else 'rules-2' end as classifier_version from {offer_state}""",
        "user_id",
    ),
    # Every third offer also has a classification of an older version, which must not count.
    "versioned_classifications": _classified(
        """select 'C' || offer_id as classification_id, 'S' || offer_id as snapshot_id, offer_id, user_id,
             case when user_id % 31 = 0 then 'rules-1' else 'rules-2' end as classifier_version from {offer_state}
           union all
           select 'O' || offer_id, 'S' || offer_id, offer_id, user_id, 'rules-1' from {offer_state}
           where user_id % 3 = 0 and user_id % 31 <> 0""",
        "user_id",
    ),
    "user_evidence": """
      select classification_id, offer_id, kind, 'x' as excerpt from (
        select classification_id, offer_id, user_id, explode(arr('junior_claim', 'required_experience')) as kind
        from {user_classifications}) e
      where user_id % 37 <> 0""",
    "quality_events": """
      select event_id, 'D' || cast(cast(ts as date) as string) as dataset_id,
        case when event_type = 'error' then 'error' when event_type = 'view' then 'info' else 'warning' end as severity,
        case when event_id % 3 = 0 then 'MONITOR_DATA_NOT_FRESH' when event_id % 3 = 1 then 'MONITOR_INCOMPLETE_QUERIES'
             when event_id % 101 = 2 then 'DATASET_ROLLBACK' else 'RETENTION_PURGED' end as event_code,
        'monitor:' || event_type as scope, event_id % 4 <> 0 as is_public, ts as created_at,
        cast(case when event_id % 5 <> 0 then ts + interval '1' hour end as timestamp) as resolved_at
      from {events}""",
    # ------------------------------------------------------------ labelled sample
    "label_rows": """
      select l.doc_id, lpad(cast(l.doc_id as string), 12, '0') as review_id, d.source as query_group, d.lang,
        case when l.toxic = 1 then null else l.quality = 1 end as reference_positive,
        d.n_chars % 3 <> 0 as predicted_positive,
        case when l.toxic = 1 then 'ambiguous' when l.quality = 1 then 'classified' else 'unclassified' end as reference_status,
        case when d.n_chars % 5 = 0 then 'ambiguous' when d.n_chars % 3 <> 0 then 'classified' else 'unclassified' end as predicted_status,
        case when d.n_chars % 4 = 0 then null else cast(d.n_chars % 7 as int) * 6 end as predicted_months,
        case when d.n_chars % 6 = 0 then null else cast(d.n_chars % 7 as int) * 6 + (case when d.n_chars % 11 = 0 then 1 else 0 end) end as reference_months,
        case when l.doc_id % 3 = 0 then 'challenge' else 'reference' end as cohort
      from {labels} l join {documents} d on d.doc_id = l.doc_id""",
}

_SPARK = (("arr(", "array("),)
_ORACLE = (("arr(", "list_value("), ("explode(", "unnest("))


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in TABLES or n in BASE]


class Frames:
    """Derived tables of one data folder, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = prepare(spark), sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.sql(TABLES[name])
            elif name in BASE:
                self._known[name] = _instants(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
            else:
                raise AttributeError(name)
        return self._known[name]

    def sql(self, sql: str) -> DataFrame:
        """Run a SELECT of the common dialect over base or derived tables."""
        for old, new in _SPARK:
            sql = sql.replace(old, new)
        return self.spark.sql(sql, **{n: getattr(self, n) for n in _needs(sql)})


def _instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps are UTC instants here."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in plain else F.col(c) for c in df.columns])


def oracle(sql: str) -> str:
    """The statement for the oracle: every derived table it needs as a common table expression."""
    order: list[str] = []

    def visit(name: str):
        if name in TABLES and name not in order:
            for needed in _needs(TABLES[name]):
                visit(needed)
            order.append(name)

    for name in _needs(sql):
        visit(name)
    parts = [f"{n} as ({TABLES[n]})" for n in order]
    body = sql.strip()
    if parts:
        head = "with " + ",\n".join(parts)
        body = head + ",\n" + body[5:] if body[:5].lower() == "with " else head + "\n" + body
    body = re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES or m[1] in BASE else m[0], body)
    for old, new in _ORACLE:
        body = body.replace(old, new)
    return body
