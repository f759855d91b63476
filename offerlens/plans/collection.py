"""Runs, history, quality, publication and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import offers as O
from offerlens.functions import rates as R
from offerlens.operators import history as Hi
from offerlens.operators import metrics as M
from offerlens.operators import publish as Pu
from offerlens.operators import quality as Q
from offerlens.operators.skew import first_by
from offerlens.plans.read_models import _all_rates_sql
from offerlens.plans.registry import query
from offerlens.sources import tables as T

RUN, BEFORE = "R2024-01-30", "R2024-01-29"
NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _sql_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {column}"


# ------------------------------------------------------------------ history


@query(
    "record_sightings",
    f"""select run_id, query_id, offer_id, {_sql_text("max(observed_at)").replace("as max(observed_at)", "as observed_at")},
          bool_or(offer_created) as offer_created, bool_or(snapshot_created) as snapshot_created
        from {{sightings}} group by run_id, query_id, offer_id""",
)
def _record_sightings(t):
    return Hi.record_sightings(t.sightings).withColumn("observed_at", _text("observed_at"))


@query(
    "record_matches",
    """select offer_id, query_id, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') as first_matched_at,
         strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') as last_matched_at, arg_max(content_hash, (observed_at, event_id)) as families
       from {sightings} group by offer_id, query_id""",
)
def _record_matches(t):
    rows = Hi.record_matches(t.sightings.withColumn("job_families", F.array("content_hash")))
    return rows.select("offer_id", "query_id", _text("first_matched_at"), _text("last_matched_at"), F.array_join("job_families", ",").alias("families"))


_CHANGES = """select *, lead(observed_at) over (partition by offer_id order by observed_at, event_id) as next_at from (
   select *, lag(content_hash) over (partition by offer_id order by observed_at, event_id) as before from {sightings}) s
   where before is null or before <> content_hash"""


@query(
    "snapshot_intervals",
    f"""select offer_id, content_hash, strftime(observed_at, '%Y-%m-%d %H:%M:%S') as valid_from,
          strftime(next_at, '%Y-%m-%d %H:%M:%S') as valid_to from ({_CHANGES}) c""",
)
def _snapshot_intervals(t):
    return Hi.snapshot_intervals(t.sightings).select("offer_id", "content_hash", _text("valid_from"), _text("valid_to"))


_LAST_DAY = "timestamp '2024-01-30 00:00:00'"


@query(
    "snapshot_scd2",
    f"""with stored as (select *, lead(observed_at) over (partition by offer_id order by observed_at, event_id) as next_at from (
          select *, lag(content_hash) over (partition by offer_id order by observed_at, event_id) as before
          from {{sightings}} where observed_at < {_LAST_DAY}) s where before is null or before <> content_hash),
        batch as (select offer_id, arg_max(content_hash, (observed_at, event_id)) as new_hash, max(observed_at) as at
          from {{sightings}} where observed_at >= {_LAST_DAY} group by offer_id),
        open_rows as (select s.offer_id, s.content_hash, s.observed_at as valid_from, case when b.new_hash <> s.content_hash then b.at end as valid_to
          from stored s left join batch b on b.offer_id = s.offer_id where s.next_at is null)
        select offer_id, content_hash, strftime(valid_from, '%Y-%m-%d %H:%M:%S') as valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') as valid_to from (
          select offer_id, content_hash, observed_at as valid_from, next_at as valid_to from stored where next_at is not null
          union all select * from open_rows
          union all select b.offer_id, b.new_hash, b.at, null from batch b
            left join open_rows o on o.offer_id = b.offer_id where o.offer_id is null or o.content_hash <> b.new_hash) rows""",
)
def _snapshot_scd2(t):
    day = F.lit("2024-01-30").cast("timestamp")
    stored = Hi.snapshot_intervals(t.sightings.filter(F.col("observed_at") < day))
    last = t.sightings.filter(F.col("observed_at") >= day).select("offer_id", "observed_at", "event_id", "content_hash")
    batch = first_by(last, ["offer_id"], ["observed_at", "event_id"], descending=True)
    return Hi.apply_snapshots(stored, batch).select("offer_id", "content_hash", _text("valid_from"), _text("valid_to"))


@query(
    "offer_upsert",
    """with batch as (select offer_id, min(observed_at) as f, max(observed_at) as l from {sightings}
          where observed_at >= timestamp '2024-01-20 00:00:00' group by offer_id)
       select coalesce(s.offer_id, b.offer_id) as offer_id, strftime(coalesce(s.first_seen_at, b.f), '%Y-%m-%d %H:%M:%S') as first_seen_at,
         strftime(greatest(s.last_seen_at, b.l), '%Y-%m-%d %H:%M:%S') as last_seen_at,
         strftime(case when b.l is null then s.closed_at end, '%Y-%m-%d %H:%M:%S') as closed_at,
         strftime(case when b.l is null then s.missing_since end, '%Y-%m-%d %H:%M:%S') as missing_since,
         coalesce(s.reopened_count, 0) + case when b.l is not null and s.closed_at is not null then 1 else 0 end as reopened_count
       from {offer_state} s full outer join batch b on b.offer_id = s.offer_id""",
)
def _offer_upsert(t):
    batch = t.sightings.filter(F.col("observed_at") >= F.lit("2024-01-20").cast("timestamp"))
    state = Hi.upsert_offers(t.offer_state, batch)
    return state.select("offer_id", _text("first_seen_at"), _text("last_seen_at"), _text("closed_at"), _text("missing_since"), "reopened_count")


@query(
    "previous_run",
    """select run_id, lag(run_id) over (partition by source_id, query_set_version order by created_at, run_id) as just_before,
         (select p.run_id from {runs} p where p.query_set_version = r.query_set_version and p.status in ('succeeded', 'partial')
            and p.created_at < r.created_at order by p.created_at desc limit 1) as last_complete from {runs} r""",
)
def _previous_run(t):
    a = Hi.previous_run(t.runs).select("run_id", F.col("previous_run_id").alias("just_before"))
    b = Hi.previous_complete_run(t.runs).select("run_id", F.col("previous_run_id").alias("last_complete"))
    return a.join(b, "run_id")


_ACTIVE = "query_set_version = 'queries-3' and enabled and valid_to is null"
_SCOPE = f"""select s.* from {{offer_state}} s where s.closed_at is null and exists (select 1 from {{matches}} m
   join {{source_queries}} q on q.query_id = m.query_id where m.offer_id = s.offer_id and {_ACTIVE})"""


def _scope(t):
    return Pu.active_scope(t.offer_state, t.matches, t.source_queries, "queries-3")


@query("query_match_semi", f"select offer_id, user_id from ({_SCOPE}) s")
def _query_match_semi(t):
    return _scope(t).select("offer_id", "user_id")


def _absent(run: str) -> str:
    return f"not exists (select 1 from {{sightings}} x where x.run_id = '{run}' and x.offer_id = s.offer_id)"


@query("current_absences", f"select offer_id from ({_SCOPE}) s where {_absent(RUN)}")
def _current_absences(t):
    return Hi.current_absences(_scope(t), t.sightings, RUN).select("offer_id")


@query("double_absences", f"select offer_id from ({_SCOPE}) s where {_absent(RUN)} and {_absent(BEFORE)}")
def _double_absences(t):
    return Hi.double_absences(Hi.current_absences(_scope(t), t.sightings, RUN), t.sightings, BEFORE).select("offer_id")


@query(
    "apply_absences",
    f"""with scoped as ({_SCOPE}) select s.offer_id,
          strftime(case when c.offer_id is not null and {_absent(RUN)} then coalesce(s.missing_since, timestamp '{NOW}') else s.missing_since end, '%Y-%m-%d %H:%M:%S') as missing_since,
          strftime(case when c.offer_id is not null and {_absent(RUN)} and {_absent(BEFORE)} then timestamp '{NOW}' else s.closed_at end, '%Y-%m-%d %H:%M:%S') as closed_at
        from {{offer_state}} s left join scoped c on c.offer_id = s.offer_id""",
)
def _apply_absences(t):
    state = Hi.apply_absences(t.offer_state, _scope(t), t.sightings, t.runs, t.run_queries, RUN, _now())
    return state.select("offer_id", _text("missing_since"), _text("closed_at"))


@query(
    "absences_after_failure",
    """select offer_id, strftime(missing_since, '%Y-%m-%d %H:%M:%S') as missing_since, strftime(closed_at, '%Y-%m-%d %H:%M:%S') as closed_at
       from {offer_state}""",
)
def _absences_after_failure(t):
    """The run before failed, so nothing ages."""
    state = Hi.apply_absences(t.offer_state, _scope(t), t.sightings, t.runs, t.run_queries, "R2024-01-20", _now())
    return state.select("offer_id", _text("missing_since"), _text("closed_at"))


# ------------------------------------------------------------------ pages and quality

_TOTALS = """select run_id, query_id, count(*) as pages, sum(received_count)::bigint as received, sum(valid_count)::bigint as valid,
   sum(quarantined_count)::bigint as quarantined, sum(in_perimeter_count)::bigint as in_perimeter, sum(warning_count)::bigint as warning,
   (array_agg(next_range_start order by range_start desc))[1] as next_range_start, max(source_total) as source_total
   from {page_facts} group by run_id, query_id"""


@query("page_totals", _TOTALS)
def _page_totals(t):
    return Q.page_totals(t.page_facts)


@query(
    "run_totals",
    f"""select run_id, count(*) as queries, {', '.join(f'sum({c})::bigint as {c}' for c in ('pages', 'received', 'valid', 'quarantined', 'in_perimeter', 'warning'))}
        from ({_TOTALS}) q group by run_id""",
)
def _run_totals(t):
    return Q.run_totals(Q.page_totals(t.page_facts))


_BROKEN = """select p.* from {page_facts} p where not p.is_terminal and not exists (select 1 from {page_facts} n
   where n.run_id = p.run_id and n.query_id = p.query_id and n.range_start = p.next_range_start)"""


@query("page_chain_check", f"select run_id, query_id, range_start, next_range_start from ({_BROKEN}) b")
def _page_chain_check(t):
    return Q.page_chain_check(t.page_facts).select("run_id", "query_id", "range_start", "next_range_start")


@query(
    "query_completeness",
    f"""select *, case when complete then null when minimum_total <> maximum_total then 'source_total_changed' else 'incomplete' end as reason from (
          select *, pages >= 1 and terminal = 1 and first_range = 0 and minimum_total = maximum_total and received = maximum_total and broken = 0 as complete
          from (select p.run_id, p.query_id, count(*) as pages, count(*) filter (where is_terminal) as terminal, min(range_start) as first_range,
                  min(source_total) as minimum_total, max(source_total) as maximum_total, sum(received_count)::bigint as received,
                  (select count(*) from ({_BROKEN}) b where b.run_id = p.run_id and b.query_id = p.query_id) as broken
                from {{page_facts}} p group by p.run_id, p.query_id) f) c""",
)
def _query_completeness(t):
    return Q.query_completeness(t.page_facts)


_FLAGS = """select run_id, offer_id, bool_or(offer_created) as offer_created, bool_or(snapshot_created) as snapshot_created
   from {sightings} group by run_id, offer_id"""


@query("sighting_flags", _FLAGS)
def _sighting_flags(t):
    return Q.sighting_flags(t.sightings)


_COMPLETE_BEFORE = """select r.run_id, (select p.run_id from {runs} p where p.query_set_version = r.query_set_version
   and p.status in ('succeeded', 'partial') and p.created_at < r.created_at order by p.created_at desc limit 1) as previous_run_id from {runs} r"""
_PREVIOUS = f"""select f.run_id, q.query_id, count(distinct s.offer_id) as previous,
   count(distinct s.offer_id) filter (where not exists (select 1 from {{quality_sightings}} n where n.run_id = f.run_id and n.offer_id = s.offer_id)) as missing_from_run
   from ({_COMPLETE_BEFORE}) f join {{run_queries}} q on q.run_id = f.previous_run_id
   left join {{quality_sightings}} s on s.run_id = q.run_id and s.query_id = q.query_id group by f.run_id, q.query_id"""


@query("previous_query_counts", _PREVIOUS)
def _previous_query_counts(t):
    return Q.previous_query_counts(t.quality_sightings, t.runs, t.run_queries)


_VOLUMES = f"""select c.run_id, c.query_id, c.current, p.previous, p.missing_from_run from (
   select q.run_id, q.query_id, count(distinct s.offer_id) as current from {{run_queries}} q
   left join {{quality_sightings}} s on s.run_id = q.run_id and s.query_id = q.query_id group by q.run_id, q.query_id) c
   join ({_PREVIOUS}) p on p.run_id = c.run_id and p.query_id = c.query_id"""


@query("partition_volume_join", _VOLUMES)
def _partition_volume_join(t):
    return Q.partition_volumes(t.quality_sightings, t.runs, t.run_queries)


def _policy(volumes: str) -> str:
    return f"""select *, case when previous = 0 or abs(current - previous) * 100 <= previous * 60 then 'ok'
       when current > previous or abs(current - previous) < 5 or coalesce(missing_from_run, abs(current - previous)) < 5 then 'warning'
       else 'block' end as verdict from ({volumes}) v"""


@query("partition_volume_policy", _policy(_VOLUMES.replace("{quality_sightings}", "{hourly_sightings}").replace("{run_queries}", "{hourly_queries}")))
def _partition_volume_policy(t):
    return Q.partition_volume_policy(Q.partition_volumes(t.hourly_sightings, t.runs, t.hourly_queries))


_POSITIVE = """claims_junior is true or minimum_experience_months is not null or beginner_friendly is not null
   or contradictory_junior is not null or status = 'ambiguous'"""
_FACTS = f"""select r.run_id, r.offers_received, r.offers_valid, r.offers_quarantined,
   coalesce((select bool_and(q.status = 'succeeded') from {{run_queries}} q where q.run_id = r.run_id), false) as pagination_complete,
   coalesce((select bool_or(source_total > 3150) from {{page_facts}} p where p.run_id = r.run_id), false) as source_cap_reached,
   coalesce(n.unique_offers, 0) as unique_offers, coalesce(n.offers_new, 0) as offers_new, coalesce(n.offers_updated, 0) as offers_updated,
   coalesce(n.positives, 0) as positives, coalesce(n.positives_with_evidence, 0) as positives_with_evidence,
   coalesce(b.unique_offers > 0 and abs(coalesce(n.unique_offers, 0) - b.unique_offers)::double / b.unique_offers > 0.4, false) or coalesce(v.blocks, false) as volume_anomaly,
   coalesce(v.warnings, 0) as volume_warnings
   from {{runs}} r join ({_COMPLETE_BEFORE}) f on f.run_id = r.run_id
   left join counted n on n.run_id = r.run_id left join counted b on b.run_id = f.previous_run_id
   left join (select run_id, bool_or(verdict = 'block') as blocks, count(*) filter (where verdict = 'warning') as warnings
              from ({_policy(_VOLUMES)}) p group by run_id) v on v.run_id = r.run_id"""
_COUNTED = f"""with counted as (select s.run_id, count(*) as unique_offers, count(*) filter (where offer_created) as offers_new,
   count(*) filter (where not offer_created and snapshot_created) as offers_updated,
   count(*) filter (where p.offer_id is not null) as positives,
   count(*) filter (where p.offer_id is not null and exists (select 1 from {{user_evidence}} e where e.classification_id = p.classification_id)) as positives_with_evidence
   from ({_FLAGS.replace("{sightings}", "{quality_sightings}")}) s left join (
     select o.offer_id, c.classification_id from {{offer_snapshots}} o join {{versioned_classifications}} c on c.snapshot_id = o.snapshot_id
     where o.valid_to is null and c.classifier_version = 'rules-2' and ({_POSITIVE})) p on p.offer_id = s.offer_id group by s.run_id)"""
_FACT_COLUMNS = [
    "run_id", "offers_received", "offers_valid", "offers_quarantined", "pagination_complete", "source_cap_reached", "unique_offers",
    "offers_new", "offers_updated", "positives", "positives_with_evidence", "volume_anomaly", "volume_warnings",
]


def _facts(t):
    return Q.run_quality_facts(
        t.runs, t.run_queries, t.page_facts, t.quality_sightings, t.offer_snapshots, t.versioned_classifications, t.user_evidence, "rules-2"
    )


@query("run_quality_facts", f"{_COUNTED} select * from ({_FACTS}) f")
def _run_quality_facts(t):
    return _facts(t).select(*_FACT_COLUMNS)


@query(
    "quality_decision",
    f"""{_COUNTED} select run_id, validation_rate, reasons, decision, decision = 'publish' as closure_eligible from (
          select *, case when blockers > 0 then 'block' when validation_rate >= 0.98 then 'publish' else 'publish_partial' end as decision from (
            select run_id, offers_valid::double / offers_received as validation_rate,
              (not pagination_complete)::int + source_cap_reached::int + (positives_with_evidence < positives)::int + volume_anomaly::int
                + (offers_valid::double / offers_received < 0.95)::int as blockers,
              concat_ws(',', case when not pagination_complete then 'pagination_incomplete' end, case when source_cap_reached then 'source_cap_reached' end,
                case when positives_with_evidence < positives then 'positive_classification_missing_evidence' end,
                case when volume_anomaly then 'volume_anomaly_detected' end,
                case when offers_valid::double / offers_received < 0.95 then 'validation_rate_below_minimum'
                     when offers_valid::double / offers_received < 0.98 then 'validation_rate_below_publish_threshold' end) as reasons
            from ({_FACTS}) f) r) d""",
)
def _quality_decision(t):
    decided = Q.quality_decision(_facts(t))
    return decided.select("run_id", "validation_rate", F.array_join("reasons", ",").alias("reasons"), "decision", "closure_eligible")


@query(
    "run_report",
    """select r.run_id, r.status, q.queries, q.queries_succeeded, 0::bigint as queries_running, q.queries_failed, p.pages, s.unique_offers,
         d.dataset_version, d.status as dataset_status, case when d.dataset_id is not null then coalesce(m.members, 0) end as members
       from {runs} r
       left join (select run_id, count(*) as queries, count(*) filter (where status = 'succeeded') as queries_succeeded,
                    count(*) filter (where status = 'failed') as queries_failed from {run_queries} group by run_id) q on q.run_id = r.run_id
       left join (select run_id, count(*) as pages from {page_facts} group by run_id) p on p.run_id = r.run_id
       left join (select run_id, count(distinct offer_id) as unique_offers from {sightings} group by run_id) s on s.run_id = r.run_id
       left join (select *, row_number() over (partition by run_id order by published_at desc, dataset_id desc) as rn from {datasets}) d
         on d.run_id = r.run_id and d.rn = 1
       left join (select dataset_id, count(*) as members from {day_members} group by dataset_id) m on m.dataset_id = d.dataset_id""",
)
def _run_report(t):
    return Q.run_report(t.runs, t.run_queries, t.page_facts, t.sightings, t.datasets, t.day_members)


# ------------------------------------------------------------------ operational samples and status

_SAMPLES = """select current_id, dataset_id, business_date, duration_ms, members, ambiguous from (
   select c.dataset_id as current_id, p.dataset_id, p.business_date, cast(round((epoch_us(r.finished_at) - epoch_us(r.started_at)) / 1000.0) as bigint) as duration_ms,
     row_number() over (partition by c.dataset_id, p.business_date order by p.published_at desc, p.dataset_id desc) as rn,
     (select count(*) from {day_members} m where m.dataset_id = p.dataset_id) as members,
     (select count(*) from {day_members} m where m.dataset_id = p.dataset_id and m.status = 'ambiguous') as ambiguous
   from {datasets} c join {runs} cr on cr.run_id = c.run_id and cr.status = 'succeeded'
   join {datasets} p on p.source_id = c.source_id and p.query_set_version = c.query_set_version and p.classifier_version = c.classifier_version
   join {runs} r on r.run_id = p.run_id and r.status = 'succeeded'
   where c.status = 'published' and p.status = 'published' and p.business_date <= c.business_date and p.business_date >= c.business_date - 7
     and (p.business_date < c.business_date or p.dataset_id = c.dataset_id)) s where rn = 1"""


def _samples(t):
    counts = t.day_members.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous")
    )
    return Q.comparable_samples(t.datasets, t.runs, counts)


@query("comparable_samples", f"select * replace (cast(business_date as varchar) as business_date) from ({_SAMPLES}) s")
def _comparable_samples(t):
    return _samples(t).withColumn("business_date", F.col("business_date").cast("string"))


@query(
    "operational_changes",
    f"""with samples as ({_SAMPLES}), prior as (select *, row_number() over (partition by current_id order by business_date desc) as n
          from samples where dataset_id <> current_id)
        select c.current_id, (select count(*) from prior p where p.current_id = c.current_id) as prior_days,
          concat_ws(',', case when p.members > 0 and c.members * 100 < p.members * 60 then 'VOLUME_DROP_OVER_40_PERCENT' end,
            case when p.members > 0 and p.ambiguous > 0 and c.members > 0 and c.ambiguous * p.members > 2 * p.ambiguous * c.members then 'AMBIGUITY_MORE_THAN_DOUBLED' end,
            case when (select count(*) from prior x where x.current_id = c.current_id) >= 7 and c.duration_ms > 2 * (
              select list_sort(list(x.duration_ms))[4] from prior x where x.current_id = c.current_id and x.n <= 7) then 'DURATION_OVER_TWICE_SEVEN_DAY_MEDIAN' end) as reasons
        from samples c left join prior p on p.current_id = c.current_id and p.n = 1 where c.dataset_id = c.current_id""",
)
def _operational_changes(t):
    changes = Q.operational_changes(_samples(t))
    return changes.select("current_id", F.col("prior_days").cast("long").alias("prior_days"), F.array_join("reasons", ",").alias("reasons"))


@query(
    "ambiguous_rate",
    """select dataset_id, count(*) filter (where status = 'ambiguous') as ambiguous, count(*) as members,
         count(*) filter (where status = 'ambiguous')::double / count(*) as ambiguous_rate from {day_members} group by dataset_id""",
)
def _ambiguous_rate(t):
    return Q.ambiguous_rate(t.day_members, "dataset_id")


@query("latest_run", "select run_id, status from {runs} where status in ('succeeded', 'partial', 'failed') order by finished_at desc, run_id desc limit 1")
def _latest_run(t):
    return Q.latest_run(t.runs).select("run_id", "status")


@query(
    "incident_list",
    f"""select event_id, case when resolved_at is not null then 'resolved' when severity in ('info', 'warning') then 'monitoring' else 'identified' end as state
        from {{quality_events}} where is_public and created_at >= timestamp '{NOW}' - interval 30 day
        order by resolved_at is null desc, created_at desc, event_id limit 20""",
)
def _incident_list(t):
    return Q.incident_list(t.quality_events, _now()).select("event_id", "state")


_INCIDENTS = f"""select event_id, resolved_at, created_at, case when resolved_at is not null then 'resolved' when severity in ('info', 'warning') then 'monitoring' else 'identified' end as state
   from {{quality_events}} where is_public and created_at >= timestamp '{NOW}' - interval 30 day and (dataset_id is null or dataset_id = 'D2024-01-30')
   order by resolved_at is null desc, created_at desc, event_id limit 20"""


@query(
    "data_status",
    f"""select dataset_id, freshness, case when degraded then 'degraded' else 'operational' end as service,
         case when degraded then case when freshness = 'stale' then 'stale' else 'limited' end else 'normal' end as quality,
         concat_ws(',', case when freshness <> 'fresh' then 'STALE_DATA:' || case when freshness = 'stale' then 'critical' else 'warning' end end,
           case when run_status = 'partial' then 'PARTIAL_COLLECTION:warning' end) as warnings,
         incidents, run_status, queries, partial_queries, duration_ms, members, ambiguous_rate,
         requests_count, offers_received, offers_valid, offers_new, offers_updated, offers_quarantined, offers_marked_missing, offers_closed from (
       select *, freshness <> 'fresh' or run_status in ('partial', 'failed') or open_incidents > 0 as degraded from (
       select d.dataset_id, case when hours <= 30 then 'fresh' when hours <= 72 then 'delayed' else 'stale' end as freshness, r.status as run_status,
         r.requests_count, r.offers_received, r.offers_valid, r.offers_new, r.offers_updated, r.offers_quarantined, r.offers_marked_missing, r.offers_closed,
         (select count(*) from {{run_queries}} q where q.run_id = r.run_id)::int as queries,
         (select count(*) from {{run_queries}} q where q.run_id = r.run_id and q.status <> 'succeeded')::int as partial_queries,
         (select count(*) from ({_INCIDENTS}) i where resolved_at is null) as open_incidents,
         (select coalesce(string_agg(event_id || ':' || state, ',' order by resolved_at is null desc, created_at desc, event_id), '') from ({_INCIDENTS}) i) as incidents,
         epoch_us(r.finished_at) // 1000 - epoch_us(r.started_at) // 1000 as duration_ms, a.members, a.ambiguous::double / a.members as ambiguous_rate
       from (select *, (epoch_us(timestamp '{NOW}') // 1000 - epoch_us(source_cutoff_at) // 1000) / 3600000.0 as hours from {{datasets}}) d, {{runs}} r, (select count(*) as members, count(*) filter (where status = 'ambiguous') as ambiguous from {{day_members}} where dataset_id = 'D2024-01-30') a
       where d.dataset_id = 'D2024-01-30' and r.run_id = 'R2024-01-30') facts) judged""",
)
def _data_status(t):
    dataset = t.datasets.filter(F.col("dataset_id") == "D2024-01-30")
    rows = t.day_members.select("dataset_id", "status")
    status = Q.data_status(dataset, t.runs, t.run_queries, rows, t.quality_events, _now())
    joined = lambda column, *parts: F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[p] for p in parts])), ",").alias(column)
    return status.select(
        "dataset_id", "freshness", "service", "quality", joined("warnings", "code", "severity"), joined("incidents", "event_id", "state"), "run_status",
        F.col("queries").cast("int").alias("queries"), F.col("partial_queries").cast("int").alias("partial_queries"), "duration_ms", "members", "ambiguous_rate",
        *Q.RUN_COUNTERS,
    )


_HEALTH = """select r.run_id, case when r.status = 'succeeded' then 'operational' else 'degraded' end as status,
   case when dayofyear(r.business_date) >= 29 then 'fresh' else 'stale' end as freshness, r.status as run_status, r.finished_at as data_as_of,
   r.started_at as last_success_at, timestamp '2024-01-31 00:00:00' as generated_at, case when r.status = 'partial' then 1 else 0 end as partial_queries,
   r.offers_received as received, r.offers_valid as valid from {runs} r"""


@query(
    "production_health",
    f"""select run_id, concat_ws(',', case when status <> 'operational' then 'STATUS_NOT_OPERATIONAL' end, case when freshness <> 'fresh' then 'DATA_NOT_FRESH' end,
          case when run_status <> 'succeeded' then 'LAST_RUN_NOT_SUCCEEDED' end,
          case when timestamp '2024-01-31 00:00:00' - data_as_of > interval 30 hour then 'DATA_OLDER_THAN_30H' end,
          case when timestamp '2024-01-31 00:00:00' - last_success_at > interval 30 hour then 'NO_SUCCESS_WITHIN_30H' end,
          case when partial_queries <> 0 then 'INCOMPLETE_QUERIES' end, case when valid::double / received < 0.98 then 'VALIDATION_BELOW_98_PERCENT' end) as reasons
        from ({_HEALTH}) h""",
)
def _production_health(t):
    checked = Q.production_health(t.sql(_HEALTH), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return checked.select("run_id", F.array_join("reasons", ",").alias("reasons"))


_WANTED = """select 'monitor:' || query_id as scope, 'DATA_NOT_FRESH' as reason from {run_queries} where query_id <> 'view'
   union all select 'monitor:' || query_id, 'DURATION_OVER_TWICE_SEVEN_DAY_MEDIAN' from {run_queries} where status = 'failed'"""


@query(
    "reconcile_incidents",
    f"""with wanted as (select distinct scope, 'MONITOR_' || reason as event_code from ({_WANTED}) w)
        select scope, event_code, severity, is_public, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at,
          strftime(case when resolved_at is null and event_code like 'MONITOR%' and not exists (select 1 from wanted w where w.scope = e.scope and w.event_code = e.event_code)
            then timestamp '{NOW}' else resolved_at end, '%Y-%m-%d %H:%M:%S') as resolved_at from {{quality_events}} e
        union all select scope, event_code, 'warning', event_code <> 'MONITOR_DURATION_OVER_TWICE_SEVEN_DAY_MEDIAN', '{NOW}', null from wanted w
          where not exists (select 1 from {{quality_events}} e where e.scope = w.scope and e.event_code = w.event_code and e.resolved_at is null)""",
)
def _reconcile(t):
    rows = Q.reconcile_incidents(t.quality_events, t.sql(_WANTED), _now())
    return rows.select("scope", "event_code", "severity", "is_public", _text("created_at"), _text("resolved_at"))


# One day without any date and contract, and texts of which some are empty.
_PROFILED = """select m.business_date, m.status, m.claims_junior, m.minimum_experience_months, m.offer_id,
   case when dayofyear(m.business_date) <> 17 then m.source_published_at end as source_published_at,
   case when dayofyear(m.business_date) <> 23 then m.contract_kind end as contract_kind,
   case when m.user_id % 8 = 3 then '  ' when m.user_id % 8 = 4 then null else m.offer_id end as description_text from {day_members} m"""


@query(
    "quality_profile",
    f"""with rows_ as materialized ({_PROFILED}), profile as (
         select business_date, count(*) as members, avg((coalesce(claims_junior, false))::int) as junior_rate,
               avg((minimum_experience_months is not null)::int) as known, avg((status = 'ambiguous')::int) as amb,
               avg((trim(coalesce(description_text, '')) = '')::int) as empty_rate,
               avg((source_published_at is null)::int) as m1, avg((contract_kind is null)::int) as m2, avg((minimum_experience_months is null)::int) as m3
         from rows_ group by business_date),
       mix as (select business_date, string_agg(kind || ':' || n, ',' order by kind) as contract_mix from (
         select business_date, coalesce(contract_kind, 'unknown') as kind, count(*) as n from rows_ group by all) k group by business_date)
       select cast(business_date as varchar) as business_date, members, round(junior_rate, 8) as junior_rate, round(known, 8) as known_experience_rate,
         round(empty_rate, 8) as empty_text_rate, contract_mix,
         coalesce(abs(junior_rate - lag(junior_rate) over w) * 100 > 15, false) as junior_jump,
         coalesce(amb > 2 * lag(amb) over w, false) as ambiguity_doubled,
         concat_ws(',', case when m1 = 1.0 and lag(m1) over w < 0.5 then 'source_published_at' end,
           case when m2 = 1.0 and lag(m2) over w < 0.5 then 'contract_kind' end,
           case when m3 = 1.0 and lag(m3) over w < 0.5 then 'minimum_experience_months' end) as lost_fields
       from profile join mix using (business_date) window w as (order by business_date)""",
)
def _quality_profile(t):
    profile = Q.quality_profile(t.sql(_PROFILED), text="description_text")
    counted = F.transform("contract_mix", lambda k: F.concat_ws(":", k["kind"], F.round(k["share"] * F.col("members")).cast("long").cast("string")))
    return profile.select(
        F.col("business_date").cast("string").alias("business_date"), "members", F.round("junior_rate", 8).alias("junior_rate"),
        F.round("known_experience_rate", 8).alias("known_experience_rate"), F.round("empty_text_rate", 8).alias("empty_text_rate"),
        F.array_join(counted, ",").alias("contract_mix"), "junior_jump", "ambiguity_doubled", F.array_join("lost_fields", ",").alias("lost_fields"),
    )


@query(
    "run_anomalies",
    "select run_id, offers_received, offers_quarantined from {runs} where offers_quarantined * 100 > offers_received * 2",
)
def _run_anomalies(t):
    return Q.run_anomalies(t.runs)


# ------------------------------------------------------------------ datasets


@query(
    "source_cutoff",
    "select run_id, strftime(max(committed_at), '%Y-%m-%d %H:%M:%S') as source_cutoff_at from {page_facts} group by run_id",
)
def _source_cutoff(t):
    return Pu.source_cutoff(t.page_facts).select("run_id", _text("source_cutoff_at"))


_MEMBERS = f"""select 'draft' as dataset_id, s.offer_id, 'S' || s.offer_id as snapshot_id, c.classification_id,
   (select string_agg(distinct f.family, ',' order by f.family) from (select unnest(coalesce(m.job_families, q.job_families)) as family
      from {{matches}} m join {{source_queries}} q on q.query_id = m.query_id where m.offer_id = s.offer_id and {_ACTIVE}) f) as job_families
   from ({_SCOPE}) s join {{user_classifications}} c on c.offer_id = s.offer_id and c.classifier_version = 'rules-2'"""


def _frozen(t):
    return Pu.freeze_membership(
        "draft", "queries-3", "rules-2", t.offer_state, t.offer_snapshots, t.user_classifications, t.matches, t.source_queries
    )


@query("freeze_membership", f"select offer_id, snapshot_id, classification_id, job_families from ({_MEMBERS}) m")
def _freeze(t):
    return _frozen(t).select("offer_id", "snapshot_id", "classification_id", F.array_join("job_families", ",").alias("job_families"))


@query(
    "missing_classification_anti",
    """select snapshot_id from {offer_snapshots} s where not exists (select 1 from {user_classifications} c
         where c.snapshot_id = s.snapshot_id and c.classifier_version = 'rules-2')""",
)
def _missing(t):
    from offerlens.operators.classify import missing_classifications

    return missing_classifications(t.offer_snapshots, t.user_classifications, "rules-2").select("snapshot_id")


@query(
    "validate_dataset",
    f"""with scope as ({_SCOPE}), members as ({_MEMBERS}) select 'draft' as dataset_id, true as publish_decision, count(*) > 0 as has_members,
          count(*) = (select count(*) from scope) as membership_matches_scope,
          not exists (select 1 from scope s where not exists (select 1 from {{user_classifications}} c where c.offer_id = s.offer_id and c.classifier_version = 'rules-2')) as classifications_complete,
          true as metric_present,
          not exists (select 1 from members m join {{user_classifications}} c on c.classification_id = m.classification_id where
             (c.junior_observation_status = 'resolved' or c.junior_observation_contradictory) and not exists (select 1 from {{user_evidence}} e where e.offer_id = c.offer_id)) as evidence_complete,
          false as validated from members""",
)
def _validate(t):
    members = _frozen(t)
    dataset = t.current_datasets.select(
        F.lit("draft").alias("dataset_id"), F.lit("draft").alias("status"), "decision", "junior_metric_version"
    )
    scope = _scope(t).select(F.lit("draft").alias("dataset_id"), "offer_id")
    classified = t.user_classifications.filter("classifier_version = 'rules-2'").withColumn("dataset_id", F.lit("draft"))
    rows = members.join(classified.drop("offer_id", "dataset_id", "snapshot_id"), "classification_id").withColumn(
        "junior_metric_version", F.lit(R.CONTRADICTION_V2)
    )
    metrics = M.daily_metrics(rows, F.lit("2024-01-30"))
    return Pu.validate_dataset(dataset, members, scope, classified, metrics, t.user_evidence)


_ROLLBACKS = """select 'D2024-01-28' as dataset_id, 'source-1' as source_id, timestamp '2024-01-31 12:00:00' as rolled_back_at from {datasets}
   where dataset_id = 'D2024-01-28'"""


def _log(t):
    metrics = M.daily_metrics(t.day_members, F.col("business_date"))
    return Pu.publication_log(t.datasets, t.day_members, metrics, t.sql(_ROLLBACKS))


@query(
    "publish_and_rollback",
    """select dataset_id, case when dataset_id = 'D2024-01-30' then 'withdrawn' else status end as status, dataset_id = 'D2024-01-28' as is_current from {datasets}""",
)
def _publish_and_rollback(t):
    return _log(t).select("dataset_id", "status", "is_current")


@query(
    "current_dataset",
    """select dataset_id, dataset_version, query_set_version, (select count(*) from {day_members} m where m.dataset_id = d.dataset_id) as member_count
       from {datasets} d where dataset_id = 'D2024-01-28'""",
)
def _current_dataset(t):
    return Pu.current_dataset(_log(t), t.day_members).select("dataset_id", "dataset_version", "query_set_version", "member_count")


@query(
    "answer_meta",
    """select dataset_version, classifier_version, query_set_version, strftime(source_cutoff_at, '%Y-%m-%d %H:%M:%S') as data_as_of,
         (select count(*) from {day_members} m where m.dataset_id = d.dataset_id) as sample_size, 'normal' as quality, '' as warnings
       from {datasets} d where dataset_id = 'D2024-01-28'""",
)
def _answer_meta(t):
    meta = Pu.answer_meta(Pu.current_dataset(_log(t), t.day_members))
    return meta.withColumn("data_as_of", _text("data_as_of")).withColumn("warnings", F.array_join("warnings", ","))


@query("metric_invariants", "select dataset_id, metric_key, '' as code from (select '' as dataset_id, '' as metric_key) x where false")
def _metric_invariants(t):
    return Pu.metric_invariants(M.daily_metrics(t.day_members, F.col("business_date"))).select("dataset_id", "metric_key", "code")


# The spoiled rows in SQL, then every rule on them.
_SPOILED = """select * exclude (status, minimum_experience_months), case when doc_id % 5 = 0 then 'ambiguous' else status end as status,
   case when doc_id % 13 = 6 then -1 when doc_id % 7 = 4 then greatest(0, minimum_experience_months - 24) else minimum_experience_months end as minimum_experience_months,
   case when doc_id % 11 = 3 then null else junior_observation_contradictory end as observed from {classified_offers}"""


@query(
    "classification_invariants",
    f"""with spoiled as ({_SPOILED})
        select offer_id, 'observation_not_consistent' as code from spoiled where (junior_observation_status = 'resolved') <> (observed is not null)
        union all select offer_id, 'observation_without_claim' from spoiled where junior_observation_status = 'resolved' and claims_junior is not true
        union all select offer_id, 'unclassified_with_answers' from spoiled where status = 'unclassified'
          and (claims_junior is not null or beginner_friendly is not null or contradictory_junior is not null or minimum_experience_months is not null)
        union all select offer_id, 'ambiguous_with_derived' from spoiled where status = 'ambiguous' and (beginner_friendly is not null or contradictory_junior is not null)
        union all select offer_id, 'contradictory_without_months' from spoiled where contradictory_junior
          and coalesce(minimum_experience_months >= 24 and claims_junior, false) is false
        union all select offer_id, 'negative_months' from spoiled where minimum_experience_months < 0""",
)
def _classification_invariants(t):
    """Rows are spoiled on purpose, so that the rules have something to find."""
    doc_id, months = F.col("doc_id"), F.col("minimum_experience_months")
    spoiled = t.classified_offers.withColumns(
        {
            "status": F.when(doc_id % 5 == 0, "ambiguous").otherwise(F.col("status")),
            "minimum_experience_months": F.when(doc_id % 13 == 6, -1).when(doc_id % 7 == 4, F.greatest(F.lit(0), months - 24)).otherwise(months),
            "junior_observation_contradictory": F.when(doc_id % 11 != 3, F.col("junior_observation_contradictory")),
        }
    )
    return Pu.classification_invariants(spoiled).select("offer_id", "code")


_PAYLOADS = """select snapshot_id, offer_id, case when doc_id % 3 <> 0 then description_text end as raw_payload,
   case when doc_id % 3 <> 0 then last_seen_at + (doc_id % 10) * interval '1' day end as raw_payload_expires_at from {offer_rows}"""
_QUARANTINE = """select 'R' || cast(cast(ts as date) as string) as run_id, event_id as item, ts as created_at from {events} where event_id % 41 = 0"""


@query(
    "retention",
    f"""select (select count(*) from ({_PAYLOADS}) p where raw_payload is not null and raw_payload_expires_at <= timestamp '{NOW}') as raw_payloads,
          (select count(*) from ({_QUARANTINE}) q where created_at < timestamp '{NOW}' - interval 30 day) as validation_errors""",
)
def _retention(t):
    return Pu.retention(t.sql(_PAYLOADS), t.sql(_QUARANTINE), t.runs, _now())


@query(
    "purge_quarantine",
    f"""select run_id, item from ({_QUARANTINE}) q where not (created_at < timestamp '{NOW}' - interval 30 day
          and exists (select 1 from {{runs}} r where r.run_id = q.run_id and r.status in ('succeeded', 'partial', 'failed', 'cancelled')))""",
)
def _purge_quarantine(t):
    return Pu.purge_quarantine(t.sql(_QUARANTINE), t.runs, _now()).select("run_id", "item")


@query(
    "retention_event",
    f"""select 'info' as severity, 'RETENTION_PURGED' as event_code, '{{"rawPayloads":' || raw || ',"validationErrors":' || errors || '}}' as details, false as is_public from (
          select (select count(*) from ({_PAYLOADS}) p where raw_payload is not null and raw_payload_expires_at <= timestamp '{NOW}') as raw,
            (select count(*) from ({_QUARANTINE}) q where created_at < timestamp '{NOW}' - interval 30 day) as errors) c where raw + errors > 0""",
)
def _retention_event(t):
    counts = Pu.retention(t.sql(_PAYLOADS), t.sql(_QUARANTINE), t.runs, _now())
    return Pu.retention_event(counts, _now()).select("severity", "event_code", "details", "is_public")


@query(
    "purge_payloads",
    f"""select snapshot_id, case when raw_payload_expires_at <= timestamp '{NOW}' then null else md5(raw_payload) end as payload,
          case when raw_payload_expires_at <= timestamp '{NOW}' then null else strftime(raw_payload_expires_at, '%Y-%m-%d %H:%M:%S') end as raw_payload_expires_at
        from ({_PAYLOADS}) p""",
)
def _purge(t):
    kept = Pu.purge_payloads(t.sql(_PAYLOADS), _now())
    return kept.select("snapshot_id", F.md5("raw_payload").alias("payload"), _text("raw_payload_expires_at"))


def _percent_sql(value: str) -> str:
    return f"replace(regexp_replace(printf('%.1f', round({value} * 100, 1)), '\\.0$', ''), '.', ',') || '\u202f%'"


_OVERALL = f"select * from ({_all_rates_sql('{day_members}', 'dataset_id, business_date')}) m where dataset_id = 'D2024-01-28'"


@query(
    "publish_insights",
    f"""select case metric_key when 'junior_contradiction_rate' then 'junior-et-deux-ans-france-' when 'beginner_friendly_rate' then 'debutants-explicitement-acceptes-france-'
          else 'transparence-salariale-france-' end || cast(business_date as varchar) as slug,
          {_percent_sql('value')} || case metric_key when 'junior_contradiction_rate' then ' des offres junior classables demandent au moins deux ans d’expérience'
            when 'beginner_friendly_rate' then ' des offres classables sont explicitement accessibles aux débutants' else ' des offres publient une rémunération exploitable' end as title,
          numerator, denominator from ({_OVERALL}) o""",
)
def _publish_insights(t):
    current = Pu.current_dataset(_log(t), t.day_members)
    drafts = Pu.insight_drafts(M.daily_metrics(t.day_members, F.col("business_date")), current)
    stored = drafts.limit(0).withColumn("status", F.lit("published"))
    return Pu.publish_insights(drafts, stored).select("slug", "title", "numerator", "denominator")


_INSIGHTS = """select 'insight-' || dataset_id as slug, published_at, case when dayofyear(business_date) = 20 then 'draft'
   when dayofyear(business_date) = 22 then 'corrected' else 'published' end as status, dataset_id from {datasets}"""


@query("insight_list", f"select slug, status from ({_INSIGHTS}) i where status in ('published', 'corrected') order by published_at desc, slug limit 12")
def _insight_list(t):
    return Pu.insight_list(t.sql(_INSIGHTS)).select("slug", "status")


@query(
    "recovered_incident",
    """select d.dataset_id, strftime(d.published_at, '%Y-%m-%d %H:%M:%S') as created_at, strftime(min(e.created_at), '%Y-%m-%d %H:%M:%S') as resolved_at
       from {datasets} d join {quality_events} e on e.event_code = 'DATASET_ROLLBACK' and e.dataset_id = 'D2024-01-26' and e.created_at >= d.published_at
       where d.status = 'withdrawn' group by d.dataset_id, d.published_at""",
)
def _recovered(t):
    """The audits of the next day stand for those of the withdrawn dataset."""
    audits = t.quality_events.filter(F.col("dataset_id") == "D2024-01-26").withColumn("dataset_id", F.lit("D2024-01-25"))
    return Pu.recovered_incidents(t.datasets, audits).select("dataset_id", _text("created_at"), _text("resolved_at"))


@query(
    "republish_method",
    f"""select 'again' as dataset_id, m.offer_id, c.classification_id, strftime((select max(ts) from {{events}}), '%Y-%m-%d %H:%M:%S') as source_cutoff_at
        from ({_MEMBERS}) m left join {{user_classifications}} c on c.snapshot_id = m.snapshot_id and c.classifier_version = 'rules-2'""",
)
def _republish(t):
    current = t.datasets.filter(F.col("dataset_id") == "D2024-01-30").withColumn("dataset_id", F.lit("draft"))
    dataset, members = Pu.republish_method(
        current.withColumn("is_current", F.lit(True)), _frozen(t), t.user_classifications, "again", "rules-2", R.CONTRADICTION_V2
    )
    joined = members.join(F.broadcast(dataset.select("dataset_id", "source_cutoff_at")), "dataset_id")
    return joined.select("dataset_id", "offer_id", "classification_id", _text("source_cutoff_at"))


@query(
    "dataset_version",
    """select run_id, strftime(started_at, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(cast((epoch_us(started_at) // 1000) % 1000 as varchar), 3, '0') || 'Z__rules-2__' || query_set_version || '__kpi-2.0.0__source-pages-1' as dataset_version from {runs}""",
)
def _dataset_version(t):
    version = O.dataset_version(F.col("started_at"), F.lit("rules-2"), F.col("query_set_version"), F.lit(R.CONTRADICTION_V2))
    return t.runs.select("run_id", version.alias("dataset_version"))


@query(
    "write_tables",
    "select run_id, query_id, count(*) as rows, count(distinct offer_id) as offers from {sightings} group by run_id, query_id",
)
def _write_tables(t):
    """Write by run, write one run again, append what is stored already: nothing changes."""
    rows = Hi.record_sightings(t.sightings)
    path = T.scratch_path(t.spark, "sightings")
    T.write_partitions(rows, path, "run_id")
    T.write_partitions(rows.filter(F.col("run_id") == RUN), path, "run_id")
    T.append_new(rows.filter(F.col("run_id") >= BEFORE), path, ["run_id", "query_id", "offer_id"], "run_id")
    stored = t.spark.read.parquet(path).groupBy("run_id", "query_id").agg(F.count(F.lit(1)).alias("offers"))
    raw = t.sightings.groupBy("run_id", "query_id").agg(F.count(F.lit(1)).alias("rows"))
    return raw.join(stored, ["run_id", "query_id"])
