"""Evaluation of the rules over labelled rows, samples and search collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import rates as R
from offerlens.functions.text import content_fingerprint, redact_text
from offerlens.operators import duplicates as Du
from offerlens.operators import evaluate as E
from offerlens.plans.read_models import V1, V2, counts_sql, rate_sql
from offerlens.plans.registry import query

_COLUMNS = "status, claims_junior, minimum_experience_months, beginner_friendly, contradictory_junior"
_BEFORE = f"select offer_id as review_id, doc_id, {_COLUMNS} from {{classified_offers}}"
_AFTER = """select offer_id as review_id, doc_id, case when doc_id % 23 = 0 then 'ambiguous' else status end as status, claims_junior,
   case when doc_id % 29 = 0 then null else minimum_experience_months end as minimum_experience_months, beginner_friendly,
   case when doc_id % 37 = 0 then null else contradictory_junior end as contradictory_junior from {classified_offers}"""
_LABELS = """select offer_id as review_id, doc_id, status, case when doc_id % 31 = 0 then false else claims_junior end as claims_junior,
   case when doc_id % 41 = 0 then 7 else minimum_experience_months end as minimum_experience_months, beginner_friendly, contradictory_junior from {classified_offers}"""


@query(
    "label_join",
    """select review_id, predicted_status, reference_status from {label_rows}""",
)
def _label_join(t):
    left, right = t.label_rows.select("review_id", "predicted_status"), t.label_rows.select("review_id", "reference_status")
    return E.label_join(left, right)


@query("confusion_matrix", """select reference_status, count(*) filter (where predicted_status = 'classified') as classified,
     count(*) filter (where predicted_status = 'ambiguous') as ambiguous, count(*) filter (where predicted_status = 'unclassified') as unclassified
   from {label_rows} group by reference_status""")  # fmt: skip
def _confusion(t):
    return E.status_confusion(t.label_rows, "reference_status", "predicted_status")


_BINARY = """count(*) filter (where p and r) as tp, count(*) filter (where p and not r) as fp, count(*) filter (where not p and r) as fn,
   count(*) filter (where not p and not r) as tn"""


def _scores(counts: str) -> str:
    return f"""select *, case when precision_status = 'passed' and recall_status = 'passed' then 'passed' else 'blocked' end as gate from (
      select *, case when precision + recall <> 0 then 2 * precision * recall / (precision + recall) end as f1,
        case when tp + fp = 0 then 'not_evaluable' when precision >= 0.92 then 'passed' else 'failed' end as precision_status,
        case when tp + fn = 0 then 'not_evaluable' when recall >= 0.85 then 'passed' else 'failed' end as recall_status
      from (select *, case when tp + fp > 0 then tp::double / (tp + fp) end as precision, case when tp + fn > 0 then tp::double / (tp + fn) end as recall
        from ({counts}) c) s) g"""


@query(
    "precision_recall_gate",
    _scores(f"select lang, {_BINARY} from (select lang, predicted_positive as p, reference_positive as r from {{label_rows}} where reference_positive is not null) x group by lang"),
)
def _precision_recall(t):
    return E.precision_recall(E.binary_counts(t.label_rows, F.col("predicted_positive"), F.col("reference_positive"), "lang"))


_ASKED = "predicted_status = 'classified' and predicted_months is not null"


@query(
    "exact_months_precision",
    f"""select *, case when predicted = 0 then 'not_evaluable' when precision >= 0.9 then 'passed' else 'failed' end as status from (
          select exact, predicted, exact::double / predicted as precision from (select count(*) filter (where {_ASKED} and predicted_months = reference_months) as exact,
            count(*) filter (where {_ASKED}) as predicted from {{label_rows}}) c) p""",
)
def _exact_months(t):
    return E.exact_months_precision(t.label_rows, "predicted_status", "predicted_months", "reference_months")


@query(
    "cohort_scores",
    _scores(
        f"""select cohort, {_BINARY}, count(*) as count, count(*) filter (where predicted_status = reference_status) as exact from (
              select *, predicted_positive as p, coalesce(reference_positive, false) as r from {{label_rows}}) x group by cohort"""
    ),
)
def _cohorts(t):
    exact = F.col("predicted_status") == F.col("reference_status")
    return E.cohort_scores(t.label_rows, F.col("predicted_positive"), F.col("reference_positive"), exact)


@query(
    "denominator_agreement",
    "select * exclude (f1, gate) from ("
    + _scores(f"select {_BINARY} from (select predicted_status = 'classified' as p, reference_status = 'classified' as r from {{label_rows}}) x")
    + ") d",
)
def _denominator(t):
    return E.denominator_agreement(t.label_rows, F.col("predicted_status") == "classified", F.col("reference_status") == "classified")


def _delta_sql() -> str:
    fields = [c.strip() for c in _COLUMNS.split(",")]
    parts = [
        f"""select '{f}' as field, count(*) filter (where b.{f} is distinct from a.{f}) as changed,
              count(*) filter (where b.{f} is not distinct from l.{f}) as before_matches,
              count(*) filter (where a.{f} is not distinct from l.{f}) as after_matches
            from ({_BEFORE}) b join ({_AFTER}) a on a.review_id = b.review_id join ({_LABELS}) l on l.review_id = b.review_id"""
        for f in fields
    ]
    return " union all ".join(parts)


@query("version_delta", _delta_sql())
def _version_delta(t):
    return E.version_delta(t.sql(_BEFORE), t.sql(_AFTER), t.sql(_LABELS))


_DIFFER = " or ".join(f"b.{c.strip()} is distinct from a.{c.strip()}" for c in _COLUMNS.split(","))


@query(
    "changed_ids",
    f"""select b.review_id, b.status <> 'ambiguous' and a.status = 'ambiguous' as became_ambiguous
        from ({_BEFORE}) b join ({_AFTER}) a on a.review_id = b.review_id where {_DIFFER}""",
)
def _changed_ids(t):
    return E.changed_ids(t.sql(_BEFORE), t.sql(_AFTER))


_PERIOD = "published_at >= timestamp '2024-01-30 00:00:00' - interval 30 day"
_SIDES = "offer_id, published_at, status, claims_junior, minimum_experience_months, junior_observation_status, junior_observation_contradictory"
_CANDIDATE = _SIDES.replace("minimum_experience_months", "case when doc_id % 29 = 0 then null else minimum_experience_months end as minimum_experience_months", 1)


@query(
    "reclassify_audit",
    f"""with b as (select * from {{classified_offers}} where {_PERIOD}), a as (select {_CANDIDATE} from b)
        select side, numerator, denominator, unknown_count, ambiguous_count, population_count, value,
          (select count(*) from b join a on a.offer_id = b.offer_id where a.minimum_experience_months is distinct from b.minimum_experience_months) as changed
        from (select 'before' as side, * from ({rate_sql(f"select {counts_sql(V1)} from b")}) x
          union all select 'candidate', * from ({rate_sql(f"select {counts_sql(V1)} from a")}) y
          union all select 'observation_candidate', * from ({rate_sql(f"select {counts_sql(V2)} from a")}) z) u""",
)
def _audit(t):
    rows = t.classified_offers.filter(F.col("published_at") >= F.lit("2023-12-31").cast("timestamp"))
    months = F.when(F.col("doc_id") % 29 != 0, F.col("minimum_experience_months"))
    report = E.reclassify_audit(rows, rows.withColumn("minimum_experience_months", months))
    return report.select("side", *R.COUNTS, "population_count", "value", "changed")


@query(
    "annotator_agreement",
    f"""select review_id, concat_ws(',', {", ".join(f"case when b.{c.strip()} is distinct from a.{c.strip()} then '{c.strip()}' end" for c in _COLUMNS.split(","))}) as disagreements,
          not ({_DIFFER}) as agree from ({_BEFORE}) b join ({_AFTER}) a using (review_id)""",
)
def _agreement(t):
    return E.annotator_agreement(t.sql(_BEFORE), t.sql(_AFTER)).withColumn("disagreements", F.array_join("disagreements", ","))


_BROKEN = """case when status = 'unclassified' and coalesce(claims_junior::varchar, minimum_experience_months::varchar, beginner_friendly::varchar, contradictory_junior::varchar) is not null then 'unclassified_values_not_null' end,
   case when status = 'ambiguous' and beginner_friendly is not null then 'ambiguous_beginner_not_null' end,
   case when status = 'ambiguous' and contradictory_junior is not null then 'ambiguous_contradiction_not_null' end,
   case when status = 'classified' and beginner_friendly is distinct from (minimum_experience_months <= 12) then 'beginner_mismatch' end,
   case when status = 'classified' and contradictory_junior is distinct from (case when claims_junior then minimum_experience_months >= 24 when not claims_junior then false end) then 'contradiction_mismatch' end"""


@query(
    "label_semantics",
    f"select review_id, code from (select review_id, unnest([{_BROKEN}]) as code from ({_AFTER}) a) x where code is not null",
)
def _label_semantics(t):
    return E.label_semantics(t.sql(_AFTER))


@query(
    "label_amendments",
    """select review_id, reference_status as original_reference_status, case when doc_id % 5 = 0 then 'ambiguous' else reference_status end as reference_status,
         doc_id % 5 = 0 as amended from {label_rows}""",
)
def _amendments(t):
    reviewed = t.label_rows.filter(F.col("doc_id") % 5 == 0).select("review_id", F.lit("ambiguous").alias("reference_status"))
    labels = t.label_rows.select("review_id", "reference_status")
    return E.label_amendments(labels, reviewed, ["reference_status"])


@query(
    "unexpected_reviews",
    """select review_id, 'not_selected' as problem from {label_rows} where doc_id % 5 = 0 and doc_id % 3 <> 0
       union all select review_id, 'not_reviewed' from {label_rows} where doc_id % 3 = 0 and doc_id % 5 <> 0""",
)
def _unexpected(t):
    labels = t.label_rows
    return E.unexpected_reviews(
        labels.filter(F.col("doc_id") % 5 == 0).select("review_id"), labels.filter(F.col("doc_id") % 3 == 0).select("review_id")
    )


@query("disjoint_corpora", "select review_id from {label_rows} where cohort = 'challenge' and doc_id % 2 = 0")
def _disjoint(t):
    """One corpus is spoiled with rows of the other, which must be found."""
    challenge = t.label_rows.filter("cohort = 'challenge'")
    mixed = t.label_rows.filter((F.col("cohort") == "reference") | (F.col("doc_id") % 2 == 0))
    return E.disjoint_corpora(challenge, mixed)


@query(
    "excerpt_containment",
    r"""select doc_id, excerpt, contains(text, excerpt) as exact,
         contains(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', '', 'g'), regexp_replace(strip_accents(lower(excerpt)), '[^\p{L}\p{N}]+', '', 'g')) as folded
       from (select doc_id, text, unnest([substring(text, 1, 12), replace(substring(text, 3, 9), ' ', '-'), 'absent phrase']) as excerpt from {documents}) x""",
)
def _excerpts(t):
    excerpts = F.array(F.substring("text", 1, 12), F.replace(F.substring("text", 3, 9), F.lit(" "), F.lit("-")), F.lit("absent phrase"))
    return E.excerpt_containment(t.documents.select("doc_id", "text"), F.col("text"), excerpts).drop("text")


# ------------------------------------------------------------------ samples


@query(
    "stratified_hash_split",
    """select review_id, query_group, case when rn > n - greatest(1, floor(n * 0.3 + 0.5)) then 'validation' else 'dev' end as split from (
         select *, row_number() over (partition by query_group order by sha256(review_id), review_id) as rn, count(*) over (partition by query_group) as n from {label_rows}) r""",
)
def _split(t):
    return E.stratified_hash_split(t.label_rows, "query_group", "review_id").select("review_id", "query_group", "split")


_CANDIDATES = """select offer_id, region_code as group_id, case when doc_id % 10 = 0 then 'overlap' when doc_id % 3 = 0 then 'keyword-only' else 'occupation-only' end as stratum from {offer_rows}"""


@query(
    "blind_stratified_sample",
    f"""with hashed as (select *, sha256(offer_id || chr(0) || group_id || chr(0) || 'seed') as h from ({_CANDIDATES}) c),
        ranked as (select *, row_number() over (partition by group_id, stratum order by h) as rs from hashed),
        rest as (select *, row_number() over (partition by group_id, rs <= 10 order by h) as rr, count(*) filter (where rs <= 10) over (partition by group_id) as taken from ranked)
        select offer_id, group_id, stratum from rest where rs <= 10 or rr <= 30 - taken""",
)
def _blind(t):
    return E.blind_stratified_sample(t.sql(_CANDIDATES), "seed")


_FINGER = r"sha256(regexp_replace(lower(title || chr(10) || {0}), '\s+', ' ', 'g'))"


@query(
    "content_fingerprint",
    f"select offer_id, {_FINGER.format('description_text')} as fingerprint from {{offer_rows}}",
)
def _fingerprint(t):
    return t.offer_rows.select("offer_id", content_fingerprint(F.col("title"), F.col("description_text")).alias("fingerprint"))


_POOL = "select offer_id, title || ' ' || region_code as title, lang as description_text, doc_id from {offer_rows}"


@query(
    "holdout_exclusion",
    f"""with pool as (select *, {_FINGER.format('description_text')} as fingerprint, sha256('seed' || offer_id) as o from ({_POOL}) p),
        fresh as (select * from pool where fingerprint not in (select fingerprint from pool where doc_id % 6 = 0))
        select offer_id, fingerprint from (select *, row_number() over (partition by fingerprint order by o) as rn from fresh) f where rn = 1 order by o limit 200""",
)
def _holdout(t):
    pool = t.sql(_POOL)
    marked = pool.withColumn("fingerprint", content_fingerprint(F.col("title"), F.col("description_text")))
    return E.holdout(pool, marked.filter(F.col("doc_id") % 6 == 0), "seed", 200).select("offer_id", "fingerprint")


@query(
    "exact_overlap_count",
    f"""with pool as (select *, {_FINGER.format('description_text')} as fingerprint from ({_POOL}) p)
        select count(*) as overlaps from pool where doc_id % 3 = 0 and fingerprint in (select fingerprint from pool where doc_id % 3 <> 0)""",
)
def _overlap_count(t):
    pool = t.sql(_POOL).withColumn("fingerprint", content_fingerprint(F.col("title"), F.col("description_text")))
    third = F.col("doc_id") % 3 == 0
    return E.exact_overlap_count(pool.filter(third), pool.filter(~third))


# Whole titles and texts. Every fifth offer has a copy under another id, which differs in case and spacing only.
_POOL_TEXTS = """select offer_id, title, description_text, doc_id from {offer_rows}
   union all select 'copy-' || offer_id, upper(title), replace(description_text, ' ', '   '), doc_id + 1 from {offer_rows} where doc_id % 5 = 0"""
_REDACT = r"regexp_replace(regexp_replace(regexp_replace({0}, '(?i)https?://[^\s]+', '[URL]', 'g'), '(?i)[\w.+-]+@[\w.-]+\.[a-z]{{2,}}', '[EMAIL]', 'g'), '(?:\+33|0)[\d .()-]{{8,}}', '[TÉLÉPHONE]', 'g')"
_POOL_REDACTED = f"select offer_id, doc_id, {_REDACT.format('title')} as title, {_REDACT.format('description_text')} as description_text from ({_POOL_TEXTS}) p"


@query(
    "holdout_exclusion_texts",
    f"""with pool as (select *, {_FINGER.format('description_text')} as fingerprint, sha256('seed' || offer_id) as o from ({_POOL_REDACTED}) p),
        fresh as (select * from pool where not exists (select 1 from pool e where e.doc_id % 6 = 0 and e.fingerprint = pool.fingerprint))
        select offer_id, fingerprint from (select *, row_number() over (partition by fingerprint order by o) as rn from fresh) f where rn = 1 order by o limit 200""",
)
def _holdout_texts(t):
    """Earlier samples hold redacted texts, so the excluded ones are redacted before they are hashed."""
    pool = t.sql(_POOL_TEXTS)
    fingerprint = content_fingerprint(redact_text(F.col("title")), redact_text(F.col("description_text")))
    used = pool.filter(F.col("doc_id") % 6 == 0).select(fingerprint.alias("fingerprint"))
    return E.holdout(pool, used, "seed", 200).select("offer_id", "fingerprint")


@query(
    "exact_overlap_count_texts",
    f"""with pool as (select *, {_FINGER.format('description_text')} as fingerprint from ({_POOL_TEXTS}) p)
        select count(*) as overlaps from pool where doc_id % 3 = 0 and fingerprint in (select fingerprint from pool where doc_id % 3 <> 0)""",
)
def _overlap_texts(t):
    pool = t.sql(_POOL_TEXTS).withColumn("fingerprint", content_fingerprint(F.col("title"), F.col("description_text")))
    third = F.col("doc_id") % 3 == 0
    return E.exact_overlap_count(pool.filter(third), pool.filter(~third))


@query(
    "challenge_sample",
    """select review_id, 'reference' as cohort from {label_rows} union all
       select * from (select substring(sha256(offer_id), 1, 16), 'challenge' from {dataset_rows} where claims_junior and status = 'ambiguous'
         and published_at >= source_cutoff_at - interval 30 day order by offer_id limit 100) c""",
)
def _challenge(t):
    return E.challenge_sample(t.label_rows, t.dataset_rows.withColumnRenamed("published_at", "source_published_at"))


# ------------------------------------------------------------------ searches

_HITS = "select distinct event_type as query_id, user_id as offer_id from {events} where value > 60 or event_type <> 'error'"
_QUERIES = "select event_type as query_id, case when event_type in ('view', 'click') then 'occupation-only' else 'keyword-only' end as kind, arr(case when event_type in ('view', 'signup', 'error') then 'g1' else 'g2' end) as group_ids, count(*) as n from {events} group by event_type union all select 'nothing', 'keyword-only', arr('g1'), count(*) from {events}"
_PAIRS = f"""select l.query_id as left_id, r.query_id as right_id, (select count(*) from ({_HITS}) a join ({_HITS}) b on a.offer_id = b.offer_id where a.query_id = l.query_id and b.query_id = r.query_id) as intersection,
   (select count(distinct offer_id) from ({_HITS}) u where u.query_id in (l.query_id, r.query_id)) as "union" from ({_QUERIES}) l join ({_QUERIES}) r on l.query_id < r.query_id"""
_JACCARD = f"""select *, case when "union" > 0 then intersection::double / "union" end as jaccard from ({_PAIRS}) p"""


@query("pairwise_overlap", f"select * from ({_JACCARD}) j where intersection > 0")
def _pairwise(t):
    return E.pairwise_overlap(t.sql(_HITS))


@query(
    "overlap_summary",
    f"""select count(*) as pairs, count(*) filter (where intersection > 0) as non_zero_pairs, avg(coalesce(jaccard, 0)) as mean_jaccard
        from ({_JACCARD}) p join ({_QUERIES}) l on l.query_id = p.left_id join ({_QUERIES}) r on r.query_id = p.right_id
        where l.kind <> r.kind and l.group_ids[1] = r.group_ids[1]""",
)
def _overlap_summary(t):
    queries = t.sql(_QUERIES)
    return E.overlap_summary(E.pairwise_overlap(t.sql(_HITS)), queries)


_FOUND = "select lpad(cast(user_id as string), 8, '0') as offer_id, event_type as query_id, case when event_type in ('view', 'click') then 'occupation-only' when event_type = 'error' then 'overlap' else 'keyword-only' end as channel from {events}"


@query(
    "union_channels",
    f"""select offer_id, string_agg(distinct channel, ',' order by channel) as channels, string_agg(distinct query_id, ',' order by query_id) as query_ids
        from ({_FOUND}) f group by offer_id""",
)
def _union_channels(t):
    rows = E.union_channels(t.sql(_FOUND))
    return rows.select("offer_id", F.array_join("channels", ",").alias("channels"), F.array_join("query_ids", ",").alias("query_ids"))


_RUNS = """select run_id || '/' || query_id as query_id, case when max(source_total) > 90 then 'over_cap' when count(*) < 4 then 'incomplete' else 'complete' end as status,
   max(source_total) as total, sum(quarantined_count) as quarantined, max(case when warning_count > 4 then 'many_warnings' end) as warning from {page_facts} group by run_id, query_id"""


@query(
    "collection_summary",
    f"""select count(*) as queries, count(*) filter (where status = 'complete') as complete, count(*) filter (where status = 'over_cap') as over_cap,
          count(*) filter (where status = 'incomplete') as incomplete, sum(total)::bigint as total_reported, sum(quarantined)::bigint as quarantined,
          coalesce(string_agg(distinct warning, ',' order by warning), '') as warnings, (select count(distinct user_id) from {{events}}) as unique_offers from ({_RUNS}) r""",
)
def _collection(t):
    return E.collection_summary(t.sql(_RUNS), t.sql(_FOUND))


@query(
    "collection_group_offers",
    f"""select g.group_id, count(distinct h.offer_id) as unique_offers from (select query_id, unnest(group_ids) as group_id from ({_QUERIES}) q) g
        left join ({_HITS}) h on h.query_id = g.query_id group by g.group_id""",
)
def _group_offers(t):
    return E.group_offers(t.sql(_HITS), t.sql(_QUERIES))


_RELEVANCE = """select review_id, query_group as group_id, case when reference_status = 'ambiguous' then 'ambiguous' else 'classified' end as label_status,
   reference_positive as relevant, case when doc_id % 10 = 0 then 'overlap' when doc_id % 3 = 0 then 'keyword-only' else 'occupation-only' end as stratum,
   case when doc_id % 50 = 7 then 0 else 2 end as evidence,
   case when doc_id % 3 = 0 then arr('view', 'error') when doc_id % 3 = 1 then arr('click', 'view') else arr('purchase', 'purchase') end as query_ids,
   case when reference_positive then null when doc_id % 2 = 0 then 'adjacent-occupation' else 'insufficient-context' end as reason from {label_rows}"""
_GROUPS = "select distinct query_group as group_id from {label_rows} union all select 'no-sample'"
_GATE = "case when {d} = 0 then 'not_evaluable' when {n}::double / {d} >= {t} then 'passed' else 'failed' end"
_BY_GROUP = f"""select *, case when sample >= 30 then 'passed' else 'failed' end as size_gate, {_GATE.format(n='resolved', d='sample', t=0.9)} as coverage_gate,
          {_GATE.format(n='relevant', d='resolved', t=0.7)} as precision_gate from (
        select g.group_id, count(r.review_id) as sample, count(r.review_id) filter (where label_status = 'classified' and relevant is not null) as resolved,
          count(r.review_id) filter (where label_status = 'classified' and relevant) as relevant from ({_GROUPS}) g left join ({_RELEVANCE}) r on r.group_id = g.group_id
        group by g.group_id) c"""


@query("query_relevance", _BY_GROUP)
def _relevance(t):
    return E.query_relevance(t.sql(_RELEVANCE), t.sql(_GROUPS))


_COLLECTED = f"""select count(*) as queries, count(*) filter (where status = 'complete') as complete, count(*) filter (where status = 'over_cap') as over_cap,
   count(*) filter (where status = 'incomplete') as incomplete, sum(quarantined) as quarantined, count(warning) as warnings from ({_RUNS}) r"""


@query(
    "relevance_gate",
    f"""with gates as (
          select sample, resolved, relevant, with_evidence, {_GATE.format(n='resolved', d='sample', t=0.9)} as coverage_gate,
            {_GATE.format(n='relevant', d='resolved', t=0.8)} as precision_gate, {_GATE.format(n='with_evidence', d='sample', t=1)} as evidence_gate,
            case when c.complete = c.queries and over_cap = 0 and incomplete = 0 then 'passed' else 'failed' end as pagination_gate,
            case when coalesce(quarantined, 0) = 0 then 'passed' else 'failed' end as quarantine_gate,
            case when warnings = 0 then 'passed' else 'failed' end as contract_gate,
            case when (select bool_and(size_gate = 'passed' and coverage_gate = 'passed' and precision_gate = 'passed') from ({_BY_GROUP}) g) then 'passed' else 'failed' end as groups_passed_gate
          from (select count(*) as sample, count(*) filter (where label_status = 'classified' and relevant is not null) as resolved,
                  count(*) filter (where label_status = 'classified' and relevant) as relevant, count(*) filter (where evidence > 0) as with_evidence
                from ({_RELEVANCE}) r) o, ({_COLLECTED}) c)
        select *, case when coverage_gate = 'passed' and precision_gate = 'passed' and evidence_gate = 'passed' and pagination_gate = 'passed'
          and quarantine_gate = 'passed' and contract_gate = 'passed' and groups_passed_gate = 'passed' then 'passed' else 'blocked' end as gate_status from gates""",
)
def _relevance_gate(t):
    return E.relevance_gate(t.sql(_RELEVANCE), t.sql(_GROUPS), E.collection_summary(t.sql(_RUNS), t.sql(_FOUND)))


@query(
    "relevance_by_stratum",
    f"""select s.stratum, count(r.review_id) as resolved, count(r.review_id) filter (where relevant) as relevant,
          count(r.review_id) filter (where relevant)::double / nullif(count(r.review_id), 0) as rate
        from (select unnest(['keyword-only', 'occupation-only', 'overlap']) as stratum) s
        left join ({_RELEVANCE}) r on r.stratum = s.stratum and label_status = 'classified' and relevant is not null group by s.stratum""",
)
def _strata(t):
    return E.relevance_by_stratum(t.sql(_RELEVANCE))


@query(
    "relevance_by_query",
    f"""select q.query_id, q.kind, count(r.review_id) as sample, count(r.review_id) filter (where label_status = 'classified') as resolved,
          count(r.review_id) filter (where label_status = 'classified' and relevant) as relevant,
          count(r.review_id) filter (where label_status = 'classified' and relevant)::double / nullif(count(r.review_id) filter (where label_status = 'classified'), 0) as rate
        from ({_QUERIES}) q left join ({_RELEVANCE}) r on list_contains(r.query_ids, q.query_id) group by q.query_id, q.kind""",
)
def _by_query(t):
    return E.relevance_by_query(t.sql(_RELEVANCE), t.sql(_QUERIES))


@query("false_positive_reasons", f"select reason, count(*) as count from ({_RELEVANCE}) r where reason is not null group by reason")
def _reasons(t):
    return E.false_positive_reasons(t.sql(_RELEVANCE))


# ------------------------------------------------------------------ duplicates

_COPIES = """select offer_id, title, company_name, commune_code, contract_kind, description_text, published_at as source_published_at, doc_id from {offer_rows}
   union all select 'copy-' || offer_id, upper(title), company_name, commune_code, contract_kind, ' ' || description_text || ' !', published_at + (doc_id % 50) * interval '1' day, doc_id
     from {offer_rows}"""


@query(
    "probable_duplicates",
    """select doc_id, far, count(*) as offers from (select doc_id, published_at is not null and doc_id % 50 > 30 as far, unnest([1, 2]) from {offer_rows}) x where not far group by doc_id, far""",
)
def _duplicates(t):
    """Every offer has a copy in other letters and up to 49 days later; near ones must be found."""
    copies = t.sql(_COPIES)
    found = Du.probable_duplicates(copies).join(copies.select("offer_id", "doc_id"), "offer_id")
    return found.groupBy("doc_id", F.lit(False).alias("far")).agg(F.count(F.lit(1)).alias("offers"))


# Blocks of many offers: the title has 40 values. Copies change the words that begin with one letter, or with several.
_VERSIONS = """select lpad(cast(doc_id as string), 10, '0') || '-' || cast(version as string) as offer_id, 'Role ' || cast(doc_id % 40 as string) as title,
     cast(null as string) as company_name, source as commune_code, case when doc_id % 3 = 0 then 'cdi' end as contract_kind,
     case version * (1 + doc_id % 4) when 0 then text when 1 then replace(text, ' s', ' zs') when 2 then replace(replace(text, ' b', ' zb'), ' c', ' zc')
       when 3 then replace(replace(replace(replace(text, ' a', ' za'), ' t', ' zt'), ' d', ' zd'), ' l', ' zl') else ' ' || replace(text, 'e', 'E') || ' !' end as description_text,
     case when doc_id % 13 <> 0 then timestamp '2024-01-30 00:00:00' - (doc_id % 120 + version * (doc_id % 25)) * interval '1' day end as source_published_at
   from (select doc_id, source, text, explode(arr(0, 1)) as version from {documents}) versions"""


@query(
    "probable_duplicate_texts",
    f"""with recursive offers as materialized (
          select offer_id, struct_pack(t := title, c := commune_code, k := contract_kind) as block, coalesce(cast(source_published_at as date), date '1970-01-01') as day,
            list_sort(list_distinct(regexp_extract_all(strip_accents(lower(coalesce(description_text, ''))), '[\\p{{L}}\\p{{N}}]+'))) as words
          from ({_VERSIONS}) v
        ), classes as materialized (select row_number() over () as class, * from (select distinct block, words from offers) d),
        words as materialized (select class, block, unnest(words) as word from classes),
        weights as (select word, length(bin((select count(*) from classes) // count(*))) as weight from words group by word),
        weighted as materialized (select class, block, word, weight from words join weights using (word)),
        totals as (select class, sum(weight) as total from weighted group by class),
        common as (select a.class as a, b.class as b, sum(a.weight) as common from weighted a join weighted b on a.block = b.block and a.word = b.word and a.class < b.class group by all),
        similar_ as (select a, b from common join totals x on x.class = a join totals y on y.class = b where common >= 0.75 * (x.total + y.total - common)
          union all select class, class from classes),
        members as materialized (select offer_id, day, class from offers join classes using (block, words)),
        links as materialized (
          select x.offer_id as a, y.offer_id as b from similar_ s join members x on x.class = s.a join members y on y.class = s.b
          where x.offer_id <> y.offer_id and abs(date_diff('day', x.day, y.day)) <= 30),
        reach(offer_id, other) as (
          select offer_id, offer_id from offers union
          select r.offer_id, l.b from reach r join (select a, b from links union select b, a from links) l on l.a = r.other
        ), clusters as (select offer_id, min(other) as cluster_id from reach group by offer_id)
        select offer_id, cluster_id, cluster_size from (select *, count(*) over (partition by cluster_id) as cluster_size from clusters) c where cluster_size > 1""",
)
def _duplicate_texts(t):
    """Each document and a changed copy, some within the bound of similarity, in blocks of many offers."""
    return Du.probable_duplicates(t.sql(_VERSIONS))
