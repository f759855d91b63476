"""Raw pages, normalization and the text rules over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlens.functions import offers as O
from offerlens.functions import text as X
from offerlens.operators import backfill as B
from offerlens.operators import classify as C
from offerlens.operators import normalize as N
from offerlens.plans.registry import query
from offerlens.rules import patterns as P
from offerlens.rules import query_set
from offerlens.sources import pages as S
from offerlens.sources import tables as T
from offerlens.sources import taxonomies as Tx
from offerlens.streaming import intake, sightings

# ------------------------------------------------------------------ raw pages made of documents

PAGE_SIZE = 20


def raw_pages(t):
    """Pages of twenty raw offers, one per document, with planted defects. Pages are bounded by their size."""
    d = F.col("doc_id")
    item = F.to_json(
        F.struct(
            F.when(d % 17 != 3, F.col("offer_id")).alias("id"),
            F.when(d % 19 == 4, F.lit("")).otherwise(F.col("title")).alias("intitule"),
            F.concat(
                F.col("description_text"),
                F.when(d % 29 == 6, "@@NUL@@").when(d % 31 == 7, "@@LONE@@").when(d % 31 == 8, "@@PAIR@@").otherwise(""),
            ).alias("description"),
            F.col("contract_code").alias("typeContrat"),
            F.col("alternance").alias("alternance"),
            F.col("experience_code").alias("experienceExige"),
            F.col("experience_label").alias("experienceLibelle"),
            F.struct(
                F.when(d % 23 == 5, 123.5).otherwise(F.lit(48.5)).alias("latitude"), F.col("commune_code").alias("commune")
            ).alias("lieuTravail"),
            F.struct(F.concat(F.lit(" "), "salary_label").alias("libelle"), F.lit("  ").alias("commentaire")).alias("salaire"),
            F.struct(F.col("source_url").alias("urlOrigine")).alias("origineOffre"),
            F.when(d % 11 == 2, d).alias("nouveauChamp"),
            F.when(d % 7 == 1, F.lit("x")).alias("autreChamp"),
        )
    )
    item = F.replace(item, F.lit("@@NUL@@"), F.lit("\\u0000"))
    item = F.replace(F.replace(item, F.lit("@@LONE@@"), F.lit("\\ud800 x")), F.lit("@@PAIR@@"), F.lit("\\ud83d\\ude00"))
    page = F.floor(d / PAGE_SIZE)
    grouped = t.offer_rows.groupBy(page.alias("page_no")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda s: s["item"]).alias("items")
    )
    listed = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    no = F.col("page_no")
    payload = (
        F.when(no % 13 == 4, F.lit('{"message": "none"}'))
        .when(no % 13 == 7, F.lit("[1, 2]"))
        .when(no % 13 == 9, F.concat(F.lit('{"resultats":'), listed, F.lit(',"extra":1}')))
        .otherwise(F.concat(F.lit('{"resultats":'), listed, F.lit(',"filtresPossibles":[]}')))
    )
    return grouped.select(F.lit("q").alias("query_key"), (no * PAGE_SIZE).alias("range_start"), payload.alias("payload"))


def _checked(t):
    return S.validate_contract(S.read_offer_pages(S.parsed_pages(raw_pages(t))))


_ITEMS = f"""select *, (doc_id // {PAGE_SIZE}) * {PAGE_SIZE} as range_start, (row_number() over (partition by doc_id // {PAGE_SIZE} order by doc_id) - 1)::int as item_ordinal
   from {{offer_rows}}"""
_GOOD_PAGES = f"select * from ({_ITEMS}) i where (doc_id // {PAGE_SIZE}) % 13 not in (4, 7)"
_ISSUES = """concat_ws(',', case when doc_id % 17 = 3 then 'id:invalid_type' end, case when doc_id % 19 = 4 then 'intitule:too_small' end,
   case when doc_id % 23 = 5 then 'lieuTravail.latitude:out_of_range' end, case when doc_id % 29 = 6 or doc_id % 31 = 7 then ':storage_text' end)"""


@query("read_offer_pages", f"select range_start, item_ordinal, case when doc_id % 17 <> 3 then offer_id end as id from ({_GOOD_PAGES}) p")
def _read_offer_pages(t):
    """Through files: pages are landed as JSON lines and read back with a fixed schema."""
    path = T.scratch_path(t.spark, "pages")
    raw_pages(t).write.json(path)
    items = S.read_offer_pages(S.parsed_pages(S.read_pages(t.spark, path)))
    return items.select("range_start", "item_ordinal", F.try_variant_get("raw", "$.id", "string").alias("id"))


@query(
    "envelope_check",
    f"""select distinct (doc_id // {PAGE_SIZE}) * {PAGE_SIZE} as range_start,
          case (doc_id // {PAGE_SIZE}) % 13 when 4 then 'result_list_missing' when 7 then 'root_not_object' end as root_issue from {{documents}}""",
)
def _envelope_check(t):
    return S.envelope_check(S.parsed_pages(raw_pages(t))).select("range_start", "root_issue")


@query("validate_contract", f"select range_start, item_ordinal, {_ISSUES} as issues from ({_GOOD_PAGES}) p")
def _validate_contract(t):
    issues = F.transform("issues", lambda i: F.concat_ws(":", i["path"], i["code"]))
    return _checked(t).select("range_start", "item_ordinal", F.array_join(issues, ",").alias("issues"))


@query(
    "storage_text_check",
    """select doc_id, doc_id % 29 <> 6 and doc_id % 31 <> 7 as storable from {documents}""",
)
def _storage_text(t):
    escape = (
        F.when(F.col("doc_id") % 29 == 6, r"\u0000")
        .when(F.col("doc_id") % 31 == 7, r"\\\ud812 \\u0000")
        .when(F.col("doc_id") % 31 == 8, r"😀 \\u0000 \\ud812")
        .otherwise("")
    )
    raw = F.concat(F.lit('{"a":'), F.regexp_replace(F.to_json(F.struct("text")), r'^\{"text":|"\}$', ""), escape, F.lit('"}'))
    return t.documents.select("doc_id", S.storage_text_ok(raw).alias("storable"))


_VALID = f"select * from ({_GOOD_PAGES}) p where {_ISSUES} = ''"


@query(
    "unknown_field_report",
    f"""select range_start, 'resultats.' || item_ordinal as path, 'nouveauChamp' as field, 'number' as observed_type from ({_VALID}) v where doc_id % 11 = 2
        union all select range_start, 'resultats.' || item_ordinal, 'autreChamp', 'string' from ({_VALID}) v where doc_id % 7 = 1
        union all select distinct (doc_id // {PAGE_SIZE}) * {PAGE_SIZE}, '$root', 'extra', 'number' from {{documents}} where (doc_id // {PAGE_SIZE}) % 13 = 9""",
)
def _unknown_fields(t):
    pages = S.parsed_pages(raw_pages(t))
    checked = S.validate_contract(S.read_offer_pages(pages))
    return S.unknown_field_report(checked).unionByName(S.unknown_root_fields(pages)).drop("query_key")


@query(
    "page_status",
    f"""select range_start, received, quarantined, warnings, case when page_no % 13 in (4, 7) then 'invalid_quarantined'
          when quarantined + warnings > 0 then 'valid_with_warnings' else 'valid' end as status from (
        select range_start, doc_id // {PAGE_SIZE} as page_no, count(*) filter (where (doc_id // {PAGE_SIZE}) % 13 not in (4, 7)) as received,
          count(*) filter (where (doc_id // {PAGE_SIZE}) % 13 not in (4, 7) and {_ISSUES} <> '') as quarantined,
          count(*) filter (where (doc_id // {PAGE_SIZE}) % 13 not in (4, 7) and {_ISSUES} = '' and doc_id % 11 = 2)
            + count(*) filter (where (doc_id // {PAGE_SIZE}) % 13 not in (4, 7) and {_ISSUES} = '' and doc_id % 7 = 1)
            + case when (doc_id // {PAGE_SIZE}) % 13 = 9 then 1 else 0 end as warnings
        from ({_ITEMS}) i group by range_start, doc_id // {PAGE_SIZE}) s""",
)
def _page_status(t):
    pages, checked = S.parsed_pages(raw_pages(t)), _checked(t)
    status = S.page_status(pages, checked, S.unknown_field_report(checked))
    return status.select("range_start", "received", "quarantined", "warnings", "status")


@query(
    "normalize_offers",
    f"""select offer_id as external_id, title, case when doc_id % 14 = 5 then 'alternance' when contract_code = 'CDI' then 'cdi' when contract_code = 'CDD' then 'cdd'
          when contract_code = 'MIS' then 'interim' when contract_code = 'SAI' then 'other' else 'unknown' end as contract,
          case when experience_code = 'E' then true when experience_code in ('D', 'S') then false end as required, experience_label, salary_label, commune_code,
          case when regexp_matches(source_url, '^https?://') then source_url end as source_url from ({_VALID}) v""",
)
def _normalize(t):
    rows = N.normalize_offers(S.valid_items(_checked(t)))
    return rows.select(
        "external_id", "title", F.col("contract.normalized").alias("contract"), F.col("structured_experience.required").alias("required"),
        F.col("structured_experience.label").alias("experience_label"), F.col("salary.label").alias("salary_label"),
        F.col("location.commune_code").alias("commune_code"), "source_url",
    )


@query(
    "stream_offer_pages",
    f"select (doc_id // {PAGE_SIZE}) * {PAGE_SIZE} as range_start, count(*) as items from ({_GOOD_PAGES}) p group by 1",
)
def _stream_pages(t):
    """The same pages arrive twice as files; each is committed once."""
    landing, committed = T.scratch_path(t.spark, "landing"), T.scratch_path(t.spark, "committed")
    pages = raw_pages(t)
    pages.write.json(landing)
    pages.write.mode("append").json(landing)
    intake.commit_pages(t.spark, landing, committed, T.scratch_path(t.spark, "progress"))
    items = S.read_offer_pages(S.parsed_pages(t.spark.read.parquet(committed)))
    return items.groupBy("range_start").agg(F.count(F.lit(1)).alias("items"))


@query(
    "stream_sightings_state",
    """select offer_id, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') as first_seen_at, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') as last_seen_at,
         count(*) as sightings, arg_max(content_hash, (observed_at, event_id)) as open_hash from {sightings} group by offer_id""",
)
def _stream_sightings(t):
    landing, state = T.scratch_path(t.spark, "sightings"), T.scratch_path(t.spark, "state")
    t.sightings.select(*sightings.COLUMNS).repartition(4).write.parquet(landing)
    sightings.keep_state(t.spark, landing, state, T.scratch_path(t.spark, "progress"))
    rows = sightings.current_state(t.spark, state)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("offer_id", text("first_seen_at"), text("last_seen_at"), "sightings", "open_hash")


# Sightings and closings arrive in six files one after the other, each over the whole time.
_CHANGES = """select offer_id, observed_at, event_id, content_hash, case when event_id % 11 in (3, 4) then 'closed' else 'seen' end as kind,
     cast(event_id % 6 as int) as file_no from {sightings}"""


@query(
    "stream_offer_state",
    f"""with ordered as (
          select *, lag(kind) over w as before, row_number() over w as place, last_value(kind) over (partition by offer_id order by file_no, observed_at, event_id
            rows between unbounded preceding and unbounded following) as last_kind
          from ({_CHANGES}) c window w as (partition by offer_id order by file_no, observed_at, event_id)
        )
        select offer_id, strftime(min(observed_at) filter (kind = 'seen'), '%Y-%m-%d %H:%M:%S') as first_seen_at,
          strftime(max(observed_at) filter (kind = 'seen'), '%Y-%m-%d %H:%M:%S') as last_seen_at, count(*) filter (kind = 'seen') as sightings,
          arg_max(content_hash, (observed_at, event_id)) filter (kind = 'seen') as open_hash,
          case when any_value(last_kind) = 'closed' then strftime(arg_max(observed_at, place) filter (kind = 'closed' and before is distinct from 'closed'), '%Y-%m-%d %H:%M:%S') end as closed_at,
          count(*) filter (kind = 'seen' and before = 'closed') as reopened_count
        from ordered group by offer_id""",
)
def _stream_state(t):
    """Six batches with a snapshot every second one; offers closed for three days leave the snapshot and come back."""
    landing, state = T.scratch_path(t.spark, "changes"), T.scratch_path(t.spark, "state")
    changes = t.sql(_CHANGES)
    for number in range(6):
        changes.filter(F.col("file_no") == number).drop("file_no").coalesce(1).write.mode("append").parquet(landing)
    sightings.keep_state(t.spark, landing, state, T.scratch_path(t.spark, "progress"), snapshot_every=2, archived_after_days=3)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sightings.current_state(t.spark, state).select(
        "offer_id", text("first_seen_at"), text("last_seen_at"), "sightings", "open_hash", text("closed_at"), "reopened_count"
    )


# ------------------------------------------------------------------ projections


@query(
    "contract_kind",
    """select offer_id, case when alternance then 'alternance' when contract_code = 'CDI' then 'cdi' when contract_code = 'CDD' then 'cdd'
         when contract_code = 'MIS' then 'interim' when contract_code = 'SAI' then 'other' else 'unknown' end as kind from {offer_rows}""",
)
def _contract_kind(t):
    return t.offer_rows.select("offer_id", O.contract_kind(F.col("alternance"), F.col("contract_code")).alias("kind"))


@query(
    "structured_experience",
    "select offer_id, case experience_code when 'E' then true when 'D' then false when 'S' then false end as required from {offer_rows}",
)
def _structured(t):
    return t.offer_rows.select("offer_id", O.structured_experience(F.col("experience_code")).alias("required"))


@query(
    "salary_label",
    """select offer_id, nullif(concat_ws(' · ', nullif(trim(salary_label), ''), nullif(trim(experience_label), ''), nullif(trim(company_name), '')), '') as label
       from {offer_rows}""",
)
def _salary_label(t):
    parts = [F.concat(F.lit(" "), c, F.lit("\t")) for c in ("salary_label", "experience_label", "company_name")]
    return t.offer_rows.select("offer_id", O.salary_label(*parts, F.lit("  ")).alias("label"))


_WS = r"[\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_TAGGED = r"""regexp_replace(regexp_replace(regexp_replace(html || '&amp;lt;&#233;&#xE9;&bogus;&#0;&nbsp;x&AMP;', '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g'),
   '(?i)<(br|/p|/li|/div|/h[1-6])\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
_DECODED = r"""array_to_string(list_transform(string_split(tagged, '&'), lambda part, i: case when i = 1 then part
   when starts_with(part, 'amp;') then '&' || part[5:] when starts_with(part, 'apos;') then '''' || part[6:]
   when starts_with(part, 'gt;') then '>' || part[4:] when starts_with(part, 'lt;') then '<' || part[4:]
   when starts_with(part, 'nbsp;') then ' ' || part[6:] when starts_with(part, 'quot;') then '"' || part[6:]
   when regexp_matches(part, '^#[0-9]{1,6};') and regexp_extract(part, '^#([0-9]+);', 1)::int > 0
     then chr(regexp_extract(part, '^#([0-9]+);', 1)::int) || regexp_replace(part, '^#[0-9]+;', '')
   when starts_with(part, '#xE9;') then 'é' || part[6:] else '&' || part end), '')"""


@query(
    "html_to_text",
    f"""select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_DECODED}, '\\r\\n?', chr(10), 'g'), '[\\t ]+', ' ', 'g'),
          ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g') as plain
        from (select page_id, {_TAGGED} as tagged from {{pages}}) p""",
)
def _html_to_text(t):
    planted = F.concat("html", F.lit("&amp;lt;&#233;&#xE9;&bogus;&#0;&nbsp;x&AMP;"))
    return t.pages.select("page_id", X.html_to_text(planted).alias("plain"))


@query(
    "redact_text",
    r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' see HTTPS://a.b/c?d now', '(?i)https?://[^\s\x{a0}\x{202f}\x{2009}\x{3000}]+', '[URL]', 'g'),
         '(?i)[\w.+-]+@[\w.-]+\.[a-z]{2,}', '[EMAIL]', 'g'), '(?:\+33|0)[\d .()-]{8,}', '[TÉLÉPHONE]', 'g') as redacted from {documents}""",
)
def _redact(t):
    return t.documents.select("doc_id", X.redact_text(F.concat("text", F.lit(" see HTTPS://a.b/c?d now"))).alias("redacted"))


def _perimeter_sql() -> str:
    fold = "' ' || trim(regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}+#.]+', ' ', 'g')) || ' '"
    rows = [
        (g["id"], p.replace("'", "''"), f.replace("'", "''"))
        for g in query_set()["groups"]
        for p in g["title_phrases"]
        for f in g["job_families"]
    ]
    values = ", ".join(f"('{g}', '{p}', '{f}')" for g, p, f in rows)
    return f"""select o.offer_id, string_agg(distinct v.g, ',' order by v.g) as group_ids, string_agg(distinct v.f, ',' order by v.f) as job_families
      from {{offer_rows}} o join (values {values}) v(g, p, f) on contains({fold.format('o.title')}, {fold.format('v.p')}) group by o.offer_id"""


@query("title_perimeter", _perimeter_sql())
def _title_perimeter(t):
    rows = N.title_perimeter(t.offer_rows.select("offer_id", "title"), query_set()["groups"])
    return rows.select("offer_id", F.array_join("group_ids", ",").alias("group_ids"), F.array_join("job_families", ",").alias("job_families"))


@query(
    "expand_query_set",
    """with g as (select c_mktsegment as group_id, unnest(list_concat(list(distinct 'M' || (c_nationkey % 7 + 1)), [null])) as occupation,
           list_concat(list(distinct 'mot ' || lower(c_mktsegment) || ' ' || (c_nationkey % 3)), list_concat(list(distinct 'dév ' || (c_nationkey % 5)), [null])) as keywords
         from {customer} where c_mktsegment <> 'FURNITURE' group by c_mktsegment),
       pairs as (select distinct occupation, keyword, group_id from (select group_id, occupation, unnest(keywords) as keyword from g) x where occupation is not null or keyword is not null)
       select 'rome=' || coalesce(occupation, '-') || '&keyword=' || replace(replace(coalesce(keyword, '-'), ' ', '%20'), 'é', '%C3%A9') as query_key,
         case when occupation is not null and keyword is not null then 'overlap' when occupation is not null then 'occupation-only' else 'keyword-only' end as kind,
         string_agg(group_id, ',' order by group_id) as group_ids from pairs group by occupation, keyword""",
)
def _expand_query_set(t):
    """Groups taken from the customer segments; the segment FURNITURE is a disabled group."""
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    groups = t.customer.groupBy(segment.alias("group_id")).agg(
        F.collect_set(F.concat(F.lit("M"), (nation % 7 + 1).cast("string"))).alias("occupations"),
        F.array_union(
            F.collect_set(F.concat(F.lit("mot "), F.lower(segment), F.lit(" "), (nation % 3).cast("string"))),
            F.collect_set(F.concat(F.lit("dév "), (nation % 5).cast("string"))),
        ).alias("keywords"),
    )
    queries = N.expand_query_set(groups.withColumn("enabled", F.col("group_id") != "FURNITURE"))
    return queries.select("query_key", "kind", F.array_join("group_ids", ",").alias("group_ids"))


@query(
    "load_taxonomies",
    """with rules as (select lower(p_type) as slug, p_name as alias, case when p_size % 3 = 0 then 'word' when p_size % 3 = 1 then 'regex' else 'case_sensitive' end as match_kind,
         max(p_brand) as brand from {part} group by 1, 2, 3)
       select slug, alias, match_kind, max(brand) as exclusions from rules group by 1, 2, 3""",
)
def _load_taxonomies(t):
    """Parts stand for a taxonomy document: the type is the slug, the names are aliases of three kinds."""
    kind = F.col("p_size") % 3
    aliases = lambda k: F.when(kind == k, F.array("p_name"))
    rules = t.part.select(
        F.lower("p_type").alias("slug"), F.col("p_type").alias("label"), aliases(0).alias("aliases"), aliases(1).alias("context_aliases"),
        aliases(2).alias("exact_case_aliases"), F.array("p_brand").alias("exclusions"),
    )
    loaded = Tx.technology_aliases(rules)
    stored = Tx.technology_aliases(rules.filter(F.col("slug") == "economy"))
    merged = Tx.merge_taxonomy(stored, loaded, ["slug", "alias", "match_kind"])
    return merged.select("slug", "alias", "match_kind", F.array_join("negative_patterns", ",").alias("exclusions"))


# The nine content columns of an offer, from those that the offers have.
_CONTENT = """select offer_id, title, description_text, company_name, region_code || '/' || commune_code as location, contract_code as contract,
   experience_code as structured_experience, salary_label as salary, source_url || '#apply' as application_url, source_url from {offer_rows}"""


@query(
    "content_hash",
    "select offer_id, sha256('{' || concat_ws(',', "
    + ", ".join(f"""'"{c}":' || coalesce(to_json({c})::varchar, 'null')""" for c in O.CONTENT_COLUMNS)
    + f") || '}}') as content_hash from ({_CONTENT}) c",
)
def _content_hash(t):
    return t.sql(_CONTENT).select("offer_id", O.content_hash(*O.CONTENT_COLUMNS).alias("content_hash"))


# ------------------------------------------------------------------ text rules


def _offers(t):
    """Documents as offers with the columns the classifier reads."""
    rows = t.offer_rows.withColumn("experience_required", O.structured_experience(F.col("experience_code")))
    return rows.select(
        "doc_id", "offer_id", "snapshot_id", "classification_id", "title", "description_text", "experience_required", "experience_label", "salary_label"
    )


_LOWER = "regexp_replace(lower(translate(description_text, '’‘`', '''''''')), '\\s+', ' ', 'g')"


@query("match_text", f"select offer_id, length({_LOWER}) as size, md5({_LOWER}) as digest from {{offer_rows}}")
def _match_text(t):
    folded = X.plain_form(X.match_form("description_text")["marked"])
    return _offers(t).select("offer_id", F.length(folded).cast("long").alias("size"), F.md5(folded).alias("digest"))


_TRANSPARENT = r"""coalesce(regexp_matches(lower(salary_label), '(^|[^\pL\pN])\d{2,6}([.,]\d{1,2})?([^\pL\pN]|$)')
   and regexp_matches(lower(salary_label), '(^|[^\pL\pN_])(horaire|heure|mensuel|mois|annuel|annuelle|an|année)([^\pL\pN_]|$)|/(h|mois|an)([^\pL\pN_]|$)')
   and regexp_matches(lower(salary_label), '€|(^|[^\pL\pN_])euros?([^\pL\pN_]|$)|(^|[^\pL\pN_])eur([^\pL\pN_]|$)'), false)"""


@query("salary_transparent", f"select offer_id, {_TRANSPARENT} as transparent from {{offer_rows}}")
def _salary_transparent(t):
    label = X.match_form(X.trim_text(F.col("salary_label")))["marked"]
    return _offers(t).select("offer_id", C.salary_transparent(label).alias("transparent"))


def _re2(pattern: str) -> str:
    body = pattern.replace(f"[{X.SPACES}]", r"\s")
    return rf"(?i)(^|[^\pL\pN_])({body})([^\pL\pN_]|$)".replace("'", "''")


def _mode_flags() -> str:
    text = "title || chr(10) || description_text"
    return ", ".join(f"regexp_matches({text}, '{_re2(P.REMOTE[m])}')::int as is_{m}" for m in P.REMOTE)


@query(
    "remote_mode",
    f"""select offer_id, case when is_remote + is_hybrid + is_onsite <> 1 then 'unknown' when is_remote = 1 then 'remote' when is_hybrid = 1 then 'hybrid' else 'onsite' end as mode,
          case when is_remote + is_hybrid + is_onsite > 1 then 'REMOTE_SIGNALS_CONFLICT'
               when is_remote + is_hybrid + is_onsite = 1 and regexp_matches(description_text, '(?i)t[ée]l[ée]travail (possible|autoris[ée])') then 'REMOTE_FREQUENCY_UNKNOWN' end as warning
        from (select offer_id, description_text, {_mode_flags()} from {{offer_rows}}) f""",
)
def _remote_mode(t):
    found = C.remote_evidence(F.col("title"), F.col("description_text"))
    rows = _offers(t).select("offer_id", found.alias("found"))
    return rows.select("offer_id", C.remote_mode(F.col("found")).alias("mode"), C.remote_warning(F.col("found")).alias("warning"))


_IN_TITLE = "case doc_id % 10 when 0 then ['java'] when 1 then ['python'] when 4 then ['react'] when 8 then ['flutter'] else [] end"
_IN_TEXT = """case doc_id % 9 when 0 then ['react-native', 'typescript'] when 1 then ['java', 'spring'] when 2 then ['django', 'python', 'sql']
   when 3 then ['go'] when 4 then ['ci-cd', 'docker', 'kubernetes'] when 5 then ['csharp', 'dotnet'] when 7 then ['javascript', 'nodejs', 'react'] else [] end"""


@query(
    "detect_technologies",
    f"select offer_id, array_to_string(list_sort(list_distinct(list_concat({_IN_TITLE}, {_IN_TEXT}))), ',') as slugs from {{offer_rows}}",
)
def _detect_technologies(t):
    rows = C.matching_forms(_offers(t)).select("offer_id", C.selected_hits(F.col("_hits")).alias("chosen"))
    return rows.select("offer_id", F.array_join(C.technology_slugs(F.col("chosen")), ",").alias("slugs"))


def _found(text: str, pattern: str, end: str = r"([^\pL]|$)") -> str:
    return rf"regexp_matches(lower({text}), '(^|[^\pL\pN_])({pattern}){end}')"


_TITLE_CLAIM = _found("title", "junior|d[ée]butante?|graduate|jeune dipl[ôo]m[ée]e?|premier emploi")
_BODY_CLAIM = _found("translate(description_text, '’', '''')", r"profil junior|d[ée]butante?s? accept[ée]e?s?|jeunes? dipl[ôo]m[ée]es?|aucune exp[ée]rience (n''est )?requise|sans exp[ée]rience requise")
_LABEL_CLAIM = _found("coalesce(experience_label, '')", r"d[ée]butante?s? accept[ée]e?s?")
_DENIED = _found("title", "pas (un |une )?(poste |profil )?junior|profil non junior|junior s''abstenir", r"([^\pL\pN_]|$)")


@query(
    "junior_signals",
    f"select offer_id, {_TITLE_CLAIM} as title_claim, {_BODY_CLAIM} as body_claim, {_LABEL_CLAIM} as label_claim, {_DENIED} as denied from {{offer_rows}}",
)
def _junior_signals(t):
    rows = C.level_matches(C.matching_forms(_offers(t)))
    return rows.select(
        "offer_id", F.col("_junior_title").isNotNull().alias("title_claim"), F.col("_junior_description").isNotNull().alias("body_claim"),
        F.col("_junior_experienceLabel").isNotNull().alias("label_claim"),
        (F.col("_no_title").isNotNull() | F.col("_no_description").isNotNull()).alias("denied"),
    )


@query(
    "senior_conflict",
    f"""select offer_id, regexp_matches(lower(title), '(^|[^\\pL\\pN_])(s[ée]nior|confirm[ée]e?|exp[ée]riment[ée]e?|lead)([^\\pL]|$)')
          and not regexp_matches(lower(title), '(s[ée]nior|lead)\\s*\\(?\\s*ou\\s+(junior|d[ée]butant)') as senior_title from {{offer_rows}}""",
)
def _senior_conflict(t):
    rows = C.senior_wording(C.level_matches(C.matching_forms(_offers(t))))
    return rows.select("offer_id", F.col("_senior").alias("senior_title"))


_NUMBER = "([0-9]{1,2}|" + "|".join(P.NUMBER_WORDS) + ")"
_DURATIONS = rf"(?:^|[^\pL\pN])({_NUMBER}\s*(\+\s*)?(années?|annees?|ans?|mois))(?:[^\pL\pN]|$)"


@query(
    "experience_mentions",
    f"""select offer_id, len(regexp_extract_all(lower(description_text), '{_DURATIONS}', 1)) as mentions,
          array_to_string(regexp_extract_all(lower(description_text), '{_DURATIONS}', 1), '|') as texts from {{offer_rows}}""",
)
def _experience_mentions(t):
    rows = C.matching_forms(_offers(t)).select("offer_id", C.duration_pieces(F.col("_form_description")["marked"]).alias("pieces"))
    singles = F.filter(C.experience_mentions(F.col("pieces")), lambda m: m["rank"] == 1)
    texts = F.coalesce(F.transform(singles, lambda m: m["text"]), F.array().cast("array<string>"))
    return rows.select("offer_id", F.size(texts).cast("long").alias("mentions"), F.array_join(texts, "|").alias("texts"))


# Expected duration evidence of the planted requirement phrases, by remainder of the id.
_VERDICTS = {
    1: "required_experience:EXP_SINGLE_DURATION:24",
    2: "required_experience:EXP_RANGE_YEARS:12",
    3: "required_experience:EXP_SINGLE_DURATION:6",
    4: "desired_experience:EXP_DESIRED_ONLY:60",
    5: "exclusion:EXP_EMPLOYER_HISTORY",
    7: "required_experience:EXP_SINGLE_DURATION:18",
    9: "required_experience:EXP_SINGLE_DURATION:60",
    10: "required_experience:EXP_SINGLE_DURATION:12,required_experience:EXP_SINGLE_DURATION:36",
}
_VERDICT_SQL = "case doc_id % 11 " + " ".join(f"when {k} then '{v}'" for k, v in _VERDICTS.items()) + " else '' end"


@query("mention_context", f"select offer_id, {_VERDICT_SQL} as evidence from {{offer_rows}}")
def _mention_context(t):
    rows = C.duration_evidence(C.matching_forms(_offers(t)), "description")
    shown = F.transform("evidence", lambda e: F.concat_ws(":", e["kind"], e["rule_id"], e["normalized_value"]))
    return rows.select("offer_id", F.array_join(shown, ",").alias("evidence"))


# Every text with durations of each form, and senior roles in the body.
_SPOKEN = """select offer_id, doc_id, title || case when doc_id % 13 = 3 then ', 3 ans d''expérience exigés' else '' end as title,
   description_text || case doc_id % 13 when 5 then ' Qualifications4 ans minimum sur la stack Java.' when 7 then ' Profil confirmé attendu.'
     when 9 then ' Nous recherchons un lead.' when 11 then ' Recrutement en tant que senior.' else '' end as description_text,
   experience_label, experience_code, salary_label from {offer_rows}"""
_SINGLE, _RANGED, _STACKED = "EXP_SINGLE_DURATION", "EXP_RANGE_YEARS", "EXP_PROFILE_STACK"
# (modulus, remainder, field, planted words, place in them, rank, rule, text)
_SPOKEN_MENTIONS = [
    (11, 1, "description", "au moins 2 ans", 9, 1, _SINGLE, "2 ans"),
    (11, 2, "description", "Expérience de 1 à 2 ans", 14, 0, _RANGED, "1 à 2 ans"),
    (11, 2, "description", "Expérience de 1 à 2 ans", 18, 1, _SINGLE, "2 ans"),
    (11, 3, "description", "6 mois d'expérience minimum", 0, 1, _SINGLE, "6 mois"),
    (11, 4, "description", "Idéalement 5 ans", 11, 1, _SINGLE, "5 ans"),
    (11, 5, "description", "créée il y a 30 ans", 13, 1, _SINGLE, "30 ans"),
    (11, 6, "description", "une formation de 3 ans", 17, 1, _SINGLE, "3 ans"),
    (11, 7, "description", "Vous disposez de 18 mois", 17, 1, _SINGLE, "18 mois"),
    (11, 9, "description", "Cinq ans d'expérience", 0, 1, _SINGLE, "cinq ans"),
    (11, 10, "description", "Minimum 1 an d'expérience", 8, 1, _SINGLE, "1 an"),
    (11, 10, "description", "Puis 3 ans d’expérience", 5, 1, _SINGLE, "3 ans"),
    (13, 5, "description", "Qualifications4 ans", 0, 2, _STACKED, "qualifications4 ans minimum sur la stack"),
    (13, 3, "title", ", 3 ans", 2, 1, _SINGLE, "3 ans"),
    (6, 0, "experienceLabel", "2 An", 0, 1, _SINGLE, "2 an"),
    (6, 2, "experienceLabel", "1 An", 0, 1, _SINGLE, "1 an"),
]


def _quoted(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


_SPOKEN_VALUES = ", ".join("(" + ", ".join(map(_quoted, m)) + ")" for m in _SPOKEN_MENTIONS)

# Single durations in the documents themselves: their texts cut at each one.
_OWN_DURATIONS = rf"""select lpad(cast(doc_id as string), 12, '0') as offer_id, string_split(regexp_replace(lower(text),
   '(^|[^\pL\pN])({_NUMBER}\s*(\+\s*)?(années?|annees?|ans?|mois))([^\pL\pN]|$)', '\1' || chr(1) || '\2' || chr(1) || '\6', 'g'), chr(1)) as parts from {{documents}}"""


@query(
    "experience_mentions_all",
    f"""select offer_id, field, rank, strpos(case field when 'title' then title when 'description' then description_text else experience_label end, words) - 1 + place as start,
          rule_id, found as text
        from ({_SPOKEN}) s join (values {_SPOKEN_VALUES}) v(modulus, remainder, field, words, place, rank, rule_id, found) on doc_id % modulus = remainder
        union all select offer_id, 'description', 1, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0)::int, '{_SINGLE}', parts[i]
        from (select *, unnest(range(2, len(parts) + 1, 2)) as i from ({_OWN_DURATIONS}) p) d""",
)
def _experience_mentions_all(t):
    """Mentions of every rank in all texts, with their places in the source."""
    rows = C.matching_forms(t.sql(_SPOKEN))

    def found(field: str):
        form = F.col(f"_form_{field}")
        mentions = F.coalesce(C.experience_mentions(C.duration_pieces(form["marked"])), F.array())
        return F.transform(
            mentions,
            lambda m: F.struct(
                F.lit(field).alias("field"), m["rank"].alias("rank"), X.source_offset(form["shifts"], m["start"]).alias("start"), m["rule_id"].alias("rule_id"), m["text"].alias("text")
            ),
        )

    return rows.select("offer_id", F.explode(F.concat(*[found(f) for f in C.TEXT_FIELDS])).alias("m")).select("offer_id", "m.*")


@query(
    "mention_context_fields",
    f"""select offer_id, concat_ws(',', nullif({_VERDICT_SQL}, ''), case when doc_id % 13 = 5 then 'required_experience:{_STACKED}:48' end) as description,
          case when doc_id % 13 = 3 then 'required_experience:{_SINGLE}:36' else '' end as title,
          case doc_id % 6 when 0 then 'required_experience:{_SINGLE}:24' when 2 then 'desired_experience:EXP_DESIRED_ONLY:12' else '' end as "experienceLabel" from {{offer_rows}}""",
)
def _mention_context_fields(t):
    """As `mention_context`, for every text."""
    rows = C.matching_forms(t.sql(_SPOKEN))
    for field in C.TEXT_FIELDS:
        rows = C.duration_evidence(rows, field).withColumnRenamed("evidence", f"_evidence_{field}")
    shown = lambda e: F.concat_ws(":", e["kind"], e["rule_id"], e["normalized_value"])
    return rows.select("offer_id", *[F.array_join(F.transform(f"_evidence_{f}", shown), ",").alias(f) for f in C.TEXT_FIELDS])


@query(
    "senior_conflict_body",
    f"""select offer_id, regexp_matches(lower(title), '(^|[^\\pL\\pN_])(s[ée]nior|confirm[ée]e?|exp[ée]riment[ée]e?|lead)([^\\pL]|$)')
          and not regexp_matches(lower(title), '(s[ée]nior|lead)\\s*\\(?\\s*ou\\s+(junior|d[ée]butant)') as senior_title,
          case doc_id % 13 when 7 then 'profil confirmé' when 9 then 'nous recherchons un lead' when 11 then 'en tant que senior' end as senior_role from ({_SPOKEN}) s""",
)
def _senior_conflict_body(t):
    """As `senior_conflict`, with the senior role that the description names."""
    rows = C.senior_wording(C.level_matches(C.matching_forms(t.sql(_SPOKEN))))
    return rows.select("offer_id", F.col("_senior").alias("senior_title"), F.col("_senior_role")["hit"].alias("senior_role"))


_MONTHS = """select event_id, cast(event_id % 3 * 12 as int) as a, cast(event_id % 5 * 6 as int) as b, event_id % 4 as n, event_id % 7 = 0 as accepted,
   event_id % 11 = 0 as junior_clash, event_id % 6 = 0 as not_required from {events}"""


def _month_rows(t):
    rows = t.sql(_MONTHS)
    label = F.when(F.col("n") % 2 == 1, F.array("a")).otherwise(F.array().cast("array<int>"))
    text = F.when(F.col("n") >= 2, F.array("b")).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("label", label).withColumn("text", text)


_MIN = "greatest(case when n % 2 = 1 then a end, case when n >= 2 then b end, case when accepted then 0 end)"


@query("resolve_minimum", f"select event_id, {_MIN} as minimum from ({_MONTHS}) m")
def _resolve_minimum(t):
    return _month_rows(t).select("event_id", C.resolved_minimum(F.concat("label", "text"), F.col("accepted")).alias("minimum"))


_CODES = f"""concat_ws(',', case when junior_clash then 'CONFLICTING_JUNIOR_SIGNALS' end, case when accepted and coalesce({_MIN}, 0) > 0 then 'BEGINNER_EXPERIENCE_CONFLICT' end,
   case when not_required and ((n % 2 = 1 and a > 0) or (n >= 2 and b > 0)) then 'STRUCTURED_EXPERIENCE_CONFLICT' end,
   case when n = 3 and a <> b then 'STRUCTURED_DURATION_CONFLICT' end)"""


def _codes():
    minimum = C.resolved_minimum(F.concat("label", "text"), F.col("accepted"))
    codes = C.conflict_codes(
        F.col("junior_clash"), F.lit(False), F.col("accepted"), F.col("not_required"), minimum, F.col("label"), F.col("text")
    )
    return F.array_compact(F.array(*codes))


@query("conflict_warnings", f"select event_id, {_CODES} as codes from ({_MONTHS}) m")
def _conflict_warnings(t):
    return _month_rows(t).select("event_id", F.array_join(_codes(), ",").alias("codes"))


@query(
    "observation_v2",
    f"""select event_id, axis, case when axis = 'resolved' then coalesce((n % 2 = 1 and a >= 24) or (n >= 2 and b >= 24), false) end as contradictory from (
          select *, case when junior_clash or (ambiguous and codes = '') then 'ambiguous' when not claims then 'unknown'
            when n = 3 and a <> b and (a < 24 or b < 24) and (a >= 24 or b >= 24) then 'ambiguous' when n > 0 then 'resolved'
            when codes = '' and accepted then 'resolved' when codes = '' then 'unknown' else 'ambiguous' end as axis
          from (select *, event_id % 2 = 0 as claims, event_id % 13 = 0 as ambiguous, {_CODES} as codes from ({_MONTHS}) m) c) x""",
)
def _observation(t):
    rows = _month_rows(t).withColumn("codes", _codes()).withColumn("claims", F.col("event_id") % 2 == 0)
    status = F.when((F.col("event_id") % 13 == 0) | (F.size("codes") > 0), "ambiguous").otherwise("classified")
    rules = F.when(F.col("accepted"), F.array(F.lit("BEGINNER_ACCEPTED_BODY"))).otherwise(F.array(F.lit("JUNIOR_EXPLICIT_TITLE")))
    axis, contradictory = C.observation(F.col("claims"), status, rules, F.concat("label", "text"), F.col("codes"))
    return rows.select("event_id", axis.alias("axis"), contradictory.alias("contradictory"))


# The expected classification of the planted phrases, from the remainders alone.
_EXPECTED = """
  select *, not denied and (title_level or body_beginner or label_beginner) or not_required as junior,
    greatest(text_months, label_months, case when accepted then 0 end) as minimum
  from (select *, not_required or (not denied and (body_beginner or label_beginner)) as accepted from (
    select offer_id, classification_id, doc_id, doc_id % 7 = 5 as denied, doc_id % 7 in (1, 2, 4) as title_level, doc_id % 11 = 8 as body_beginner,
      doc_id % 6 = 1 as label_beginner, doc_id % 7 in (3, 6) as senior, coalesce(experience_code in ('D', 'S'), false) as not_required,
      cast(case doc_id % 11 when 1 then 24 when 2 then 12 when 3 then 6 when 7 then 18 when 9 then 60 when 10 then 36 end as int) as text_months,
      cast(case when doc_id % 6 = 0 then 24 end as int) as label_months, doc_id % 11 = 10 as two_durations
    from {offer_rows}) p) q"""
_BLOCKED = """(junior and (senior or denied)) or (accepted and coalesce(minimum, 0) > 0) or (not_required and coalesce(greatest(text_months, label_months), 0) > 0)
   or (label_months is not null and text_months is not null and text_months <> label_months)"""
_ANSWERS = f"""select *, case when status = 'classified' then case when accepted then true else minimum <= 12 end end as beginner_friendly,
   case when status = 'classified' and claims_junior then minimum >= 24 when status = 'classified' and not claims_junior then false end as contradictory_junior
   from (select *, case when {_BLOCKED} then 'ambiguous' when claims_junior is not null or minimum is not null then 'classified' else 'unclassified' end as status
     from (select *, case when senior and not junior then false when junior then true when denied then false end as claims_junior from ({_EXPECTED}) e) c) s"""


def classified(t):
    return C.with_observation(C.classify(_offers(t)))


@query(
    "classify_offers",
    f"select offer_id, status, claims_junior, minimum as minimum_experience_months, beginner_friendly, contradictory_junior from ({_ANSWERS}) a",
)
def _classify(t):
    rows = C.classify(_offers(t))
    return rows.select("offer_id", "status", "claims_junior", "minimum_experience_months", "beginner_friendly", "contradictory_junior")


@query("evidence_table")
def _evidence_table(t):
    return C.evidence_table(classified(t))


@query(
    "technology_mentions",
    f"""select classification_id, unnest(list_sort(list_distinct(list_concat({_IN_TITLE}, {_IN_TEXT})))) as slug from {{offer_rows}}""",
)
def _technology_mentions(t):
    return C.technology_mentions(C.evidence_table(classified(t))).select("classification_id", "slug")


@query(
    "evidence_summary",
    f"""select classification_id, title_n + body_n + label_n + structured_n as junior_claim, required as required_experience,
          body_n + label_n + structured_n as beginner_acceptance from (
        select *, (not denied and title_level)::int as title_n, (not denied and body_beginner)::int as body_n, (not denied and label_beginner)::int as label_n,
          not_required::int as structured_n, (text_months is not null)::int + (label_months is not null)::int + two_durations::int as required from ({_EXPECTED}) e) c
        where title_n + body_n + label_n + structured_n + required > 0""",
)
def _evidence_summary(t):
    summary = C.evidence_summary(C.evidence_table(classified(t)))
    to_int = [F.col(c).cast("int").alias(c) for c in ("junior_claim", "required_experience", "beginner_acceptance")]
    return summary.filter((F.col("junior_claim") > 0) | (F.col("required_experience") > 0)).select("classification_id", *to_int)


# Further evidence of the planted phrases by kind, from the remainders alone: salary, remote modes (of `remote_mode`), technologies, senior titles,
# desired and excluded durations.
_OTHER_EVIDENCE = f"""(doc_id % 6 in (0, 1))::int + (is_remote + is_hybrid + is_onsite) + len(list_distinct(list_concat({_IN_TITLE}, {_IN_TEXT})))
   + denied::int + senior::int + (doc_id % 11 in (4, 5))::int + (doc_id % 6 = 2)::int"""


@query(
    "evidence_summary_all",
    f"""select * from (
          select classification_id, title_n + body_n + label_n + structured_n + required + {_OTHER_EVIDENCE} as total, title_n + body_n + label_n + structured_n as junior_claim,
            required as required_experience, body_n + label_n + structured_n as beginner_acceptance,
            list_sort(list_distinct(list_filter([text_months, case when two_durations then 12 end, label_months], lambda m: m is not null))) as required_months
          from (select *, (not denied and title_level)::int as title_n, (not denied and body_beginner)::int as body_n, (not denied and label_beginner)::int as label_n,
              not_required::int as structured_n, (text_months is not null)::int + (label_months is not null)::int + two_durations::int as required from ({_EXPECTED}) e) c
          join (select offer_id, {_mode_flags()} from {{offer_rows}}) f using (offer_id)) s
        where total > 0""",
)
def _evidence_summary_all(t):
    return C.evidence_summary(C.evidence_table(classified(t)))


@query("semantic_violations", "select classification_id, '' as code from {offer_rows} where false")
def _semantic_violations(t):
    answers = ("status", "claims_junior", "minimum_experience_months", "beginner_friendly", "contradictory_junior")
    # without its texts, and written: both sides of the join need it, and classifying is nearly all of the work
    rows = T.written(classified(t).select("classification_id", *answers, "evidence"), "classified")
    return C.semantic_violations(rows, C.evidence_summary(C.evidence_table(rows)))


@query(
    "reclassify_backfill",
    f"""select 'classifier-1.3.7' as classifier_version, count(*) as snapshots, count(*) filter (where doc_id % 3 <> 0) as created,
          count(*) filter (where doc_id % 3 <> 0 and claims_junior) as junior_created from ({_ANSWERS}) a""",
)
def _reclassify(t):
    """A third of the snapshots has this version already; only the rest is classified, then coverage is complete."""
    offers = _offers(t)
    done = offers.filter(F.col("doc_id") % 3 == 0).select("snapshot_id", F.lit(C.CLASSIFIER_VERSION).alias("classifier_version"))
    fresh = C.reclassify_backfill(offers, done).select("snapshot_id", "classifier_version", "claims_junior", F.lit(True).alias("fresh"))
    every = fresh.unionByName(done, allowMissingColumns=True)
    return every.groupBy("classifier_version").agg(
        F.count(F.lit(1)).alias("snapshots"), F.count_if("fresh").alias("created"), F.count_if("claims_junior").alias("junior_created")
    )


@query(
    "reclassify_resumed",
    f"""select count(*) as snapshots, count(*) as classified, 0 as missing, 0 as repeated, count(*) filter (doc_id % 3 <> 0) as created,
          count(*) filter (doc_id % 3 <> 0 and {_TRANSPARENT}) as with_salary from {{offer_rows}}""",
)
def _reclassify_resumed(t):
    """The walk is ended after three of eight ranges and taken up again; a third of the snapshots is not new."""
    offers, path = _offers(t), T.scratch_path(t.spark, "walk")
    stored = offers.filter(F.col("doc_id") % 3 == 0).select("snapshot_id", F.lit(C.CLASSIFIER_VERSION).alias("classifier_version"))
    B.backfill(offers, stored, path, ranges=8, at_once=3, most=3)
    B.backfill(offers, stored, path, ranges=8, at_once=5)
    results = B.backfilled(t.spark, path)
    counts = results.agg(F.count(F.lit(1)).alias("created"), F.count_if("salary_transparent").alias("with_salary"))
    row = B.coverage(offers, stored, results)
    return row.withColumns({c: counts.select(c).scalar() for c in counts.columns})


@query("immutable_result_check", "select snapshot_id from {offer_rows} where doc_id % 97 = 5")
def _immutable(t):
    """Classifying again gives the same hash, but for the stored rows that were changed on purpose."""
    again = classified(t).select("doc_id", "snapshot_id", F.lit(C.CLASSIFIER_VERSION).alias("classifier_version"), C.result_hash().alias("result_hash"))
    changed = F.when(F.col("doc_id") % 97 == 5, F.lit("changed")).otherwise(F.col("result_hash"))
    return C.changed_results(again.withColumn("result_hash", changed), again).select("snapshot_id")


@query("result_hash")
def _result_hash(t):
    return classified(t).select("classification_id", C.result_hash().alias("result_hash"))
