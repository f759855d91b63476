"""The registered queries of this package over the supplied tables, and their statements where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm import (
    conversation_repair,
    decontaminate,
    hard_negatives,
    log_bilinear,
    main_text,
    near_dedup,
    pu_quality,
    quality_rules,
    segmentations,
    sharding,
    token_counts,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segmentations.segmentations(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "sample", "n_pieces", F.xxhash64("ids").alias("ids_digest"), "log_prob", "inclusion", "round_trip")


_NEAR_DUPLICATES = """
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words
), sizes as materialized (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as materialized (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)
), reach as (
  with recursive r(doc_id, other) as (
    select doc_id, doc_id from documents union
    select r.doc_id, case when l.a = r.other then l.b else l.a end from r join links l on r.other in (l.a, l.b)
  ) select doc_id, min(other) as component_id from r group by doc_id
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join reach using (doc_id) left join sizes using (doc_id)
"""


@query("op7_minhash_near_dedup", _NEAR_DUPLICATES)
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


_DECONTAMINATION = """
with texts as (
  select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark
), words as materialized (
  select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from texts
), item_windows as (
  select distinct id as item_id, unnest(case when len(w) >= 10 then list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))
    else [array_to_string(w, ' ')] end) as words, least(len(w), 10) as n
  from words where kind = 'i' and len(w) > 0
), starts as (
  select id as doc_id, n, unnest(range(1, len(w) - n + 2)) as pos, w from words, (select distinct n from item_windows) where kind = 'd'
), hits as materialized (
  select doc_id, item_id, pos, s.n from (select doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') as words from starts) s join item_windows i using (words)
), covered as (
  select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as place from hits) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as listed
  from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id
)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered c on c.doc_id = id left join items i on i.doc_id = id where kind = 'd'
"""


@query("op3_benchmark_decontamination", _DECONTAMINATION)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_WARC = """
with payloads as (select page_id, coalesce(html, '') as p from pages),
sized as (select page_id, strlen(p) as n, sha1(p) as digest from payloads),
targets as (select *, case when n >= 1000 then max(page_id) over (partition by digest) else page_id end as target from sized)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id = target then 'response' else 'revisit' end as record_type,
  case when page_id <> target then target end as refers_to
from targets
"""


@query("op5_warc", _WARC)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    read = warc.read_archives(files, payloads=False)
    return read.select(
        warc.page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id(F.col("refers_to")).alias("refers_to")
    )


# the supplied pages hold one article each, with h1 and p as its only blocks
_MAIN_TEXT = """
with parts as (
  select page_id, url, list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h1)>'),
    lambda b: trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'),
      '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) as blocks
  from pages
), texts as (select page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10) || chr(10)) as text from parts)
select page_id, url, coalesce(text, '') as text, coalesce(length(text), 0)::bigint as n_chars from texts
"""


@query("op9_html_extraction", _MAIN_TEXT)
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


# the checksum runs over the bytes of a text from the left, eight shifts a byte, with the polynomial of CRC-32
_SHARDING = """
with recursive steps(byte, round, c) as (
  select range, 0, range from range(256) union all
  select byte, round + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where round < 8
), crc_table as materialized (select list(c order by byte) as t from steps where round = 8),
rows as (
  select doc_id, coalesce(source, '') as source, source is null as no_source, coalesce(text, '') as text,
    md5('20:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key
  from documents
), checked as (
  select r.*, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) as text_crc32
  from rows r, crc_table
), fractions as (
  select *, (2 * row_number() over (partition by source, no_source order by key, doc_id) - 1)
    / (2 * count(*) over (partition by source, no_source))::double as fraction
  from checked
), places as (
  select *, row_number() over (order by fraction, source, no_source, key, doc_id) - 1 as place, count(*) over () as total from fractions
), cut as (select *, (place * 16) // total as shard from places)
select doc_id, (strlen(text) + 1)::bigint as size, text_crc32::bigint as text_crc32, case when not no_source then source end as source, 'rows' as law,
  shard::int as shard, (row_number() over (partition by shard order by place) - 1)::bigint as slot, null::int as grown_shard
from cut
"""


@query("op8_sharding", _SHARDING)
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


# a row is told from its repeats by its number; ties between these show the same values
_HARD_NEGATIVES = """
with rows as materialized (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as materialized (
  select a.r as anchor_row, a.vec_id as anchor_id, a.label as own, b.r, b.vec_id, b.label,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::bigint as score
  from rows a join rows b on a.vec_id % 50 = 0 and a.r <> b.r
), positives as (
  select anchor_row, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_row order by score desc, vec_id nulls last, r) as place
  from scores where own = label qualify place <= 5
)
select anchor_id, positive_id, (row_number() over (partition by anchor_row, place order by score desc, vec_id nulls last, r))::int as rank,
  vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_row)
where own <> label and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""


@query("op11_hard_negatives", _HARD_NEGATIVES)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


@query("op12_lm_scores")
def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.log_probabilities(_table(spark, sf_dir, "documents"))


# one step of the recursion a row; before it at most two turns are inserted ("filled")
_REPAIR = """
with recursive steps(byte, round, c) as (
  select range, 0, range from range(256) union all
  select byte, round + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where round < 8
), crc_table as materialized (select list(c order by byte) as t from steps where round = 8),
plain as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))), '..'), lambda h: ('0x' || h)::bigint),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 20 as kind
  from conversations, crc_table
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from plain where kind <> 0
), keyed as (select *, unhex(sha256(length(role)::varchar || ':' || role || text)) as digest from damaged),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, digest, copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again from keyed
), judged as materialized (
  select conv_id, i, turn, role, text, left(role, 1) as initial,
    case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 1 when again then 2
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 3 else 0 end as fault,
    coalesce(left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) not in ('su', 'ua', 'au'), false) as illegal
  from ordered
), filled(from_state, to_state, inserts) as (
  values (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')
), kept(from_state, initial, to_state) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves as (
  select from_state, to_state, initial, 'K' as edit, 0 as cost from kept
  union all select from_state, to_state, i, 'R', 2 from kept, (values ('s'), ('u'), ('a'), ('')) other(i) where initial <> 's'
  union all select s, s, i, 'D', 3 from range(4) states(s), (values ('s'), ('u'), ('a'), ('')) other(i)
), best(conv_id, i, state, found) as (
  select distinct conv_id, 0::bigint, 0, '000000' from judged
  union all
  select b.conv_id, b.i + 1, m.to_state, min(lpad((left(found, 6)::int + 2 * length(inserts) + m.cost + case when fault = 3 and edit <> 'D' then 1 else 0 end)::varchar, 6, '0')
    || substr(found, 7) || inserts || edit)
  from best b join judged j on j.conv_id is not distinct from b.conv_id and j.i = b.i + 1 join filled f on f.from_state = b.state
    join moves m on m.from_state = f.to_state and m.initial = case when j.initial in ('s', 'u', 'a') then j.initial else '' end
  where fault in (0, 3) or edit = 'D'
  group by 1, 2, 3
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n, count(*) filter (fault = 1) as blank,
    count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated, count(*) filter (illegal) as illegal from judged group by conv_id
), ended as materialized (
  select b.conv_id, min(lpad((left(found, 6)::int + 2 * length(inserts))::varchar, 6, '0') || substr(found, 7) || inserts) as found
  from best b join counts c on c.conv_id is not distinct from b.conv_id and c.n = b.i join filled f on f.from_state = b.state where to_state in (0, 3) group by 1
), edits as (
  select conv_id, p, substr(found, 6 + p, 1) as edit, length(replace(substr(found, 7, p), 'I', '')) as i, length(replace(substr(found, 7, p), 'D', '')) as k
  from (select conv_id, found, unnest(range(1, length(found) - 5)) as p from ended)
), done as (
  select e.conv_id, p, k, edit, role, case when edit = 'I' then '' else text end as text, max(case when edit = 'K' and k = 1 and initial = 's' then 1 else 0 end) over (partition by e.conv_id) as s
  from edits e left join judged j on j.conv_id is not distinct from e.conv_id and j.i = e.i where edit <> 'D'
), hashed as (
  select conv_id, sha256(string_agg(case when edit = 'K' then role when (k - s) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by p)) as h
  from done group by conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(left(found, 6)::bigint, 0) as cost, coalesce(substr(found, 7), '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id
  left join ended e on e.conv_id is not distinct from o.conv_id left join hashed x on x.conv_id is not distinct from o.conv_id
"""


@query("op13_conversation_repair", _REPAIR)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repairs(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
