"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from offerlens.llm import decontaminate, main_text, near_dedup, pu_quality, quality_rules, segmentations, sharding, token_counts, toxicity, warc

LONG = " ".join(f"word{i}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog near the river bank while seven small birds sing in an old tree"
SCHEMA = "doc_id long, text string, source string, n long, part long, token long, words string, score double"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (None, PROSE), (None, None), (7, "two words")]
    return spark.createDataFrame([(i, t, None if i == 3 else "web", 1, 2, 3, "x", 0.5) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 1), (7, 0, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


def by_id(rows):
    found = {}
    for row in rows.collect():
        found.setdefault(row.doc_id, []).append(row)
    return found


def test_quality_rules(documents, nothing):
    rows = by_id(quality_rules.quality(documents))
    assert sum(map(len, rows.values())) == 10
    for i in (3, 4, 5):
        assert (rows[i][0].n_words, rows[i][0].base_failed, rows[i][0].kept, rows[i][0].ratio) == (0, True, False, None if i != 5 else rows[i][0].ratio)
    assert rows[1][0].kept and rows[2] == [rows[2][0]] * 2 and rows[6][0].n_words == 60_000
    assert quality_rules.quality(nothing).count() == 0
    assert quality_rules.passing(documents).columns == documents.columns
    assert quality_rules.passing(nothing).count() == 0


def test_token_counts(documents, nothing):
    rows = by_id(token_counts.token_counts(documents))
    assert (rows[3][0].n_bytes, rows[3][0].n_tokens) == (0, 0) == (rows[4][0].n_bytes, rows[4][0].n_tokens)
    assert rows[5][0].n_tokens == 0 and rows[5][0].n_bytes == 4 and rows[6][0].over_limit and len(rows[None]) == 2
    assert token_counts.token_counts(nothing).count() == 0


def test_contamination(spark, documents, nothing):
    items = spark.createDataFrame([(10, "Brown fox; jumps over the lazy dog near the river bank"), (9, "two words"), (9, "two words"), (8, None), (7, ""), (None, "seven small birds")], "item_id long, text string")
    rows = by_id(decontaminate.contamination(documents, items))
    assert [r["items"] for r in rows[2]] == [["10"]] * 2 and rows[1][0].n_hit == 14 and rows[7][0]["items"] == ["9"]
    for i in (3, 4, 5):
        assert (rows[i][0].n_words, rows[i][0].n_hit, rows[i][0].contaminated) == (0, 0, False)
    assert rows[6][0].n_words == 60_000 and not rows[6][0].contaminated
    assert {r.n_hit for r in decontaminate.contamination(documents, items.limit(0)).collect()} == {0}
    assert decontaminate.contamination(nothing, items).count() == 0
    kept = decontaminate.without_contaminated(documents, items)
    assert kept.columns == documents.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6]


@pytest.mark.parametrize("benchmark", [[], [(8, None), (7, ""), (6, " -- ")]])
def test_words_are_counted_without_windows(spark, documents, benchmark):
    rows = by_id(decontaminate.contamination(documents, spark.createDataFrame(benchmark, "item_id long, text string")))
    assert [rows[i][0].n_words for i in (3, 4, 5, 6, 7)] == [0, 0, 0, 60_000, 2] and [r.n_words for r in rows[2]] == [len(PROSE.split())] * 2
    assert not any(r.n_hit or r.n_items or r.contaminated for own in rows.values() for r in own)


def test_toxicity_and_quality_scores(documents, nothing, labels):
    for run in (toxicity.toxicity, pu_quality.quality_scores):
        rows = by_id(run(documents, labels))
        assert sum(map(len, rows.values())) == 10
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for own in rows.values() for r in own)
        assert rows[3][0].score == rows[4][0].score and rows[2][0].score == rows[2][1].score
        assert run(nothing, labels).count() == 0
        assert len({r.score for r in run(documents, labels.limit(0)).collect()}) == 1
    assert toxicity.without_toxic(documents, labels).columns == documents.columns


def test_near_duplicates(documents, nothing):
    rows = by_id(near_dedup.near_duplicates(documents))
    assert [r.component_id for r in rows[2]] == [1, 1] and rows[1][0].kept and not rows[2][0].kept
    for i in (3, 4, 5):
        assert (rows[i][0].n_shingles, rows[i][0].component_id, rows[i][0].kept) == (0, i, True)
    assert rows[7][0].n_shingles == 1 and rows[6][0].n_shingles == 59_996
    assert all(r.component_id is None and r.kept for r in rows[None])
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.without_near_duplicates(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7]


def test_sharding(documents, nothing):
    rows = sharding.shards(documents, n_shards=3).collect()
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (3, 4)
    found = {r.doc_id: r for r in rows}
    assert (found[3].size, found[3].text_crc32, found[3].source) == (1, 0, None) and all(r.law == "rows" and r.grown_shard is None for r in rows)
    assert sharding.shards(nothing).count() == 0


def test_segmentations(documents, nothing):
    rows = by_id(segmentations.segmentations(documents))
    for i in (3, 4):
        assert [(r.ids, r.inclusion, r.round_trip) for r in rows[i]] == [([], 1.0, True)]
    assert len(rows[6]) == 2 and all(r.round_trip for own in rows.values() for r in own)
    assert [r.ids for r in rows[2][:2]] == [r.ids for r in rows[2][2:]] or sorted(map(tuple, (r.ids for r in rows[2])))[::2] == sorted({tuple(r.ids) for r in rows[2]})
    assert segmentations.segmentations(nothing).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + PROSE * 12 + "</p>"
    rows = [(1, "u", body), (5, "u\r\nX: y", body), (5, None, body), (3, "u", body), (4, "u", None), (6, "u", ""), (None, "u", body), (8, "u", PROSE), (9, "u", PROSE)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, target long")


def test_warc(spark, pages):
    files = warc.write_archives(pages, warc.archive_folder(spark))
    rows = warc.read_archives(files).collect()
    got = sorted((r.record_id if r.record_id.startswith("urn:page") else "", r.record_type, r.refers_to or "", r.payload_bytes) for r in rows)
    size = len(PROSE) * 12 + 7
    five = "urn:page:5"
    assert got == sorted(
        [("", "response", "", size), ("urn:page:1", "revisit", five, size), ("urn:page:3", "revisit", five, size), ("urn:page:4", "response", "", 0), (five, "response", "", size), (five, "response", "", size)]
        + [("urn:page:6", "response", "", 0), ("urn:page:8", "response", "", len(PROSE)), ("urn:page:9", "response", "", len(PROSE))]
    )
    assert {r.target_uri for r in rows} == {"u", "u%0D%0AX: y", None}
    empty = warc.write_archives(pages.limit(0), warc.archive_folder(spark))
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


def test_main_text(pages):
    rows = main_text.extract(pages).collect()
    assert len(rows) == 9 and {r.n_chars for r in rows if r.page_id in (4, 6)} == {0}
    assert main_text.extract(pages.limit(0)).count() == 0
    assert main_text.extract(pages.withColumn("text", F.lit("clash")).withColumn("e", F.lit(1))).columns == ["page_id", "url", "text", "n_chars"]
