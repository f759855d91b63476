"""Queries over whole texts and whole results, on literal documents and against the oracle."""

import oracle_check
import pytest

from offerlens.plans import registry, texts
from offerlens.sources.tables import written

SF_DIR = "/root/testdata/sf0.001"


def run(spark, folder, name, texts):
    rows = [(i, text, "fr", "web", len(text)) for i, text in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return registry.queries()[name](spark, str(folder)).collect()


@pytest.mark.parametrize("name", ["holdout_exclusion_texts", "exact_overlap_count_texts"])
def test_pool_matches_oracle(spark, name):
    status, _, _, note = oracle_check.compare(spark, oracle_check.connect(SF_DIR), SF_DIR, name)
    assert status == "ok", note


def test_holdout_reads_the_texts(spark, tmp_path):
    """1 and 71 share title, language and source only; 5 has an excluded copy, known by its redacted text."""
    rows = run(spark, tmp_path, "holdout_exclusion_texts", [(1, "one text"), (71, "another"), (5, "write to a.b@example.org")])
    assert sorted(r.offer_id for r in rows) == ["000000000001", "000000000071"]


def test_overlap_reads_the_texts(spark, tmp_path):
    """3 and 73 share all but the text; the copy of 5 stands in the other cohort."""
    rows = run(spark, tmp_path, "exact_overlap_count_texts", [(3, "one text"), (73, "another"), (5, "third")])
    assert rows[0].overlaps == 1


def test_summary_shows_all_evidence(spark):
    status, _, _, note = oracle_check.compare(spark, oracle_check.connect(SF_DIR), SF_DIR, "evidence_summary_all")
    assert status == "ok", note
    rows = registry.queries()["evidence_summary_all"](spark, SF_DIR).collect()
    assert any(r.junior_claim == r.required_experience == 0 < r.total for r in rows) and [12, 36] in [r.required_months for r in rows]


@pytest.mark.parametrize("name", ["experience_mentions_all", "mention_context_fields", "senior_conflict_body"])
def test_all_forms_match_oracle(spark, name):
    status, _, _, note = oracle_check.compare(spark, oracle_check.connect(SF_DIR), SF_DIR, name)
    assert status == "ok", note


def test_mentions_keep_ranks_and_places(spark, tmp_path):
    rows = run(spark, tmp_path, "experience_mentions_all", [(2, "abc"), (5, "un an ici")])
    found = {(r.offer_id[-1], r.field, r["rank"], r.start, r.rule_id, r.text) for r in rows}
    assert ("2", "description", 0, 18, "EXP_RANGE_YEARS", "1 à 2 ans") in found and ("2", "experienceLabel", 1, 24, "EXP_SINGLE_DURATION", "1 an") in found
    assert ("5", "description", 1, 0, "EXP_SINGLE_DURATION", "un an") in found and any(f[2] == 2 and f[4] == "EXP_PROFILE_STACK" for f in found)


def test_semantic_violations_classifies_once(spark, monkeypatch):
    """The texts are read by one classification, whatever reads its results."""
    calls = []
    monkeypatch.setattr(texts.T, "written", lambda rows, name: calls.append(name) or written(rows, name))
    rows = registry.queries()["semantic_violations"](spark, SF_DIR)
    assert calls == ["classified"] and "text_forms" not in rows._jdf.queryExecution().toString() and rows.count() == 0
