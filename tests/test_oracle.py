"""A spread of registered queries against the oracle on the smallest data; `tests/oracle_check.py` runs all."""

import oracle_check
import pytest

from offerlens.plans import registry

SF_DIR = "/root/testdata/sf0.001"
NAMES = (
    "overview", "explorer_page", "keyset_after", "trends", "trend_segments", "taxonomy_counts", "metrics_by_dimension", "all_technologies",
    "snapshot_intervals", "snapshot_scd2", "offer_upsert", "apply_absences", "query_completeness", "run_quality_facts", "quality_decision",
    "freeze_membership", "publish_and_rollback", "operational_changes", "reconcile_incidents", "html_to_text", "validate_contract",
    "stream_offer_pages", "stream_sightings_state", "classify_offers", "observation_v2", "stratified_hash_split", "pairwise_overlap",
    "version_delta", "excerpt_containment",
)


@pytest.fixture(scope="module")
def oracle():
    return oracle_check.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, oracle, name):
    status, _, _, note = oracle_check.compare(spark, oracle, SF_DIR, name)
    assert status == "ok", note


def test_every_statement_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
