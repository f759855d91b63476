"""The resumable reclassification: aborted anywhere, it goes on, and classifies every snapshot once."""

import pytest

from offerlens.operators import backfill as B
from offerlens.operators import classify as C
from offerlens.sources.tables import scratch_path

SCHEMA = "snapshot_id string, title string, description_text string, experience_required boolean, experience_label string, salary_label string"


def test_aborted_walk_goes_on(spark, monkeypatch):
    snapshots = spark.createDataFrame([(f"s{i}", "Développeur junior", "Java", None, None, None) for i in range(40)], SCHEMA)
    stored = spark.createDataFrame([(f"s{i}", C.CLASSIFIER_VERSION if i % 2 else "older") for i in range(20)], "snapshot_id string, classifier_version string")
    path, judged, plain = scratch_path(spark, "walk"), [], C.reclassify_backfill

    def lost(rows, *given):
        judged.append(sorted(r.snapshot_id for r in C.missing_classifications(rows, *given).select("snapshot_id").collect()))
        if len(judged) == 2:
            raise RuntimeError("lost")
        return plain(rows, *given)

    monkeypatch.setattr(C, "reclassify_backfill", lost)
    with pytest.raises(RuntimeError, match="lost"):
        B.backfill(snapshots, stored, path, ranges=6, at_once=2)
    assert B.done_ranges(spark, path) == [0, 1] and B.coverage(snapshots, stored, B.backfilled(spark, path)).first().missing > 0
    assert B.backfill(snapshots, stored, path, ranges=6, at_once=4) == [2, 3, 4, 5]
    assert B.backfill(snapshots, stored, path, ranges=6) == []
    assert tuple(B.coverage(snapshots, stored, B.backfilled(spark, path)).first()) == (40, 40, 0, 0)
    assert sorted(judged[0] + judged[2]) == sorted(r.snapshot_id for r in B.backfilled(spark, path).collect()) and len(judged[0] + judged[2]) == 30
