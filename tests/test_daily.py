"""The daily job: a run that dies keeps the dataset before it current, goes on where it stopped, and ends the same."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from offerlens.operators import daily as Da
from offerlens.operators import quality
from offerlens.plans import daily as plans
from offerlens.plans import registry
from offerlens.sources.tables import scratch_path

DAYS = [dt.datetime(2024, 1, d, 5) for d in (10, 11)]


def _landing(spark, path, offers):
    items = [{"id": i, "intitule": f"Développeur {i}", "description": text, "experienceExige": "D", "experienceLibelle": "Débutant accepté", "typeContrat": "CDI"} for i, text in offers]
    payloads = [("q", 0, json.dumps({"resultats": items[:3]})), ("q", 3, json.dumps({"resultats": items[3:]}))]
    spark.createDataFrame(payloads, "query_key string, range_start long, payload string").write.json(path)
    return path


def _queries(spark):
    return spark.createDataFrame([("q", "queries-3", True, None, ["software"])], "query_id string, query_set_version string, enabled boolean, valid_to timestamp, job_families array<string>")


def _state(store):
    last = store.runs()[-1]
    runs = store.read("runs", *store.runs()).orderBy("run_id").select("run_id", "previous_run_id", "members", "offers_new", "offers_updated", "offers_marked_missing", "is_published", "dataset_version").collect()
    members = store.read("members", last).orderBy("offer_id").collect()
    offers = store.read("offers", last).orderBy("offer_id").select("offer_id", "missing_since", "closed_at", "reopened_count").collect()
    return [list(map(tuple, x)) for x in (runs, members, offers)]


def test_a_run_that_dies_goes_on(spark, monkeypatch):
    first = [(f"o{i}", "Python et SQL. Poste en full remote.") for i in range(6)]
    second = [(i, text + " Expérience de 3 ans exigée." * (i == "o2")) for i, text in first if i != "o4"] + [("o9", "Java")]
    store = Da.Store(spark, scratch_path(spark, "observatory"))
    groups = [{"id": "dev", "title_phrases": ["développeur"], "job_families": ["software"]}]
    runs = [Da.Run(f"R{i}", day, "queries-3", _landing(spark, f"{store.path}/landing{i}", rows)) for i, (day, rows) in enumerate(zip(DAYS, (first, second)))]
    assert Da.current_run(store) is None
    Da.collect_daily(store, runs[0], _queries(spark), groups)
    assert Da.current_run(store) == "R0"

    plain, dies = Da.Store.write, ["pages", "snapshots_closed", "evidence", "decisions", "metrics", "runs"]

    def write(self, table, run, rows):
        if dies and table == dies[0]:
            dies.pop(0)
            raise RuntimeError(f"lost at {table}")
        plain(self, table, run, rows)

    monkeypatch.setattr(Da.Store, "write", write)
    while dies:
        with pytest.raises(RuntimeError, match="lost at"):
            Da.collect_daily(store, runs[1], _queries(spark), groups)
        assert Da.current_run(store) == "R0" and store.runs() == ["R0"]
    Da.collect_daily(store, runs[1], _queries(spark), groups)
    done, members, offers = _state(store)
    assert Da.current_run(store) == "R1"
    assert [r[:7] for r in done] == [("R0", None, 6, 6, 0, 0, True), ("R1", "R0", 7, 1, 1, 1, True)]
    assert [m[1] for m in members] == ["o0", "o1", "o2", "o3", "o4", "o5", "o9"] and [o[0] for o in offers if o[1]] == ["o4"]
    before = _state(store)
    Da.collect_daily(store, runs[1], _queries(spark), groups)  # a finished run is left as it is
    assert _state(store) == before
    rows = Da.dataset_rows(store, "R1")
    assert rows.filter(F.col("offer_id") == "o2").select("minimum_experience_months").first()[0] == 36 and rows.count() == 7


def test_run_names_are_folder_names(spark):
    with pytest.raises(ValueError, match="folder name"):
        Da.collect_daily(Da.Store(spark, "/nowhere"), Da.Run("../x", DAYS[0], "q", "/nowhere"), None, [])


def test_more_documents_than_the_source_lists_of_three_queries(spark, tmp_path, monkeypatch):
    """With a limit of 60 items a query and 300 documents, the first day is still published."""
    monkeypatch.setattr(quality, "SOURCE_CAP", 60)
    monkeypatch.setattr(plans, "QUERY_PAGES", 3, raising=False)
    rows = [(i, "Python et SQL.", "fr", "web", 14) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.answer, r.key): r["count"] for r in registry.queries()["daily_read_models"](spark, str(tmp_path)).collect()}
    members = sum(1 for i in range(300) if i % 10 in (0, 1, 3, 4, 5, 8) and i % 97 != 3)
    assert found["sample", "size"] == found["trend", "2024-01-10"] == members
