"""The daily job parses a page once and normalizes a text once; markup steps that are left out change nothing."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from offerlens.functions import text as X
from offerlens.operators import daily as Da
from offerlens.sources.tables import scratch_path


def _item(i, **more):
    return {"id": f"o{i}", "intitule": f"Développeur {i}", "description": f"Texte {i}", **more}


def test_pages_are_parsed_once_and_texts_normalized_once(spark, monkeypatch):
    store = Da.Store(spark, scratch_path(spark, "observatory"))
    pages = [
        ("q", 0, json.dumps({"resultats": [_item(0), _item(1, neu=1), {"id": "bad"}]})), ("q", 3, json.dumps({"resultats": [], "extra": 1})),
        ("r", 0, "no json"), ("r", 20, json.dumps({"resultats": "none"})), ("s", 0, json.dumps({"resultats": [None, _item(2)]})), ("s", 0, json.dumps({"resultats": [None, _item(2)]})),
        (None, None, json.dumps({"resultats": [_item(3)]})), ("t", 0, None),
    ]
    landing = f"{store.path}/landing"
    spark.createDataFrame(pages, "query_key string, range_start long, payload string").write.json(landing)
    plain, read_from = Da.Store.write, {}

    def write(self, table, run, rows):
        read_from[table] = {f.removeprefix("file:").removeprefix("//").removeprefix(store.path).split("/")[1] for f in rows.inputFiles()}
        plain(self, table, run, rows)

    monkeypatch.setattr(Da.Store, "write", write)
    run = Da.Run("R0", dt.datetime(2024, 1, 10, 5), "queries-3", landing)
    Da.land(store, run, None, [{"id": "dev", "title_phrases": ["développeur"], "job_families": ["software"]}])
    assert [t for t, folders in read_from.items() if "landing" in folders] == ["judged_items"]
    assert read_from["observations"] == {"items"}
    facts = store.read("pages", "R0").select("query_id", "range_start", "status", "root_issue", "received_count", "quarantined_count", "warning_count", "in_perimeter_count").collect()
    # a page without a key is met by no join, as ever: it counts no items
    assert sorted(map(tuple, facts), key=str) == sorted([
        ("q", 0, "valid_with_warnings", None, 3, 1, 1, 2), ("q", 3, "valid_with_warnings", None, 0, 0, 1, 0), ("r", 0, "invalid_quarantined", "invalid_json", 0, 0, 0, 0),
        ("r", 20, "invalid_quarantined", "result_list_missing", 0, 0, 0, 0), ("s", 0, "valid_with_warnings", None, 2, 1, 0, 1), ("t", 0, "invalid_quarantined", "invalid_json", 0, 0, 0, 0),
    ], key=str)
    assert store.read("quarantine", "R0").count() == 2 and store.read("items", "R0").count() == 4


def _every_step(value):
    """All steps over every text."""
    text = F.regexp_replace(value, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/li|/div|/h[1-6])\s*/?>", "\n")
    text = X.decode_entities(F.regexp_replace(text, r"<[^>]*>", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\t ]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, f"^[{X.SPACES}]+|[{X.SPACES}]+$", "")


def test_plain_text_is_that_of_all_steps(spark):
    rng = random.Random(5)
    parts = [*X.SPACES, "\r\n", "a", "é", "<br>", "<i>", "<script>x</script>", "&#13;", "&#10;", "&#32;", "&nbsp;", "&amp;lt;", "&", "<", "\u0085"]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.filter(~X.html_to_text(F.col("text")).eqNullSafe(_every_step(F.col("text")))).count() == 0
