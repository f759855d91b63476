"""What probable duplicates write: a row a class instead of a row a word, and every text's words once."""

import pytest

from offerlens.operators import duplicates as Du
from offerlens.sources import tables as T

SCHEMA = "offer_id string, title string, company_name string, commune_code string, contract_kind string, description_text string, source_published_at timestamp"


@pytest.fixture
def run(spark, monkeypatch):
    """Rows found, and by name the rows of each written table and the folders of its files."""
    tables, plain = {}, T.written

    def written(rows, name):
        found = plain(rows, name)
        tables[name] = (found.count(), found.inputFiles()[0].rsplit("/", 1)[0])
        return found

    monkeypatch.setattr(Du, "written", written)
    base = [f"w{k}" for k in range(40)]
    texts = {"a": base, "b": base[:38] + ["x", "y"], "c": base, "d": ["z"] * 3, "e": [], "f": [f"v{k}" for k in range(30)]}
    rows = [(i, "Job", "b", "c", None, " ".join(words), None) for i, words in texts.items()] + [("g", "Job", "other", "c", None, " ".join(base), None)]
    found = sorted(tuple(r) for r in Du.probable_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3)]
    return tables


def test_words_are_weighed_into_a_row_a_class(run):
    """four classes of one block have words, and one class is alone in its block."""
    assert run["offer-weights"][0] == run["offer-cores"][0] == 4


def test_words_of_texts_are_not_kept_beside_their_classes(spark, run):
    """the words of all offers, and then of all classes, leave the disk when the next table has what is needed."""
    left = {name for name, (_, folder) in run.items() if T._exists(spark, folder)}
    assert "offer-words" not in left and "offer-classes" not in left and {"offer-days", "offer-nodes", "offer-weights"} <= left
