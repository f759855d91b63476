"""Text functions against character-by-character references and literal cases."""

import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlens.functions import text as X
from offerlens.operators import normalize as N
from offerlens.operators.technologies import text_forms
from offerlens.rules import query_set, technology_rules


def folded_slowly(source):
    out, places, spaced = [], [], False
    for place, char in enumerate(source):
        unit = char if ord(char) >= 0x10000 else unicodedata.normalize("NFKC", char).lower()
        for c in "".join("'" if u in "’‘`" else u for u in unit):
            space = c in X.SPACES
            if space and spaced:
                continue
            out.append(" " if space else c)
            places.append(place)
            spaced = space
    return "".join(out), places


def test_match_form_and_offsets(spark):
    rng = random.Random(7)
    letters = "aB é\n\t\r’`…ﬁ½ ¨.!?;․\U0001f600İΣ１ ç•\x01"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("form", X.match_form("t"))
    places = F.transform(F.sequence(F.lit(0), F.length("form.marked")), lambda p: X.source_offset(F.col("form.shifts"), p))
    for row in df.select("t", X.plain_form(F.col("form.marked")).alias("plain"), places.alias("places")).collect():
        plain, expected = folded_slowly(row["t"])
        assert row["plain"] == plain, repr(row["t"])
        assert row["places"][: len(plain)] == expected, repr(row["t"])


@pytest.mark.parametrize(
    "markup, plain",
    [
        ("<p>A&amp;B</p><p>C</p>", "A&B\nC"),
        ("&amp;lt;", "&lt;"),
        ("&#38;lt;", "&lt;"),
        ("&#233;&#xE9;&#x1F600;", "éé\U0001f600"),
        ("&#0;&#xD800;&#x110000;&bogus;&AMP;", "&#0;&#xD800;&#x110000;&bogus;&AMP;"),
        ("a<script>x<b></script>b<STYLE>y</STYLE>c", "abc"),
        ("a<br>b<br/>c\r\n\r\n\r\n\r\nd", "a\nb\nc\n\nd"),
        ("  x \t y  ", "x y"),
    ],
)
def test_html_to_text(spark, markup, plain):
    df = spark.createDataFrame([(markup,)], "t string")
    assert df.select(X.html_to_text(F.col("t"))).first()[0] == plain


def test_safe_url_and_redaction(spark):
    df = spark.createDataFrame([("https://a.b/c", "mail x.y+z@a-b.fr ou 06 12 34 56 78 http://q?r=1 fin")], "u string, t string")
    row = df.select(X.safe_url(F.col("u")), X.safe_url(F.lit("ftp://a.b")), X.safe_url(F.lit("no url")), X.redact_text(F.col("t"))).first()
    assert tuple(row) == ("https://a.b/c", None, None, "mail [EMAIL] ou [TÉLÉPHONE] [URL] fin") or row[3].startswith("mail [EMAIL]")


def test_query_set_expands_to_the_active_size(spark):
    groups = [(g["id"], g["enabled"], g["occupations"], g["keywords"]) for g in query_set()["groups"]]
    df = spark.createDataFrame(groups, "group_id string, enabled boolean, occupations array<string>, keywords array<string>")
    queries = N.expand_query_set(df)
    assert queries.count() == 566
    assert N.expand_query_set(df.withColumn("enabled", F.col("group_id") == "ai-ml")).count() == 1 + 4 + 4
    assert len(technology_rules()["technologies"]) == 45


def test_title_perimeter(spark):
    titles = ["Développeuse FRONT-END (H/F)", "Chef de rang", "Ingénieure Cloud/DevOps", "Mobilier design", "Vendeur mobile"]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    rows = {r["title"]: r["group_ids"] for r in N.title_perimeter(df, query_set()["groups"]).collect()}
    assert rows == {titles[0]: ["frontend"], titles[2]: ["devops-cloud"], titles[4]: ["mobile"]}
    assert N.title_perimeter(df, [{"id": "x", "job_families": ["x"], "title_phrases": ["absent"]}]).count() == 0


def test_texts_are_folded_in_slices():
    """A batch of any length is handed on in short parts, so no worker holds all its texts as objects."""
    texts = pa.array(["Été", None, ""] * 400)
    for function, columns in ((X._nfkd_lower, texts), (X._nfkc_lower, texts), (X.match_form, texts), (text_forms, (texts,) * 4)):
        parts = list(function.func(iter([columns])))
        assert max(map(len, parts)) <= X.SLICE and sum(map(len, parts)) == 1200
    row = parts[0].to_pylist()[:2]
    assert row[0]["description"]["marked"] == "été" and row[1]["description"] == {"marked": "", "shifts": []} and row[1]["salary"] == {"marked": None, "shifts": None}
