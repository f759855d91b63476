"""Rules of level, experience, remote mode, salary and technologies on literal offers."""

import pytest
from pyspark.sql import functions as F

from offerlens.operators import classify as C
from offerlens.rules import patterns as P

SCHEMA = "id string, title string, description_text string, experience_required boolean, experience_label string, salary_label string"
CASES = {
    # id: (title, description, required, label, salary), (status, junior, months, beginner, contradictory, axis, axis value)
    "two_years": (("Développeur junior", "Une expérience d'au moins 2 ans est exigée.", None, None, None), ("classified", True, 24, False, True, "resolved", True)),
    "range": (("Dév", "Expérience de 1 à 2 ans minimum.", None, None, None), ("classified", None, 12, True, None, "unknown", None)),
    "glued_range": (("Dév", "Expérience de 1à2 ans minimum.", None, None, None), ("classified", None, 12, True, None, "unknown", None)),
    "desired": (("Dév junior", "Idéalement 5 ans d’expérience.", None, None, None), ("classified", True, None, None, None, "unknown", None)),
    "trailing_wish": (("Dév junior", "5 ans d'expérience dans le web est souhaitée.", None, None, None), ("classified", True, None, None, None, "unknown", None)),
    "employer": (("Dév junior", "Notre société créée il y a 30 ans recrute.", None, None, None), ("classified", True, None, None, None, "unknown", None)),
    "diploma": (("Dév junior", "Formation de 3 ans exigée, expérience web.", None, None, None), ("classified", True, None, None, None, "unknown", None)),
    "words": (("Dév", "Cinq ans d'expérience exigée", None, None, None), ("classified", None, 60, False, None, "unknown", None)),
    "months": (("Dév", "Vous justifiez de 18 mois d'expérience", None, None, None), ("classified", None, 18, False, None, "unknown", None)),
    "line_break": (("Dév", "Il faut 2\nans d'expérience requis", None, None, None), ("classified", None, 24, False, None, "unknown", None)),
    "stack": (("Dév", "Qualifications3 ans minimum sur la stack Java", None, None, None), ("classified", None, 36, False, None, "unknown", None)),
    "accepted": (("Dév", "Débutants acceptés", None, None, None), ("classified", True, 0, True, False, "resolved", False)),
    "wished_code": (("Dév", "x", False, "Expérience souhaitée", None), ("classified", True, 0, True, False, "resolved", False)),
    "conflict": (("Dév", "Débutants acceptés. 3 ans d'expérience exigés.", None, None, None), ("ambiguous", True, 36, None, None, "resolved", True)),
    "label_text": (("Dév junior", "1 an d'expérience exigé", True, "3 An(s)", None), ("ambiguous", True, 36, None, None, "ambiguous", None)),
    "senior": (("Lead dev", "x", None, None, None), ("classified", False, None, None, False, "unknown", None)),
    "either": (("Dév senior ou junior", "x", None, None, None), ("classified", True, None, None, None, "unknown", None)),
    "senior_junior": (("Dév junior confirmé", "x", None, None, None), ("ambiguous", True, None, None, None, "ambiguous", None)),
    "negated": (("Dév, profil non junior", "Profil junior", None, None, None), ("classified", False, None, None, False, "unknown", None)),
    "nothing": (("Dév", "Rien", None, None, None), ("unclassified", None, None, None, None, "unknown", None)),
    "beginner_alternative": (("Dév", "3 ans d'expérience ou vous êtes débutant", None, None, None), ("unclassified", None, None, None, None, "unknown", None)),
    "strong_of": (("Dév", "Forts de 20 ans d'expérience exigée", None, None, None), ("unclassified", None, None, None, None, "unknown", None)),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, *given) for name, (given, _) in CASES.items()]
    rows += [
        ("remote", "Dév", "Full remote", None, None, "2500 € par mois"),
        ("possible", "Dév", "Télétravail possible.", None, None, "selon profil"),
        ("both", "Dév full-remote", "mode hybride", None, None, "35000"),
        ("native", "Dév", "React Native et Docker, Digital Git", None, None, None),
        ("context", "Dév", "Go, langage backend. JS", None, None, None),
        ("no_context", "Dév", "On y go, rust et rails", None, None, None),
        ("script", "Dév", "JavaScript et Java", None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: r for r in C.with_observation(C.classify(df)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_answers(results, name):
    r = results[name]
    got = (
        r["status"], r["claims_junior"], r["minimum_experience_months"], r["beginner_friendly"], r["contradictory_junior"],
        r["junior_observation_status"], r["junior_observation_contradictory"],
    )
    assert got == CASES[name][1], [tuple(e) for e in r["evidence"]]


def test_evidence_is_the_source(results):
    fields = {"title": "title", "description": "description_text", "experienceLabel": "experience_label", "salaryLabel": "salary_label"}
    for r in results.values():
        for e in r["evidence"]:
            source = r[fields[e["field"]]] or ""
            assert source[e["start"] : e["end"]] == e["excerpt"]


def test_enrichment(results):
    assert [results[n]["remote_mode"] for n in ("remote", "possible", "both", "nothing")] == ["remote", "hybrid", "unknown", "unknown"]
    assert [w["code"] for w in results["possible"]["warnings"]] == ["REMOTE_FREQUENCY_UNKNOWN"]
    assert [w["code"] for w in results["both"]["warnings"]] == ["REMOTE_SIGNALS_CONFLICT"]
    assert [results[n]["salary_transparent"] for n in ("remote", "possible", "both", "nothing")] == [True, False, False, False]
    assert results["native"]["technology_slugs"] == ["docker", "react-native"]
    assert results["context"]["technology_slugs"] == ["go", "javascript"]
    assert results["no_context"]["technology_slugs"] == []
    assert results["script"]["technology_slugs"] == ["javascript"]


def test_filter_after_classification(spark, results):
    df = spark.createDataFrame([("a", "Dév junior", "x", None, None, None)], SCHEMA)
    assert C.classify(df).filter("status = 'classified' and claims_junior").count() == 1


def test_fast_patterns_find_what_the_plain_ones_find(spark):
    pieces = ["2 ans", "12 à 24 mois", "trois\nannées", "un–deux ans", "é3 ans", "x5 ans", "_6 ans", "²7 ans", "qualifications2 ans minimum sur la stack", "10 + ans", "FULL REMOTE", "xfull remote"]
    pieces += ["TÉLÉTRAVAIL INTÉGRAL", "éfull-remote", "_hybride", "Hybrıde", "2 JOURS de télétravail", "aucun teletravail", "ſaucun télétravail", "Présence obligatoire", "présence ſur site", "K100 % remote"]
    texts = [a + mid + b for a in pieces for b in pieces for mid in ("", " ", ". • ", "\n")]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    start = r"(?=[\dcdhnqstu])(?<![\p{L}\p{N}])"
    plain = "|".join([P.STACK, P.RANGE.replace(P.NUMBER_START, start), P.DURATION.replace(P.NUMBER_START, start)])
    found = {"durations": F.regexp_extract_all("text", F.lit(f"({P.MENTION})"), F.lit(1)), **{m: F.regexp_extract_all("text", F.lit(P.remote_rx(m)), F.lit(0)) for m in P.REMOTE}}
    wanted = {"durations": F.regexp_extract_all("text", F.lit(f"({plain})"), F.lit(1)), **{m: F.regexp_extract_all("text", F.lit(f"(?iu){P.word(P.REMOTE[m])}"), F.lit(0)) for m in P.REMOTE}}
    out = rows.select("text", F.struct(*[c.alias(n) for n, c in found.items()]).alias("a"), F.struct(*[c.alias(n) for n, c in wanted.items()]).alias("b"))
    assert [r for r in out.where("a <> b").collect()] == []
    assert all(out.where(f"size(a.{n}) > 0").count() for n in found)
    clauses = rows.select(C._clauses(F.col("text")).alias("a"), F.regexp_replace("text", f"[{P.BOUNDARY_MARKS}]", C.SEPARATOR).alias("b"))
    assert clauses.where("a <> b").count() == 0
