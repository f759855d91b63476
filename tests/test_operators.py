"""Borders of rates, quality, history, paging, intake and evaluation on literal frames."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from offerlens.functions import rates as R
from offerlens.operators import evaluate as E
from offerlens.operators import explorer as X
from offerlens.operators import history as H
from offerlens.operators import publish as Pu
from offerlens.operators import quality as Q
from offerlens.operators.scope import Scope, split_list
from offerlens.operators.skew import bucketed_neighbour, bucketed_rank, hash_slice
from offerlens.sources import pages as S
from offerlens.sources import tables as T
from offerlens.streaming import intake

DAY = dt.datetime(2024, 1, 1)


def at(days, hours=0):
    return DAY + dt.timedelta(days=days, hours=hours)


def all_pages(filtered, sort, limit):
    """Walk the keyset to the end."""
    column, pages, after = X.SORTS[sort][0], [], None
    while True:
        rows = X.explorer_page(filtered, sort, limit, after).select("offer_id", column).collect()
        rows.sort(key=lambda r: r["offer_id"], reverse=X.SORTS[sort][1])
        present = sorted([r for r in rows if r[column] is not None], key=lambda r: r[column], reverse=X.SORTS[sort][1])
        rows = present + [r for r in rows if r[column] is None]
        pages.append([tuple(r) for r in rows[:limit]])
        if len(rows) <= limit:
            return pages
        after = (rows[limit - 1][column], rows[limit - 1]["offer_id"])


def test_rate_borders(spark):
    rows = [(0, 0, 0, 0), (5, 19, 1, 0), (8, 20, 0, 0), (10, 49, 0, 1), (10, 50, 0, 0)]
    df = R.rate_from_counts(spark.createDataFrame(rows, "numerator long, denominator long, unknown_count long, ambiguous_count long"))
    got = [(r["value"], r["sample_quality"], r["coverage"]) for r in df.collect()]
    assert got == [(None, "insufficient", None), (None, "insufficient", 0.95), (0.4, "caution", 1.0), (10 / 49, "caution", 0.98), (0.2, "normal", 1.0)]
    with pytest.raises(Exception, match="numerator cannot exceed"):
        R.rate_from_counts(spark.createDataFrame([(2, 1, 0, 0)], "numerator long, denominator long, unknown_count long, ambiguous_count long")).collect()


def test_scope_values():
    assert split_list(" b, a ,,b") == ("a", "b")
    assert Scope().period == "30d"
    for bad in ({"job": "cook"}, {"technologies": "a,b,c,d"}, {"area": "planet:1"}, {"contracts": "x"}, {"remote": "x"}, {"period": "1d"}):
        with pytest.raises(ValueError):
            Scope(**bad)


def test_partition_volume_policy(spark):
    rows = [(8, 3, 4), (8, 3, 5), (5, 0, 5), (1, 0, 1), (10, 24, 0), (0, 9, 0), (10, 4, 6), (100, 40, 60), (100, 39, None)]
    df = spark.createDataFrame(rows, "previous long, current long, missing_from_run long")
    verdicts = [r["verdict"] for r in Q.partition_volume_policy(df).collect()]
    assert verdicts == ["warning", "block", "block", "warning", "warning", "ok", "ok", "ok", "block"]


def test_quality_decision(spark):
    base = dict(run_id="r", offers_received=100, offers_valid=100, offers_quarantined=0, positives=10, positives_with_evidence=10, pagination_complete=True, source_cap_reached=False, volume_anomaly=False)
    cases = [
        ({}, "publish", []),
        ({"offers_valid": 98, "offers_quarantined": 2}, "publish", []),
        ({"offers_valid": 95, "offers_quarantined": 5}, "publish_partial", ["validation_rate_below_publish_threshold"]),
        ({"offers_valid": 94, "offers_quarantined": 6}, "block", ["validation_rate_below_minimum"]),
        ({"offers_received": 0, "offers_valid": 0}, "block", ["validation_rate_unavailable"]),
        ({"pagination_complete": False, "source_cap_reached": True, "positives_with_evidence": 9, "volume_anomaly": True}, "block",
         ["pagination_incomplete", "source_cap_reached", "positive_classification_missing_evidence", "volume_anomaly_detected"]),
    ]
    schema = "run_id string, offers_received long, offers_valid long, offers_quarantined long, positives long, positives_with_evidence long, pagination_complete boolean, source_cap_reached boolean, volume_anomaly boolean"
    df = spark.createDataFrame([tuple((base | change).values()) for change, *_ in cases], schema)
    got = [(r["decision"], r["reasons"], r["closure_eligible"]) for r in Q.quality_decision(df).collect()]
    assert got == [(d, r, d == "publish") for _, d, r in cases]


def test_history(spark):
    seen = [("a", at(0), 1, "x"), ("a", at(1), 2, "x"), ("a", at(2), 3, "y"), ("a", at(2, 1), 4, "y"), ("a", at(5), 5, "x"), ("b", at(1), 6, "z")]
    df = spark.createDataFrame(seen, "offer_id string, observed_at timestamp, event_id long, content_hash string")
    whole = {(r["offer_id"], r["content_hash"], r["valid_from"], r["valid_to"]) for r in H.snapshot_intervals(df).collect()}
    assert whole == {("a", "x", at(0), at(2)), ("a", "y", at(2), at(5)), ("a", "x", at(5), None), ("b", "z", at(1), None)}
    stored = H.snapshot_intervals(df.filter("event_id < 5 and offer_id = 'a'"))
    batch = df.filter("event_id >= 5")
    step = H.apply_snapshots(stored, batch)
    assert {tuple(r) for r in step.select("offer_id", "content_hash", "valid_from", "valid_to").collect()} == whole
    again = H.apply_snapshots(step, batch)
    assert {tuple(r) for r in again.select("offer_id", "content_hash", "valid_from", "valid_to").collect()} == whole


def test_upsert_keeps_last_seen_and_reopens(spark):
    state = spark.createDataFrame([("a", at(1), at(9), None, at(8), 0)], "offer_id string, first_seen_at timestamp, last_seen_at timestamp, missing_since timestamp, closed_at timestamp, reopened_count int")
    batch = spark.createDataFrame([("a", at(3)), ("b", at(4))], "offer_id string, observed_at timestamp")
    rows = {r["offer_id"]: r for r in H.upsert_offers(state, batch).collect()}
    assert (rows["a"]["first_seen_at"], rows["a"]["last_seen_at"], rows["a"]["closed_at"], rows["a"]["reopened_count"]) == (at(1), at(9), None, 1)
    assert (rows["b"]["first_seen_at"], rows["b"]["last_seen_at"], rows["b"]["reopened_count"]) == (at(4), at(4), 0)


@pytest.mark.parametrize("previous, expected", [("succeeded", {"gone": (True, True), "once": (True, False), "here": (False, False)}), ("partial", {})])
def test_absences(spark, previous, expected):
    runs = spark.createDataFrame([("r1", previous, True, at(1)), ("r2", "succeeded", True, at(2))], "run_id string, status string, closure_eligible boolean, created_at timestamp")
    runs = runs.withColumn("source_id", F.lit("s")).withColumn("query_set_version", F.lit("q")).withColumn("mode", F.lit("full"))
    queries = spark.createDataFrame([("r1", "succeeded"), ("r2", "succeeded")], "run_id string, status string")
    sightings = spark.createDataFrame([("r1", "once"), ("r1", "here"), ("r2", "here")], "run_id string, offer_id string")
    offers = spark.createDataFrame([("gone",), ("once",), ("here",)], "offer_id string")
    offers = offers.withColumn("missing_since", F.lit(None).cast("timestamp")).withColumn("closed_at", F.lit(None).cast("timestamp"))
    state = H.apply_absences(offers, offers, sightings, runs, queries, "r2", F.lit("2024-01-03").cast("timestamp"))
    got = {r["offer_id"]: (r["missing_since"] is not None, r["closed_at"] is not None) for r in state.collect()}
    assert got == (expected or {k: (False, False) for k in ("gone", "once", "here")})


def test_skew_windows_equal_plain_windows(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"), (F.col("id") * 37 % 211).alias("t"), "id")
    order = Window.partitionBy("key").orderBy("t", "id")
    plain = rows.withColumn("previous_id", F.lag("id").over(order)).withColumn("next_id", F.lead("id").over(order))
    bucket = F.floor(F.col("t") / 20)
    split = bucketed_neighbour(bucketed_neighbour(rows, ["key"], bucket, ["t", "id"], ["id"]), ["key"], bucket, ["t", "id"], ["id"], following=True)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, split.select(*plain.columns).collect()), key=repr)
    hashed = rows.withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    expected = hashed.select("id", F.row_number().over(Window.partitionBy("key").orderBy("h")).alias("rank"))
    got = bucketed_rank(hashed, ["key"], [F.col("h")], hash_slice(F.col("h"), 1)).select("id", "rank")
    assert set(map(tuple, expected.collect())) == set(map(tuple, got.collect()))


@pytest.mark.parametrize("sort", X.SORTS)
def test_pages_cover_everything_once(spark, sort):
    rows = [(f"{i:03d}", at(i % 5) if i % 4 else None, i % 6 * 6 if i % 5 else None) for i in range(47)]
    df = spark.createDataFrame(rows, "offer_id string, source_published_at timestamp, minimum_experience_months int").cache()
    pages = all_pages(df, sort, 12)
    assert sorted(o for page in pages for o, _ in page) == [r[0] for r in rows]
    values = [v for page in pages for _, v in page]
    present = [v for v in values if v is not None]
    assert values == present + [None] * (len(values) - len(present)), "nulls come last both ways"
    assert present == sorted(present, reverse=X.SORTS[sort][1])


def test_contract_and_replay(spark, tmp_path):
    page = '{"resultats":[{"id":"1","intitule":"t","description":"d","nouveau":[1]},{"id":"","intitule":"t","description":"\\\\u0000"},{"id":"3","intitule":"t","description":"\\ud83d"},{"id":"4","intitule":"t"},{"id":"5","intitule":"t","description":"\\ud83d\\ude00","langues":[{"libelle":1}],"contexteTravail":{"horaires":["a"]}},7]}'
    pages = spark.createDataFrame([("q", 0, page), ("q", 150, '{"x":1}'), ("q", 300, "no json")], "query_key string, range_start long, payload string")
    parsed = S.parsed_pages(pages)
    checked = S.validate_contract(S.read_offer_pages(parsed))
    issues = {r["item_ordinal"]: [tuple(i) for i in r["issues"]] for r in checked.select("item_ordinal", "issues").collect()}
    assert issues == {
        0: [], 1: [("id", "too_small")], 2: [("", "storage_text")], 3: [("description", "invalid_type")], 4: [("langues", "invalid_type")], 5: [("", "invalid_type")],
    }
    unknown = S.unknown_field_report(checked)
    assert [tuple(r) for r in unknown.select("path", "field", "observed_type").collect()] == [("resultats.0", "nouveau", "array")]
    status = {r["range_start"]: (r["status"], r["root_issue"]) for r in S.page_status(parsed, checked, unknown).collect()}
    assert status == {0: ("valid_with_warnings", None), 150: ("invalid_quarantined", "result_list_missing"), 300: ("invalid_quarantined", "invalid_json")}

    landing, committed, progress = (str(tmp_path / n) for n in ("landing", "committed", "progress"))
    for _ in range(2):
        pages.write.mode("append").json(landing)
        intake.commit_pages(spark, landing, committed, progress, files_per_batch=1)
    assert spark.read.parquet(committed).count() == 3


def test_repeated_writes_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 10), (1, "b", 11), (2, "a", 12)], "run int, offer string, v int")
    path = str(tmp_path / "t")
    T.write_partitions(rows, path, "run")
    T.write_partitions(rows.filter("run = 2"), path, "run")
    T.append_new(rows.withColumn("v", F.lit(0)), path, ["run", "offer"], "run")
    assert {tuple(r) for r in spark.read.parquet(path).select("run", "offer", "v").collect()} == {(1, "a", 10), (1, "b", 11), (2, "a", 12)}


def test_label_join_refuses_gaps_and_repeats(spark):
    left = spark.createDataFrame([("1", "x"), ("2", "y")], "review_id string, p string")
    good = left.withColumnRenamed("p", "l")
    assert E.label_join(left, good).count() == 2
    for bad in (good.filter("review_id = '1'"), good.unionByName(good.limit(1))):
        with pytest.raises(Exception, match="one to one"):
            E.label_join(left, bad).collect()


def test_gates(spark):
    rows = [(0, 0, 5, 5), (92, 8, 8, 0), (91, 9, 0, 0), (85, 0, 15, 0), (84, 0, 16, 0)]
    df = E.precision_recall(spark.createDataFrame(rows, "tp long, fp long, fn long, tn long"))
    got = [(r["precision_status"], r["recall_status"], r["gate"]) for r in df.collect()]
    assert got == [
        ("not_evaluable", "failed", "blocked"), ("passed", "passed", "passed"), ("failed", "passed", "blocked"), ("passed", "passed", "passed"), ("passed", "failed", "blocked"),
    ]


def test_pairwise_overlap_against_brute_force(spark):
    hits = [(f"q{q}", o) for q in range(5) for o in range(40) if (o * (q + 3)) % 5 < 2] + [("q6", 100)]
    df = spark.createDataFrame(hits, "query_id string, offer_id int")
    sets = {q: {o for x, o in hits if x == q} for q, _ in hits}
    expected = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = {(r["left_id"], r["right_id"]): (r["intersection"], r["union"]) for r in E.pairwise_overlap(df).collect()}
    assert got == expected
    queries = spark.createDataFrame([(f"q{q}", "keyword-only" if q % 2 else "occupation-only", ["g"]) for q in range(8)], "query_id string, kind string, group_ids array<string>")
    row = E.overlap_summary(E.pairwise_overlap(df), queries).first()
    mixed = [v for (a, b), v in expected.items() if int(a[1]) % 2 != int(b[1]) % 2]
    assert (row.pairs, row.non_zero_pairs) == (16, len(mixed)) and abs(row.mean_jaccard - sum(i / u for i, u in mixed) / 16) < 1e-12


def test_lost_query_and_empty_run_block(spark):
    """A query that loses its offers and a run without any are seen, whatever classifier versions are stored."""
    runs = spark.createDataFrame(
        [("r1", "s", "q", "full", "succeeded", 1), ("r2", "s", "q", "full", "succeeded", 2), ("r3", "s", "q", "full", "succeeded", 3)],
        "run_id string, source_id string, query_set_version string, mode string, status string, at int",
    ).selectExpr("*", "timestamp_seconds(at) as created_at", "10L as offers_received", "10L as offers_valid", "0L as offers_quarantined")
    queries = spark.createDataFrame([(r, q, "succeeded") for r in ("r1", "r2", "r3") for q in ("a", "b")], "run_id string, query_id string, status string")
    seen = [("r1", "a", f"o{i}") for i in range(30)] + [("r1", "b", f"p{i}") for i in range(5)] + [("r2", "a", f"o{i}") for i in range(30)]
    sightings = spark.createDataFrame(seen, "run_id string, query_id string, offer_id string").selectExpr("*", "true as offer_created", "true as snapshot_created")
    pages = spark.createDataFrame([("r1", 10)], "run_id string, source_total int")
    offers = [f"o{i}" for i in range(30)]
    snapshots = spark.createDataFrame([(f"s{o}", o) for o in offers], "snapshot_id string, offer_id string").selectExpr("*", "cast(null as timestamp) as valid_to")
    versions = [(f"{v}{o}", f"s{o}", v, "classified", True) for o in offers for v in ("v1", "v2")]
    classifications = spark.createDataFrame(
        versions, "classification_id string, snapshot_id string, classifier_version string, status string, claims_junior boolean"
    ).selectExpr("*", "cast(null as int) as minimum_experience_months", "cast(null as boolean) as beginner_friendly", "cast(null as boolean) as contradictory_junior")
    evidence = spark.createDataFrame([(f"v1{o}",) for o in offers], "classification_id string")
    volumes = Q.partition_volume_policy(Q.partition_volumes(sightings, runs, queries)).collect()
    assert {(r.run_id, r.query_id): (r.current, r.previous, r.verdict) for r in volumes} == {
        ("r2", "a"): (30, 30, "ok"), ("r2", "b"): (0, 5, "block"), ("r3", "a"): (0, 30, "block"), ("r3", "b"): (0, 0, "ok")
    }
    for version, proven in (("v1", 30), ("v2", 0)):
        facts = Q.run_quality_facts(runs, queries, pages, sightings, snapshots, classifications, evidence, version)
        rows = {r.run_id: r for r in facts.collect()}
        assert (rows["r2"].unique_offers, rows["r2"].positives, rows["r2"].positives_with_evidence) == (30, 30, proven)
        assert [rows[r].volume_anomaly for r in ("r1", "r2", "r3")] == [False, True, True]


def test_second_rollback_withdraws_the_restored(spark):
    datasets = spark.createDataFrame([(f"P{i}", "s", "publish", "published", i) for i in (1, 2, 3)], "dataset_id string, source_id string, decision string, status string, at int")
    datasets = datasets.withColumn("published_at", F.expr("timestamp_seconds(at)"))
    members = datasets.select("dataset_id")
    metrics = datasets.select("dataset_id", F.lit(R.CONTRADICTION).alias("metric_key"))
    rollbacks = spark.createDataFrame([("P2", "s", 4), ("P1", "s", 5)], "dataset_id string, source_id string, at int").selectExpr("dataset_id", "source_id", "timestamp_seconds(at) as rolled_back_at")
    rows = {r.dataset_id: (r.status, r.is_current) for r in Pu.publication_log(datasets, members, metrics, rollbacks).collect()}
    assert rows == {"P1": ("published", True), "P2": ("withdrawn", False), "P3": ("withdrawn", False)}


def test_split_windows_keep_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    near = bucketed_neighbour(rows, ["k"], F.col("v"), ["v"], ["v"]).collect()
    assert sorted((r.v, r.previous_v) for r in near) == [(1, None), (2, 1), (3, None)]
    assert bucketed_rank(rows, ["k"], [F.col("v")], F.col("v")).count() == 3
