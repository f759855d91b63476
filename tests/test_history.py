"""Snapshot intervals against a plain walk, whatever the buckets."""

import datetime as dt
import random

from pyspark.sql import functions as F

from offerlens.operators import history as H

START = dt.datetime(2024, 1, 1)
SCHEMA = "offer_id string, observed_at timestamp, event_id long, content_hash string"


def _plain(rows):
    found = []
    for offer in {r[0] for r in rows}:
        runs = []
        for _, at, _, content in sorted((r for r in rows if r[0] == offer), key=lambda r: (r[1], r[2])):
            if not runs or runs[-1][0] != content:
                runs.append((content, at))
        found += [(offer, content, at, after) for (content, at), after in zip(runs, [at for _, at in runs[1:]] + [None])]
    return sorted(found, key=repr)


def test_intervals_over_any_buckets(spark):
    rng = random.Random(1)
    for states, minutes, offers in ((1, 5000, 3), (2, 20_000, 4), (3, 3000, 2), (2, 100_000, 6)):
        rows = [(f"o{rng.randrange(offers)}", START + dt.timedelta(minutes=rng.randrange(minutes)), i, rng.choice(["a", "b", None][:states])) for i in range(250)]
        df = spark.createDataFrame(rows, SCHEMA)
        for bucket in (None, F.date_trunc("hour", "observed_at"), F.date_trunc("year", "observed_at"), F.col("observed_at")):
            got = sorted(map(tuple, H.snapshot_intervals(df, bucket).collect()), key=repr)
            assert got == _plain(rows)


def test_intervals_use_two_exchanges_and_no_join(spark):
    rows = spark.createDataFrame([("a", START, 1, "x")], SCHEMA)
    plan = H.snapshot_intervals(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and H.snapshot_intervals(rows.limit(0)).count() == 0
