"""Stored cells kept up by changes equal a full count."""

import random

from offerlens.operators import cells as Ce
from offerlens.operators import metrics as M
from offerlens.sources.tables import scratch_path

SETS = [(), ("region_code",), ("job_family", "technology_slug"), ("technology_slug", "contract_kind", "remote_mode")]
SCHEMA = (
    "dataset_id string, junior_metric_version string, offer_id string, status string, claims_junior boolean, minimum_experience_months int, beginner_friendly boolean,"
    " contradictory_junior boolean, junior_observation_status string, junior_observation_contradictory boolean, salary_transparent boolean, region_code string,"
    " contract_kind string, remote_mode string, job_families array<string>, technologies array<string>"
)


def _offer(rng, i):
    pick = lambda *values: rng.choice(values)
    several = lambda values: rng.choices(values, k=rng.randrange(3)) or pick(None, [])
    return [f"o{i}", pick("classified", "ambiguous", "unclassified"), pick(True, False, None), pick(None, 6, 24), pick(True, False, None), pick(True, None),
            pick("resolved", "unknown", "ambiguous"), pick(True, False, None), pick(True, False), pick("r1", "r2", None), pick("cdi", None), pick("remote", "onsite"),
            several(["data", "web"]), several(["java", "sql"])]


def _sorted(frame):
    return sorted(map(str, frame.select("dataset_id", "junior_metric_version", *Ce.KEYS, *M.CELL_COUNTERS, "offers").collect()))


def test_cells_follow_the_changes(spark):
    rng, path = random.Random(1), scratch_path(spark, "cells")
    offers = {i: _offer(rng, i) for i in range(120)}
    before = None
    for day, version in (("d1", "junior-contradiction-1.0.0"), ("d2", "junior-contradiction-1.0.0"), ("d3", "junior-contradiction-2.0.0"), ("d4", "junior-contradiction-2.0.0")):
        if before is not None:
            for i in rng.sample(sorted(offers), 25):  # some leave, some change, some only list their families in another order
                offers[i] = _offer(rng, i) if rng.random() < 0.6 else offers[i][:-2] + [x[::-1] + x[:1] if x else x for x in offers[i][-2:]]
                if rng.random() < 0.3:
                    del offers[i]
            offers |= {i: _offer(rng, i) for i in range(1000 * len(day) + rng.randrange(99), 1000 * len(day) + 105)}
        if day == "d4":
            offers = {i: o for i, o in offers.items() if o[9] != "r2"}  # the cells of r2 vanish
        now = spark.createDataFrame([(day, version, *o) for o in offers.values()], SCHEMA)
        if before is None:
            Ce.store_cells(M.cells(now, SETS), path)
        else:
            Ce.store_cells(Ce.next_cells(Ce.read_cells(spark, path), before, now, SETS), path)
        stored = Ce.read_cells(spark, path).filter(f"dataset_id = '{day}'")
        assert _sorted(stored) == _sorted(Ce._full(M.cells(now, SETS)))
        before = now
    assert "r2" not in {r.region_code for r in stored.collect()}


def test_only_changed_members_are_counted(spark):
    rng = random.Random(2)
    rows = [("d1", "v", *_offer(rng, i)) for i in range(50)]
    after = [("d2", *r[1:]) for r in rows[2:]] + [("d2", "v", *_offer(rng, 99))]
    after[0] = (*after[0][:-2], ["new"], after[0][-1])
    gone, come = Ce.changed_members(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(after, SCHEMA))
    assert sorted(r.offer_id for r in gone.collect()) == ["o0", "o1", "o2"] and sorted(r.offer_id for r in come.collect()) == ["o2", "o99"]
