"""Time the headline queries on one machine and print one JSON line.

Read models run over stored tables, as they do in service: the derived tables are written once (timed as
`store_tables`) and each read model is the median of three warm runs. Jobs run once over the supplied data.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from offerlens.plans import registry  # noqa: E402
from offerlens.plans.derived import Frames  # noqa: E402
from offerlens.session import local_session  # noqa: E402
from offerlens.sources.tables import scratch_path  # noqa: E402

READ_MODELS = ("overview", "explorer", "trends", "taxonomy_counts", "data_status", "contradiction_rate_v2", "overview_metrics")
JOBS = (
    "snapshot_intervals",
    "offer_upsert",
    "apply_absences",
    "run_quality_facts",
    "query_completeness",
    "freeze_membership",
    "daily_metrics",
    "metrics_by_dimension",
    "title_perimeter",
    "html_to_text",
    "validate_contract",
    "pairwise_overlap",
    "stratified_hash_split",
    "classify_offers",
)
STORED = {
    "dataset_rows": "description_text",
    "mentions": None,
    "day_members": None,
    "datasets": None,
    "runs": None,
    "run_queries": None,
    "quality_events": None,
    "memberships": None,
}


def stored_frames(spark, sf_dir: str) -> Frames:
    frames = Frames(spark, sf_dir)
    for name, dropped in STORED.items():
        path = scratch_path(spark, name)
        rows = getattr(frames, name)
        (rows.drop(dropped) if dropped else rows).write.parquet(path)
        frames._known[name] = spark.read.parquet(path)
    return frames


def spread_frames(spark, sf_dir: str) -> Frames:
    """The supplied documents in one file per core: a scan of one small file is one task."""
    frames = Frames(spark, sf_dir)
    path = scratch_path(spark, "documents")
    frames.documents.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    frames._known["documents"] = spark.read.parquet(path)
    return frames


def seconds(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registry.queries()
    functions, times = registry._QUERIES, {}
    holder = {}
    times["store_tables"] = seconds(lambda: holder.update(frames=stored_frames(spark, sf_dir)))
    frames = holder["frames"]
    for name in READ_MODELS:
        functions[name](frames).collect()
        times[name] = statistics.median(seconds(lambda: functions[name](frames).collect()) for _ in range(3))
    raw = spread_frames(spark, sf_dir)
    for name in JOBS:
        times[name] = seconds(lambda: functions[name](raw).write.format("noop").mode("overwrite").save())
    documents = raw.documents.count()
    times = {name: round(value, 4) for name, value in times.items()}
    line = {
        "metric": "total_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "classified_rows_per_second": round(documents / times["classify_offers"], 1),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
