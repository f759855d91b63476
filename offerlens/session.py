"""Session defaults. A cluster session is used as given; only missing settings are filled in."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on for right results (UTC instants) or for skew handling at run time.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
}
PREFERRED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, through Spark's own file service."""
    context = spark.sparkContext
    if getattr(context, "_offerlens_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="offerlens-")) / "offerlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*")):
            if file.suffix in (".py", ".json"):
                out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._offerlens_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the UTC session zone and ship the package; other settings stay as the cluster chose them."""
    ship_package(spark)
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, name: str = "offerlens") -> SparkSession:
    """Session for tests and the bench on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**REQUIRED, **PREFERRED}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only for a session on one machine, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="offerlens-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder
