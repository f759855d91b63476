"""Parquet tables of the observatory: partitioned writes that can be repeated without a trace."""

from __future__ import annotations

import re
import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.session import checkpoint_dir


def write_partitions(rows: DataFrame, path: str, *partition: str) -> None:
    """Replace exactly the partitions present in `rows`; writing the same rows again changes nothing.

    Rows of one partition stay spread over their tasks, so a hot partition is many files, not one task.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str], *partition: str) -> None:
    """Add the rows whose key is not stored yet ("on conflict do nothing").

    The partition columns belong to the key, so only the stored partitions that occur in `rows` can hold a key of
    theirs; no file of another partition is read. Rows that are equal in the key count once.
    """
    fresh = rows.dropDuplicates(keys)
    if _exists(rows.sparkSession, path):
        fresh = fresh.join(stored_keys(rows, path, keys, *partition), keys, "left_anti")
    fresh.write.mode("append").partitionBy(*partition).parquet(path)


def stored_keys(rows: DataFrame, path: str, keys: list[str], *partition: str) -> DataFrame:
    """Keys in those partitions of a stored table that occur in `rows`, whose number a batch bounds."""
    if not set(partition) <= set(keys):
        raise ValueError("partition columns must belong to the key")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    found = [tuple(r) for r in rows.select(*partition).distinct().collect()] if partition else [()]
    if len(partition) == 1:
        listed = [v for v, in found if v is not None]
        held = F.col(partition[0]).isin(listed) | (F.lit(any(v is None for v, in found)) & F.col(partition[0]).isNull())
    else:
        one = lambda values: reduce(and_, (F.col(p).eqNullSafe(F.lit(v)) for p, v in zip(partition, values)), F.lit(True))
        held = reduce(or_, map(one, found), F.lit(False))
    return stored.filter(held).select(*keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a written table in the shared folder."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def unwritten(rows: DataFrame) -> None:
    """Remove a table of `written` that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in rows.inputFiles()}:
        remove(rows.sparkSession, folder)


def computed_once(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """Add an expensive column behind a generator.

    A filter on a plain computed column is pushed below it with a copy of its whole expression; the
    output of an outer generator stays where it is, so the column is computed once per row.
    """
    return rows.select("*", F.explode_outer(F.array(column)).alias(name))


def _exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a folder, in order."""
    target, files = _file_system(spark, path)
    if not files.exists(target):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(target) if f.isDirectory())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return _exists(spark, f"{path}/_SUCCESS")


def check_name(name: str) -> None:
    """A name that becomes a folder."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}", name):
        raise ValueError(f"not a folder name: {name!r}")


def numbered_folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the completely written tables below a folder, in order."""
    return sorted(int(n) for n in folder_names(spark, path) if n.isdigit() and is_complete(spark, f"{path}/{n}"))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table of the library's own that nothing reads any more."""
    target, files = _file_system(spark, path)
    files.delete(target, True)


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows replaced by new ones of the same key, plus the new keys."""
    kept = stored.join(rows.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(rows.select(*[F.col(c) for c in stored.columns]))
