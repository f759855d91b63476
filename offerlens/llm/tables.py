"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from offerlens.session import checkpoint_dir, prepare

#: Rows of an Arrow batch: texts are long, and a batch is held whole by a Python worker.
BATCH_ROWS = 500


def ready(rows: DataFrame) -> DataFrame:
    """Ship the package to the workers and keep Arrow batches small; called by operators that run Python."""
    spark = prepare(rows.sparkSession)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return rows


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and go on from the files."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # what the C library keeps of numpy's and Python's memory


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "longs": T.ArrayType(T.LongType()),
    "ints": T.ArrayType(T.IntegerType()),
}


def struct(fields: str) -> T.StructType:
    """A struct type from "name type, ..."; unlike a DDL string it needs no session when a module is imported."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])
