"""Bounded samples of rows with a known label, for the classifiers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT = 2
#: Bounds of a training sample: rows of a class, and UTF-8 bytes of a text. Scoring has neither.
ROWS = 4000
BYTES = 30_000


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from. A null id has no label and is not held out."""
    return F.coalesce(fold(id_col) == HELD_OUT, F.lit(False))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The n rows that come first by a hash of their id: the same rows in every run."""
    return rows.orderBy(F.xxhash64("id"), "id").limit(n)


def labels_of(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """One row an id that may be learned from: `id, label`; of contradicting labels the larger counts."""
    usable = labels.where(~held_out(id_col) & F.col(column).isin(0, 1))
    return usable.groupBy(F.col(id_col).alias("id")).agg(F.max(column).alias("label"))


def texts_of(documents: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts of a bounded set of ids; one row an id."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= BYTES)
    return rows.join(F.broadcast(ids), "id").dropDuplicates(["id"])


def labelled_rows(
    documents: DataFrame, labels: DataFrame, column: str, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, float]:
    """(`id, label, text`, share of label 1 among all rows that may be learned from), at most ROWS of each class."""
    known = labels_of(labels, column, id_col)
    total, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    ids = _first(known.where("label = 1"), ROWS).unionByName(_first(known.where("label = 0"), ROWS))
    return texts_of(documents, ids, id_col, text_col), (ones + 1) / (total + 2)


def labelled(documents: DataFrame, labels: DataFrame, column: str, id_col: str = "doc_id", text_col: str = "text"):
    """(texts, labels, share) of the rows of `labelled_rows`, in the order of their ids."""
    rows, share = labelled_rows(documents, labels, column, id_col, text_col)
    found = rows.orderBy("id").select("text", "label").collect()
    return [r.text for r in found], [r.label for r in found], share


def any_texts(documents: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Texts of at most n rows outside the held-out fold, whatever their label, the same rows in every run."""
    ids = _first(documents.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id")).distinct(), n)
    return [r.text for r in texts_of(documents, ids, id_col, text_col).orderBy("id").select("text").collect()]
