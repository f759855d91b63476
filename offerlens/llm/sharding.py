"""Shards whose mixture of sources is that of the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.tables import stored

SHARDS = 16
SEED = 20
#: Ranks are counted in this many slices, so no task orders a whole source or the whole table.
SLICES = 4096


def shuffle_key(seed: int, id_col: str, text_col: str) -> Column:
    """Hex digits that order rows at random: a digest of seed, id and text, so that a null or repeated id spreads too."""
    shown = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.md5(shown.cast("binary"))


def _ranked(rows: DataFrame, parts: list[str], order: list[Column]) -> DataFrame:
    """Add `rank`, the 0-based rank of a row in its part, and `total`, the part's rows.

    The rank is the rows of the part's earlier slices plus the rank in the row's own slice.
    """
    sizes = rows.groupBy(*parts, "slice").agg(F.count("*").alias("n"))
    part = Window.partitionBy(*parts)
    before = part.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*parts, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(part).alias("total"))
    inside = F.row_number().over(Window.partitionBy(*parts, "slice").orderBy(*order)) - 1
    joined = rows.withColumn("inside", inside).join(offsets, [*parts, "slice"])
    return joined.withColumn("rank", F.col("inside") + F.col("offset")).drop("inside", "offset")


def shards(
    documents: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: `doc_id, size, text_crc32, source, law, shard, slot, grown_shard`.

    Rows of a source are shuffled by a seeded digest; the row of rank r among n gets the fraction (2r - 1) / 2n. Rows
    are ordered by fraction and cut into `n_shards` runs whose counts differ by at most one (law `rows`), so every
    shard has nearly the whole's share of each source. `slot` counts from 0 in the order of the run. `size` is the
    text's bytes plus 1.

    A null text has no bytes, the checksum of an empty one; a null source is a source of its own. Repeated rows
    each get a place; ties between equal rows may fall either way, which leaves the result the same. `grown_shard` is
    null: adding a shard under this law moves rows between all shards.
    """
    source, text = F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        source.alias("source"),
        F.col(source_col).isNull().alias("no_source"),
        shuffle_key(seed, id_col, text_col).alias("key"),
    )
    digits = len(f"{SLICES - 1:x}")
    strata = ["source", "no_source"]
    rows = stored(rows.withColumn("slice", F.conv(F.substring("key", 1, digits), 16, 10).cast("int") % SLICES), "shard-rows")
    ranked = _ranked(rows, strata, [F.col("key"), F.col("doc_id")])
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("total")).cast("double")
    placed = ranked.withColumn("fraction", fraction).withColumn("slice", F.floor(F.col("fraction") * SLICES).cast("int"))
    placed = stored(placed.drop("rank", "total"), "shard-fractions")
    order = [F.col("fraction"), F.col("source"), F.col("no_source"), F.col("key"), F.col("doc_id")]
    cut = _ranked(placed, [], order).withColumn("shard", F.expr(f"rank * {n_shards} div total"))
    # the first rank of shard s is the least p with p * n_shards div total = s
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return cut.select(
        "doc_id",
        "size",
        "text_crc32",
        F.when(~F.col("no_source"), F.col("source")).alias("source"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
