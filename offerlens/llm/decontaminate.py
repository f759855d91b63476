"""Benchmark passages in documents: a prefix-filtered join of word shingles, confirmed on whole item windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm import words
from offerlens.llm.tables import ready, stored

WINDOW = 10
SHINGLE = 3
#: Bits of the bitmap that tells tasks which shingles to look up: 2 MB, whatever the size of the benchmark.
BITMAP_BITS = 1 << 24

_WINDOWS = "item_id string, words string, length int, shingles array<bigint>"
_HITS = "row_id long, id long, n_words long, found array<struct<at int, shingle long, context string>>"


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of each item with the shingle hashes of each: 3 words, or the whole of a shorter window."""
    for batch in batches:
        out = []
        for item, text in zip(batch["item_id"], words.encoded(batch["text"], words.ALNUM)):
            own = text.split()
            for at in range(max(len(own) - WINDOW + 1, 1) if own else 0):
                window = b" ".join(own[at : at + WINDOW])
                length = min(WINDOW, len(own))
                made = words.runs(words.hash_words([window]), min(SHINGLE, length)).values
                out.append((item, window.decode(), length, words.signed(made)))
        yield pd.DataFrame(out, columns=["item_id", "words", "length", "shingles"])


def _bit(shingles: np.ndarray) -> np.ndarray:
    return shingles & np.uint64(BITMAP_BITS - 1)


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """The set bits of the shingles, or-ed on the executors into at most BITMAP_BITS / 32 words."""
    cells = shingles.groupBy(F.expr(f"cast(shiftright(shingle & {BITMAP_BITS - 1}, 5) as int)").alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shingle & 31 as int))")).alias("bits")
    )
    found = cells.toPandas()
    bits = np.zeros(BITMAP_BITS // 32, np.uint32)
    bits[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return bits.view(np.uint8)


def _marked(hashed: words.Hashed, sizes: tuple[int, ...], bits: np.ndarray):
    """For each shingle size the (text, position, shingle) whose bit is set."""
    for k in sizes:
        made = words.runs(hashed, k)
        hit = np.flatnonzero(bits[_bit(made.values)])
        text = np.searchsorted(made.offsets, hit, side="right") - 1
        yield k, text, hit - made.offsets[text], made.values[hit]


def _counts(sizes, packed):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(packed.value, bitorder="little").view(np.bool_)
        for batch in batches:
            for _, _, _, shingles in _marked(words.hash_words(words.encoded(batch["text"], words.ALNUM)), sizes, bits):
                values, n = np.unique(shingles, return_counts=True)
                yield pd.DataFrame({"shingle": words.signed(values), "n": n})

    return run


def _lookups(sizes, packed):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(packed.value, bitorder="little").view(np.bool_)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = words.encoded(batch["text"], words.ALNUM)
            found = [[] for _ in texts]
            hashed = words.hash_words(texts)
            split: dict[int, list[bytes]] = {}
            for k, text, at, shingles in _marked(hashed, sizes, bits):
                for i, place, shingle in zip(text.tolist(), at.tolist(), words.signed(shingles).tolist()):
                    own = split[i] if i in split else split.setdefault(i, texts[i].split())
                    context = b" ".join(own[max(place - WINDOW + 1, 0) : place + WINDOW])
                    found[i].append({"at": place, "shingle": shingle, "context": context.decode()})
            yield pd.DataFrame(
                {"row_id": np.arange(row, row + len(texts)), "id": batch["id"].astype("Int64"), "n_words": hashed.counts(), "found": found}
            )
            row += len(texts)

    return run


def _covered(windows: Column) -> Column:
    """Words covered by sorted (start, length) windows."""
    zero = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end"))

    def step(state, window):
        end = window.start + window.length
        added = F.greatest(end - F.greatest(window.start, state.end), F.lit(0))
        return F.struct((state.words + added).alias("words"), F.greatest(state.end, end).alias("end"))

    return F.aggregate(F.array_sort(windows), zero, step, lambda state: state.words)


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document: `doc_id, n_words, n_hit, n_items, items, contaminated`.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lowered. A window is ten consecutive words of an
    item, or the whole of a shorter item; a document word inside any occurrence of a window is hit. `items` lists,
    sorted as strings, the ids of items with an occurring window.

    1. The shingles (three words) of all windows set bits of a bitmap of fixed size, which the tasks receive.
    2. Their frequencies over all documents give the rarity order. Containment of a whole window needs every one
       of its shingles, so its prefix is one shingle, the rarest.
    3. Documents give the positions whose shingle has a prefix bit; these join with the windows by shingle.
       The place of the shingle in the window bounds where the window would start and end in the document.
    4. The words around the position are compared with the whole window.

    Null and empty texts have no words and no hit. Repeated rows are each returned with their own counts. An item
    without an id marks words but is not listed; an item without words has no window. With an empty benchmark no
    word is hit, and words are counted all the same.
    """
    items = ready(benchmark).select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = source.sparkSession

    item_windows = stored(items.mapInPandas(_windows, _WINDOWS), "windows")
    distinct = item_windows.groupBy("words", "length").agg(F.first("shingles").alias("shingles"))
    places = stored(distinct.select("words", "length", F.posexplode("shingles").alias("offset", "shingle")), "places")
    sizes = tuple(sorted({min(SHINGLE, r.length) for r in places.select("length").distinct().collect()}))

    packed = spark.sparkContext.broadcast(_bitmap(places.select("shingle")))
    counts = source.select("text").mapInPandas(_counts(sizes, packed), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    ranked = places.join(counts, "shingle", "left").groupBy("words", "length").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    )
    # a window with a shingle that no document has cannot occur
    prefixes = stored(ranked.where("rarest.n > 0").select("words", "length", "rarest.shingle", "rarest.offset"), "prefixes")

    looked = spark.sparkContext.broadcast(_bitmap(prefixes.select("shingle")))
    rows = stored(source.mapInPandas(_lookups(sizes, looked), _HITS), "lookups")
    places = rows.select("row_id", "n_words", F.explode("found").alias("f")).select("row_id", "n_words", "f.*")
    start = F.col("at") - F.col("offset")
    candidates = places.join(prefixes, "shingle").where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    first = F.least("at", F.lit(WINDOW - 1)) - F.col("offset") + 1
    exact = F.array_join(F.slice(F.split("context", " "), first, F.col("length")), " ") == F.col("words")
    hits = stored(candidates.where(exact).select("row_id", "words", start.alias("start"), "length"), "hits")

    covered = hits.groupBy("row_id").agg(_covered(F.collect_set(F.struct("start", "length"))).alias("n_hit"))
    listed = item_windows.where("item_id is not null").select("item_id", "words").distinct()
    occurring = hits.select("row_id", "words").distinct().join(listed, "words").select("row_id", "item_id").distinct()
    named = occurring.groupBy("row_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    result = rows.select("row_id", "id", "n_words").join(covered, "row_id", "left").join(named, "row_id", "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return result.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), (n_hit > 0).alias("contaminated")
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without any benchmark passage, with their columns; each is judged by its own text."""
    keyed = documents.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = contamination(keyed, benchmark).where("contaminated").select(F.col("doc_id").alias("__digest")).distinct()
    return documents.join(marked, F.xxhash64(text_col) == F.col("__digest"), "left_anti")
