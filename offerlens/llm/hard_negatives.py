"""Hard negatives by exact integer inner products, scored with subset-sum tables (the method of the Four Russians).

Components are whole numbers. A candidate is kept as bit planes: byte `g` of plane `b` holds bit `b` of its
components 8g to 8g + 7, the highest plane being the sign of two's complement. For an anchor the sums of all 256
subsets of each eight components are computed once; the inner product with a candidate is then, from the sign plane
down, "shift by one, add the table entries that the plane's bytes name". Every score is exact.

Rows with a component too large for that ("wide" ones) are scored by products of whole numbers, in Python's own if
64 bits don't hold them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.tables import ready, stored

SCALE = 256
#: Components of this size or more aren't kept as bit planes: scores could leave 64 bits.
LARGEST = 1 << 27
#: Rows and anchors of one cell of the grid; what a task holds at once.
ROW_BLOCK = 16_384
ANCHOR_BLOCK = 2_048
#: Anchors scored together: their tables stay in the processor's cache.
TOGETHER = 128
#: Rows scored together.
CHUNK = 1_024
N_POSITIVES = 5
N_NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
LEAST, MOST = 50, 95


@dataclass(frozen=True)
class Shape:
    """Sizes that hold for the whole table: components, their largest absolute value, bits of one with its sign."""

    dims: int
    largest: int
    bits: int
    #: Bits of the largest component of a wide row, 0 if there is none.
    wide: int = 0

    @property
    def score_bits(self) -> int:
        """No score is 1 << score_bits or more in size."""
        return 2 * max(self.wide, self.bits) + self.dims.bit_length()

    @property
    def far(self) -> bool:
        """Whether scores may leave 64 bits."""
        return self.wide > 0 and self.score_bits > 62

    @property
    def groups(self) -> int:
        return max(1, -(-self.dims // 8))

    def sums(self) -> np.dtype:
        """A type that holds any sum over one plane."""
        most = 8 * self.groups * self.largest
        return np.dtype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)

    def scores(self) -> np.dtype:
        return np.dtype(np.int32 if 16 * self.groups * self.largest << self.bits < 1 << 31 else np.int64)


def components(vectors, shape: Shape) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros up to whole groups of eight."""
    found = np.zeros((len(vectors), 8 * shape.groups), np.int64)
    for i, own in enumerate(vectors):
        found[i, : len(own)] = own
    return found


def planes(values: np.ndarray, shape: Shape) -> np.ndarray:
    """(rows, bits, groups) bytes."""
    found = np.empty((len(values), shape.bits, shape.groups), np.uint8)
    for bit in range(shape.bits):
        found[:, bit] = np.packbits((values >> bit & 1).astype(np.uint8), axis=1, bitorder="little")
    return found


def tables(anchors: np.ndarray, shape: Shape) -> np.ndarray:
    """(groups, 256, anchors): sums of every subset of each eight components, each from the one without its highest bit."""
    found = np.zeros((shape.groups, 256, len(anchors)), shape.sums())
    for group in range(shape.groups):
        for bit in range(8):
            found[group, 1 << bit : 2 << bit] = found[group, : 1 << bit] + anchors[:, 8 * group + bit].astype(found.dtype)
    return found


def scores(packed: np.ndarray, subset_sums: np.ndarray, shape: Shape) -> np.ndarray:
    """(rows, anchors) inner products."""
    n, width = len(packed), subset_sums.shape[2]
    found = np.zeros((n, width), shape.scores())
    plane, taken = np.empty((2, min(n, CHUNK), width), subset_sums.dtype)
    for start in range(0, n, CHUNK):
        out = found[start : start + CHUNK]
        sums, entry = plane[: len(out)], taken[: len(out)]
        bytes_of = np.ascontiguousarray(packed[start : start + CHUNK].transpose(1, 2, 0))
        for bit in reversed(range(shape.bits)):
            np.take(subset_sums[0], bytes_of[bit, 0], axis=0, out=sums, mode="clip")
            for group in range(1, shape.groups):
                np.take(subset_sums[group], bytes_of[bit, group], axis=0, out=entry, mode="clip")
                sums += entry
            out <<= 1
            if bit == shape.bits - 1:
                out -= sums
            else:
                out += sums
    return found


def _unpacked(packed: np.ndarray, shape: Shape) -> np.ndarray:
    """The components that the planes hold."""
    found = np.zeros((len(packed), 8 * shape.groups), np.int64)
    for bit in range(shape.bits):
        plane = np.unpackbits(packed[:, bit], axis=1, bitorder="little").astype(np.int64) << bit
        found += -plane if bit == shape.bits - 1 else plane
    return found


def _whole(value: float) -> int:
    """floor(SCALE * value), exact also where the product is no double any more."""
    return int(value) * SCALE if abs(value) >= 1 << 53 else math.floor(value * SCALE)


def _with_wide(small: np.ndarray, wide, kind) -> np.ndarray:
    """Components of rows of both kinds, those of the wide ones filled in."""
    found = small.astype(kind)
    for i, own in enumerate(wide):
        if own is not None:
            found[i, : len(own)] = [_whole(x) for x in own.tolist()]
    return found


def _wide_scores(found: np.ndarray, packed: np.ndarray, chosen: pd.DataFrame, some: pd.DataFrame, shape: Shape) -> np.ndarray:
    """The scores with those of wide rows and wide anchors put in."""
    rows, anchors = (np.flatnonzero(side["wide"].notna().to_numpy()) for side in (chosen, some))
    kind = object if shape.far else np.int64
    found = found.astype(kind)
    if not len(rows) and not len(anchors):
        return found
    right = _with_wide(components(some["components"], shape), some["wide"], kind)
    if len(rows):
        found[rows] = _with_wide(_unpacked(packed[rows], shape), chosen["wide"].iloc[rows], kind) @ right.T
    if len(anchors):
        found[:, anchors] = _with_wide(_unpacked(packed, shape), chosen["wide"], kind) @ right[anchors].T
    return found


def _columns(score: np.ndarray, shape: Shape) -> dict:
    """Scores as columns: in 64 bits, null where they don't fit, and as strings in their order where some may not fit."""
    if not shape.far:
        return {"score": score, "far": None}
    digits, shift = shape.score_bits // 4 + 2, 1 << shape.score_bits
    return {
        "score": pd.array([int(x) if -(1 << 63) <= x < 1 << 63 else None for x in score], dtype="Int64"),
        "far": [f"{int(x) + shift:0{digits}x}" for x in score],
    }


_ROW = "row long, id long, no_id boolean, label int, wide array<double>, planes binary"


def _packed(shape: Shape):
    def run(batches):
        for batch in batches:
            bits = planes(components(batch["components"], shape), shape)
            yield batch[["row", "id", "no_id", "label", "wide"]].assign(planes=[own.tobytes() for own in bits])

    return run


def _blocks(rows: pd.DataFrame, anchors: pd.DataFrame, shape: Shape, same: bool):
    """(anchors, rows, scores) of anchors with one label and the rows of the same, or of the other labels.

    Rows come in the order of their ids, those without one last.
    """
    rows = rows.sort_values(["no_id", "id", "row"], ignore_index=True)
    packed = np.frombuffer(b"".join(rows["planes"]), np.uint8).reshape(len(rows), shape.bits, shape.groups)
    own = rows["label"].to_numpy()
    for label, members in anchors.groupby("label"):
        place = np.flatnonzero((own == label) == same)
        if not len(place):
            continue
        taken, chosen = packed[place], rows.iloc[place].reset_index(drop=True)
        for start in range(0, len(members), TOGETHER):
            some = members.iloc[start : start + TOGETHER].reset_index(drop=True)
            found = scores(taken, tables(components(some["components"], shape), shape), shape)
            yield some, chosen, _wide_scores(found, taken, chosen, some, shape) if shape.wide else found


def _listed(some: pd.DataFrame, chosen: pd.DataFrame, found: np.ndarray, least: np.ndarray):
    """Flat (anchor, row, score) of the scores from `least` on, by anchor, then highest score, then row."""
    row, anchor = np.nonzero((found >= least).astype(bool))
    score = found[row, anchor]
    if found.dtype != object:
        score = score.astype(np.int64)
    order = np.lexsort((row, -score, anchor))
    return anchor[order], row[order], score[order]


def _limits(found: np.ndarray, shape: Shape) -> tuple[int, int]:
    """Bounds of the scores, which their type holds."""
    if found.dtype == object:
        return -(1 << shape.score_bits), 1 << shape.score_bits
    limits = np.iinfo(found.dtype)
    return limits.min, limits.max


def _reach(found: np.ndarray, k: int, least: int) -> np.ndarray:
    """A bound that at least k scores of each column reach, if there are k: the k-th of the maxima of stretches."""
    cuts = np.arange(0, len(found), 64)
    if len(cuts) < k:
        return np.full(found.shape[1], least, found.dtype)
    most = np.maximum.reduceat(found, cuts, axis=0)
    return np.partition(most, len(cuts) - k, axis=0)[len(cuts) - k]


_POSITIVE = "anchor_row long, row long, id long, no_id boolean, score long, far string"


def _positives(shape: Shape):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for some, chosen, found in _blocks(rows, anchors, shape, same=True):
            # one more than asked for, as the anchor itself may be among them
            anchor, row, score = _listed(some, chosen, found, _reach(found, N_POSITIVES + 1, _limits(found, shape)[0]))
            other = some["row"].to_numpy()[anchor] != chosen["row"].to_numpy()[row]
            anchor, row, score = anchor[other], row[other], score[other]
            rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
            anchor, row, score = (x[rank < N_POSITIVES] for x in (anchor, row, score))
            parts.append(chosen.iloc[row][["row", "id", "no_id"]].assign(anchor_row=some["row"].to_numpy()[anchor], **_columns(score, shape)))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["anchor_row", "row", "id", "no_id", "score", "far"])

    return run


_NEGATIVE = "anchor_row long, place int, row long, id long, no_id boolean, score long, far string"


def _share(percent: int, score: np.ndarray) -> np.ndarray:
    """percent * score / 100, rounded down; the product itself might leave 64 bits."""
    return score // 100 * percent + score % 100 * percent // 100


def _window(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest negative score that go with a positive score."""
    return -_share(LEAST, -score), _share(MOST, score)


def _given(some: pd.DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Positive scores by anchor and place, and whether there is one."""
    given, has = np.zeros((len(some), N_POSITIVES), object if shape.far else np.int64), np.zeros((len(some), N_POSITIVES), bool)
    for i, own in enumerate(some["positive_far" if shape.far else "positive_scores"]):
        given[i, : len(own)] = [int(x, 16) - (1 << shape.score_bits) for x in own] if shape.far else own
        has[i, : len(own)] = True
    return given, has


def _negatives(shape: Shape):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for some, chosen, found in _blocks(rows, anchors, shape, same=False):
            given, has = _given(some, shape)
            least, most = _window(given)
            open_ = has & (least <= most).astype(bool)
            if not open_.any():
                continue
            # below the lowest ceiling of an anchor, only the best few rows can be chosen
            low, high = _limits(found, shape)
            ceiling = np.clip(np.where(open_, most, high).min(axis=1), low, high).astype(found.dtype)
            floor = np.clip(np.where(open_, least, high).min(axis=1), low, high).astype(found.dtype)
            bound = np.maximum(_reach(np.where((found <= ceiling).astype(bool), found, low), N_NEGATIVES, low), floor)
            anchor, row, score = _listed(some, chosen, found, bound)
            starts = np.searchsorted(anchor, np.arange(len(some) + 1))
            for a, place in np.argwhere(open_):
                own = score[starts[a] : starts[a + 1]]
                first = np.searchsorted(-own, -most[a, place])
                kept = slice(starts[a] + first, min(starts[a] + first + N_NEGATIVES, starts[a + 1]))  # not into the next anchor's
                good = (score[kept] >= least[a, place]).astype(bool)
                if good.any():
                    near = chosen.iloc[row[kept][good]][["row", "id", "no_id"]]
                    parts.append(near.assign(anchor_row=some["row"][a], place=place + 1, **_columns(score[kept][good], shape)))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["anchor_row", "place", "row", "id", "no_id", "score", "far"])

    return run


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Both sides dealt over a grid of row blocks and anchor blocks; each side is copied along the other's blocks."""
    row_blocks, anchor_blocks = -(-n_rows // ROW_BLOCK), -(-n_anchors // ANCHOR_BLOCK)

    def block(n: int):
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    left = rows.select("*", block(row_blocks).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("a"))
    right = anchors.select("*", block(anchor_blocks).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("r"))
    return left.groupBy("r", "a").cogroup(right.groupBy("r", "a"))


def hard_negatives(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, moved: int = 7, labels: int = 10
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`, in longs but for the int rank.

    Components become floor(256 x). Where the id is divisible by `moved` the label becomes (label + 1) % `labels`.
    Anchors are the rows whose id is divisible by `every`; the positives of one are its best five other rows of its
    label, and each positive gets the best three rows of other labels whose score is 50 to 95 percent of the
    positive's. Equal scores are ordered by the smaller id, and rows of equal ids in any order, which the result
    doesn't show.

    Rows and anchors are dealt over a grid of blocks of bounded size, so a common label or vector is no task's own.
    The first pass scores rows of the anchor's label, the second all others: no pair is scored twice. A cell returns
    the best few per anchor, and these few are merged. The number of pairs is anchors times rows; no pair is left out.

    Rows with a null label, a null vector or a component that is null or not finite take no part. Scores are exact
    whatever the size of the components; one that doesn't fit its column, a long, is returned as null. A shorter vector counts as filled with zeros, an empty one scores 0. A row without an id is no anchor, keeps
    its label, comes after all ids and is returned with a null id. Repeated rows are rows of their own: a repeated
    anchor returns its triples as often, each copy being a row of the same label to the other. An empty table, one
    without anchors, or anchors without positives or negatives give no rows. Other columns are not read.
    """
    key, vector, label = F.col(id_col).cast("long"), F.col(vector_col), F.col(label_col).cast("int")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    taken = ready(embeddings).where(label.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(key, F.lit(0)).alias("id"),
        key.isNull().alias("no_id"),
        F.when(key % moved == 0, (label + 1) % labels).otherwise(label).alias("label"),
        vector.cast("array<double>").alias("vector"),
    )
    taken = stored(taken, "vectors")
    is_anchor = ~F.col("no_id") & (F.col("id") % every == 0)
    size = F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))
    n_rows, n_anchors, dims, top = taken.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("vector")), F.max(size)).first()
    dims, top = dims or 0, top or 0.0
    limit = min(LARGEST, 1 << max(1, (62 - dims.bit_length()) // 2)) / SCALE
    is_wide, wide = size >= limit, 0
    if top >= limit:
        wide, top = _whole(top).bit_length() + 1, taken.agg(F.max(F.when(~is_wide, size))).first()[0] or 0.0
    largest = math.ceil(SCALE * top)
    shape = Shape(dims, largest, largest.bit_length() + 1, wide)
    whole = F.transform("vector", lambda x: F.floor(SCALE * x).cast("long"))
    taken = taken.select(
        "row", "id", "no_id", "label", F.when(~is_wide, whole).otherwise(F.array().cast("array<long>")).alias("components"), F.when(is_wide, F.col("vector")).alias("wide")
    )
    if not n_anchors:
        n_rows = n_anchors = 1  # a grid of one cell, which stays empty
    rows = stored(taken.mapInPandas(_packed(shape), _ROW), "planes")
    anchors = taken.where(is_anchor)

    def first(found: DataFrame, k: int, rank: str, *keys: str) -> DataFrame:
        best = Window.partitionBy(*keys).orderBy(F.desc("far"), F.desc("score"), "no_id", "id", "row")
        named = F.when(~F.col("no_id"), F.col("id"))
        return found.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= k).select(*keys, rank, named.alias("found_id"), "score", "far")

    positives = stored(first(_cells(rows, anchors, n_rows, n_anchors).applyInPandas(_positives(shape), _POSITIVE), N_POSITIVES, "place", "anchor_row"), "positives")
    listed = positives.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "score", "far"))).alias("p"))
    given = anchors.join(listed.select("row", F.col("p.score").alias("positive_scores"), F.col("p.far").alias("positive_far")), "row")
    negatives = first(_cells(rows, given, n_rows, n_anchors).applyInPandas(_negatives(shape), _NEGATIVE), N_NEGATIVES, "rank", "anchor_row", "place")
    pairs = positives.select("anchor_row", "place", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return (
        negatives.join(pairs, ["anchor_row", "place"])
        .join(named, "anchor_row")
        .select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
