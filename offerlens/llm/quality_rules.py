"""Quality rules: plain counts, and bands of zstandard ratios over whole texts and fixed chunks."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import words
from offerlens.llm.tables import ready, struct

LEVEL = 3
CHUNK = 4096
#: A text or chunk below this many bytes is too short for a ratio to say anything.
SHORTEST = 256
#: (bytes, lowest, highest): a ratio of compressed to plain bytes outside the band of its length rejects. Longer
#: texts repeat more of their own words, so both ends fall with the length.
BANDS = (
    (256, 0.22, 0.95),
    (1024, 0.20, 0.78),
    (4096, 0.17, 0.70),
    (16384, 0.14, 0.67),
    (65536, 0.12, 0.65),
)
#: The band of whole chunks, and the share of chunks outside it that rejects a text.
CHUNK_BAND = (0.20, 0.70)
CHUNK_SHARE = 0.5
_SYMBOLS = b"#*$%&|<>"
_WINDOW = 5

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, n_chunks long, n_chunks_repetitive long, n_chunks_incompressible long"
)


def _repeated_words(hashes: np.ndarray, n_words: int) -> int:
    """Words inside 5-word windows that occur twice or more; `hashes` has one value a window."""
    values, where, n = np.unique(hashes, return_inverse=True, return_counts=True)
    if len(values) == len(hashes):
        return 0
    starts = np.flatnonzero(n[where] > 1)
    steps = np.zeros(n_words + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + _WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(steps[:-1])))


def _duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen = Counter(line for line in data.split(b"\n") if line.split())
    return sum(seen.values()) - len(seen)


def _band(size: int) -> tuple[float, float]:
    return next(((low, high) for least, low, high in reversed(BANDS) if size >= least), (0.0, float("inf")))


def _chunks(data: bytes) -> list[bytes]:
    """Consecutive pieces of CHUNK bytes; a last piece below half of that goes with the one before."""
    cuts = list(range(0, max(len(data) - CHUNK // 2, 1), CHUNK)) + [len(data)]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _compression(data: bytes, compress) -> tuple[bool, float | None, int, int, int]:
    """Whether the bands pass; the whole ratio; chunks, and chunks below and above their band."""
    if len(data) < SHORTEST:
        return True, None, 0, 0, 0
    ratio = len(compress(data)) / len(data)
    low, high = _band(len(data))
    if len(data) <= CHUNK:
        return low <= ratio <= high, ratio, 0, 0, 0
    ratios = [len(compress(c)) / len(c) for c in _chunks(data)]
    below = sum(r < CHUNK_BAND[0] for r in ratios)
    above = sum(r > CHUNK_BAND[1] for r in ratios)
    return low <= ratio <= high and below + above < CHUNK_SHARE * len(ratios), ratio, len(ratios), below, above


@F.pandas_udf(struct(FIELDS))
def measured(text: pd.Series) -> pd.DataFrame:
    """The counts and the verdict of each text; null is a text without words."""
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    plain = [t.encode() if t is not None else b"" for t in text]
    hashed = words.hash_words([p.translate(_SEPARATED) for p in plain])
    windows, counts = words.runs(hashed, _WINDOW), hashed.counts()
    rows = []
    for i, data in enumerate(plain):
        n = int(counts[i])
        # code points are bytes that do not continue another
        chars = len(data.translate(None, _NO_POINT))
        symbols = sum(data.count(c) for c in _SYMBOLS)
        repeats = _repeated_words(windows.of(i), n)
        failed = n < 10 or 100 * repeats > 20 * n
        passed, *found = _compression(data, compress)
        rows.append((n, chars, symbols, _duplicate_lines(data), repeats, failed, passed and not failed, *found))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])


_WHITE = bytes([32, *range(9, 14)])
_SEPARATED = bytes(32 if b in _WHITE else b for b in range(256))
_NO_POINT = _WHITE + bytes(range(0x80, 0xC0))


def quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `doc_id`, the fields of `FIELDS`.

    Words are `[^\\x20\\x09-\\x0D]+`. `word_chars` are the code points in words, `n_symbols` the characters of
    `[#*$%&|<>]`, `n_dup_lines` the lines with a word equal to an earlier line, `n_repeat_words` the words inside
    5-word windows found twice or more. `base_failed`: under 10 words, or over 20 % repeated words. `kept` is false
    if the base failed, or if the zstandard ratio of the whole text lies outside the band of its length, or if half
    of its 4 KB chunks lie outside theirs: low ratios are repetitive text, high ones incompressible.

    Null and empty texts have no words, fail the base and have a null ratio; texts under 256 bytes have no ratio and
    pass the bands. Rows are independent: ties, repeated rows and null ids come back as they are, in any number.
    """
    source = ready(documents).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.select("doc_id", measured("text").alias("m")).select("doc_id", "m.*")


def passing(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns."""
    return ready(documents).where(measured(F.col(text_col))["kept"])
