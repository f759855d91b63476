"""Quality classifier by positive-unlabelled learning: trusted positives against unlabelled web text.

The risk of a scorer g with class share p is  p R_P(+) + max(0, R_U(-) - p R_P(-)): the positives' loss as positives,
and the unlabelled texts' loss as negatives less what the positives among them cause, which is never let below zero.
Only positive labels are used. The share of positives among the unlabelled texts is estimated from the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.llm import samples, words
from offerlens.llm.tables import ready

THRESHOLD = 0.7
#: Unlabelled texts of the bounded sample; the positives are bounded by `samples.ROWS`.
UNLABELLED = 6000
HIDDEN = 24
STEPS = 800
BATCH = 500
RATE = 0.01
SEED = 5
#: The share of positives that a score threshold of the share estimate must leave above it.
LEAST_POSITIVES = 0.8

_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?.,;:"
FEATURES = (
    "log_words", "log_bytes", "word_bytes", "symbols", "symbol_words", "upper", "upper_words", "digits", "marks", "exclamations", "pipes",
    "word_types", "shingle_types", "same_next", "top_word", "line_words", "same_lines", "links", "non_ascii", "other_controls",
)


def features(texts) -> np.ndarray:
    """One row of `FEATURES` per whole text; an empty text has zeros."""
    plain = [t.encode() if t is not None else b"" for t in texts]
    hashed = words.hash_words([p.translate(words.SPACED) for p in plain])
    triples = words.runs(hashed, 3)
    out = np.zeros((len(plain), len(FEATURES)))
    for i, data in enumerate(plain):
        own = hashed.of(i)
        if not len(own):
            continue
        raw = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        n, size = len(own), len(data)
        kinds, times = np.unique(own, return_counts=True)
        threes = triples.of(i)
        lines = [x for x in data.split(b"\n") if x.strip()]
        split = data.split()
        upper = int(raw[65:91].sum())
        letters = upper + int(raw[97:123].sum())
        symbol_words = sum(w.translate(None, _SYMBOLS) != w for w in split) if raw[list(_SYMBOLS)].any() else 0
        upper_words = sum(w.isupper() for w in split) if upper else 0
        out[i] = (
            np.log1p(n), np.log1p(size), size / n, raw[list(_SYMBOLS)].sum() / size, symbol_words / n, upper / max(letters, 1), upper_words / n,
            raw[48:58].sum() / size, raw[list(_MARKS)].sum() / n, raw[33] / n, raw[124] / n,
            len(kinds) / n, len(np.unique(threes)) / max(len(threes), 1), np.count_nonzero(own[1:] == own[:-1]) / n, times.max() / n,
            np.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), data.count(b"http") / n, raw[128:].sum() / size,
            (raw[:9].sum() + raw[11:32].sum()) / size,
        )
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    share: float

    def _logits(self, rows: np.ndarray) -> np.ndarray:
        hidden = np.tanh(_ones(np.clip((rows - self.mean) / self.spread, -8, 8)) @ self.inner)
        return _ones(hidden) @ self.outer

    def scores(self, texts) -> np.ndarray:
        """The probability of high quality of each whole text."""
        if not len(texts):
            return np.empty(0)
        return _sigmoid(self._logits(features(texts)))


def _ones(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.ones((len(rows), 1))], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Adam:
    def __init__(self, *values):
        self.values, self.step = values, 0
        self.first, self.second = ([np.zeros_like(v) for v in values] for _ in range(2))

    def down(self, slopes, sign: float = 1.0) -> None:
        self.step += 1
        for v, g, a, b in zip(self.values, slopes, self.first, self.second):
            g = sign * g + 1e-4 * v
            a[:] = 0.9 * a + 0.1 * g
            b[:] = 0.999 * b + 0.001 * g**2
            v -= RATE * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + 1e-8)


def _fit(positive: np.ndarray, unlabelled: np.ndarray, share: float | None, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two-layer weights of the non-negative risk, or of plain positives against unlabelled if `share` is None."""
    inner = rng.normal(0, 0.3, (positive.shape[1] + 1, HIDDEN))
    outer = rng.normal(0, 0.3, HIDDEN + 1)
    adam = _Adam(inner, outer)
    for _ in range(STEPS):
        p = positive[rng.integers(0, len(positive), BATCH)]
        u = unlabelled[rng.integers(0, len(unlabelled), BATCH)]
        rows = _ones(np.concatenate([p, u]))
        hidden = np.tanh(rows @ inner)
        logits = _ones(hidden) @ outer
        chance = _sigmoid(logits)
        # slopes of softplus(-z) for a positive and softplus(z) for a negative
        as_positive, as_negative = (chance - 1) / BATCH, chance / BATCH
        slope, sign = np.zeros(2 * BATCH), 1.0
        if share is None:
            slope[:BATCH], slope[BATCH:] = as_positive[:BATCH], as_negative[BATCH:]
        else:
            loss = np.logaddexp(0, logits)
            rest = loss[BATCH:].mean() - share * loss[:BATCH].mean()
            negative = np.concatenate([-share * as_negative[:BATCH], as_negative[BATCH:]])
            if rest >= 0:
                slope = negative
                slope[:BATCH] += share * as_positive[:BATCH]
            else:  # the negative part has gone below zero: climb out of it
                slope, sign = negative, -1.0
        back = np.outer(slope, outer[:-1]) * (1 - hidden**2)
        adam.down((rows.T @ back, _ones(hidden).T @ slope), sign)
    return inner, outer


def _share(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the two shares above a threshold.

    Above any threshold the unlabelled hold at least share * (positives above it), so each ratio bounds the share
    from above; thresholds that leave few positives are not used, as their ratios are noise.
    """
    cuts = np.quantile(positive, np.linspace(0.01, 1 - LEAST_POSITIVES, 20))
    ratios = [(unlabelled >= c).mean() / (positive >= c).mean() for c in cuts]
    return float(np.clip(min(ratios), 0.02, 0.98))


def train(positive: list[str], unlabelled: list[str]) -> Model:
    """Estimate the share with a plain classifier on half of both samples, then minimise the non-negative risk."""
    size = len(FEATURES)
    if not positive or not unlabelled:
        return Model(np.zeros(size), np.ones(size), np.zeros((size + 1, HIDDEN)), np.zeros(HIDDEN + 1), 0.5)
    rng = np.random.default_rng(SEED)
    p, u = features(positive), features(unlabelled)
    mean, spread = u.mean(axis=0), u.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / spread, -8, 8) for x in (p, u))
    if len(p) > 1 and len(u) > 1:
        inner, outer = _fit(p[::2], u[::2], None, rng)
        scored = [_ones(np.tanh(_ones(x[1::2]) @ inner)) @ outer for x in (p, u)]
        share = _share(*scored)
    else:
        share = 0.5
    return Model(mean, spread, *_fit(p, u, share, rng), share)


def fitted(documents: DataFrame, labels: DataFrame, column: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of bounded samples outside the held-out fold: positives, and texts whose label is not looked at."""
    texts, answers, _ = samples.labelled(documents, labels.where(F.col(column) == 1), column, id_col, text_col)
    return train([t for t, a in zip(texts, answers) if a == 1], samples.any_texts(documents, UNLABELLED, id_col, text_col))


def quality_scores(
    documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: `doc_id, held_out, score, predicted`.

    Trusted positives are rows labelled 1 whose crc32(doc_id) modulo 4 is not 2; labels 0 are never read. Unlabelled
    texts are a bounded sample of documents of the same folds, whatever their label. Scores come from 20 counts of the whole
    text through one hidden layer, trained on the non-negative unbiased risk.

    Null and empty texts score as a text with all counts zero. Without positives or documents every score is 0.5.
    Repeated rows score alike; a null id is not held out.
    """
    ready(documents)
    shared = documents.sparkSession.sparkContext.broadcast(fitted(documents, labels, "quality", id_col, text_col))

    @F.pandas_udf(T.DoubleType())
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(list(text)), dtype=float)

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = source.select("doc_id", samples.held_out("doc_id").alias("held_out"), run("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
