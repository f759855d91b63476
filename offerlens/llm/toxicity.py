"""Toxicity: character n-gram embeddings averaged over a text into a linear softmax, trained together in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.llm import samples
from offerlens.llm.tables import give_back, ready

THRESHOLD = 0.3
BITS = 18
DIMENSIONS = 8
GRAMS = (2, 3, 4, 5)
EPOCHS = 10
BATCH = 200
RATE = 0.1
#: Share of a text's n-grams that a training step leaves out, so that every n-gram of a word learns its part.
DROPPED = 0.5
DECAY = 2e-6
SEED = 7
#: Neutral n-grams added to every text, so that the few n-grams of a short text do not decide alone.
NEUTRAL = 300
#: Texts of one pass of the n-gram arrays, in characters; a longer text goes in pieces cut at spaces.
PIECE = 1 << 18

_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)


def _grams(line: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, bucket) of every character n-gram of a line of words with one space before, between and after.

    A word's n-grams may hold the space before or after it, never one inside: they mark its ends.
    """
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    space, codes = chars == 32, chars * _SCRAMBLE
    starts, buckets = [], []
    power, total = np.uint64(1), np.zeros(len(codes), np.uint64)
    inner = np.zeros(len(codes), np.bool_)
    for n in range(1, max(GRAMS) + 1):
        length = len(codes) - n + 1
        if length <= 0:
            break
        if n > 2:
            inner = inner[:length] | space[n - 2 : n - 2 + length]
        total = total[:length] + codes[n - 1 :] * power
        power *= _NEXT
        if n in GRAMS:
            at = np.flatnonzero(~inner[:length])
            hashed = (total[at] + np.uint64(n)) * _FINAL
            hashed ^= hashed >> np.uint64(29)
            starts.append(at)
            buckets.append(((hashed * _SCRAMBLE) >> np.uint64(64 - BITS)).astype(np.int32))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    return np.concatenate(starts), np.concatenate(buckets)


def _line(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _pieces(line: str):
    """A long line in pieces that end at a space."""
    at = 0
    while len(line) - at > PIECE:
        cut = line.find(" ", at + PIECE)
        if cut < 0:
            break
        yield line[at:cut]
        at = cut + 1
    yield line[at:]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the share of its n-grams that each has."""
    parts = []
    with np.errstate(over="ignore"):
        for piece in _pieces(_line(text)):
            parts.append(_grams(f" {piece} ")[1])
    buckets, n = np.unique(np.concatenate(parts), return_counts=True)
    return buckets, (n / (n.sum() + NEUTRAL)).astype(np.float32)


@dataclass
class Model:
    """`weights[bucket]` is its embedding's part of the log odds; `bias` has the class shares in it."""

    weights: np.ndarray
    bias: float

    def scores(self, texts) -> np.ndarray:
        """The probability of label 1 of each whole text."""
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)

        def add(own: list[int], lines: list[str]) -> None:
            ends = np.cumsum([len(x) + 1 for x in lines])
            starts, buckets = _grams(f" {' '.join(lines)} ")
            # the n-gram that starts with the space before a line belongs to that line
            text = np.searchsorted(ends, starts, side="right")
            text = np.minimum(text, len(lines) - 1)
            np.add.at(counts, own, np.bincount(text, minlength=len(lines)))
            np.add.at(sums, own, np.bincount(text, self.weights[buckets], minlength=len(lines)))

        with np.errstate(over="ignore"):
            own, lines, size = [], [], 0
            for i, text in enumerate(texts):
                for piece in _pieces(_line(text)):
                    if size + len(piece) > PIECE and lines:
                        add(own, lines)
                        own, lines, size = [], [], 0
                    if piece:
                        own.append(i)
                        lines.append(piece)
                        size += len(piece) + 1
            if lines:
                add(own, lines)
        return 1 / (1 + np.exp(-np.clip(sums / (counts + NEUTRAL) + self.bias, -60, 60)))


def _packed(texts: list[str], at_once: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features of the texts as slices of a few large arrays: thousands of small ones would leave the process's
    memory in pieces that are not given back after training."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(texts), at_once):
        own = [features(t) for t in texts[start : start + at_once]]
        ids, shares = (np.concatenate(column) for column in zip(*own))
        ends = np.cumsum([len(x) for x, _ in own])
        rows += [(ids[e - len(x) : e], shares[e - len(x) : e]) for e, (x, _) in zip(ends, own)]
    return rows


def train(texts: list[str], labels: list[int], share: float) -> Model:
    """Fit embeddings and softmax together by mini-batch Adam on balanced classes, then shift to the real share."""
    prior = float(np.log(share / (1 - share)))
    answers = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), prior)
    rng = np.random.default_rng(SEED)
    rows = _packed(texts)
    embedding = (rng.random((1 << BITS, DIMENSIONS), dtype=np.float32) - 0.5) / DIMENSIONS
    softmax = (rng.random((DIMENSIONS + 1, 2), dtype=np.float32) - 0.5) / DIMENSIONS
    weight = np.where(answers == 1, 0.5 / max((answers == 1).sum(), 1), 0.5 / max((answers == 0).sum(), 1)) * len(answers)
    state = [np.zeros_like(embedding), np.zeros_like(embedding), np.zeros_like(softmax), np.zeros_like(softmax)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            ids = np.concatenate([rows[i][0] for i in chosen])
            kept = rng.random(len(ids)) >= DROPPED
            ids = ids[kept]
            shares = np.concatenate([rows[i][1] for i in chosen])[kept] / (1 - DROPPED)
            text = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])[kept]
            used, local = np.unique(ids, return_inverse=True)
            vectors = embedding[used]
            mean = np.stack([np.bincount(text, shares * vectors[local, d], minlength=len(chosen)) for d in range(DIMENSIONS)], axis=1)
            hidden = np.concatenate([mean, np.ones((len(chosen), 1))], axis=1)
            logits = hidden @ softmax
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), answers[chosen]] -= 1
            error *= weight[chosen][:, None] / len(chosen)
            back = error @ softmax[:-1].T
            slope = np.stack([np.bincount(local, shares * back[text, d], minlength=len(used)) for d in range(DIMENSIONS)], axis=1)
            slope += DECAY * vectors
            step += 1
            _adam(embedding, used, slope, state[0], state[1], step)
            _adam(softmax, slice(None), hidden.T @ error, state[2], state[3], step)
    contrast = (softmax[:, 1] - softmax[:, 0]).astype(np.float64)
    return Model((embedding @ contrast[:-1]).astype(np.float32), float(contrast[-1]) + prior)


def _adam(values, at, slope, first, second, step: int) -> None:
    first[at] = 0.9 * first[at] + 0.1 * slope
    second[at] = 0.99 * second[at] + 0.01 * slope**2
    values[at] -= RATE * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.99**step)) + 1e-8)


def _trainer(share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, labels = [], []
        for batch in batches:
            texts += batch["text"].tolist()
            labels += batch["label"].tolist()
        model = train(texts, labels, share)
        give_back()
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    return run


def fitted(documents: DataFrame, labels: DataFrame, column: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a bounded sample of labelled rows (`samples.ROWS` of a class) outside the held-out fold.

    It is trained in a task: the driver gets the weights (1 MB) and neither texts nor features.
    """
    rows, share = samples.labelled_rows(documents, labels, column, id_col, text_col)
    # the order decides which rows share a mini-batch
    ordered = rows.repartition(1).sortWithinPartitions("id").select("text", F.col("label").cast("int").alias("label"))
    found = ordered.mapInPandas(_trainer(share), "weights binary, bias double").collect()
    if not found:  # without rows there may be no task
        return train([], [], share)
    return Model(np.frombuffer(found[0].weights, np.float32), found[0].bias)


def _scorer(documents: DataFrame, model: Model):
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input

    @F.pandas_udf(T.DoubleType())
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(list(text)))

    return run


def toxicity(
    documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: `doc_id, held_out, score, predicted`.

    Words are what lies between white space, lower-cased; a text is the average of the embeddings of its character
    n-grams of `GRAMS`, word ends included, and `NEUTRAL` zero vectors, so misspelled words share most of their
    vectors with the known ones. Labels are learned from rows whose crc32(doc_id) modulo 4 is not 2, a bounded
    sample of them; every whole text is scored from the text alone.

    Null and empty texts score what an empty text scores. Without labels of both classes all rows score the share
    of toxic labels ((ones + 1) / (rows + 2)). Repeated rows score alike; a null id is not held out.
    """
    ready(documents)
    scorer = _scorer(documents, fitted(documents, labels, "toxic", id_col, text_col))
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = source.select("doc_id", samples.held_out("doc_id").alias("held_out"), scorer("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    ready(documents)
    scorer = _scorer(documents, fitted(documents, labels, "toxic", id_col, text_col))
    return documents.where(scorer(F.col(text_col)) < threshold)
