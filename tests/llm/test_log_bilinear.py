"""The log-bilinear model: counts and scores by brute force, its gradients, what it learns, odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from offerlens.llm import log_bilinear as lm

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def _plain(rows):
    """Base scores of (doc_id, text) rows."""
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = collections.Counter(w for (_, text), held in zip(rows, out) if not held for w in _words(text))
    total, distinct = sum(counts.values()), len(counts)
    base = lambda text: sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in _words(text))
    return [(i, held, len(_words(t)), sum(counts[w] > 0 for w in _words(t)), total, round(base(t), 6)) for (i, t), held in zip(rows, out)]


def _got(frame):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.log_probabilities(frame).collect()]


@pytest.mark.parametrize("known", [1 << 18, 300])
def test_base_scores(spark, monkeypatch, known):
    """Also with a vocabulary that is mostly joined instead of sent to the tasks."""
    monkeypatch.setattr(lm, "KNOWN", known)
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(_got(documents)) == sorted(_plain(rows))


def test_known_words_change_no_score(spark, monkeypatch):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3, "doc_id")
    whole = {r.doc_id: r.score for r in lm.log_probabilities(documents).collect()}
    monkeypatch.setattr(lm, "KNOWN", 1500)
    few = {r.doc_id: r.score for r in lm.log_probabilities(documents).collect()}
    assert whole.keys() == few.keys() and all(math.isclose(whole[i], few[i], rel_tol=1e-5) for i in whole)


def test_score_is_the_models_log_probability(spark):
    """Every class and share of a small corpus, one softmax at a time; what is left of each context goes to unseen words."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).select(_as_text("doc_id"), "text")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    lm.ready(documents)
    frame = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    _, vocabulary, model = lm.fitted(frame)
    assert len(vocabulary.words) == vocabulary.distinct
    own = lm.tokens([t for _, t in rows])
    at = vocabulary.found(own.words)
    classes = vocabulary.classes_of(own, at)
    n = {int(w): int(c) for w, c in zip(vocabulary.words, vocabulary.n)}
    want = []
    for i in range(len(rows)):
        span, total = range(own.offsets[i], own.offsets[i + 1]), 0.0
        for t in span:
            q = np.zeros(lm.WIDTH)
            for j in range(lm.CONTEXT):
                before = classes[t - 1 - j] if t - 1 - j >= span.start else lm.CLASSES
                q += model.read[before].astype(float) * model.places[j]
            logits = model.out.astype(float) @ q + model.bias
            total += logits[classes[t]] - math.log(np.exp(logits).sum())
            if classes[t] > lm.FREQUENT:
                held = vocabulary.class_n[classes[t]] + vocabulary.class_words[classes[t]] + 1
                total += math.log((n.get(int(own.words[t]), 0) + 1) / held)
        want.append(total / math.log(10))
    inside = [w for w in range(lm.CLASSES) if w > lm.FREQUENT]
    for c in inside[:20]:
        members = vocabulary.n[vocabulary.classes == c]
        assert (members + 1).sum() + 1 == vocabulary.class_n[c] + vocabulary.class_words[c] + 1
    got = {r.doc_id: r.score for r in lm.log_probabilities(frame).collect()}
    assert all(math.isclose(got[int(i)], w, rel_tol=1e-4) for (i, _), w in zip(rows, want))


def _as_text(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("string").alias(name)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    model = lm.Model.fresh(rng.normal(0, 2, lm.CLASSES))
    near = rng.integers(0, lm.CLASSES + 1, (lm.CONTEXT, 1)).repeat(lm.CLASSES, axis=1)
    assert abs(np.exp(model.log_probabilities(near, np.arange(lm.CLASSES))).sum() - 1) < 1e-4
    model.bias += 200  # beyond the range of a float's exponential
    assert abs(np.exp(model.log_probabilities(near, np.arange(lm.CLASSES))).sum() - 1) < 1e-4


def test_steps_follow_the_gradient_of_the_contrast():
    """One step from the same start against numeric derivatives of the loss over the batch."""
    rng = np.random.default_rng(2)
    shares = np.log(rng.dirichlet(np.ones(lm.CLASSES)))
    model = lm.Model.fresh(shares)
    near, targets = rng.integers(0, lm.CLASSES + 1, (lm.CONTEXT, 40)).astype(np.int16), rng.integers(0, lm.CLASSES, 40).astype(np.int16)
    trainer = lm.Trainer(model, shares, 7)
    noise = np.minimum(np.searchsorted(trainer.bounds, np.random.default_rng(7).random(lm.NOISE)), lm.CLASSES - 1)

    def loss(flat):
        m = lm.Model(*(v.reshape(x.shape) for v, x in zip(np.split(flat, np.cumsum([x.size for x in model.parts()])[:-1]), model.parts())))
        q = sum(m.read[near[j]] * m.places[j] for j in range(lm.CONTEXT))
        hit = (q * m.out[targets]).sum(axis=1) + m.bias[targets] - shares[targets] - math.log(lm.NOISE)
        miss = q @ m.out[noise].T + m.bias[noise] - shares[noise] - math.log(lm.NOISE)
        return (np.log1p(np.exp(-hit)).sum() + np.log1p(np.exp(miss)).sum()) / len(targets)

    trainer.learn(near, targets)
    start, moved = model.flat().astype(float), trainer.model.flat().astype(float)
    spent = np.concatenate([x.ravel() for x in trainer.spent]).astype(float) - 1e-2
    for at in [*rng.choice(np.flatnonzero(spent > 1e-9), 40, replace=False), *rng.choice(np.flatnonzero(abs(spent) < 1e-9), 10)]:
        up, down = start.copy(), start.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        slope = (loss(up) - loss(down)) / 2e-4
        assert abs((start - moved)[at] - lm.RATE * slope / math.sqrt(1e-2 + slope * slope)) < 2e-3


def test_beats_the_base_on_held_out_texts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8, "doc_id")
    rows = lm.log_probabilities(documents).where("held_out").selectExpr("sum(score)", "sum(base_score)", "sum(n_tokens)").first()
    assert (rows[0] - rows[1]) / rows[2] > 0.1  # a tenth of a decade a token


def test_odd_rows(spark):
    rng = random.Random(1)
    long = " ".join(f"Word{rng.randrange(9000)}" for _ in range(60_000))
    rows = [(1, "The cat sat"), (1, "The cat sat"), (2, None), (3, ""), (4, " \n\t\x0b"), (5, long), (None, "the CAT"), (None, None), (7, "É x\x1fy \x85")]
    rows += [(2**62 + i, f"cat {i}") for i in range(40)]
    schema = "doc_id long, text string, row long, word string, times int, n int, ending int"
    frame = spark.createDataFrame([(*r, 1, "w", 2, 3, 4) for r in rows], schema)
    assert sorted(_got(frame), key=repr) == sorted(_plain(rows), key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in lm.log_probabilities(frame).collect())
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2]
    assert held and all(r.train_tokens == 0 == r.base_score for r in lm.log_probabilities(spark.createDataFrame([(*r, 1, "w", 2, 3, 4) for r in held], schema)).collect())
    assert lm.log_probabilities(spark.createDataFrame([], schema)).count() == 0
